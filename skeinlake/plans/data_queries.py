"""Queries of the general data problems: intervals, skewed keys, instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlake.operators import instants, intervals, skew
from skeinlake.session import table

#: A repository that holds at least this part of all rows is reported as hot.
HOT_SHARE = 0.04


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.interval_report(table(spark, d, "chain_groups"), table(spark, d, "chains"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    profile = skew.repo_profile(table(spark, d, "event_rows"), table(spark, d, "shards"))
    return profile.where((F.col("share") >= HOT_SHARE) & F.col("repo_key").isNotNull()).select("repo_key")


def p4_repo_profile(spark: SparkSession, d: str) -> DataFrame:
    profile = skew.repo_profile(table(spark, d, "event_rows"), table(spark, d, "shards"))
    return profile.withColumn("share", F.round("share", 9))


def p4_shard_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every event row with what its repository's shards say, through the balanced join."""
    rows = table(spark, d, "event_rows").select("row_no", "bank", "repo_key")
    shards = table(spark, d, "shards").groupBy("repo").agg(F.count(F.lit(1)).alias("n_shards"), F.min("shard_key").alias("first_shard"))
    joined = skew.balanced_join(rows, shards, "repo_key", "repo", ["row_no"])
    return joined.groupBy("bank", "first_shard", "n_shards").agg(F.count(F.lit(1)).alias("n_rows"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    banks = table(spark, d, "banks")
    events = instants.found_instants(table(spark, d, "event_rows"), ["ts", "sent_ts"], "row_no", "event_rows", banks)
    files = instants.found_instants(table(spark, d, "parsed_files"), ["started_at"], "file_no", "parsed_files", banks)
    return events.unionByName(files)


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_repo_profile, p4_shard_rows, p5_found)}

def _zones_sql(years: range = range(2024, 2028)) -> str:
    """The zone database as rows (tz, from_local, off) for SQL, which has no rule of
    its own for wall-clock times that occur twice or never."""
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    rows = []
    for tz in ("Asia/Bangkok", "Europe/Berlin", "America/New_York", "UTC", "Australia/Sydney", "Asia/Kolkata"):
        at = datetime(years[0], 1, 1, tzinfo=timezone.utc)
        off = at.astimezone(ZoneInfo(tz)).utcoffset()
        rows.append((tz, "1900-01-01 00:00:00", off))
        while at.year < years[-1]:
            at += timedelta(minutes=30)
            if (now := at.astimezone(ZoneInfo(tz)).utcoffset()) != off:
                rows.append((tz, f"{at + max(now, off):%Y-%m-%d %H:%M:%S}", now))
                off = now
    return ", ".join(f"('{tz}', TIMESTAMP '{wall}', {int(off.total_seconds())})" for tz, wall, off in rows)


_ABBREVIATIONS = ", ".join(f"('{k}', {m * 60})" for k, m in instants.ABBREVIATIONS.items())
_P5 = f"""
WITH zone(tz, wall, off) AS (VALUES {_zones_sql()}), abbr(a, off) AS (VALUES {_ABBREVIATIONS}),
v AS (SELECT 'event_rows' AS tab, row_no AS id, bank, unnest(['ts', 'sent_ts']) AS field, unnest([ts, sent_ts]) AS raw FROM event_rows
  UNION ALL SELECT 'parsed_files', file_no, bank, 'started_at', started_at FROM parsed_files),
o AS (SELECT v.*, lower(trim(raw)) AS x, b.tz FROM v LEFT JOIN banks b USING (bank) WHERE raw IS NOT NULL AND NOT regexp_full_match(raw, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d\\.\\d{{3}}Z')),
p AS (SELECT *, CASE
   WHEN regexp_matches(x, '^\\d{{4}}-\\d\\d-\\d\\d[t ]\\d\\d:\\d\\d') THEN regexp_extract(x, '^(\\d{{4}}-\\d\\d-\\d\\d)', 1)
   WHEN regexp_matches(x, '^[a-z]{{3}}, \\d\\d [a-z]{{3}} \\d{{4}} ') THEN x[13:16] || '-' || lpad(((instr('janfebmaraprmayjunjulaugsepoctnovdec', x[9:11]) + 2) // 3)::VARCHAR, 2, '0') || '-' || x[6:7]
   WHEN regexp_matches(x, '^\\d\\d\\.\\d\\d\\.\\d{{4}} ') THEN x[7:10] || '-' || x[4:5] || '-' || x[1:2]
   WHEN regexp_matches(x, '^\\d\\d/\\d\\d/\\d{{4}} .* [ap]m') THEN x[7:10] || '-' || x[1:2] || '-' || x[4:5]
   WHEN regexp_matches(x, '^\\d\\d/\\d\\d/\\d{{4}} ') THEN (x[7:10]::INT - CASE WHEN x[7:10]::INT >= 2400 THEN 543 ELSE 0 END)::VARCHAR || '-' || x[4:5] || '-' || x[1:2] END AS day,
  regexp_extract(x, '(\\d\\d):(\\d\\d)', 0) AS hm, coalesce(try_cast(nullif(regexp_extract(x, '\\d\\d:\\d\\d:(\\d\\d)', 1), '') AS INT), 0) AS sec,
  rpad(regexp_extract(x, ':\\d\\d[.,](\\d{{1,6}})', 1), 6, '0')::BIGINT AS micro, regexp_extract(x, ' ([ap]m)\\b', 1) AS half,
  regexp_extract(regexp_replace(x, '^\\d{{4}}-\\d\\d-\\d\\d', ''), '\\d([+-])(\\d\\d):?(\\d\\d)|([+-])(\\d\\d)(\\d\\d)$', 0) AS plus,
  regexp_extract(regexp_replace(x, '\\b[ap]m\\b', ''), '\\d *([a-z]{{1,4}})$', 1) AS short, regexp_extract(raw, ' ([A-Z][a-z]+/[A-Z][A-Za-z_]+)\\s*$', 1) AS named FROM o),
d AS (SELECT *, try_cast(day AS DATE) AS dd, hm[1:2]::INT AS h0, hm[4:5]::INT AS mi FROM p WHERE day IS NOT NULL),
w AS (SELECT *, CASE half WHEN 'am' THEN h0 % 12 WHEN 'pm' THEN h0 % 12 + 12 ELSE h0 END AS hh FROM d WHERE dd IS NOT NULL AND year(dd) >= 1),
t AS (SELECT *, dd::TIMESTAMP + to_hours(hh) + to_minutes(mi) + to_seconds(sec) AS wall, CASE WHEN named <> '' THEN named ELSE tz END AS zone_name FROM w),
z AS (SELECT t.*, zone.off AS zone_off FROM t ASOF LEFT JOIN zone ON t.zone_name = zone.tz AND t.wall >= zone.wall),
f AS (SELECT z.*, CASE WHEN plus <> '' THEN (CASE WHEN contains(plus, '-') THEN -1 ELSE 1 END) * (regexp_extract(plus, '[+-](\\d\\d)', 1)::INT * 3600 + regexp_extract(plus, '(\\d\\d)$', 1)::INT * 60) WHEN short <> '' THEN a.off ELSE zone_off END AS off FROM z LEFT JOIN abbr a ON z.short = a.a)
SELECT tab, id, field, epoch_us(wall) - off::BIGINT * 1000000 + micro AS epoch_us FROM f WHERE off IS NOT NULL
UNION ALL SELECT tab, id, field, CASE WHEN contains(x, '.') THEN split_part(x, '.', 1)::BIGINT * 1000000 + rpad(split_part(x, '.', 2), 6, '0')[1:6]::BIGINT
  WHEN length(x) = 10 THEN x::BIGINT * 1000000 WHEN length(x) = 13 THEN x::BIGINT * 1000 ELSE x::BIGINT END FROM o WHERE regexp_full_match(x, '\\d{{10}}(\\.\\d+)?|\\d{{13}}|\\d{{16}}')
"""

SQL = {
    "p5_found": _P5,
    "p1_found": """
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY loaded_at DESC NULLS LAST, start_ms DESC, end_ms DESC) AS rn FROM chain_groups) WHERE rn = 1),
counted AS (
  SELECT chain_id, start_ms AS s, greatest(start_ms, coalesce(end_ms, start_ms)) AS e FROM latest WHERE start_ms IS NOT NULL AND start_ms <> 0),
flagged AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chain_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM counted),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY chain_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
periods AS (SELECT chain_id, min(s) AS start_ms, max(e) AS end_ms, sum(e - s) AS work FROM numbered GROUP BY chain_id, island),
ahead AS (SELECT chain_id, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY chain_id ORDER BY start_ms) AS end_ms FROM periods),
totals AS (SELECT chain_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, sum(work) AS work FROM periods GROUP BY chain_id)
SELECT chain_id, 'period' AS kind, start_ms, end_ms FROM periods
UNION ALL SELECT chain_id, 'gap', start_ms, end_ms FROM ahead WHERE end_ms IS NOT NULL
UNION ALL SELECT t.chain_id, 'wall', t.start_ms, t.end_ms FROM totals t JOIN chains c USING (chain_id) WHERE c.wall_ms IS DISTINCT FROM t.end_ms - t.start_ms
UNION ALL SELECT t.chain_id, 'work', t.start_ms, t.end_ms FROM totals t JOIN chains c USING (chain_id) WHERE c.work_ms IS DISTINCT FROM t.work
""",
    "p4_found": """
SELECT repo_key FROM event_rows WHERE repo_key IS NOT NULL GROUP BY repo_key
HAVING count(*) >= 0.04 * (SELECT count(*) FROM event_rows)
""",
    "p4_repo_profile": """
WITH listed AS (SELECT repo, count(*) AS n_shards FROM shards GROUP BY repo)
SELECT e.repo_key, count(*) AS n_rows, sum(length(text)) AS chars, count(DISTINCT session_uuid) AS sessions, any_value(n_shards) AS n_shards,
       round(count(*) / (SELECT count(*) FROM event_rows), 9) AS share
FROM event_rows e LEFT JOIN listed l ON e.repo_key IS NOT DISTINCT FROM l.repo GROUP BY e.repo_key
""",
    "p4_shard_rows": """
WITH s AS (SELECT repo, count(*) AS n_shards, min(shard_key) AS first_shard FROM shards GROUP BY repo)
SELECT bank, first_shard, n_shards, count(*) AS n_rows FROM event_rows e LEFT JOIN s ON e.repo_key IS NOT DISTINCT FROM s.repo
GROUP BY bank, first_shard, n_shards
""",
}
