"""Queries of the engine's own operators over the domain tables, with SQL beside them.

Rounded floats are rounded on both sides; ties are broken by ids on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from skeinlake.functions import text as T
from skeinlake.operators import mutations as M, reports as Q, sessions as S
from skeinlake.operators.filters import Scope, main_tiers, overlaps, sample
from skeinlake.search import ranking as R
from skeinlake.session import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- filters ------------------------------------------------------------------

_MAIN = "((coalesce(kind,'')='transcript' AND tier='session') OR coalesce(kind,'') IN ('note','message') OR (coalesce(kind,'')='' AND tier IN ('session','note')))"


@query(f"SELECT row_no FROM event_rows WHERE bank='mill' AND contains(repo_key,'wicket-io') AND {_MAIN} AND role IN ('user','assistant') AND ts >= '2025-06-01T00:00:00.000Z' AND ts <= '2025-12-31T23:59:59.999Z'")
def filter_scope(spark: SparkSession, d: str) -> DataFrame:
    scope = Scope(bank="mill", repo="wicket-io", prose=True, since="2025-06-01", until="2025-12-31")
    return scope.apply(table(spark, d, "event_rows")).select("row_no")


@query(f"SELECT row_no FROM event_rows WHERE {_MAIN} AND contains(lower(via),'tide') AND contains(lower(from_user),'a_')")
def filter_facets(spark: SparkSession, d: str) -> DataFrame:
    return Scope(via="TIDE", from_user="a_").apply(table(spark, d, "event_rows")).select("row_no")


@query("SELECT tier, kind, count(*) AS n FROM event_rows WHERE tier='subagent' AND org='kilnworks' AND starts_with(worktree, 'wt/') GROUP BY 1, 2")
def filter_tier_org(spark: SparkSession, d: str) -> DataFrame:
    rows = Scope(tier="subagent", org="kilnworks").apply(table(spark, d, "event_rows"))
    return rows.where(F.col("worktree").startswith("wt/")).groupBy("tier", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT file_no FROM parsed_files WHERE ((coalesce(ended_at,'')<>'' AND ended_at >= '2025-05-01T00:00:00.000Z') OR (coalesce(ended_at,'')='' AND started_at >= '2025-05-01T00:00:00.000Z')) AND started_at <= '2025-05-20T23:59:59.999Z'")
def filter_overlap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_files").where(overlaps("2025-05-01T00:00:00.000Z", "2025-05-20T23:59:59.999Z")).select("file_no")


@query("SELECT row_no FROM event_rows WHERE uid < '1000'")
def filter_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_rows").where(sample(F.col("uid"), 16)).select("row_no")


@query("SELECT file_no FROM parsed_files WHERE (starts_with(session_uuid,'a') OR contains(file_path,'/a1')) AND NOT ends_with(file_path,'/journal.jsonl')")
def filter_find_id(spark: SparkSession, d: str) -> DataFrame:
    found = F.col("session_uuid").startswith("a") | F.col("file_path").contains("/a1")
    return table(spark, d, "parsed_files").where(found & ~F.col("file_path").endswith("/journal.jsonl")).select("file_no")


@query("SELECT file_no FROM parsed_files WHERE tier='session' AND (contains(lower(coalesce(title,'')),'batch') OR contains(lower(coalesce(description,'')),'batch'))")
def filter_find_name(spark: SparkSession, d: str) -> DataFrame:
    has = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains("batch")
    return table(spark, d, "parsed_files").where((F.col("tier") == "session") & (has("title") | has("description"))).select("file_no")


@query(f"SELECT source, count(*) AS n, sum(least(length(text),2000)) AS chars FROM event_rows WHERE {_MAIN} AND role IN ('user','assistant') AND length(text) >= 24 GROUP BY source")
def filter_embeddable(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "event_rows").where(main_tiers() & F.col("role").isin("user", "assistant") & (F.char_length("text") >= 24))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least(F.char_length("text"), F.lit(2000))).cast("decimal(38,0)").cast("long").alias("chars"))


@query("SELECT row_no FROM event_rows WHERE role='user' AND contains(text,'<channel') AND coalesce(via,'')=''")
def filter_unfaceted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_rows").where((F.col("role") == "user") & F.col("text").contains("<channel") & (F.coalesce("via", F.lit("")) == "")).select("row_no")


@query("SELECT row_no FROM event_rows WHERE tier='memory' AND mem_type IN ('project','feedback')")
def filter_memories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_rows").where((F.col("tier") == "memory") & F.col("mem_type").isin("project", "feedback")).select("row_no")


# ---- projections --------------------------------------------------------------


@query("SELECT row_no, sha1(source || chr(31) || file_path || chr(31) || seq::VARCHAR) AS uid2 FROM event_rows WHERE source IS NOT NULL AND file_path IS NOT NULL AND seq IS NOT NULL")
def project_uid(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "event_rows").where("source IS NOT NULL AND file_path IS NOT NULL AND seq IS NOT NULL")
    return rows.select("row_no", T.uid_of(F.col("source"), F.col("file_path"), F.col("seq")).alias("uid2"))


@query("""WITH p AS (SELECT file_no, string_split(file_path,'/') AS a FROM parsed_files)
SELECT file_no, CASE WHEN len(a)>=5 AND a[-3]='workflows' AND a[-4]='subagents' THEN array_to_string(a[-5:],'/')
 WHEN len(a)>=3 AND a[-2]='subagents' THEN array_to_string(a[-3:],'/') ELSE a[-1] END AS tree_key FROM p""")
def project_tree_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_files").select("file_no", T.tree_key_of(F.col("file_path")).alias("tree_key"))


@query("SELECT source, tier, CASE WHEN starts_with(source,'hermes') THEN 'message' WHEN tier IN ('note','memory') THEN tier ELSE 'transcript' END AS derived, kind, count(*) AS n FROM event_rows GROUP BY ALL")
def project_kind(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "event_rows").select("source", "tier", T.kind_of(F.col("tier"), F.col("source")).alias("derived"), "kind")
    return rows.groupBy("source", "tier", "derived", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH t AS (SELECT row_no, regexp_extract(text, '^\s*<channel(?:\s)([^>]*)(?:>|$)', 1) AS a FROM event_rows WHERE role='user')
SELECT row_no, regexp_extract(a,'(?:^|[^\w-])source="([^"]*)"',1) AS via2, regexp_extract(a,'(?:^|[^\w-])chat_id="([^"]*)"',1) AS chat_id2,
 regexp_extract(a,'(?:^|[^\w-])message_id="([^"]*)"',1) AS msg_id2, regexp_extract(a,'(?:^|[^\w-])user="([^"]*)"',1) AS from_user2,
 regexp_extract(a,'(?:^|[^\w-])user_id="([^"]*)"',1) AS from_user_id2, regexp_extract(a,'(?:^|[^\w-])ts="([^"]*)"',1) AS sent_ts2
FROM t WHERE regexp_extract(a,'(?:^|[^\w-])source="([^"]*)"',1) <> ''""")
def project_channel(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "event_rows").where(F.col("role") == "user").select("row_no", T.channel_facets(F.col("text")).alias("f")).where("f IS NOT NULL")
    return rows.select("row_no", *[F.col(f"f.{c}").alias(f"{c}2") for c in ("via", "chat_id", "msg_id", "from_user", "from_user_id", "sent_ts")])


@query("SELECT via, regexp_replace(via, '^plugin:[^:]*:(.+)$', '\\1') AS label, count(*) AS n FROM event_rows WHERE via <> '' GROUP BY ALL")
def project_via_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_rows").where("via <> ''").groupBy("via", T.via_label(F.col("via")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT cwd, regexp_extract(cwd,'(?:^|/)(code\\.tarn\\.example|forge\\.example|git\\.northlab\\.test)/([^/]+)/([^/]+)',1) || '/' || regexp_extract(cwd,'(?:^|/)(code\\.tarn\\.example|forge\\.example|git\\.northlab\\.test)/([^/]+)/([^/]+)',2) || '/' || regexp_extract(cwd,'(?:^|/)(code\\.tarn\\.example|forge\\.example|git\\.northlab\\.test)/([^/]+)/([^/]+)',3) AS key, count(*) AS n FROM parsed_files WHERE regexp_matches(cwd,'(?:^|/)(code\\.tarn\\.example|forge\\.example|git\\.northlab\\.test)/([^/]+)/([^/]+)') GROUP BY ALL")
def project_repo_key(spark: SparkSession, d: str) -> DataFrame:
    key = T.repo_key_of(F.col("cwd"), ["code.tarn.example", "forge.example", "git.northlab.test"])
    return table(spark, d, "parsed_files").groupBy("cwd", key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("key IS NOT NULL")


@query("SELECT file_no, CASE WHEN regexp_extract(file_path,'[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}',0)<>'' THEN lower(regexp_extract(file_path,'[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}',0)) ELSE regexp_replace(string_split(file_path,'/')[-1],'\\.[^.]*$','') END AS sid FROM parsed_files")
def project_session_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_files").select("file_no", T.session_id_of_path(F.col("file_path")).alias("sid"))


@query("SELECT file_no, translate(cwd,'/.','--') AS dir FROM parsed_files WHERE cwd IS NOT NULL")
def project_encoded_dir(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_files").where("cwd IS NOT NULL").select("file_no", T.encode_project_dir(F.col("cwd")).alias("dir"))


@query(r"""SELECT row_no, CASE WHEN role IN ('user','assistant','thinking','system') THEN ''
 WHEN regexp_matches(text,'^\[tool_use (Edit|Write|MultiEdit|NotebookEdit)\]') THEN 'edit-payload' WHEN regexp_matches(text,'^\[tool_use (Read|Glob|LS|Grep|TodoWrite)\]') THEN 'navigation-call'
 WHEN regexp_matches(text,'[^ \t-\r]{120,}') AND regexp_matches(text,'[A-Za-z0-9+/]{120,}={0,2}') THEN 'binary-blob' ELSE '' END AS rule FROM event_rows WHERE length(text) <= 500""")
def project_noise(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "event_rows")).where(F.char_length("text") <= 500).select("row_no", T.noise_rule(F.col("text"), F.col("role")).alias("rule"))


# All rules, over any role and length of text.
_RULE = """CASE WHEN role IN ('user','assistant','thinking','system') THEN ''
 WHEN role='tool_result' AND length(text)>500 AND len(list_filter(range(1, len(nums)-1), lambda i: nums[i+1]=nums[i]+1 AND nums[i+2]=nums[i]+2))>0 THEN 'file-readback'
 WHEN regexp_matches(text,'^\\[tool_use (EDIT)\\]') THEN 'edit-payload' WHEN regexp_matches(text,'^\\[tool_use (NAVIGATION)\\]') THEN 'navigation-call'
 WHEN regexp_matches(text,'[^ \\t-\\r]{120,}') AND (BLOBS) THEN 'binary-blob'
 WHEN regexp_matches(text,'^\\[tool_result\\]\\s*(<system-reminder>|\\{"total_tokens")') THEN 'harness-bookkeeping' ELSE '' END""".replace(
    "EDIT", T.EDIT_TOOLS).replace("NAVIGATION", T.NAVIGATION_TOOLS).replace("BLOBS", " OR ".join(f"regexp_matches(text,'{x}')" for x in T.BLOB_SHAPES))
_RULED = f"""WITH s AS (SELECT row_no, text, role, CASE WHEN role='tool_result' AND length(text)>500 THEN regexp_extract_all(text, '(?:^|\\n|\\s)(\\d{{1,5}})(?:→|\\t| )', 1)[1:401]::INT[] ELSE []::INT[] END AS nums FROM event_rows),
r AS (SELECT row_no, octet_length(encode(text)) AS b, {_RULE} AS rule FROM s)"""


@query(_RULED + " SELECT row_no, rule FROM r")
def project_noise_all(spark: SparkSession, d: str) -> DataFrame:
    """project_noise over texts of any length; a row without text is no noise."""
    return spread(table(spark, d, "event_rows")).select("row_no", T.noise_rule(F.col("text"), F.col("role")).alias("rule"))


_S = T.SCRIPT_RANGES
_COUNT = ", ".join(f"length(regexp_replace(text,'[^{r}]','','g')) AS {s}" for s, r in _S.items())


@query(f"""WITH c AS (SELECT lower(trim(source)) AS src, {_COUNT} FROM documents WHERE text IS NOT NULL)
SELECT src, {', '.join(f'sum({s})::BIGINT AS {s}' for s in _S)} FROM c GROUP BY src""")
def script_totals(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents")).where("text IS NOT NULL")
    return docs.groupBy(F.lower(F.trim("source")).alias("src")).agg(*[F.sum(T.script_letters(F.col("text"), s)).alias(s) for s in T.SCRIPT_RANGES])


_WORDS = ",".join("'" + w.replace("'", "''") + "'" for w in T.ENGLISH_WORDS)
_ALL = "".join(_S.values())
_CLASS = f"""WITH c AS (SELECT *, {_COUNT}, length(regexp_replace(text, '[^\\p{{L}}]|[{_ALL}]|[\\x{{10000}}-\\x{{10FFFF}}]','','g')) AS other,
  regexp_extract_all(lower(text), '[a-z]{{2,}}(?:''[a-z]+)?') AS w FROM SOURCE WHERE text IS NOT NULL),
t AS (SELECT *, thai+latin+cjk+hangul+cyrillic+arabic+indic+sea+other AS total, greatest(latin,cjk,hangul,cyrillic,arabic,indic,sea,other) AS most, len(list_filter(w, lambda x: x IN ({_WORDS}))) AS hits, len(w) AS nw FROM c)
SELECT ID, CASE WHEN total=0 THEN 'none' WHEN thai*2>=total THEN 'th' WHEN thai*10>=total THEN 'th+en' WHEN most*2<total THEN 'other'
 WHEN latin=most THEN CASE WHEN (nw<=8 AND hits>=1) OR (nw>8 AND hits>=2 AND hits/nw>=0.08) THEN 'en' ELSE 'latin' END
 WHEN cjk=most THEN 'zh/ja' WHEN hangul=most THEN 'ko' WHEN cyrillic=most THEN 'cyrillic' WHEN arabic=most THEN 'arabic' WHEN indic=most THEN 'indic' WHEN sea=most THEN 'lo/km/my' ELSE 'other' END AS class FROM t"""


@query(_CLASS.replace("SOURCE", "documents").replace("ID", "doc_id"))
def language_classes(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).where("text IS NOT NULL").select("doc_id", T.language_class(F.col("text")).alias("class"))


@query(f"WITH x AS ({_CLASS.replace('SOURCE', 'event_rows').replace('ID', 'bank, text')}) SELECT bank, class, count(*) AS n_events, sum(length(text))::BIGINT AS chars FROM x GROUP BY ALL")
def language_mix(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "event_rows")).where("text IS NOT NULL").select("bank", "text", T.language_class(F.col("text")).alias("class"))
    return rows.groupBy("bank", "class").agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.char_length("text")).alias("chars"))


# ---- aggregates and rollups ---------------------------------------------------


@query("""WITH r AS (SELECT *, coalesce(nullif(session_uuid,''), file_path) AS conversation, row_number() OVER (PARTITION BY bank, repo_key, coalesce(nullif(session_uuid,''), file_path) ORDER BY (tier<>'session'), coalesce(started_at,''), file_path, file_no) AS rn FROM parsed_files)
SELECT bank, repo_key, conversation, max(CASE WHEN rn=1 THEN file_path END) AS parent_path, max(CASE WHEN rn=1 THEN tier END) AS parent_tier, max(CASE WHEN rn=1 THEN coalesce(started_at,'') END) AS started_at,
 count(*)-1 AS children, sum(lines)::BIGINT AS tree_lines FROM r GROUP BY bank, repo_key, conversation""")
def group_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return S.group_transcripts(table(spark, d, "parsed_files")).withColumn("started_at", F.coalesce("started_at", F.lit("")))


@query("""WITH g AS (SELECT bank, repo_key, coalesce(nullif(session_uuid,''), file_path) AS c, min(started_at) AS s, sum(lines)::BIGINT AS l FROM parsed_files WHERE tier IN ('session','subagent','workflow_agent') GROUP BY ALL)
SELECT c, s, l FROM g ORDER BY s DESC NULLS LAST, c LIMIT 40""")
def sessions_newest(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "parsed_files").where(F.col("tier").isin("session", "subagent", "workflow_agent"))
    grouped = files.groupBy("bank", "repo_key", F.coalesce(S.nonempty("session_uuid"), F.col("file_path")).alias("c")).agg(F.min("started_at").alias("s"), F.sum("lines").alias("l"))
    return R.top(grouped.select("c", "s", "l"), 40, [F.desc_nulls_last("s"), F.col("c")])


@query("SELECT source, tier, count(*) AS n_files, sum(lines)::BIGINT AS n_lines, count(DISTINCT nullif(workflow_run_id,'')) AS n_runs, min(nullif(started_at,'')) AS first_start, max(nullif(ended_at,'')) AS last_end FROM parsed_files GROUP BY ALL")
def session_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.tree_stats(table(spark, d, "parsed_files"), ["source", "tier"])


@query("SELECT bank, repo_key, (2 - grouping(bank) - grouping(repo_key))::INT AS level, count(*) AS n_rows, count(DISTINCT session_uuid) AS n_sessions FROM event_rows GROUP BY ROLLUP (bank, repo_key)")
def bank_repo_rollup(spark: SparkSession, d: str) -> DataFrame:
    return S.bank_rollup(table(spark, d, "event_rows"), {"n_rows": F.count(F.lit(1)), "n_sessions": F.count_distinct("session_uuid")})


@query("SELECT bank, count(*) AS n_files, epoch_us(max(loaded_at)) AS last_loaded, max(started_at) AS newest FROM parsed_files GROUP BY bank")
def status_freshness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_files").groupBy("bank").agg(F.count(F.lit(1)).alias("n_files"), F.unix_micros(F.max("loaded_at")).alias("last_loaded"), F.max("started_at").alias("newest"))


@query("""WITH c AS (SELECT chat_id, from_user AS v, count(*) AS n, min(row_no) AS first_at FROM event_rows WHERE from_user <> '' GROUP BY ALL)
SELECT chat_id, string_agg(v, ',' ORDER BY n DESC, first_at, v) AS people FROM c GROUP BY chat_id""")
def rooms_people(spark: SparkSession, d: str) -> DataFrame:
    return S.ranked_values(table(spark, d, "event_rows"), ["chat_id"], "from_user", "row_no", "people")


@query("""WITH f AS (SELECT bank, count(*) AS n FROM event_rows GROUP BY bank) SELECT bank, n, row_number() OVER (ORDER BY n DESC, bank)::INT AS rank FROM f""")
def banks_ranked(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "event_rows").groupBy("bank").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "bank")))  # one row a bank


@query("SELECT type_key AS kind, sum(n)::BIGINT AS n FROM (SELECT unnest(['user','assistant','attachment']) AS type_key, unnest([json_extract_string(type_counts,'$.user')::INT, json_extract_string(type_counts,'$.assistant')::INT, json_extract_string(type_counts,'$.attachment')::INT]) AS n FROM parsed_files WHERE type_counts IS NOT NULL) GROUP BY ALL")
def type_count_totals(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "parsed_files").select(F.explode(F.from_json("type_counts", "map<string,long>")).alias("kind", "n"))
    return counted.where(F.col("kind").isin("user", "assistant", "attachment")).groupBy("kind").agg(F.sum("n").alias("n"))


@query("""WITH p AS (SELECT list_filter(string_split(file_path,'/'), lambda x: x<>'') AS a, lines FROM parsed_files), e AS (SELECT '/' || array_to_string(a[1:i],'/') AS dir, lines FROM p, LATERAL (SELECT unnest(range(1, len(a))) AS i))
SELECT dir, count(*) AS n_files, sum(lines)::BIGINT AS weight FROM e GROUP BY dir""")
def tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    return S.path_rollup(table(spark, d, "parsed_files"), "file_path", F.col("lines"))


@query("WITH r AS (SELECT DISTINCT cwd FROM parsed_files WHERE cwd<>'') SELECT cwd FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE starts_with(a.cwd, b.cwd || '/'))")
def outermost_roots(spark: SparkSession, d: str) -> DataFrame:
    return S.outermost(table(spark, d, "parsed_files").where("cwd <> ''").select("cwd").distinct(), "cwd")


@query("SELECT lang, sum(n_events)::BIGINT AS n_events, sum(chars)::BIGINT AS chars, round(sum(chars)/(SELECT sum(chars) FROM langs_result),6) AS share FROM langs_result GROUP BY lang")
def recorded_languages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "langs_result")
    total = F.broadcast(rows.agg(F.sum("chars").alias("_t")))
    sums = rows.groupBy("lang").agg(F.sum("n_events").alias("n_events"), F.sum("chars").alias("chars"))
    return sums.crossJoin(total).select("lang", "n_events", "chars", F.round(F.col("chars") / F.col("_t"), 6).alias("share"))


# ---- joins --------------------------------------------------------------------


@query("""WITH s AS (SELECT DISTINCT session_uuid FROM parsed_files), m AS (SELECT row_no, mem_type, origin_session FROM event_rows WHERE tier='memory')
SELECT mem_type, CASE WHEN coalesce(origin_session,'')='' THEN 'none' WHEN s.session_uuid IS NULL THEN 'orphaned' ELSE 'joined' END AS state, count(*) AS n
FROM m LEFT JOIN s ON m.origin_session = s.session_uuid GROUP BY ALL""")
def memory_join(spark: SparkSession, d: str) -> DataFrame:
    memories = table(spark, d, "event_rows").where("tier = 'memory'").select("row_no", "mem_type", "origin_session")
    joined = S.memory_join(memories, table(spark, d, "parsed_files"), "origin_session", "session_uuid")
    return joined.groupBy("mem_type", "state").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH f AS (SELECT file_path, source, tier, max(lines) AS lines FROM parsed_files GROUP BY ALL), i AS (SELECT file_path, max(lines) AS lines FROM parsed_files WHERE source <> 'omp' AND lines < 15 GROUP BY ALL)
SELECT source, tier, CASE WHEN i.file_path IS NULL THEN 'missing' WHEN i.lines IS DISTINCT FROM f.lines THEN 'changed' ELSE 'indexed' END AS state, count(*) AS n FROM f LEFT JOIN i USING (file_path) GROUP BY ALL""")
def pending_diff(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "parsed_files")
    found = files.groupBy("file_path", "source", "tier").agg(F.max("lines").alias("lines"))
    index = files.where("source <> 'omp' AND lines < 15").groupBy("file_path").agg(F.max("lines").alias("lines"))
    return S.disk_diff(found, index, "file_path", ["lines"]).groupBy("source", "tier", "state").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH i AS (SELECT DISTINCT bank, file_path FROM parsed_files), f AS (SELECT DISTINCT file_path FROM event_rows), g AS (SELECT bank, count(*) AS drops FROM i ANTI JOIN f USING (file_path) GROUP BY bank)
SELECT bank, count(*) AS files, coalesce(max(drops),0) AS drops, round(coalesce(max(drops),0)/count(*),6) AS part FROM i LEFT JOIN g USING (bank) GROUP BY bank""")
def prune_plan(spark: SparkSession, d: str) -> DataFrame:
    return M.prune_plan(table(spark, d, "parsed_files").select("bank", "file_path").distinct(), table(spark, d, "event_rows").select("file_path"), "file_path", ["bank"])


@query("SELECT e.row_no FROM event_rows e WHERE length(text) >= 24 AND NOT EXISTS (SELECT 1 FROM lang_labels l WHERE l.row_no = e.row_no)")
def embed_backlog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_rows").where(F.char_length("text") >= 24).join(table(spark, d, "lang_labels"), "row_no", "left_anti").select("row_no")


@query("""WITH m AS (SELECT repo_key, count(*) AS memories FROM event_rows WHERE tier='memory' GROUP BY 1), t AS (SELECT repo_key, count(*) AS transcripts FROM parsed_files WHERE tier NOT IN ('note','memory') GROUP BY 1)
SELECT repo_key, memories, coalesce(transcripts,0) AS transcripts, round(memories/greatest(1,coalesce(transcripts,0)),6) AS density FROM m LEFT JOIN t USING (repo_key)""")
def memory_density(spark: SparkSession, d: str) -> DataFrame:
    memories = table(spark, d, "event_rows").where("tier = 'memory'").groupBy("repo_key").agg(F.count(F.lit(1)).alias("memories"))
    files = table(spark, d, "parsed_files").where(~F.col("tier").isin("note", "memory")).groupBy("repo_key").agg(F.count(F.lit(1)).alias("transcripts"))
    joined = memories.join(files, "repo_key", "left").withColumn("transcripts", F.coalesce("transcripts", F.lit(0)))
    return joined.withColumn("density", F.round(F.col("memories") / F.greatest(F.lit(1), "transcripts"), 6))


_STARTS = "SELECT file_no, repo_key, (loaded_at) AS at FROM parsed_files WHERE tier='session' AND repo_key IS NOT NULL"


@query(f"""WITH f AS ({_STARTS}), t AS (SELECT * FROM f WHERE file_no % 7 = 0),
b AS (SELECT t.file_no, 'before' AS side, f.file_no AS neighbour, row_number() OVER (PARTITION BY t.file_no ORDER BY f.at DESC, f.file_no DESC)::INT AS rank FROM t JOIN f ON t.repo_key=f.repo_key AND f.at < t.at),
a AS (SELECT t.file_no, 'after' AS side, f.file_no AS neighbour, row_number() OVER (PARTITION BY t.file_no ORDER BY f.at, f.file_no)::INT AS rank FROM t JOIN f ON t.repo_key=f.repo_key AND f.at > t.at)
SELECT * FROM b WHERE rank<=3 UNION ALL SELECT * FROM a WHERE rank<=3""")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "parsed_files").where("tier = 'session' AND repo_key IS NOT NULL").select("file_no", "repo_key", F.col("loaded_at").alias("at"))
    return S.neighbours(files.where("file_no % 7 = 0"), files, ["repo_key"], "at", "file_no", 3)


@query(f"""WITH f AS ({_STARTS}), t AS (SELECT * FROM f),
b AS (SELECT t.file_no, 'before' AS side, f.file_no AS neighbour, row_number() OVER (PARTITION BY t.file_no ORDER BY f.at DESC, f.file_no DESC)::INT AS rank FROM t JOIN f ON t.repo_key=f.repo_key AND f.at < t.at),
a AS (SELECT t.file_no, 'after' AS side, f.file_no AS neighbour, row_number() OVER (PARTITION BY t.file_no ORDER BY f.at, f.file_no)::INT AS rank FROM t JOIN f ON t.repo_key=f.repo_key AND f.at > t.at)
SELECT * FROM b WHERE rank<=3 UNION ALL SELECT * FROM a WHERE rank<=3""")
def neighbours_all(spark: SparkSession, d: str) -> DataFrame:
    """neighbours of every session file."""
    files = table(spark, d, "parsed_files").where("tier = 'session' AND repo_key IS NOT NULL").select("file_no", "repo_key", F.col("loaded_at").alias("at"))
    return S.neighbours(files, files, ["repo_key"], "at", "file_no", 3)


@query("""SELECT c.c_mktsegment, count(DISTINCT c.c_custkey) AS customers, count(o.o_orderkey) AS urgent FROM customer c LEFT JOIN orders o ON c.c_custkey=o.o_custkey AND o.o_orderpriority='1-URGENT' GROUP BY 1""")
def join_left_residual(spark: SparkSession, d: str) -> DataFrame:
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    joined = customer.join(orders, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderpriority") == "1-URGENT"), "left")
    return joined.groupBy("c_mktsegment").agg(F.count_distinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("urgent"))


@query("SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, count(*) AS n, round(sum(l_extendedprice*(1-l_discount)),2) AS revenue FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey GROUP BY 1")
def join_inner_chain(spark: SparkSession, d: str) -> DataFrame:
    items, supplier, nation = (table(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    joined = items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# ---- windows ------------------------------------------------------------------

_GROUPS = "SELECT chain_id, run, start_ms, greatest(start_ms, coalesce(end_ms, start_ms)) AS end_ms FROM chain_groups WHERE start_ms IS NOT NULL"


@query(f"""WITH g AS ({_GROUPS}), e AS (SELECT chain_id, run, start_ms AS t, 1 AS d FROM g UNION ALL SELECT chain_id, run, end_ms, -1 FROM g), s AS (SELECT chain_id, run, t, d, sum(d) AS n FROM e GROUP BY ALL),
w AS (SELECT chain_id, run, sum(n) OVER (PARTITION BY chain_id, run ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS o FROM s) SELECT chain_id, run, greatest(max(o),0)::BIGINT AS peak FROM w GROUP BY ALL""")
def peak_concurrency(spark: SparkSession, d: str) -> DataFrame:
    return S.peak_concurrency(table(spark, d, "chain_groups"), ["chain_id", "run"], "start_ms", "end_ms")


@query(f"""WITH g AS ({_GROUPS}), e AS (SELECT chain_id, start_ms AS t, 1 AS d FROM g UNION ALL SELECT chain_id, end_ms, -1 FROM g), s AS (SELECT chain_id, t, d, sum(d) AS n FROM e GROUP BY ALL),
w AS (SELECT chain_id, sum(n) OVER (PARTITION BY chain_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS o FROM s), p AS (SELECT chain_id, greatest(max(o),0)::BIGINT AS peak FROM w GROUP BY ALL)
SELECT chain_id, min(start_ms) AS first_start, max(end_ms) AS last_end, max(end_ms)-min(start_ms) AS wall, sum(end_ms-start_ms)::BIGINT AS work, count(*) AS n, any_value(peak) AS peak FROM g JOIN p USING (chain_id) GROUP BY chain_id""")
def chain_totals(spark: SparkSession, d: str) -> DataFrame:
    return S.chain_totals(table(spark, d, "chain_groups"), ["chain_id"], "start_ms", "end_ms")


@query("""WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)
SELECT user_id, p AS gap_start, ts AS gap_end, (epoch(date_trunc('second', ts)) - epoch(date_trunc('second', p)))::BIGINT AS gap_seconds FROM g WHERE epoch(date_trunc('second', ts)) - epoch(date_trunc('second', p)) > 36000""")
def gap_sentinels(spark: SparkSession, d: str) -> DataFrame:
    return S.gap_sentinels(table(spark, d, "events"), ["user_id"], "ts", 36_000)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n, min(ts) AS started_at, max(ts) AS ended_at FROM s GROUP BY user_id, k""")
def activity_sessions(spark: SparkSession, d: str) -> DataFrame:
    return S.sessionize(table(spark, d, "events"), ["user_id"], "ts", "8 hours")


@query("""WITH g AS (SELECT user_id, ts, epoch(date_trunc('second', ts))::BIGINT AS e, epoch(date_trunc('second', ts))::BIGINT - lag(epoch(date_trunc('second', ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, max(e)-min(e) AS span, list_sort(list(gap) FILTER (gap IS NOT NULL))[(count(gap)//2+1)::INT] AS median_gap, max(gap) AS longest_gap FROM g GROUP BY user_id""")
def gap_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.gap_stats(table(spark, d, "events"), ["user_id"], "ts")


@query("""WITH m AS (SELECT max(ts) AS u FROM events), a AS (SELECT (epoch(date_trunc('second', u)) - epoch(date_trunc('second', ts)))::BIGINT AS age FROM events, m), c AS (SELECT 23 - age // 3600 AS bucket, count(*) AS n FROM a WHERE age >= 0 AND age < 86400 GROUP BY 1)
SELECT g.range AS bucket, coalesce(n,0) AS n FROM range(24) g LEFT JOIN c ON c.bucket = g.range""")
def activity_buckets(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    until = F.lit(events.agg(F.max("ts")).first()[0])
    return S.activity_buckets(events, "ts", 60, 24, until)


@query("""WITH s AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority, round(sum(o_totalprice),2) AS total, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total DESC, o_orderpriority)::INT AS rank, count(*) OVER (PARTITION BY day) AS k FROM s)
SELECT day, o_orderpriority, total, n, rank, greatest(k-2,0) AS more FROM r WHERE rank <= 2""")
def report_by_day(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return S.daily_report(orders, day, "o_orderpriority", {"total": F.round(F.sum("o_totalprice"), 2), "n": F.count(F.lit(1))}, 2)


@query("""WITH t AS (SELECT row_no, session_uuid, seq, text, lower(trim(role)) AS role FROM event_rows WHERE tier='session' AND seq IS NOT NULL AND text IS NOT NULL AND session_uuid IS NOT NULL),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_uuid, seq ORDER BY row_no) AS rn FROM t) WHERE rn=1),
n AS (SELECT *, sum((role='user')::INT) OVER (PARTITION BY session_uuid ORDER BY seq ROWS UNBOUNDED PRECEDING) AS exchange FROM o)
SELECT session_uuid, exchange::BIGINT AS exchange, arg_min(text, seq) FILTER (role='user') AS asked, arg_max(text, seq) FILTER (role='assistant' AND regexp_matches(text,'[^\\s\\p{Z}]')) AS answered FROM n GROUP BY session_uuid, exchange HAVING count(*) FILTER (role='user') > 0""")
def exchange_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.exchanges(_turns(spark, d), ["session_uuid"], "seq")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "event_rows").where("tier = 'session' AND seq IS NOT NULL AND text IS NOT NULL AND session_uuid IS NOT NULL")
    first = rows.groupBy("session_uuid", "seq").agg(F.min_by(F.struct("row_no", "text", F.lower(F.trim("role")).alias("role")), "row_no").alias("r"))
    return first.select("session_uuid", "seq", "r.*")


_TURNS = """WITH t AS (SELECT row_no, session_uuid, seq, text, lower(trim(role)) AS role FROM event_rows WHERE tier='session' AND seq IS NOT NULL AND text IS NOT NULL AND session_uuid IS NOT NULL),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_uuid, seq ORDER BY row_no) AS rn FROM t) WHERE rn=1)"""


@query("""WITH t AS (SELECT row_no, session_uuid, seq, text, lower(trim(role)) AS role FROM event_rows WHERE tier='session' AND seq IS NOT NULL AND text IS NOT NULL AND session_uuid IS NOT NULL),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_uuid, seq ORDER BY row_no) AS rn FROM t) WHERE rn=1),
n AS (SELECT *, sum((role='user')::INT) OVER (PARTITION BY session_uuid ORDER BY seq ROWS UNBOUNDED PRECEDING) AS exchange FROM o),
x AS (SELECT session_uuid, exchange::BIGINT AS exchange, arg_min(text, seq) FILTER (role='user') AS asked, arg_max(text, seq) FILTER (role='assistant' AND regexp_matches(text,'[^\\s\\p{Z}]')) AS answered FROM n GROUP BY session_uuid, exchange HAVING count(*) FILTER (role='user') > 0) SELECT session_uuid, exchange, asked, answered FROM (SELECT *, row_number() OVER (PARTITION BY session_uuid ORDER BY exchange DESC) AS back FROM x) WHERE back <= 2""")
def exchange_tail(spark: SparkSession, d: str) -> DataFrame:
    return S.exchanges(_turns(spark, d), ["session_uuid"], "seq", 2)


_HARNESS = "|".join([*[f"(?i:^\\s*{p})" for p in T.HOST_PREAMBLES], *T.HARNESS_TURNS, *T.INBOUND_TURNS])


@query(_TURNS + f""", u AS (SELECT *, regexp_matches(text, '{_HARNESS}') AS h, regexp_extract(text, '^\\[tool_use ([\\w.:-]+)\\]', 1) AS tool,
 CASE WHEN regexp_matches(text, '^\\[tool_use (Edit|Write|MultiEdit|NotebookEdit)\\]') THEN regexp_extract(text, '"file_path"\\s*:\\s*"([^"]+)"', 1) ELSE '' END AS edited FROM o),
c AS (SELECT session_uuid, count_if(role='user' AND NOT h)::BIGINT AS asked, count_if(role='user' AND h)::BIGINT AS omitted, count_if(role='assistant')::BIGINT AS answers, count_if(role='tool_use')::BIGINT AS calls,
 arg_max(regexp_replace(regexp_replace(text,'\\s+',' ','g'),'^ +| +$','','g'), seq) FILTER (role='assistant') AS ended_with FROM u GROUP BY 1),
tl AS (SELECT session_uuid, array_to_string(list(v || ' ' || n ORDER BY n DESC, v)[1:12], ', ') AS top_tool FROM (SELECT session_uuid, tool AS v, count(*) AS n FROM u WHERE role='tool_use' AND tool<>'' GROUP BY ALL) GROUP BY 1),
ed AS (SELECT session_uuid, array_to_string(list(v || ' ' || n ORDER BY n DESC, v)[1:12], ', ') AS top_edited FROM (SELECT session_uuid, edited AS v, count(*) AS n FROM u WHERE role='tool_use' AND edited<>'' GROUP BY ALL) GROUP BY 1)
SELECT * FROM c LEFT JOIN tl USING (session_uuid) LEFT JOIN ed USING (session_uuid)""")
def session_recap(spark: SparkSession, d: str) -> DataFrame:
    return S.recap(_turns(spark, d), ["session_uuid"], "seq")


@query("""WITH k AS (SELECT *, CASE WHEN coalesce(ts,'')<>'' THEN md5(ts || chr(31) || coalesce(role,'~') || chr(31) || coalesce(text,'~')) ELSE 'uid' || uid END AS key FROM event_rows)
SELECT min(row_no) AS row_no, count(*) AS n_copies FROM k GROUP BY key""")
def dedupe_content(spark: SparkSession, d: str) -> DataFrame:
    return S.dedupe_events(table(spark, d, "event_rows"), F.col("row_no")).select("row_no", "n_copies")


@query("""WITH n AS (SELECT row_no, regexp_replace(regexp_replace(text,'\\s+',' ','g'),'^ +| +$','','g') AS norm FROM event_rows WHERE text IS NOT NULL AND role='user') SELECT min(row_no) AS row_no, count(*)-1 AS collapsed FROM n GROUP BY norm""")
def collapse_by_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "event_rows").where("text IS NOT NULL AND role = 'user'")
    return rows.groupBy(T.squeeze(F.col("text")).alias("_n")).agg(F.min("row_no").alias("row_no"), (F.count(F.lit(1)) - 1).alias("collapsed")).drop("_n")


@query("""WITH s AS (SELECT user_id, event_id, ts FROM events WHERE event_type='click') SELECT user_id, lag(event_id) OVER w AS parent, event_id AS child FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY parent IS NOT NULL""")
def key_chain(spark: SparkSession, d: str) -> DataFrame:
    clicks = table(spark, d, "events").where("event_type = 'click'").withColumn("key", F.col("user_id").cast("string"))
    return S.key_chain(clicks, "key", ["ts", "event_id"], "event_id").select(F.col("key").cast("long").alias("user_id"), "parent", "child")


_NODES = """SELECT c.bank || '/' || c.repo_key AS scope, c.chain_id AS id, c.start_ms, greatest(c.start_ms, c.end_ms) AS end_ms, greatest(c.start_ms, c.end_ms) + 2000 AS mtime_ms, CASE WHEN c.total % 2 = 0 THEN 'clear' ELSE 'other' END AS started FROM chains c WHERE c.start_ms IS NOT NULL AND c.end_ms IS NOT NULL AND c.repo_key IS NOT NULL"""
#: Wide windows, so that the test tables have links.
_WIDE = {"flush_ms": 600_000, "relaunch_ms": 86_400_000, "adjacency_ms": 172_800_000}


@query(f"""WITH n AS ({_NODES}), p AS (SELECT c.scope, c.id AS child, c.start_ms AS cs, c.started, p.id AS parent, p.end_ms AS pe, p.mtime_ms AS pm,
 CASE WHEN c.started='clear' THEN abs(c.start_ms-p.mtime_ms) <= 600000 ELSE p.mtime_ms <= c.start_ms+1000 AND c.start_ms-p.mtime_ms <= 86400000 END AS m,
 c.started='clear' AND c.start_ms-p.end_ms <= 172800000 AS ev FROM n c JOIN n p ON c.scope=p.scope AND p.id<>c.id AND p.start_ms<c.start_ms AND p.end_ms<=c.start_ms+1000),
q AS (SELECT *, bool_or(m) OVER (PARTITION BY scope, child) AS anym FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY scope, child ORDER BY pe DESC, parent) AS r, count(*) OVER (PARTITION BY scope, child) AS c FROM q WHERE CASE WHEN anym THEN m ELSE ev END),
b AS (SELECT scope, parent, child, CASE WHEN started='clear' THEN 'clear' ELSE 'relaunch' END AS kind, greatest(0, cs-pe) AS gap_ms, CASE WHEN m THEN 'mtime' ELSE 'last-event' END AS via, c>1 AS ambiguous FROM k WHERE r=1)
SELECT * EXCLUDE (z) FROM (SELECT *, row_number() OVER (PARTITION BY scope, parent ORDER BY (kind<>'clear')::INT, gap_ms, child) AS z FROM b) WHERE z=1""")
def lineage_links(spark: SparkSession, d: str) -> DataFrame:
    chains = table(spark, d, "chains").where("start_ms IS NOT NULL AND end_ms IS NOT NULL AND repo_key IS NOT NULL")
    end = F.greatest("start_ms", "end_ms")
    nodes = chains.select(
        F.concat_ws("/", "bank", "repo_key").alias("scope"), F.col("chain_id").alias("id"), "start_ms", end.alias("end_ms"), (end + 2000).alias("mtime_ms"),
        F.when(F.col("total") % 2 == 0, "clear").otherwise("other").alias("started"), F.array().cast("array<string>").alias("carries"))
    return S.lineage_links(nodes, **_WIDE)


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha1('0:' || doc_id::VARCHAR), doc_id) AS k FROM documents) SELECT source, doc_id FROM r WHERE k <= 20""")
def stratified_pool(spark: SparkSession, d: str) -> DataFrame:
    return M.sampled_pool(table(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 20)


@query("""SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING),2) AS running FROM lineitem""")
def window_running_sum(spark: SparkSession, d: str) -> DataFrame:
    frame = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(frame), 2).alias("running"))


# ---- logs ---------------------------------------------------------------------


def _log(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.select("event_type", F.get_json_object("props", "$.k").cast("long").alias("hits"), F.round(F.col("value") * 1000).cast("long").alias("ms"), "event_id")


_LOG = "SELECT event_type, event_id, json_extract_string(props,'$.k')::BIGINT AS hits, round(value*1000)::BIGINT AS ms FROM events"


@query(f"""WITH l AS ({_LOG}) SELECT event_type, count(*) AS n, count_if(hits=0)::BIGINT AS zero_hits, list_sort(list(ms))[(count(*)//2+1)::INT] AS median_cost, max(ms) AS worst_cost FROM l GROUP BY event_type""")
def log_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.log_stats(_log(spark, d), "event_type", "ms")


@query(f"WITH l AS ({_LOG}) SELECT event_id, ms FROM l ORDER BY ms DESC, event_id LIMIT 5")
def log_slowest(spark: SparkSession, d: str) -> DataFrame:
    return R.top(_log(spark, d).select("event_id", "ms"), 5, [F.desc("ms"), F.col("event_id")])


@query("""WITH t AS (SELECT unnest(list_distinct(list_filter(string_split(lower(description),' '), lambda x: len(x)>3))) AS term FROM parsed_files WHERE description IS NOT NULL) SELECT term, count(*) AS n FROM t GROUP BY term ORDER BY n DESC, term LIMIT 50""")
def term_cloud(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower("description"), " "), lambda w: F.char_length(w) > 3))
    counts = table(spark, d, "parsed_files").select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return R.top(counts, 50, [F.desc("n"), F.col("term")])


# ---- sets and mutations -------------------------------------------------------


@query("SELECT file_path FROM parsed_files UNION SELECT file_path FROM event_rows")
def set_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_files").select("file_path").union(table(spark, d, "event_rows").select("file_path")).distinct()


@query("SELECT session_uuid FROM parsed_files EXCEPT SELECT chain_id FROM chains")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_files").select("session_uuid").subtract(table(spark, d, "chains").select("chain_id"))


@query("SELECT session_uuid FROM parsed_files INTERSECT SELECT chain_id FROM chains")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_files").select("session_uuid").intersect(table(spark, d, "chains").select("chain_id"))


@query("SELECT 'file' AS kind, bank, repo_key FROM parsed_files UNION ALL SELECT 'chain', bank, repo_key FROM chains")
def set_union_all(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(k).alias("kind"), "bank", "repo_key") for t, k in (("parsed_files", "file"), ("chains", "chain"))]
    return parts[0].unionByName(parts[1])


@query("""WITH n AS (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'F') SELECT o.o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM orders o LEFT JOIN n USING (o_orderkey)""")
def update_only(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    patch = orders.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return M.update_only(orders.drop("o_orderstatus"), patch, ["o_orderkey"])


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 5 = 0""")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    new = orders.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("new"))
    return M.upsert(orders.where("o_orderkey % 3 <> 0"), new, ["o_orderkey"])


@query("""SELECT * EXCLUDE (rn, row_no) FROM (SELECT uid, file_path, row_no AS last_row, row_no, row_number() OVER (PARTITION BY uid, file_path ORDER BY row_no DESC) AS rn FROM event_rows) WHERE rn = 1""")
def keep_last(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "event_rows").select("uid", "file_path", "row_no").where("uid IS NOT NULL AND file_path IS NOT NULL")
    return M.keep_last(rows, ["uid", "file_path"], "row_no").withColumnRenamed("row_no", "last_row")


# ---- search -------------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')"


def _bm25(words: list[str], source: str, key: str, scope: str = "") -> str:
    by = f"PARTITION BY {scope}" if scope else ""
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count_if(tf{i}>0) OVER ({by}) AS df{i}" for i in range(len(words)))
    part = " + ".join(f"CASE WHEN tf{i}>0 THEN ln(1.0 + (n - df{i} + 0.5)/(df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(len(words)))
    sc = f"{scope}, " if scope else ""
    return f"""WITH t AS (SELECT {sc}{key}, list_filter({_TOKENS}, lambda x: len(x) <= 128) AS w FROM {source} WHERE text IS NOT NULL), c AS (SELECT {sc}{key}, len(w) AS dl, {tf} FROM t),
s AS (SELECT *, count(*) OVER ({by}) AS n, avg(dl) OVER ({by}) AS avgdl, {df} FROM c), r AS (SELECT {sc}{key}, {part} AS score FROM s)"""


@query(_bm25(["peak", "concurrency", "cache", "cold"], "documents", "doc_id") + " SELECT doc_id, round(score,6) AS score FROM r WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents")).where("text IS NOT NULL")
    scored = R.bm25(docs, "doc_id", "text", "peak concurrency cache cold").withColumn("score", F.round("score", 6))
    return R.top(scored, 20, [F.desc("score"), F.col("doc_id")])


@query(_bm25(["importer", "index"], "event_rows", "row_no") + " SELECT row_no, round(score,6) AS score FROM r WHERE score > 0")
def bm25_all(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "event_rows")).where("text IS NOT NULL")
    return R.bm25(rows, "row_no", "text", "importer index").withColumn("score", F.round("score", 6))


@query(_bm25(["importer", "index"], "event_rows", "row_no") + " SELECT row_no, round(score,6) AS score FROM r WHERE score > 0")
def bm25_index(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "event_rows")).where("text IS NOT NULL")
    return R.bm25_from_index(R.build_index(rows, "row_no", "text"), "row_no", "importer index").withColumn("score", F.round("score", 6))


@query(_bm25(["tests", "green"], "documents", "doc_id", "repo_key") + """, k AS (SELECT repo_key, doc_id, round(score,6) AS score FROM r WHERE score > 0 AND repo_key IS NOT NULL),
z AS (SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY score DESC, doc_id)::INT AS rank, count(*) OVER (PARTITION BY repo_key) > 3 AS capped FROM k) SELECT * FROM z WHERE rank <= 3""")
def bm25_per_shard(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents")).where("text IS NOT NULL AND repo_key IS NOT NULL")
    scored = R.bm25(docs, "doc_id", "text", "tests green", ["repo_key"]).withColumn("score", F.round("score", 6))
    return R.per_scope_top(scored, ["repo_key"], 3, [F.desc("score"), F.col("doc_id")])


@query("SELECT row_no FROM event_rows WHERE contains(lower(text), 'still the slow one')")
def like_fallback(spark: SparkSession, d: str) -> DataFrame:
    return R.contains_all(spread(table(spark, d, "event_rows")), "text", "Still the SLOW one").select("row_no")


@query("""WITH c AS (SELECT bank, repo_key, count(*) AS n FROM event_rows WHERE contains(lower(text),'importer') GROUP BY ALL)
SELECT coalesce(sum(least(n,20)),0)::BIGINT AS total, count_if(n>20)::BIGINT AS capped_scopes, count_if(n>20)=0 AS exact FROM c""")
def search_total_floor(spark: SparkSession, d: str) -> DataFrame:
    return R.hit_totals(R.contains_all(table(spark, d, "event_rows"), "text", "importer"), ["bank", "repo_key"], 20)


@query(f"""WITH t AS (SELECT repo_key, {_TOKENS} AS w FROM event_rows), c AS (SELECT repo_key, count_if(list_contains(w,'importer')) AS a, count_if(list_contains(w,'the')) AS b, count_if(list_contains(w,'zebra')) AS z FROM t GROUP BY repo_key)
SELECT unnest(['importer','the','zebra']) AS term, unnest([round(avg((a>=3)::INT),6), round(avg((b>=3)::INT),6), round(avg((z>=3)::INT),6)]) AS df_fraction FROM c""")
def generic_query(spark: SparkSession, d: str) -> DataFrame:
    return R.generic_terms(spread(table(spark, d, "event_rows")), "text", ["importer", "the", "zebra"], ["repo_key"])


_PROBE = [1.0 if i % 2 else -0.5 for i in range(64)]


@query(f"""SELECT vec_id, round(greatest(0, least(1, list_dot_product(embedding::DOUBLE[], {[x / 8 for x in _PROBE]}::DOUBLE[]))),6) AS cosine FROM embeddings ORDER BY cosine DESC, vec_id LIMIT 20""")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    found = R.cosine_top(table(spark, d, "embeddings"), "vec_id", "embedding", [x / 8 for x in _PROBE], 0).withColumn("cosine", F.round("cosine", 6))
    return R.top(found, 20, [F.desc("cosine"), F.col("vec_id")])


@query("""WITH q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id AS neighbour, list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) AS c FROM q, embeddings WHERE vec_id <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, neighbour)::INT AS rank FROM s) SELECT query, neighbour, round(c,6) AS cosine, rank FROM r WHERE rank <= 5""")
def semantic_knn(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return R.knn_join(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "vec_id", "embedding", 5).withColumn("cosine", F.round("cosine", 6))


def _ranked(docs: DataFrame, words: str) -> DataFrame:
    scored = R.bm25(docs, "doc_id", "text", words).withColumn("score", F.round("score", 6))
    return R.top(scored, 30, [F.desc("score"), F.col("doc_id")]).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc_id")))  # 30 rows


def _top30(words: list[str], name: str) -> str:
    return _bm25(words, "documents", "doc_id").replace("WITH t AS", f"WITH {name}t AS").replace("FROM t)", f"FROM {name}t)").replace(", c AS", f", {name}c AS").replace("FROM c)", f"FROM {name}c)").replace(
        "\ns AS", f"\n{name}s AS").replace("FROM s)", f"FROM {name}s)").replace(", r AS", f", {name}r AS") + f", {name} AS (SELECT doc_id, row_number() OVER (ORDER BY round(score,6) DESC, doc_id) AS rank FROM {name}r WHERE score > 0 ORDER BY rank LIMIT 30)"


@query(_top30(["tests", "green"], "qa") + ", " + _top30(["cache", "cold"], "qb")[5:] + " SELECT doc_id, round(sum(1.0/(60+rank)),6) AS fused FROM (SELECT * FROM qa UNION ALL SELECT * FROM qb) GROUP BY doc_id")
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents")).where("text IS NOT NULL")
    fused = R.reciprocal_rank_fusion([_ranked(docs, "tests green"), _ranked(docs, "cache cold")], ["doc_id"])
    return fused.withColumn("fused", F.round("fused", 6))


@query("""WITH q AS (SELECT vec_id AS query, label, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id AS item, list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) AS c FROM q, embeddings WHERE vec_id <> query),
r AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY c DESC, item) AS rank FROM s), f AS (SELECT q.query, r.rank FROM q LEFT JOIN r ON r.query=q.query AND r.item=q.query+1 AND r.rank<=100)
SELECT count(*) AS n, round(avg(coalesce(1.0/rank,0)),6) AS mrr, round(avg((coalesce(rank,0)=1)::INT),6) AS recall_1, round(avg((rank IS NOT NULL)::INT),6) AS recall_k, round(avg((rank IS NULL)::INT),6) AS missed FROM f""")
def known_item_measures(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    queries = vectors.where("vec_id % 20 = 0")
    ranked = R.knn_join(queries, vectors, "vec_id", "vec_id", "embedding", 100).withColumnRenamed("neighbour", "item")
    return R.retrieval_measures(ranked, queries.select(F.col("vec_id").alias("query"), (F.col("vec_id") + 1).alias("item")), "query", "item", 100)


@query("""WITH w AS (SELECT doc_id AS q, doc_id AS item FROM documents WHERE doc_id % 10 = 0), a AS (SELECT doc_id FROM documents WHERE contains(lower(text),'the')), b AS (SELECT doc_id FROM documents WHERE length(text) > 500)
SELECT count_if(a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL)::BIGINT AS hit_both, count_if(a.doc_id IS NOT NULL AND b.doc_id IS NULL)::BIGINT AS only_a, count_if(a.doc_id IS NULL AND b.doc_id IS NOT NULL)::BIGINT AS only_b, count_if(a.doc_id IS NULL AND b.doc_id IS NULL)::BIGINT AS hit_none
FROM w LEFT JOIN a ON a.doc_id=item LEFT JOIN b ON b.doc_id=item""")
def method_contingency(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    pair = lambda df: df.select(F.col("doc_id").alias("q"), F.col("doc_id").alias("item"))
    return R.contingency(pair(docs.where(F.lower("text").contains("the"))), pair(docs.where(F.char_length("text") > 500)), pair(docs.where("doc_id % 10 = 0")), "q", "item")


@query("""WITH w AS (SELECT doc_id AS q, doc_id AS item FROM documents), a AS (SELECT doc_id FROM documents WHERE contains(lower(text),'the')), b AS (SELECT doc_id FROM documents WHERE length(text) > 500)
SELECT count_if(a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL)::BIGINT AS hit_both, count_if(a.doc_id IS NOT NULL AND b.doc_id IS NULL)::BIGINT AS only_a, count_if(a.doc_id IS NULL AND b.doc_id IS NOT NULL)::BIGINT AS only_b, count_if(a.doc_id IS NULL AND b.doc_id IS NULL)::BIGINT AS hit_none
FROM w LEFT JOIN a ON a.doc_id=item LEFT JOIN b ON b.doc_id=item""")
def method_contingency_all(spark: SparkSession, d: str) -> DataFrame:
    """method_contingency with every document as a known item."""
    docs = table(spark, d, "documents")
    pair = lambda df: df.select(F.col("doc_id").alias("q"), F.col("doc_id").alias("item"))
    return R.contingency(pair(docs.where(F.lower("text").contains("the"))), pair(docs.where(F.char_length("text") > 500)), pair(docs), "q", "item")


@query(f"""WITH t AS (SELECT session_uuid, list_distinct(list({_TOKENS}[1])) AS w FROM event_rows WHERE text <> '' AND role='user' GROUP BY 1), u AS (SELECT session_uuid, list_distinct(list({_TOKENS}[1])) AS w FROM event_rows WHERE text <> '' AND role='assistant' GROUP BY 1)
SELECT session_uuid, round(len(list_intersect(list_filter(t.w, lambda x: x IS NOT NULL), u.w)) / len(list_filter(list_distinct(list_concat(t.w, u.w)), lambda x: x IS NOT NULL)),6) AS overlap FROM t JOIN u USING (session_uuid) WHERE len(list_filter(list_distinct(list_concat(t.w, u.w)), lambda x: x IS NOT NULL)) > 0""")
def first_word_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "event_rows")).where("text <> ''")
    words = lambda role, name: rows.where(F.col("role") == role).groupBy("session_uuid").agg(F.collect_set(F.get(T.tokens(F.col("text")), F.lit(0))).alias(name))
    both = words("user", "a").join(words("assistant", "b"), "session_uuid").where(F.size(F.array_union("a", "b")) > 0)
    return both.select("session_uuid", F.round(R.jaccard(F.col("a"), F.col("b")), 6).alias("overlap"))


_SIDED = """WITH x AS (SELECT session_uuid, text, regexp_replace(lower(role), '[^\\p{L}]+', '', 'g') AS r FROM event_rows WHERE text <> '' AND session_uuid IS NOT NULL),
y AS (SELECT session_uuid, text, r IN ('assistant','agent','model') AS answers, regexp_matches(text, '[GAPLESS]') AS g FROM x WHERE r IN ('user','human','assistant','agent','model')),
s AS (SELECT session_uuid, bool_or(g) AS grams FROM y GROUP BY 1 HAVING bool_or(answers) AND NOT bool_and(answers)),
w AS (SELECT session_uuid, answers, grams, text, regexp_replace(text, '[\\s\\x0B\\p{Z}]+', '', 'g') AS bare FROM y JOIN s USING (session_uuid)),
t AS (SELECT DISTINCT session_uuid, answers, unnest(CASE WHEN grams THEN list_transform(range(1, length(bare)-1), lambda i: substring(bare, i::INT, 3)) ELSE TOKENS END) AS token FROM w),
u AS (SELECT session_uuid, token, count(*) AS sides FROM t GROUP BY ALL)""".replace("GAPLESS", T.GAPLESS).replace("TOKENS", _TOKENS)


@query(_SIDED + " SELECT session_uuid, round(count_if(sides=2)/count(*),6) AS overlap FROM u GROUP BY session_uuid")
def word_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard overlap of a session's user and assistant texts, by all their words; by 3-grams of both
    sides where any of its texts has letters of a script without word gaps.  Roles are taken in any spelling."""
    rows = spread(table(spark, d, "event_rows")).where("text <> '' AND session_uuid IS NOT NULL")
    role = F.regexp_replace(F.lower("role"), r"[^\p{L}]+", "")
    said = rows.select("session_uuid", "text", role.alias("_r")).where(F.col("_r").isin("user", "human", "assistant", "agent", "model"))
    sided = said.select("session_uuid", "text", F.col("_r").isin("assistant", "agent", "model").alias("side"))
    return R.text_overlap(sided, "session_uuid", "side", "text").withColumn("overlap", F.round("overlap", 6))


@query()
def mean_interval(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return R.bootstrap_interval(values, "x", 200)


# ---- audits and reports -------------------------------------------------------


@query(r"""WITH r AS (SELECT uid, text, octet_length(encode(text)) AS b, CASE WHEN role IN ('user','assistant','thinking','system') THEN '' WHEN regexp_matches(text,'^\[tool_use (Edit|Write|MultiEdit|NotebookEdit)\]') THEN 'edit-payload' WHEN regexp_matches(text,'^\[tool_use (Read|Glob|LS|Grep|TodoWrite)\]') THEN 'navigation-call' ELSE '' END AS rule FROM event_rows WHERE text IS NOT NULL AND uid IS NOT NULL AND role IN ('user','assistant','thinking','system','tool_use'))
SELECT rule, count(*) AS n, sum(b)::BIGINT AS bytes, round(count(*)/(SELECT count(*) FROM r),6) AS part FROM r GROUP BY rule""")
def noise_probe(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "event_rows")).where("text IS NOT NULL AND uid IS NOT NULL AND role IN ('user','assistant','thinking','system','tool_use')")
    return Q.noise_probe(rows).drop("samples")


@query(_RULED + " SELECT rule, count(*) AS n, sum(b)::BIGINT AS bytes, round(count(*)/(SELECT count(*) FROM r),6) AS part FROM r GROUP BY rule")
def noise_probe_all(spark: SparkSession, d: str) -> DataFrame:
    """noise_probe over every event row, whatever its role; one without text is no noise and counts in the whole."""
    return Q.noise_probe(spread(table(spark, d, "event_rows"))).drop("samples")


_FACET = {"via": "source", "chat_id": "chat_id", "msg_id": "message_id", "from_user": "user", "from_user_id": "user_id", "sent_ts": "ts"}
_AT = {k: f"regexp_extract(a, '(?:^|[^\\w-]){v}=\"([^\"]*)\"', 1)" for k, v in _FACET.items()}


@query("""WITH t AS (SELECT *, regexp_extract(text, '^\\s*<channel(?:\\s)([^>]*)(?:>|$)', 1) AS a FROM event_rows WHERE role='user' AND contains(text,'<channel'))
SELECT row_no, """ + ", ".join(f"{x} AS {k}" for k, x in _AT.items()) + f" FROM t WHERE {_AT['via']} <> '' AND (" + " OR ".join(f"coalesce({k},'') <> {x}" for k, x in _AT.items()) + ")")
def backfill_plan(spark: SparkSession, d: str) -> DataFrame:
    return Q.backfill_plan(table(spark, d, "event_rows"))


@query("""WITH h AS (SELECT *, coalesce(role='user' AND length(trim(text, ' '))>5 AND NOT starts_with(text,'[Request interrupted'), false) AS human FROM event_rows)
SELECT file_path, count_if(human)::BIGINT AS human, count_if(role='assistant')::BIGINT AS answers, count_if(role='tool_use')::BIGINT AS calls, arg_min(CASE WHEN human THEN text END, CASE WHEN human THEN struct_pack(a := seq, b := row_no) END) FILTER (WHERE human AND seq IS NOT NULL) AS first_prompt,
 min(nullif(ts,'')) AS first_at, max(nullif(ts,'')) AS last_at FROM h GROUP BY file_path""")
def dig_files(spark: SparkSession, d: str) -> DataFrame:
    return Q.dig(table(spark, d, "event_rows"), ["file_path"], "ts", "row_no")


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type='click'),
l AS (SELECT p AS parent, event_id AS child FROM s WHERE p IS NOT NULL AND rn % 9 <> 0),
w AS (SELECT parent AS node, parent AS root, 0::BIGINT AS depth FROM l WHERE parent NOT IN (SELECT child FROM l) GROUP BY parent UNION ALL SELECT l.child, w.root, w.depth + 1 FROM w JOIN l ON l.parent = w.node) SELECT node, root, depth FROM w""")
def lineage_trees(spark: SparkSession, d: str) -> DataFrame:
    clicks = table(spark, d, "events").where("event_type = 'click'")
    own = W.partitionBy("user_id").orderBy("ts", "event_id")
    links = clicks.select(F.lag("event_id").over(own).alias("parent"), F.col("event_id").alias("child"), F.row_number().over(own).alias("rn"))
    return Q.lineage_trees(links.where("parent IS NOT NULL AND rn % 9 <> 0"))


@query("""WITH n AS (SELECT file_no AS id, CASE WHEN file_no % 4 <> 0 THEN file_no - file_no % 4 END AS parent, lines FROM parsed_files), j AS (SELECT coalesce(p.id, n.id) AS id, p.id IS NOT NULL AS s, n.lines FROM n LEFT JOIN (SELECT DISTINCT id FROM n) p ON n.parent = p.id)
SELECT id, count_if(s)::BIGINT AS spawned, sum(lines)::BIGINT AS lines FROM j GROUP BY id""")
def fold_spawns(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "parsed_files").select(F.col("file_no").alias("id"), F.when(F.col("file_no") % 4 != 0, F.col("file_no") - F.col("file_no") % 4).alias("parent"), "lines")
    return Q.fold_spawns(nodes, "id", "parent", ["lines"])


@query("""WITH p AS (SELECT list_filter(string_split(file_path,'/'), lambda x: x<>'') AS a, lines FROM parsed_files), e AS (SELECT '/' || array_to_string(a[1:i],'/') AS dir, lines FROM p, LATERAL (SELECT unnest(range(1, len(a))) AS i)),
r AS (SELECT dir, count(*) AS n_files, sum(lines)::BIGINT AS weight, regexp_replace(dir,'/[^/]+$','') AS parent FROM e GROUP BY dir), k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY weight DESC, dir)::INT AS rank, count(*) OVER (PARTITION BY parent) AS c FROM r)
SELECT dir, n_files, weight, parent, rank, greatest(c-3,0) AS more FROM k WHERE rank <= 3""")
def tree_listing(spark: SparkSession, d: str) -> DataFrame:
    return Q.tree_listing(S.path_rollup(table(spark, d, "parsed_files"), "file_path", F.col("lines")), 3)


@query("SELECT DISTINCT repo FROM shards WHERE repo NOT IN (SELECT repo_key FROM chains WHERE repo_key IS NOT NULL)")
def shards_never_first(spark: SparkSession, d: str) -> DataFrame:
    return Q.never_first(table(spark, d, "shards").select("repo").distinct(), table(spark, d, "chains"), "repo", "repo_key")


@query("""WITH h AS (SELECT bank, repo_key, count(*) AS n FROM event_rows WHERE contains(lower(text),'importer') GROUP BY ALL), k AS (SELECT * FROM h ORDER BY n DESC, bank, repo_key LIMIT 25)
SELECT (SELECT epoch_us(max(loaded_at)) FROM parsed_files f WHERE EXISTS (SELECT 1 FROM k WHERE k.bank=f.bank AND k.repo_key=f.repo_key)) AS newest, (SELECT count(*) > 25 FROM h) AS sampled""")
def answer_freshness(spark: SparkSession, d: str) -> DataFrame:
    hits = R.contains_all(table(spark, d, "event_rows"), "text", "importer")
    return Q.answer_freshness(hits, table(spark, d, "parsed_files"), ["bank", "repo_key"], "loaded_at").withColumn("newest", F.unix_micros("newest"))


@query("""WITH p AS (SELECT bank, count(*) AS n FROM event_rows GROUP BY bank), i AS (SELECT bank, count(*) AS h FROM event_rows WHERE tier='session' GROUP BY bank)
SELECT bank, n - coalesce(h,0) AS missing, (n - coalesce(h,0) >= 100 AND n - coalesce(h,0) >= n*0.05) AS rebuild FROM p LEFT JOIN i USING (bank)""")
def index_lag(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "event_rows")
    count = lambda df: df.groupBy("bank").agg(F.count(F.lit(1)).alias("n"))
    return Q.index_lag(count(rows.where("tier = 'session'")), count(rows), ["bank"], 100)


@query("""SELECT round(sum(CASE WHEN lang NOT IN ('en','latin','none') THEN chars ELSE 0 END)/sum(chars),6) AS part, sum(CASE WHEN lang NOT IN ('en','latin','none') THEN chars ELSE 0 END)/sum(chars) >= 0.05 AS multilingual FROM langs_result""")
def model_advice(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "langs_result").groupBy(F.col("lang").alias("class")).agg(F.sum("chars").alias("chars"))
    return Q.model_advice(sums).drop("classes")


@query("""WITH e AS (SELECT min(file_path) AS a, max(file_path) AS b FROM parsed_files) SELECT a[1:(SELECT max(i) FROM range(0, 400) t(i) WHERE i <= least(length(a), length(b)) AND a[1:i] = b[1:i])::INT] AS prefix FROM e""")
def common_prefix(spark: SparkSession, d: str) -> DataFrame:
    return Q.common_prefix(table(spark, d, "parsed_files"), "file_path")


@query("""SELECT ((l_quantity>=10)::INT + (l_quantity>=25)::INT + (l_quantity>=40)::INT)::INT AS band, count(*) AS n, round(avg(l_discount),6) AS mean FROM lineitem GROUP BY 1""")
def banded_means(spark: SparkSession, d: str) -> DataFrame:
    return Q.banded_means(table(spark, d, "lineitem"), "l_quantity", [10, 25, 40], "l_discount")


@query("""WITH c AS (SELECT unnest([1, 10, 30]) AS k) SELECT k::INT AS k, round(avg((p_size <= k)::INT),6) AS recall, median(p_size)::DOUBLE AS median_rank FROM part, c GROUP BY k""")
def recall_curve(spark: SparkSession, d: str) -> DataFrame:
    return Q.recall_curve(table(spark, d, "part"), "p_size", [1, 10, 30])


@query()
def known_item_queries(spark: SparkSession, d: str) -> DataFrame:
    """Spans drawn from the documents, and whether a search for each finds its document among the rows that hold it."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    asked = Q.known_item_queries(docs, "doc_id", "text")
    held = asked.join(docs.select("doc_id", S.squeeze(F.col("text")).alias("_t")), "doc_id")
    return held.select("doc_id", "query", F.col("_t").contains(F.col("query")).alias("found"))


@query("""WITH t AS (SELECT session_uuid, epoch_ms(loaded_at) AS ms FROM event_rows WHERE session_uuid IS NOT NULL AND loaded_at IS NOT NULL) SELECT session_uuid, min(ms) AS ms FROM t GROUP BY session_uuid HAVING max(ms) - min(ms) <= 5000""")
def mark_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Sessions whose load marks all fall together."""
    marks = table(spark, d, "event_rows").where("session_uuid IS NOT NULL AND loaded_at IS NOT NULL").select("session_uuid", F.unix_millis("loaded_at").alias("ms"))
    kept = Q.collapse_marks(marks, ["session_uuid"], "ms")
    return kept.groupBy("session_uuid").agg(F.min("ms").alias("ms"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
