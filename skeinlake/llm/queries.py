"""Queries of the operators on free text, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlake.llm import bpe, canonical, conversations, langid, mixing, personal, spans
from skeinlake.session import materialize, spread, table


def _personal(spark: SparkSession, d: str) -> DataFrame:
    return personal.extract(spread(table(spark, d, "event_rows").select("row_no", "text", "from_user")), table(spark, d, "channel_users"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.distinct_values(_personal(spark, d))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redact(table(spark, d, "event_rows"), materialize(_personal(spark, d), "personal"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    documents, rows = langid.inputs(*(table(spark, d, t) for t in ("documents", "event_rows", "lang_labels")))
    # joined once, then counted, sampled and dealt out from there
    texts = materialize(documents.unionByName(rows), "texts")
    return langid.label_segments(spread(texts), langid.fit_sample([texts.where(F.col("tab") == t) for t in ("documents", "event_rows")]))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.wrongly_labelled(materialize(_segments(spark, d), "segments"))


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).drop("label")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.found_broken(table(spark, d, "event_rows"), table(spark, d, "banks"))


def p6_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild(table(spark, d, "event_rows"), table(spark, d, "banks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.copies_of(table(spark, d, "event_rows"), "row_no", "text", ["session_uuid"])


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return canonical.collapse_copies(table(spark, d, "event_rows"), "row_no", "text", ["session_uuid"])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return mixing.documents_with_sizes(documents, bpe.token_counts(spread(documents.select("doc_id", "text")), "doc_id", "text"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(_sized(spark, d), table(spark, d, "mix_targets"))


def p9_sample(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(materialize(_sized(spark, d), "sized"), table(spark, d, "mix_targets"))


def p9_margins(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_margins(_sized(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"), "doc_id", "text")


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_amounts(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_redacted, p3_found, p3_segments, p6_found, p6_conversations, p7_found, p7_counts, p8_ids, p9_sample, p9_mix, p9_margins, p10_found, p10_shared)
}

#: The canonical form in SQL: fields of a tool call sorted at two depths, as deep as they go here.
_FIELDS = """array_to_string(list_transform(list_sort(json_keys(j)), lambda k: k || ' ' || CASE WHEN json_type(j, '$."' || k || '"') = 'OBJECT'
  THEN array_to_string(list_transform(list_sort(json_keys(j, '$."' || k || '"')), lambda m: m || ' ' || (j -> ('$."' || k || '"."' || m || '"'))::VARCHAR), ' ') ELSE (j -> ('$."' || k || '"'))::VARCHAR END), ' ')"""
_CANON = f"""raw AS (SELECT *, lower(text) AS low, regexp_extract(lower(text), '(?s)(\\{{.*\\}})', 1) AS body FROM event_rows WHERE regexp_matches(text, '[\\p{{L}}\\p{{Nd}}]')),
tried AS (SELECT *, CASE WHEN regexp_matches(low, '^\\W*tool.?use\\b[^{{]*\\{{') AND json_valid(body) THEN body::JSON END AS j FROM raw),
canon AS (SELECT *, regexp_replace(CASE WHEN j IS NOT NULL THEN replace(low, body, {_FIELDS}) ELSE low END, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]+', '', 'g') AS c FROM tried)"""

SQL = {
    "p7_found": f"""WITH {_CANON}, g AS (SELECT row_no AS copy_row_no, min(row_no) OVER (PARTITION BY session_uuid, c) AS row_no FROM canon)
SELECT row_no, copy_row_no FROM g WHERE row_no <> copy_row_no""",
    "p7_counts": f"WITH {_CANON} SELECT min(row_no) AS row_no, count(*) AS n_copies FROM canon GROUP BY session_uuid, c",
    "p6_found": f"""WITH {_CANON}, side AS (SELECT *, CASE WHEN regexp_replace(lower(role), '[^\\p{{L}}]+', '', 'g') IN ('user', 'human') THEN 'u' WHEN regexp_replace(lower(role), '[^\\p{{L}}]+', '', 'g') IN ('assistant', 'agent', 'model') THEN 'a' END AS who FROM canon WHERE tier = 'session'),
turns AS (SELECT session_uuid, c, arg_min(who, row_no) AS who, min(row_no) AS row_no FROM side WHERE who IS NOT NULL GROUP BY session_uuid, c),
t AS (SELECT t.*, e.seq FROM turns t JOIN event_rows e USING (row_no)), q AS (SELECT session_uuid, seq, count(*) AS n FROM t GROUP BY ALL),
b AS (SELECT session_uuid, bool_or(n > 1 OR seq IS NULL) AS broken FROM q GROUP BY 1), f AS (SELECT session_uuid, arg_min(who, seq) AS first, arg_max(who, seq) AS last FROM t GROUP BY 1),
s AS (SELECT DISTINCT session_uuid FROM event_rows WHERE tier = 'session' AND session_uuid IS NOT NULL),
r AS (SELECT session_uuid, CASE WHEN b.broken IS NULL THEN 'empty' WHEN b.broken OR first = 'a' THEN 'broken' WHEN last = 'u' THEN 'no_reply' END AS reason FROM s LEFT JOIN b USING (session_uuid) LEFT JOIN f USING (session_uuid))
SELECT session_uuid, reason FROM r WHERE reason IS NOT NULL""",
    "p10_shared": """WITH w AS (SELECT doc_id, i, md5(substring(text, i, 250)) AS h FROM documents, LATERAL (SELECT unnest(range(1, length(text) - 248)) AS i) WHERE length(text) >= 250),
s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), k AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 250 THEN 0 ELSE 1 END AS fresh FROM w JOIN s USING (h)),
n AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM k), p AS (SELECT doc_id, max(i) - min(i) + 250 AS chars FROM n GROUP BY doc_id, island)
SELECT doc_id, count(*) AS n_spans, sum(chars)::BIGINT AS shared_chars, any_value(length(text)) AS n_chars FROM p JOIN documents USING (doc_id) GROUP BY doc_id""",
    "p10_found": """WITH w AS (SELECT DISTINCT doc_id, md5(substring(text, i, 250)) AS h FROM documents, LATERAL (SELECT unnest(range(1, length(text) - 248)) AS i) WHERE length(text) >= 250),
s AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), k AS (SELECT w.doc_id, w.h FROM w JOIN s USING (h))
SELECT DISTINCT a.doc_id, b.doc_id AS other_doc_id FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id""",
}
