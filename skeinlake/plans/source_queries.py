"""Queries through readers, writers, streams and the embedding pipeline.

What a reader is given is first written from the domain tables into the shared
folder, so its result can be held against SQL on those tables.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlake.operators import mutations as M
from skeinlake.search import embedding as E
from skeinlake.sources import files as S
from skeinlake.session import shared_dir, table
from skeinlake.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "event_rows").where("text IS NOT NULL AND text <> '' AND session_uuid IS NOT NULL")
    return rows.select("session_uuid", F.lower(F.trim("role")).alias("role"), "ts", "text", "cwd").where(F.col("role").isin("user", "assistant"))


_TURNS = "SELECT session_uuid, lower(trim(role)) AS role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM event_rows WHERE text IS NOT NULL AND text <> '' AND session_uuid IS NOT NULL AND lower(trim(role)) IN ('user','assistant') GROUP BY ALL"


def _summary(events: DataFrame) -> DataFrame:
    return events.groupBy("session_uuid", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query(_TURNS)
def ingest_messages(spark: SparkSession, d: str) -> DataFrame:
    """One message a line, with text blocks."""
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    message = F.struct("role", block.alias("content"))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.col("session_uuid").alias("sessionId"), F.col("ts").alias("timestamp"), "cwd", message.alias("message")))
    path = _folder(spark, "messages")
    _turns(spark, d).select(line.alias("value")).write.option("maxRecordsPerFile", 20_000).text(path)
    return _summary(S.parse_messages(S.lines_of(spark, path))[0])


@query(_TURNS)
def ingest_rollouts(spark: SparkSession, d: str) -> DataFrame:
    """Typed records with a payload; the session is in the file's first record, so each file holds one."""
    content = F.array(F.struct(F.lit("input_text").alias("type"), F.col("text")))
    payload = F.struct(F.lit("message").alias("type"), "role", content.alias("content"))
    line = F.to_json(F.struct(F.lit("response_item").alias("type"), F.col("ts").alias("timestamp"), payload.alias("payload")))
    lines = _turns(spark, d).groupBy("session_uuid").agg(F.collect_list(line).alias("lines"))
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("session_uuid").alias("id")).alias("payload")))
    whole = lines.select(F.pmod(F.xxhash64("session_uuid"), F.lit(64)).alias("part"), F.array_join(F.concat(F.array(meta), "lines"), "\n").alias("value"))
    path = _folder(spark, "rollouts")
    whole.drop("part").write.option("maxRecordsPerFile", 1).text(path)
    return _summary(S.parse_rollouts(S.lines_of(spark, path))[0])


@query("SELECT lower(trim(source)) AS src, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE regexp_matches(text, '[^\\s\\p{Z}]') AND n_chars < 15000 AND NOT starts_with(text, '---') AND NOT contains(text, chr(13)) AND NOT ends_with(text, chr(10)) GROUP BY ALL")
def ingest_notes(spark: SparkSession, d: str) -> DataFrame:
    """A document a Markdown file; texts with front matter or foreign line ends come back changed and are left out."""
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"[^\s\p{Z}]") & (F.col("n_chars") < 15_000) & ~F.col("text").startswith("---") & ~F.col("text").contains("\r") & ~F.col("text").endswith("\n"))
    path = _folder(spark, "notes")
    body = F.concat(F.lit("---\nsrc: "), F.coalesce(F.nullif(F.lower(F.trim("source")), F.lit("")), F.lit("~")), F.lit("\n---\n"), F.col("text"))
    docs.select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    read = spark.read.text(path, wholetext=True).select("value")
    keys, text = S.front_matter(F.regexp_replace("value", r"\n$", ""))
    src = F.nullif(F.try_element_at(keys, F.lit("src")), F.lit("~"))
    return read.groupBy(src.alias("src")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length(text)).alias("chars"))


@query()
def ingest_notes_all(spark: SparkSession, d: str) -> DataFrame:
    """Every document a Markdown file, read by parse_notes: by source the files, their events, the
    characters written and read back.  `own` files have front matter of their own; the parser takes it
    off, which is `taken` characters, and changes nothing else.  A document without text is an `empty`
    file: it has no event, so `files_read` is less by as many."""
    path = _folder(spark, "notes")
    docs = table(spark, d, "documents").select(F.lower(F.trim("source")).alias("src"), F.coalesce("text", F.lit("")).alias("text"))
    # the source is in the path, as ids may be repeated
    folder = F.concat(F.lit("s"), F.coalesce(F.hex("src"), F.lit("-")))
    named = docs.select("src", "text", F.concat(folder, F.lit("/"), F.expr("uuid()"), F.lit(".md")).alias("name"))
    written = S.write_files(named, path, "name", "text", {"src": F.col("src"), "own": S.front_matter(F.col("text"))[1] != F.col("text"), "chars": F.char_length("text")})
    put = written.groupBy("src").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("chars") == 0).alias("empty"), F.count_if("own").alias("own"), F.sum("chars").alias("chars_written"))
    read = S.parse_notes(spark, path)
    code = F.regexp_extract("file_path", r"/s([0-9A-F]*|-)/[^/]+$", 1)
    src = F.when(code != "-", F.decode(F.unhex(code), "UTF-8"))
    got = read.groupBy(src.alias("src")).agg(F.count_distinct("file_path").alias("files_read"), F.count(F.lit(1)).alias("events"), F.sum(F.char_length("text")).alias("chars_read"))
    both = put.join(got.withColumnRenamed("src", "_src"), F.col("src").eqNullSafe(F.col("_src")), "left").na.fill(0, ["files_read", "events", "chars_read"])
    return both.select("src", "files", "empty", "files_read", "own", "events", "chars_written", "chars_read", (F.col("chars_written") - F.col("chars_read")).alias("taken"))


@query("SELECT bank, count(*) AS n FROM parsed_files WHERE bank IN ('mill','fern','dune') GROUP BY bank")
def partition_pruning(spark: SparkSession, d: str) -> DataFrame:
    """Written by bank, three banks overwritten, read with a filter that prunes partitions."""
    path = _folder(spark, "by-bank")
    files = table(spark, d, "parsed_files").select("bank", "file_no")
    M.write_partitioned(files, path, ["bank"])
    M.write_partitioned(files.where(F.col("bank").isin("mill", "fern")), path, ["bank"])
    return spark.read.parquet(path).where(F.col("bank").isin("mill", "fern", "dune")).groupBy("bank").agg(F.count(F.lit(1)).alias("n"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _wall(df: DataFrame) -> DataFrame:
    """Instants as they were written, without zone."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in df.dtypes])


def _run(spark: SparkSession, stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is now and gives what it wrote last."""
    out, checkpoint = _folder(spark, name), _folder(spark, f"{name}-state")
    sink = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    running = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS bucket_start, count(*) AS n FROM events GROUP BY 1")
def stream_activity(spark: SparkSession, d: str) -> DataFrame:
    return _wall(_run(spark, live.activity(_stream(spark, d), "ts", 60), "activity"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 8 HOUR AS closes_at, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _wall(_run(spark, live.live_sessions(_stream(spark, d), "ts", ["user_id"], "8 hours"), "sessions"))


@query("SELECT count(DISTINCT (user_id, event_type, ts)) AS n FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    found = live.without_repeats(_stream(spark, d), "ts", ["user_id", "event_type", "ts"], "400 days")
    return _run(spark, found.select("user_id", "event_type", "ts"), "dedupe", "append").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY user_id")
def stream_stateful(spark: SparkSession, d: str) -> DataFrame:
    found = _run(spark, live.running_totals(_stream(spark, d), "user_id", "ts", "value", "60 days"), "totals", "update")
    last = found.groupBy("key").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))
    return last.select(F.col("key").alias("user_id"), "n", F.round("total", 4).alias("total"))


@query("SELECT 'hashing-64' AS model, 64 AS dim, count(*) AS n FROM documents WHERE length(text) >= 24")
def embed_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Every row that lacks a vector gets one."""
    docs = table(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL")
    none = spark.createDataFrame([], "doc_id long")
    vectors = E.embed(E.backlog(docs, none, "doc_id"), "doc_id", E.hashing_provider(), "hashing-64")
    return vectors.groupBy("model", "dim").agg(F.count(F.lit(1)).alias("n"))
