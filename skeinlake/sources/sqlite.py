"""A Python data source for session databases in SQLite: spark.read.format("session_sqlite").

Options: path (a file or a folder), table (sessions or messages).  Each file is a
partition, read by the executor that gets it; retired messages are filtered in SQL.
"""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skeinlake.functions.text import uid_of

_SCHEMAS = {
    "sessions": "db string, id string, cwd string, git_branch string, model string, title string, started_at double, ended_at double, parent_session_id string, session_key string",
    "messages": "db string, id long, session_id string, role string, content string, tool_name string, timestamp double",
}


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str) -> None:
        self.path, self.table = path, table

    def partitions(self) -> list[InputPartition]:
        files = [self.path] if os.path.isfile(self.path) else sorted(glob.glob(f"{self.path}/**/*.db", recursive=True))
        return [InputPartition(f) for f in files] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        wanted = [c.split()[0] for c in _SCHEMAS[self.table].split(", ")][1:]
        with sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True) as db:
            have = {r[1] for r in db.execute(f"PRAGMA table_info({self.table})")}
            where = "WHERE active = 1 AND coalesce(compacted, 0) = 0" if self.table == "messages" else ""
            columns = ", ".join(c if c in have else f"NULL AS {c}" for c in wanted)
            for row in db.execute(f"SELECT {columns} FROM {self.table} {where} ORDER BY id"):
                yield (partition.value, *row)


class SessionSqlite(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_sqlite"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("table", "messages")]

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("table", "messages"))


def read_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, sessions) of databases; a session without a live message doesn't come out."""
    spark.dataSource.register(SessionSqlite)
    load = lambda t: spark.read.format("session_sqlite").option("path", path).option("table", t).load()
    from pyspark.sql import Window as W

    messages, sessions = load("messages"), load("sessions")
    ordinal = F.row_number().over(W.partitionBy("db", "session_id").orderBy("id"))
    role = F.when(F.col("role") == "tool", "tool_result").when(F.col("role") == "session_meta", "system").when((F.col("role") == "assistant") & F.col("tool_name").isNotNull(), "tool_use").otherwise(F.col("role"))
    key = F.concat("db", F.lit("#"), "session_id")
    events = messages.where(F.coalesce("content", F.lit("")) != "").select(
        uid_of(F.lit("hermes"), key, F.col("id")).alias("uid"), F.col("session_id").alias("session_uuid"), key.alias("file_path"), ordinal.cast("long").alias("seq"), role.alias("role"),
        F.date_format(F.timestamp_millis((F.col("timestamp") * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.col("content").alias("text"),
        F.lit("hermes").alias("source"), F.lit("session").alias("tier"), F.lit("message").alias("kind"))
    live = messages.groupBy("db", F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("n_rows"), F.max("timestamp").alias("last_at"))
    return events, sessions.join(live, ["db", "id"])
