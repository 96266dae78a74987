"""Per-key work when a few keys hold most rows: fragment and replicate by load.

The load of every key is counted (combined on the map side).  Each task should
get total / tasks rows.  A key above that is split into as many shards as it
needs, a middling key is packed with others onto the least loaded tasks, and the
tail is spread by hash.  Only the keys that are packed go to the driver: those
above 1 % of a task's share, so at most 100 * tasks of them whatever the data.
The matching side is repeated only to the shards of the split keys.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, functions as F

from skeinlake.session import materialize

#: A key is packed, not hashed, from this part of a task's fair share of rows.
PACK_FROM = 0.01

_PLAN = "_key string, __places array<int>"


def pack(loads: list[tuple[str | None, int]], share: float, tasks: int, rest: int = 0) -> list[tuple[str | None, list[int]]]:
    """Tasks of each key: heavy keys first, shards onto the least loaded tasks.
    `rest` rows are taken as spread evenly over the tasks.  A key's shards go to
    different tasks unless it needs more shards than there are tasks."""
    heap = [(rest / tasks, task) for task in range(tasks)]
    heapq.heapify(heap)
    placed = []
    for key, rows in sorted(loads, key=lambda x: (-x[1], x[0] is not None, x[0] or "")):
        shards = min(tasks, max(1, -(-rows // max(1, int(share)))))
        taken = [heapq.heappop(heap) for _ in range(shards)]
        placed.append((key, [task for _, task in taken]))
        for load, task in taken:
            heapq.heappush(heap, (load + rows / shards, task))
    return placed


def load_plan(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """One plan row for each packed key: _key and its tasks, __places."""
    counts = materialize(df.groupBy(F.col(key).cast("string").alias("_key")).agg(F.count(F.lit(1)).alias("_rows")), "loads")
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    share = max(1.0, total / tasks)
    heavy = [(r["_key"], r["_rows"]) for r in counts.where(F.col("_rows") >= share * PACK_FROM).collect()]
    placed = pack(heavy, share, tasks, total - sum(n for _, n in heavy))
    return df.sparkSession.createDataFrame(placed, _PLAN)


def _places(df: DataFrame, key: str, plan: DataFrame, tasks: int) -> DataFrame:
    """df with __places.  The plan is broadcast: it has at most tasks / PACK_FROM rows."""
    p = F.broadcast(plan.withColumnRenamed("_key", "__key2"))
    tail = F.array(F.pmod(F.xxhash64(F.lit("tail"), F.col(key).cast("string")), F.lit(tasks)).cast("int"))
    joined = df.join(p, F.col(key).cast("string").eqNullSafe(F.col("__key2")), "left").drop("__key2")
    return joined.withColumn("__places", F.coalesce("__places", tail))


def fragment(df: DataFrame, key: str, plan: DataFrame, tasks: int, spread: list[str]) -> DataFrame:
    """df with `__task`, partitioned so that task i has exactly the rows of __task i.
    A hash of the columns `spread` divides the rows of a split key evenly; it is
    a function of the row, so a task that is run again gives the same rows."""
    at = F.pmod(F.xxhash64(*spread), F.size("__places")).cast("int")
    return (
        _places(df, key, plan, tasks).withColumn("__task", F.get("__places", at)).drop("__places")
        .repartitionById(tasks, F.col("__task"))
    )


def replicate(side: DataFrame, key: str, plan: DataFrame, tasks: int) -> DataFrame:
    """The matching side, each row once for each task that works on its key."""
    return _places(side, key, plan, tasks).withColumn("__task", F.explode("__places")).drop("__places").repartitionById(tasks, F.col("__task"))


def balanced_join(
    df: DataFrame, side: DataFrame, key: str, side_key: str, spread: list[str], tasks: int | None = None, how: str = "left"
) -> DataFrame:
    """df joined with side on key (nulls match nulls), without one task for one
    key: df is fragmented, side replicated to the fragments only.  `how` is inner
    or left.  Columns of side that clash with df's get the suffix `_side`.  Every
    row of df is in one fragment, so the result is that of the plain join, with
    empty tables on either side as well.
    """
    tasks = tasks or tasks_of(df)
    plan = load_plan(df, key, tasks)
    side = side.withColumnsRenamed({c: f"{c}_side" for c in side.columns if c in df.columns})
    side_key = f"{side_key}_side" if side_key in df.columns else side_key
    left = fragment(df, key, plan, tasks, spread)
    right = replicate(side, side_key, plan, tasks).withColumnRenamed("__task", "__task2")
    on = (F.col("__task") == F.col("__task2")) & F.col(key).eqNullSafe(F.col(side_key))
    return left.join(right, on, how).drop("__task", "__task2")


def balanced_aggregate(
    df: DataFrame, key: str, partial: dict[str, Column], final: dict[str, Column], spread: list[str], tasks: int | None = None
) -> DataFrame:
    """Per-key aggregates in two stages: partial by (key, task) where the fragment
    lies, then final over at most `tasks` rows a key.  To count distinct values
    exactly, spread by them and add up.  Extra columns are ignored; a null key is
    a key of its own; an empty table gives an empty result."""
    tasks = tasks or tasks_of(df)
    plan = load_plan(df, key, tasks)
    parts = fragment(df, key, plan, tasks, spread).groupBy(key, "__task").agg(*[c.alias(n) for n, c in partial.items()])
    return parts.groupBy(key).agg(*[c.alias(n) for n, c in final.items()])


def tasks_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def repo_profile(rows: DataFrame, shards: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per repository over all banks: rows, characters, distinct sessions, share
    of all rows, and how many shards list it (null if none)."""
    narrow = rows.select("repo_key", "session_uuid", F.char_length("text").alias("chars"))
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("_total")))
    per_key = balanced_aggregate(
        narrow,
        "repo_key",
        {"n": F.count(F.lit(1)), "chars": F.sum("chars"), "sessions": F.count_distinct("session_uuid")},
        {"n_rows": F.sum("n"), "chars": F.sum("chars"), "sessions": F.sum("sessions")},
        ["session_uuid"],
        tasks,
    )
    listed = shards.groupBy(F.col("repo").alias("_repo")).agg(F.count(F.lit(1)).alias("n_shards"))
    out = per_key.join(listed, F.col("repo_key").eqNullSafe(F.col("_repo")), "left").crossJoin(total)
    return out.select("repo_key", "n_rows", "chars", "sessions", "n_shards", (F.col("n_rows") / F.col("_total")).alias("share"))
