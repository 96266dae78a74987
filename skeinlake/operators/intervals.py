"""Overlapping, nested, touching and gapped intervals per entity.

``merge_intervals`` merges with Spark's ``session_window``, whose duration here
differs by row: an interval [start, end] is a session that begins at start and
lasts end - start plus one microsecond, so that touching intervals and intervals
without length merge natively (bounds are whole milliseconds, the microsecond is
taken off again).

One entity may hold a third of all rows, so no task gets a whole entity: sessions
are merged per (entity, time slot of the start), with Spark's merge on the map
side, and periods that run across slots are joined by a carry computed over one
summary row per (entity, slot).  The summaries of an entity are bounded by the
length of its history in slots, not by its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skeinlake.session import materialize

#: Width of a time slot.  Narrower slots split a hot entity further and make more summary rows.
SLOT_MS = 24 * 3600 * 1000


def latest_version(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key with the greatest `order`, once: a map-side combined
    max over structs.  Ties in `order` are broken by all other columns, so the
    result is the same whatever the partitioning.  Nulls in `order` come first."""
    rest = sorted(c for c in df.columns if c != key and c not in order)
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in df.columns if c != key])


def usable_intervals(df: DataFrame, start: str, end: str) -> DataFrame:
    """Drops intervals whose start is null or 0; an end that is null or before
    the start becomes the start."""
    return df.where(F.col(start).isNotNull() & (F.col(start) != 0)).withColumn(
        end, F.greatest(F.col(start), F.coalesce(F.col(end), F.col(start)))
    )


def _micros(ms: Column) -> Column:
    return F.timestamp_micros(ms * 1000)


def merge_intervals(df: DataFrame, entity: str, start: str, end: str, slot_ms: int = SLOT_MS) -> DataFrame:
    """Continuous periods: entity, start_ms, end_ms, n_intervals, work_ms (sum of
    the lengths of the intervals in the period).

    Input bounds are epoch milliseconds with start <= end (see usable_intervals);
    other columns are ignored, whatever their names.  Rows with null bounds give
    nothing.  A null entity is an entity of its own.  Repeated rows count as
    often as they occur; an empty input gives an empty result.
    """
    rows = df.select(_key(df, entity), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_t"))
    rows = rows.where(F.col("_s").isNotNull() & (F.col("_t") >= F.col("_s")))
    seconds = ((F.col("_t") - F.col("_s")).cast("decimal(18,0)") / F.lit(1000)).cast("decimal(18,6)")
    rows = rows.select(
        "_e", "_s", "_t",
        F.floor(F.col("_s") / slot_ms).alias("_slot"),
        _micros(F.col("_s")).alias("_at"),
        F.make_interval(secs=(seconds + F.lit("0.000001").cast("decimal(18,6)")).cast("decimal(18,6)")).alias("_lasts"),
    )
    merged = (
        rows.groupBy("_e", "_slot", F.session_window("_at", F.col("_lasts")).alias("_w"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_t") - F.col("_s")).alias("_work"))
        .select(
            "_e", "_slot", "_n", "_work",
            F.unix_millis("_w.start").alias("_s"),
            F.floor((F.unix_micros("_w.end") - 1) / 1000).cast("long").alias("_t"),
        )
    )
    merged = materialize(merged, "merged")  # read three times from here on
    # What earlier slots reach: a period that starts no later than that is no new one.
    by_slot = W.partitionBy("_e").orderBy("_slot")
    reach = merged.groupBy("_e", "_slot").agg(F.max("_t").alias("_reach")).select(
        "_e", "_slot", F.max("_reach").over(by_slot.rowsBetween(W.unboundedPreceding, -1)).alias("_carry")
    )
    marked = _slot_join(merged, reach).withColumn("_new", F.col("_carry").isNull() | (F.col("_s") > F.col("_carry")))
    # A period is the last new one at or before it, in its slot or an earlier one.
    within = W.partitionBy("_e", "_slot").orderBy("_s").rowsBetween(W.unboundedPreceding, 0)
    own = marked.withColumn("_own", F.max(F.when(F.col("_new"), F.col("_s"))).over(within))
    opened = own.groupBy("_e", "_slot").agg(F.max("_own").alias("_opened")).select(
        "_e", "_slot", F.max("_opened").over(by_slot.rowsBetween(W.unboundedPreceding, -1)).alias("_before")
    )
    whole = _slot_join(own, opened).withColumn("_id", F.coalesce("_own", "_before"))
    return whole.groupBy("_e", "_id").agg(
        F.max("_t").alias("end_ms"), F.sum("_n").alias("n_intervals"), F.sum("_work").alias("work_ms")
    ).select(_entity(df, entity), F.col("_id").alias("start_ms"), "end_ms", "n_intervals", "work_ms")


#: Stands for a null entity while equality decides; no text of a table holds it.
_NULL = "\0null"


def _key(df: DataFrame, entity: str) -> Column:
    """The entity as a text without nulls, so that joins by slot are plain equalities
    and everything by (entity, slot) shares one partitioning."""
    return F.coalesce(F.col(entity).cast("string"), F.lit(_NULL)).alias("_e")


def _entity(df: DataFrame, entity: str) -> Column:
    return F.when(F.col("_e") != _NULL, F.col("_e")).cast(df.schema[entity].dataType).alias(entity)


def _slot_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, ["_e", "_slot"], "left")


def gaps(periods: DataFrame, entity: str, slot_ms: int = SLOT_MS) -> DataFrame:
    """The stretches between neighbouring periods of an entity: entity, start_ms,
    end_ms.  `lead` runs within (entity, slot); the last period of a slot takes
    the first start of the next slot that has one, from the slots' summaries."""
    slotted = periods.select(_key(periods, entity), "start_ms", "end_ms", F.floor(F.col("start_ms") / slot_ms).alias("_slot"))
    first = slotted.groupBy("_e", "_slot").agg(F.min("start_ms").alias("_first")).select(
        "_e", "_slot", F.lead("_first").over(W.partitionBy("_e").orderBy("_slot")).alias("_next_slot")
    )
    following = F.lead("start_ms").over(W.partitionBy("_e", "_slot").orderBy("start_ms"))
    return (
        _slot_join(slotted.withColumn("_lead", following), first)
        .select(_entity(periods, entity), F.col("end_ms").alias("start_ms"), F.coalesce("_lead", "_next_slot").alias("end_ms"))
        .where(F.col("end_ms").isNotNull())
    )


def recorded_totals(periods: DataFrame, recorded: DataFrame, entity: str, wall: str, work: str) -> DataFrame:
    """Entities whose recorded wall time is null or not last end - first start
    (kind `wall`), or whose recorded work is null or not the sum of the lengths of
    their intervals (kind `work`): entity, kind, start_ms, end_ms."""
    true = periods.groupBy(F.col(entity).alias("_e")).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("work_ms").alias("_work")
    )
    said = recorded.select(F.col(entity).alias("_r"), F.col(wall).alias("_said_wall"), F.col(work).alias("_said_work"))
    both = true.join(said, F.col("_e").eqNullSafe(F.col("_r")))
    wrong = F.filter(
        F.array(
            F.when(~F.col("_said_wall").eqNullSafe(F.col("end_ms") - F.col("start_ms")), F.lit("wall")),
            F.when(~F.col("_said_work").eqNullSafe(F.col("_work")), F.lit("work")),
        ),
        lambda kind: kind.isNotNull(),
    )
    return both.select(F.col("_e").alias(entity), F.explode(wrong).alias("kind"), "start_ms", "end_ms")


def interval_report(groups: DataFrame, recorded: DataFrame) -> DataFrame:
    """Periods, gaps and wrong recorded totals of all chains: chain_id, kind,
    start_ms, end_ms.  `groups` are versions of intervals (group_id, chain_id,
    start_ms, end_ms, loaded_at), of which the last loaded counts."""
    versions = groups.select("group_id", "chain_id", "start_ms", "end_ms", "loaded_at")
    counted = usable_intervals(latest_version(versions, "group_id", ["loaded_at"]), "start_ms", "end_ms")
    periods = materialize(merge_intervals(counted, "chain_id", "start_ms", "end_ms"), "periods")
    columns = ["chain_id", "kind", "start_ms", "end_ms"]
    return (
        periods.withColumn("kind", F.lit("period")).select(columns)
        .unionByName(gaps(periods, "chain_id").withColumn("kind", F.lit("gap")).select(columns))
        .unionByName(recorded_totals(periods, recorded, "chain_id", "wall_ms", "work_ms").select(columns))
    )
