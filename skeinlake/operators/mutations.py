"""Upserts, updates, deletes and widening of tables kept as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F, types as T


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by `order`, combined on the map side."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(order, *sorted(c for c in rest if c != order))).alias("_r")
    return rows.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in: matched keys replaced, others added."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def update_only(old: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """old with columns of patch where the key matches; nothing is added."""
    given = [c for c in patch.columns if c not in keys]
    right = patch.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in given])
    joined = old.join(right, keys, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in old.columns])


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def widen(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """df with the scalar columns it lacks, at "" or 0; nested ones are refused."""
    for field in wanted:
        if field.name not in df.columns:
            if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
                raise ValueError(f"{field.name} is nested and can't be added")
            df = df.withColumn(field.name, F.lit("" if isinstance(field.dataType, T.StringType) else 0).cast(field.dataType))
    return df


def write_partitioned(df: DataFrame, path: str, keys: list[str]) -> None:
    """Overwrites only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def prune_plan(indexed: DataFrame, found: DataFrame, path: str, group: list[str]) -> DataFrame:
    """What a prune would drop per group, with the part of the group it is.  Found
    is everything found anywhere, so a file that moved between groups stays."""
    gone = indexed.join(found.select(path).distinct(), path, "left_anti").groupBy(*group).agg(F.count(F.lit(1)).alias("drops"))
    return indexed.groupBy(*group).agg(F.count(F.lit(1)).alias("files")).join(gone, group, "left").select(
        *group, "files", F.coalesce("drops", F.lit(0)).alias("drops"), F.round(F.coalesce("drops", F.lit(0)) / F.col("files"), 6).alias("part"))


def sampled_pool(rows: DataFrame, strata: list[str], key: str, quota: int, seed: int = 0) -> DataFrame:
    """At most `quota` rows of each stratum, those of the least seeded hashes."""
    rank = F.row_number().over(W.partitionBy(*strata).orderBy(F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= quota).drop("_rank")
