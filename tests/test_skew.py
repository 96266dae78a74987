from collections import Counter

from pyspark.sql import functions as F

from skeinlake.operators import skew as K


def rows(spark):
    data = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{i % 97}", i % 11, "x", 1) for i in range(6000)]
    return spark.createDataFrame(data, "id long, key string, session long, _key string, _task int")


def side(spark):
    return spark.createDataFrame([("hot", 1, 5), ("k1", 2, 6), (None, 3, 7), ("unused", 4, 8)], "name string, id long, weight long")


def test_pack_spreads_a_heavy_key():
    placed = dict(K.pack([("hot", 500), ("b", 60), ("c", 50)], 100, 8, 200))
    assert len(set(placed["hot"])) == 5 and len(placed["b"]) == len(placed["c"]) == 1
    assert placed["b"][0] not in placed["hot"]


def test_fragments_are_even_and_whole(spark):
    df = rows(spark)
    plan = K.load_plan(df, "key", 8)
    got = K.fragment(df, "key", plan, 8, ["id"]).select("id", "__task", F.spark_partition_id().alias("p")).collect()
    assert sorted(r["id"] for r in got) == list(range(6000))
    assert all(r["p"] == r["__task"] for r in got)
    sizes = Counter(r["__task"] for r in got)
    assert max(sizes.values()) < 1.5 * 6000 / 8


def test_join_equals_the_plain_one(spark):
    df, other = rows(spark), side(spark)
    for how in ("left", "inner"):
        got = K.balanced_join(df, other, "key", "name", ["id"], 8, how).select("id", "key", "weight", "id_side").collect()
        plain = df.join(other.withColumnRenamed("id", "id_side"), F.col("key").eqNullSafe(F.col("name")), how).select("id", "key", "weight", "id_side").collect()
        assert sorted(map(str, got)) == sorted(map(str, plain))


def test_aggregate_counts_distinct_exactly(spark):
    df = rows(spark)
    got = K.balanced_aggregate(df, "key", {"n": F.count(F.lit(1)), "s": F.count_distinct("session")}, {"n": F.sum("n"), "s": F.sum("s")}, ["session"], 8)
    want = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session").alias("s"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_empty_tables(spark):
    df, other = rows(spark), side(spark)
    assert K.balanced_join(df.limit(0), other, "key", "name", ["id"], 4).count() == 0
    assert K.balanced_join(df, other.limit(0), "key", "name", ["id"], 4).count() == 6000
    empty = spark.createDataFrame([], "bank string, repo_key string, session_uuid string, text string, share string")
    shards = spark.createDataFrame([], "bank string, repo string")
    assert K.repo_profile(empty, shards, 4).count() == 0
