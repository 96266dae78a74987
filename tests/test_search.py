from pyspark.sql import functions as F

from skeinlake.search import embedding as E, ranking as R


def docs(spark):
    rows = [(1, "needle " * 3 + "hay " * 9), (2, "needle " + "hay " * 11), (3, "hay " * 12), (4, "Needle's eye, straw"), (5, ""), (6, None), (7, "ตัวอย่าง needle")]
    return spark.createDataFrame(rows, "id long, text string")


def test_scan_and_index_agree(spark):
    for query in ("needle", "needle straw", "NEEDLE eye hay", "nothing"):
        a = {r["id"]: round(r["score"], 9) for r in R.bm25(docs(spark), "id", "text", query).collect()}
        b = {r["id"]: round(r["score"], 9) for r in R.bm25_from_index(R.build_index(docs(spark), "id", "text"), "id", query).collect()}
        assert a == b


def test_more_of_a_word_scores_higher_and_words_widen(spark):
    one = {r["id"]: r["score"] for r in R.bm25(docs(spark), "id", "text", "needle").collect()}
    assert one[1] > one[2] and set(one) == {1, 2, 4, 7}
    assert set(one) < {r["id"] for r in R.bm25(docs(spark), "id", "text", "needle hay").collect()}
    assert R.bm25(docs(spark), "id", "text", " ?! ").count() == 0


def test_limits(spark):
    df = spark.createDataFrame([(s, i) for s in "ab" for i in range(s == "a" and 5 or 2)], "s string, i long")
    assert R.top(df, 0, [F.col("i")]).count() == 7 and R.top(df, 3, [F.col("i")]).count() == 3
    assert tuple(R.hit_totals(df, ["s"], 3).first()) == (5, 1, False)
    assert tuple(R.hit_totals(df, ["s"], 0).first()) == (7, 0, True)
    assert {(r["s"], r["capped"]) for r in R.per_scope_top(df, ["s"], 3, [F.col("i")]).collect()} == {("a", True), ("b", False)}
    assert tuple(R.hit_totals(df.limit(0), ["s"], 3).first()) == (0, 0, True)


def test_embedding_resumes_and_isolates(spark):
    rows = spark.createDataFrame([(i, f"event number {i} with enough text here") for i in range(20)] + [(99, "short")], "uid long, text string")
    vectors = spark.createDataFrame([(1,), (2,)], "uid long")
    made = E.embed(E.backlog(rows, vectors, "uid"), "uid", E.hashing_provider(16), "h").collect()
    assert {r["uid"] for r in made} == set(range(20)) - {1, 2}
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 and r["dim"] == 16 for r in made)

    def broken(texts):
        raise RuntimeError

    assert E.embed(rows, "uid", broken, "h").count() == 0
    mixed = spark.createDataFrame([("a", "m", 3), ("a", "n", 3), ("b", "m", 3)], "repo string, model string, dim int")
    assert [r["repo"] for r in E.check_model(mixed, ["repo"]).collect()] == ["a"]


def test_bootstrap_covers_the_mean(spark):
    r = R.bootstrap_interval(spark.range(400).select(F.col("id"), (F.col("id") % 10).cast("double").alias("x")), "x", 300).first()
    assert r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] < 1.0


def test_knn_in_blocks_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (60, 4)).astype(float)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(99, None)], "id long, v array<float>")
    got = {(r["query"], r["rank"]): r["neighbour"] for r in R.knn_join(df.where("id % 5 = 0"), df, "id", "id", "v", 4, 3, 7).collect()}
    want = {}
    for q in range(0, 60, 5):
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-vectors[q] @ vectors[i], i))
        want |= {(q, n + 1): i for n, i in enumerate(order[:4])}
    assert got == want
    assert R.knn_join(df.limit(0), df, "id", "id", "v", 3).count() == 0
