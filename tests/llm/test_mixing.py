import numpy as np
from pyspark.sql import functions as F

from skeinlake.llm import mixing as M

SCHEMA = "doc_id long, source string, lang string, topic string, n_tokens long"


def docs(spark, n=4000):
    rows = []
    for i in range(n):
        source = "a" if i % 3 else "b" if i % 2 else "c" if i % 5 else "d"
        rows.append((i, source, "en" if i % 4 else "th", f"t{i % 5}", 20 + i * 7919 % 180))
    return spark.createDataFrame([*rows, (n, None, None, None, 50), (n + 1, "zzz", "en", "t1", 50), (n + 2, "a", "en", "t1", 0)], SCHEMA)


def targets(spark):
    return spark.createDataFrame([(" A", 0.4, 1), ("b", 0.3, 4), ("c", 0.2, 3), ("d", 0.05, 1), ("gone", 0.05, 9)], "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    report = {r["source"]: r for r in M.mix_report(docs(spark), targets(spark)).collect()}
    assert set(report) == {"a", "b", "c", "d", "gone"}
    assert report["gone"]["mixed_tokens"] == 0 and all(r["most_copies"] <= r["max_repeats"] for r in report.values())
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-4
    # d can't give its share; a, b and c keep their proportions
    assert report["d"]["n_copies"] == report["d"]["n_docs"]
    for x, y in (("a", "b"), ("b", "c")):
        ratio = report[x]["mixed_tokens"] / report[y]["mixed_tokens"]
        assert abs(ratio / (report[x]["target_share"] / report[y]["target_share"]) - 1) < 0.02


def test_margins_of_languages_hold(spark):
    df = docs(spark)
    drawn = M.mix(df, targets(spark), 200_000.0)
    thai = drawn.where("lang = 'th'").agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0]
    total = drawn.agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0]
    known = df.where("source in ('a','b','c','d')")
    share = known.where("lang = 'th'").agg(F.sum("n_tokens")).first()[0] / known.agg(F.sum("n_tokens")).first()[0]
    assert abs(total / 200_000 - 1) < 0.02 and abs(thai / total - share) < 0.02
    assert [tuple(r) for r in drawn.orderBy("doc_id").collect()] == [tuple(r) for r in M.mix(df.repartition(7), targets(spark), 200_000.0).orderBy("doc_id").collect()]


def test_empty_and_null(spark):
    assert M.mix(docs(spark).limit(0), targets(spark)).count() == 0
    report = M.mix_report(docs(spark).limit(0), targets(spark)).collect()
    assert len(report) == 5 and all(r["mixed_tokens"] == 0 for r in report)
    none = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    assert M.mix(docs(spark, 10), none).count() == 0


def test_fill_and_rake():
    due = M.fill_shares(np.array([100.0, 10.0, 0.0]), np.array([0.5, 0.4, 0.1]), np.array([2.0, 2.0, 5.0]), 100.0)
    assert np.allclose(due, [80, 20, 0])
    tokens, source, lang = np.array([60.0, 40.0, 30.0, 70.0]), np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    weight = M.rake(tokens, source, [(lang, np.array([0.5, 0.5]))], np.array([100.0, 100.0]), np.array([3.0, 3.0]))
    assert np.allclose(np.bincount(source, weight * tokens), [100, 100]) and np.allclose(np.bincount(lang, weight * tokens), [100, 100], atol=1e-2)
