from pyspark.sql import functions as F

from skeinlake.operators import reports as Q
from skeinlake.streaming import live


def test_audits(spark):
    log = spark.createDataFrame([("/a", "gone", "e1", "t1"), ("/a", "denied", "e2", "t2"), ("/b", "gone", "e", "t1")], "path string, rule string, error string, ts string")
    assert {tuple(r) for r in Q.skipped_paths(log).collect()} == {("/a", "denied", "e2", 2), ("/b", "gone", "e", 1)}
    events = spark.createDataFrame(
        [(f"u{i}", "[tool_use Read] {}", "tool_use") for i in range(5)] + [("z", "hello", "user"), (None, None, None)], "uid string, text string, role string")
    got = {r["rule"]: (r["n"], list(r["samples"])) for r in Q.noise_probe(events, 2).collect()}
    assert got["navigation-call"] == (5, ["[tool_use Read] {}"] * 2) and got[""][0] == 2


def test_backfill_is_idempotent(spark):
    from skeinlake.operators.mutations import update_only

    text = '<channel source="mqtt" chat_id="1" user="u">hi</channel>'
    schema = "row_no long, role string, text string, " + ", ".join(f"{c} string" for c in Q.FACETS)
    rows = spark.createDataFrame([(1, "user", text, *[""] * 6), (2, "user", text, "mqtt", "1", "", "u", "", None), (3, "user", "<channel-id>", *[None] * 6), (4, "assistant", text, *[""] * 6)], schema)
    plan = Q.backfill_plan(rows)
    assert [(r["row_no"], r["via"], r["from_user"]) for r in plan.collect()] == [(1, "mqtt", "u")]
    assert Q.backfill_plan(update_only(rows, plan, ["row_no"])).count() == 0


def test_marks_and_trees(spark):
    marks = spark.createDataFrame([("s", x) for x in (0, 3_000, 5_001, 9_000, 10_003, 10_003)], "k string, ms long")
    assert sorted(r["ms"] for r in Q.collapse_marks(marks, ["k"], "ms").collect()) == [0, 5_001, 10_003]
    links = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21), (20, 22)], "parent long, child long")
    got = {tuple(r) for r in Q.lineage_trees(links).collect()}
    assert got == {(i, 0, i) for i in range(10)} | {(20, 20, 0), (21, 20, 1), (22, 20, 1)}
    assert Q.lineage_trees(links.limit(0)).count() == 0
    nodes = spark.createDataFrame([("p", None, 1), ("c", "p", 2), ("x", "lost", 4)], "id string, up string, n long")
    assert {tuple(r) for r in Q.fold_spawns(nodes, "id", "up", ["n"]).collect()} == {("p", 1, 3), ("x", 0, 4)}


def test_small_reports(spark):
    paths = spark.createDataFrame([("/a/bc",), ("/a/bd/e",), ("/a/b",)], "p string")
    assert Q.common_prefix(paths, "p").first()["prefix"] == "/a/b"
    found = spark.createDataFrame([("/r/a", "t2"), ("/r/b", "t3"), ("/q/c", "t9")], "path string, at string")
    assert tuple(Q.current_session(found, F.col("path").startswith("/r/"), "at").first()) == ("/r/b", "t3", False)
    shares = spark.createDataFrame([("en", 90), ("th", 10)], "class string, chars long")
    assert tuple(Q.model_advice(shares).first()) == (0.1, True, "th,en")
    lag = Q.index_lag(spark.createDataFrame([("a", 9_000)], "k string, n long"), spark.createDataFrame([("a", 10_000), ("b", 500)], "k string, n long"), ["k"])
    assert {tuple(r) for r in lag.collect()} == {("a", 1000, True), ("b", 500, False)}
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(5 + i))) for i in range(20)], "id long, text string")
    asked = {r["id"]: r["query"] for r in Q.known_item_queries(docs, "id", "text").collect()}
    assert asked and all(8 <= len(q.split()) <= 12 for q in asked.values()) and all(f" {q} " in " " + " ".join(f"w{j}" for j in range(5 + i)) + " " for i, q in asked.items())


def test_streams_over_files_that_come_later(spark, tmp_path):
    schema = "k string, at timestamp, v double"
    write = lambda rows: spark.createDataFrame(rows, "k string, at string, v double").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.upsert_batches(live.without_repeats(stream, "at", ["k", "at"], "1 hour"), lambda df, _: seen.extend(r["k"] for r in df.collect()), str(tmp_path / "state")).awaitTermination()

    write([("a", "2026-01-01 00:00:00", 1.0), ("a", "2026-01-01 00:00:00", 1.0)])
    run()
    assert seen == ["a"]
    write([("a", "2026-01-01 00:00:00", 1.0), ("b", "2026-01-01 00:00:01", 1.0)])
    run()
    assert sorted(seen) == ["a", "b"]
    recent = live.recent_sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "at", "k")
    out = []
    recent.writeStream.outputMode("complete").foreachBatch(lambda df, _: out.append({(r["k"], r["n"]) for r in df.collect()})).trigger(availableNow=True).start().awaitTermination()
    assert out[-1] == {("a", 3), ("b", 1)}
