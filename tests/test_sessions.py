from pyspark.sql import functions as F

from skeinlake.operators import mutations as M, sessions as S

NODE = "scope string, id string, start_ms long, end_ms long, mtime_ms long, started string, carries array<string>"


def links(spark, *nodes):
    got = S.lineage_links(spark.createDataFrame(list(nodes), NODE)).collect()
    return {(r["parent"], r["child"], r["kind"], r["via"], r["ambiguous"]) for r in got}


def node(i, start, end, mtime=None, started="other", carries=()):
    return ("s", i, start, end, end if mtime is None else mtime, started, list(carries))


def test_lineage(spark):
    assert links(spark, node("a", 0, 100_000), node("b", 103_000, 200_000, started="clear")) == {("a", "b", "clear", "mtime", False)}
    assert links(spark, node("a", 0, 100_000, 900_000), node("b", 180_000, 200_000, started="clear")) == {("a", "b", "clear", "last-event", False)}
    assert links(spark, node("a", 0, 100_000), node("b", 150_000, 200_000)) == {("a", "b", "relaunch", "mtime", False)}
    assert links(spark, node("a", 0, 100_000), node("b", 170_000, 200_000)) == set()
    assert links(spark, node("a", 0, 100_000), node("b", 50_000, 200_000, carries=["a", "x"])) == {("a", "b", "fork", "ids", False)}
    # a cleared child beats a relaunched one that is nearer; the nearer parent of two is taken
    three = links(spark, node("a", 0, 100_000), node("b", 101_000, 101_500), node("c", 104_000, 110_000, started="clear"))
    assert ("a", "b", "relaunch", "mtime", False) in three and ("b", "c", "clear", "mtime", True) in three


def test_peak_ends_before_starts(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 5, 12), ("b", 3, 3), ("c", 5, None)], "g string, s long, e long")
    assert {tuple(r) for r in S.peak_concurrency(df, ["g"], "s", "e").collect()} == {("a", 2), ("b", 0), ("c", 0)}


def test_exchanges(spark):
    turns = [
        (1, "user", "first"), (2, "assistant", "answer one"), (3, "user", "<bash-stdout> noise"), (4, "assistant", "answer two"),
        (5, "user", "<teammate-message> report"), (6, "assistant", "for the report"), (7, "user", "second"), (8, "tool_use", "x"), (9, "assistant", " "),
    ]
    df = spark.createDataFrame([("s", *t) for t in turns], "k string, seq long, role string, text string")
    assert {(r["asked"], r["answered"]) for r in S.exchanges(df, ["k"], "seq").collect()} == {("first", "answer two"), ("second", None)}
    assert [r["asked"] for r in S.exchanges(df, ["k"], "seq", 1).collect()] == ["second"]


def test_dedupe_is_by_content_not_uid(spark):
    df = spark.createDataFrame(
        [("u", "t1", "user", "a", 1), ("u", "t1", "user", "b", 2), ("v", "t1", "user", "a", 3), ("w", "", "user", "a", 4), ("w", "", "user", "z", 5), (None, None, None, None, 6)],
        "uid string, ts string, role string, text string, n long",
    )
    got = {(r["n"], r["n_copies"]) for r in S.dedupe_events(df, -F.col("n")).collect()}
    assert got == {(3, 2), (2, 1), (5, 2), (6, 1)}


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (4, 1, 3, 2)] + [("b", 9)], "g string, x long")
    got = df.groupBy("g").agg(S.upper_median("x").alias("m")).collect()
    assert {tuple(r) for r in got} == {("a", 3), ("b", 9)}


def test_neighbours_of_equal_instants_are_left_out_on_both_sides(spark):
    df = spark.createDataFrame([("k", 1, 10), ("k", 2, 20), ("k", 3, 20), ("k", 4, 30), ("x", 5, 20)], "key string, id long, at long")
    got = {tuple(r) for r in S.neighbours(df.where("id = 2"), df, ["key"], "at", "id", 5).collect()}
    assert got == {(2, "before", 1, 1), (2, "after", 1, 4)}


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/x", 1), ("/a/b/y", 2), ("/a/z", 4), ("/q", 8)], "p string, w long")
    assert {tuple(r) for r in S.path_rollup(df, "p", F.col("w")).collect()} == {("/a", 3, 7), ("/a/b", 2, 3)}
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/d/e",), ("/c/d",)], "p string")
    assert {r["p"] for r in S.outermost(roots, "p").collect()} == {"/a", "/ab", "/c/d"}


def test_disk_and_memory(spark):
    found = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", None, 5)], "path string, mtime long, size long")
    known = spark.createDataFrame([("a", 1, 5), ("b", 3, 5), ("c", None, 5)], "path string, mtime long, size long")
    assert {(r["path"], r["state"]) for r in S.disk_diff(found, known, "path", ["mtime", "size"]).collect()} == {("a", "indexed"), ("b", "changed"), ("c", "indexed")}
    memories = spark.createDataFrame([("m1", "s"), ("m2", "gone"), ("m3", ""), ("m4", None)], "id string, o string")
    sessions = spark.createDataFrame([("s",), ("s",)], "u string")
    assert {(r["id"], r["state"]) for r in S.memory_join(memories, sessions, "o", "u").collect()} == {("m1", "joined"), ("m2", "orphaned"), ("m3", "none"), ("m4", "none")}


def test_mutations(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, v string, n long")
    new = spark.createDataFrame([(2, "B", 9), (3, "C", 9)], "k long, v string, n long")
    assert {tuple(r) for r in M.upsert(old, new, ["k"]).collect()} == {(1, "a", 1), (2, "B", 9), (3, "C", 9)}
    assert {tuple(r) for r in M.update_only(old, new.select("k", "v"), ["k"]).collect()} == {(1, "a", 1), (2, "B", 2)}
    assert {tuple(r) for r in M.delete(old, new, ["k"]).collect()} == {(1, "a", 1)}
    wide = M.widen(old, spark.createDataFrame([], "k long, extra string, flag int").schema)
    assert wide.first()["extra"] == "" and wide.first()["flag"] == 0
    import pytest

    with pytest.raises(ValueError):
        M.widen(old, spark.createDataFrame([], "x array<int>").schema)
    again = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, None, 3)], "k long, v string, n long")
    assert [tuple(r) for r in M.keep_last(again, ["k"], "n").collect()] == [(1, None, 3)]
