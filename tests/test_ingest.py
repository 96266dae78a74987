import json

from pyspark.sql import functions as F

from skeinlake.functions import text as T
from skeinlake.sources import files as S, ingest as I

from .test_text import one


def test_locations_and_labels(spark):
    loc = lambda p: tuple(one(spark, T.location_of(F.col("p")), p=p))
    assert loc("/x/github.com/o/r/wt/fix/src/a/b.py") == ("o", "r", "", "fix", "src/a")
    assert loc("/x/github.com/o/r/agents/7/lab/proj/n.md") == ("o", "r", "proj", "agents/7", "lab/proj")
    assert loc("/x/github.com/o/r/incubate/org/inner/n.md") == ("o", "r", "inner", "", "incubate/org/inner")
    assert loc("/tmp/x") == ("", "", "", "", "")
    assert one(spark, T.chat_label(F.col("c")), c="123456789012345678") == "#…345678" and one(spark, T.chat_label(F.col("c")), c="42") == "#42"
    tag = T.room_tag(F.col("v"), F.col("c"), F.col("u"))
    assert one(spark, tag, v="plugin:a:mqtt,mqtt", c="1,2,3", u="a,b,c,d") == "[mqtt #1 +2 · a, b, c +1]" and one(spark, tag, v="", c="1", u="a") == ""
    head = T.channel_head(T.channel_facets(F.col("t")))
    assert one(spark, head, t='<channel source="plugin:a:mqtt" user="u" chat_id="9" ts="now">x') == "u @ mqtt #9 · sent now"
    assert list(one(spark, T.query_keywords(F.col("q")), q=" peak  concurrency a ")) == ["peak  concurrency a", "peak", "concurrency"]
    assert list(one(spark, T.query_keywords(F.col("q")), q="ภาษาไทย")) == ["ภาษาไทย"] and list(one(spark, T.query_keywords(F.col("q")), q=" ")) == []
    same = T.same_checkout(F.col("a"), F.col("b"))
    assert one(spark, same, a="/x/github.com/o/r/src", b="/y/github.com/o/r/doc") and not one(spark, same, a="/x/github.com/o/r/wt/f/s", b="/x/github.com/o/r/s")


def test_repo_keys(spark):
    rows = spark.createDataFrame([(1, "/w/mono/app/src"), (2, "/w/mono"), (3, "/x/github.com/O/R/s"), (4, "/tmp"), (5, None)], "id long, cwd string")
    maps = spark.createDataFrame([("/w", "k/w"), ("/w/mono/app/", "k/app")], "prefix string, key string")
    known = spark.createDataFrame([("github.com/o/r",)], "key string")
    got = {r["id"]: r["repo_key"] for r in I.resolve_repo_keys(rows, "cwd", maps, known).collect()}
    assert got == {1: "k/app", 2: "k/w", 3: "github.com/o/r", 4: "_unresolved", 5: "_unresolved"}
    sources = [S.Source("a", "/w"), S.Source("b", "/w/mono")]
    assert [one(spark, I.source_of_path(F.col("p"), sources), p=p) for p in ("/w/x", "/w/mono/x", "/wx")] == ["a", "b", None]


def test_import_is_idempotent_and_replaces(spark, tmp_path):
    def write(n):
        lines = [{"type": "user", "sessionId": "s", "timestamp": "t", "message": {"role": "user", "content": f"line {i}"}} for i in range(n)]
        lines.append({"type": "assistant", "sessionId": "s", "message": {"role": "assistant", "content": [{"type": "tool_use", "name": "Read", "input": {}}]}})
        (tmp_path / "p").mkdir(exist_ok=True)
        (tmp_path / "p" / "s.jsonl").write_text("\n".join(map(json.dumps, lines)))

    def parse(todo):
        paths = [r["path"].replace("file:", "") for r in todo.collect()]
        lines = S.lines_of(spark, paths) if paths else spark.createDataFrame([], "file_path string, seq long, v string").withColumn("v", F.try_parse_json("v"))
        return S.parse_messages(lines)[0].withColumn("file_path", F.concat(F.lit("file:"), "file_path"))

    def run(manifest, events):
        found = S.discover(spark, [S.Source("claude", str(tmp_path))])
        events, manifest, skipped = I.import_files(found, manifest, events, parse)
        rows = lambda df, c: spark.createDataFrame(df.select(*c).collect(), df.select(*c).schema)
        return rows(manifest, ["path", "mtime", "size"]), rows(events, S.EVENT_FIELDS), skipped.count()

    manifest = spark.createDataFrame([], "path string, mtime long, size long")
    events = parse(spark.createDataFrame([], "path string, mtime long, size long"))
    write(3)
    manifest, events, skipped = run(manifest, events)
    assert (events.count(), skipped, manifest.count()) == (3, 1, 1)
    manifest, events, skipped = run(manifest, events)
    assert (events.count(), skipped, manifest.count()) == (3, 0, 1)
    write(5)
    manifest, events, skipped = run(manifest, events)
    assert (events.count(), skipped, manifest.count()) == (5, 1, 1)


def test_logs(spark, tmp_path):
    I.append_log(spark.createDataFrame([("a", 1), ("b", 2)], "q string, hits int"), str(tmp_path / "log"))
    (tmp_path / "log" / "torn.json").write_text('{"q": "c", "hits": 3}\n{"q": "d", "hi')
    assert {tuple(r) for r in I.read_log(spark, str(tmp_path / "log"), "q string, hits int").collect()} == {("a", 1), ("b", 2), ("c", 3)}
    I.write_rows(spark.createDataFrame([("a", 1)], "q string, n int"), str(tmp_path / "t"), "tsv")
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).collect()] == [("a", "1")]


def test_choices(spark):
    found = spark.createDataFrame(
        [("/r/p/s1.jsonl", "s1", 5, 100, 1, 9), ("/r/p/s2.jsonl", "s2", 7, 200, 0, 9), ("/r/p/me.jsonl", "me", 1, 300, 3, 9), ("/q/p/s1.jsonl", "s1", 9, 90, 0, 1), ("/r/p/s1/subagents/a.jsonl", "s1", 1, 1, 0, 1)],
        "path string, session string, weight int, last long, human int, n int",
    )
    assert I.previous_session(found, F.col("path").startswith("/r/"), "me", "last", "human", "n").first()["path"] == "/r/p/s1.jsonl"
    assert {r["path"] for r in I.best_copies(found, "session", "weight", 0, "path").collect()} == {"/q/p/s1.jsonl", "/r/p/s2.jsonl", "/r/p/me.jsonl"}
    assert I.seek(found, "S1").count() == 3 and I.tree_files(found, "s1").count() == 3
    notes = spark.createDataFrame([("/wt/a.md", "r", "a.md", 3, True), ("/main/a.md", "r", "a.md", 3, False), ("/wt/a2.md", "r", "a.md", 4, True)], "path string, repo string, rel string, size int, wt boolean")
    assert {r["path"] for r in I.dedupe_notes(notes, ["repo", "rel", "size"], "wt").collect()} == {"/main/a.md", "/wt/a2.md"}
