"""Queries that do the whole job: rows that narrower forms leave out."""

import duckdb
import pytest

from skeinlake.operators import reports as Q
from skeinlake.plans import reference_queries as P, source_queries as N
from skeinlake.search import embedding as E


def numbered(n=60):
    return "".join(f"{i}\tline of a file\n" for i in range(1, n + 1))


NOISE = [
    (1, "u1", "tool_result", numbered(), "file-readback"),
    (2, "u2", "tool_result", "1\ta\n2\tb\n3\tc", ""),  # numbered, but short
    (3, "u3", "tool_result", "1 9 4 " * 120, ""),  # long, but not ascending
    (4, "u4", "user", numbered(), ""),
    (5, None, "tool_use", "[tool_use Edit] {}", "edit-payload"),
    (6, "u6", "reasoning", "x" + "A1b2" * 200, "binary-blob"),
    (7, "u7", "tool_result", "[tool_result] <system-reminder>", "harness-bookkeeping"),
    (8, "u8", "agent", "said", ""),
    (9, "u9", "note", None, ""),
    (10, "u10", None, "[tool_use Grep] {}", "navigation-call"),
    (11, "u11", "assistant", "word " * 200, ""),
]


@pytest.fixture(scope="module")
def noise(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("noise"))
    rows = spark.createDataFrame([r[:4] for r in NOISE], "row_no long, uid string, role string, text string")
    rows.write.parquet(f"{folder}/event_rows.parquet")
    return folder


def test_noise_is_probed_over_every_event_row(spark, noise):
    got = {r["rule"]: (r["n"], r["bytes"], r["part"]) for r in P.QUERIES["noise_probe_all"](spark, noise).collect()}
    want = {}
    for _, _, _, text, rule in NOISE:
        n, b = want.get(rule, (0, 0))
        want[rule] = (n + 1, b + len((text or "").encode()))
    assert got == {rule: (n, b, round(n / len(NOISE), 6)) for rule, (n, b) in want.items()}


def test_noise_rules_hold_for_texts_of_any_length(spark, noise):
    want = {r[0]: r[4] for r in NOISE}
    assert {r["row_no"]: r["rule"] for r in P.QUERIES["project_noise_all"](spark, noise).collect()} == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW event_rows AS SELECT * FROM read_parquet('{noise}/event_rows.parquet/*.parquet')")
    assert dict(db.execute(P.SQL["project_noise_all"]).fetchall()) == want


def test_runs_of_numbered_lines_by_brute_force(spark, tmp_path):
    import random
    import re

    draw = random.Random(7)
    texts = [draw.choice(["", "x "]) + "".join(f"{draw.choice([i, i, i, 7])}{draw.choice(['→', chr(9), ' ', ':'])}{'w' * draw.randint(1, 9)}{draw.choice([chr(10), ' ', ','])}" for i in range(draw.randint(60, 200))) for _ in range(40)]
    texts += ["7 w\n" * k + "1 a\n2 b\n3 c\n" + "w" * 500 for k in (0, 397, 398, 399, 400, 401, 402)]

    def run(t):
        n = [int(m) for m in re.findall(r"(?:^|\n|\s)(\d{1,5})(?:→|\t| )", t)][:401]
        return any(n[i + 1] == n[i] + 1 and n[i + 2] == n[i] + 2 for i in range(len(n) - 2))

    spark.createDataFrame([(i, "tool_result", t) for i, t in enumerate(texts)], "row_no long, role string, text string").write.parquet(f"{tmp_path}/event_rows.parquet")
    got = {r["row_no"]: r["rule"] == "file-readback" for r in P.QUERIES["project_noise_all"](spark, str(tmp_path)).collect()}
    assert got == {i: len(t) > 500 and run(t) for i, t in enumerate(texts)} and len(set(got.values())) == 2


HEAD = "---\ndate: 2025-01-02\nsrc: x\n---\n"
NOTES = [  # source, text, characters taken by the parser, chunks
    ("a", "plain", 0, 1),
    ("A ", HEAD + "body", len(HEAD), 1),
    ("a", "line\r\nline\r\n", 0, 1),
    ("a", "ends so\n\n", 0, 1),
    ("b/é", "---\nnot closed", 0, 1),
    ("b/é", "w" * 31_000, 0, 3),
    ("b/é", HEAD + "## one\n" + "x" * 9_000 + "\n## two\n" + "y" * 9_000, len(HEAD), 2),
    (None, "   ", 0, 1),
    (None, None, 0, 0),
    ("c", "", 0, 0),
]


def test_every_document_is_read_as_a_note(spark, tmp_path):
    rows = [(7, text, source) for source, text, _, _ in NOTES]  # ids may be repeated
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["src"]: tuple(r)[1:] for r in N.QUERIES["ingest_notes_all"](spark, str(tmp_path)).collect()}
    want = {}
    for source, text, taken, chunks in NOTES:
        src, n = source and source.strip().lower(), len(text or "")
        was = want.get(src, (0,) * 8)
        want[src] = tuple(x + y for x, y in zip(was, (1, n == 0, n > 0, taken > 0, chunks, n, n - taken, taken)))
    assert got == want


def test_all_documents_of_the_table_come_back(spark, data):
    docs = duckdb.execute(f"SELECT text FROM read_parquet('{data}/documents.parquet')").fetchall()
    import re

    bodies = [re.sub(r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", "", t or "", count=1) for (t,) in docs]
    rows = N.QUERIES["ingest_notes_all"](spark, data).collect()
    assert sum(r["files"] for r in rows) == len(docs) and sum(r["files_read"] for r in rows) == sum(bool(t) for (t,) in docs)
    assert sum(r["chars_written"] for r in rows) == sum(len(t or "") for (t,) in docs)
    assert sum(r["chars_read"] for r in rows) == sum(map(len, bodies)) < sum(r["chars_written"] for r in rows)
    assert sum(r["events"] for r in rows) >= sum(r["files_read"] for r in rows)


def test_overlap_takes_all_words_and_grams(spark, tmp_path):
    long = "q" * 200
    rows = [
        ("s", "user", "alpha beta " + long), ("s", " Human", "gamma"), ("s", "ASSISTANT ", "delta Beta"), ("s", "model", "gamma " + long), ("s", "tool_use", "alpha"),
        ("t", "user", "สวัสดี ครับ ab"), ("t", "assistant", "สวัสดีค่ะ"), ("one", "user", "alone"), (None, "user", "x"), (None, "assistant", "x"), ("z", "user", "a b"), ("z", "agent", "!"),
    ]
    spark.createDataFrame(rows, "session_uuid string, role string, text string").write.parquet(f"{tmp_path}/event_rows.parquet")
    got = {r["session_uuid"]: r["overlap"] for r in P.QUERIES["word_overlap"](spark, str(tmp_path)).collect()}
    grams = lambda x: {x[i : i + 3] for i in range(len(x) - 2)}
    a, b = grams("สวัสดีครับab"), grams("สวัสดีค่ะ")
    assert got == {"s": round(3 / 5, 6), "t": round(len(a & b) / len(a | b), 6), "z": 0.0}


def test_scripts_without_word_gaps_are_asked_for_by_characters(spark):
    texts = {1: "ก" * 30 + "ข" * 40, 2: " ".join(["สวัสดีครับ"] * 20), 3: "漢字" * 50, 4: "ก" * 20, 5: "few words", 6: "ข" * 60}
    asked = {}
    for seed in range(5):
        rows = Q.known_item_queries(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text", seed=seed).collect()
        got = {r["id"]: r["query"] for r in rows}
        assert set(got) == {1, 2, 3, 6}
        for i, q in got.items():
            assert len(q) == 32 and q in texts[i] and 10 <= texts[i].rindex(q)
            asked.setdefault(i, set()).add(q)
    assert len(asked[2]) > 1


def test_vectors_rest_on_whole_texts(spark):
    import numpy as np

    texts = {1: "a " * 1_000, 2: "a " * 1_000 + "b " * 1_000 + "c " * 500, 3: "short"}
    seen = lambda ts: np.array([[t.count(c) / len(t) for c in "abc"] for t in ts])
    rows = E.embed(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", seen, "m").collect()
    got = {r["id"]: r["embedding"] for r in rows}
    for i, v in ((1, [1, 0, 0]), (2, [1_000, 1_000, 500]), (3, [0, 0, 0])):
        assert np.allclose(got[i], np.array(v) / (np.linalg.norm(v) or 1), atol=1e-6)


def test_every_file_and_document_is_a_target(spark, data):
    n = duckdb.execute(f"SELECT count(*) FROM read_parquet('{data}/documents.parquet')").fetchone()[0]
    assert sum(P.QUERIES["method_contingency_all"](spark, data).first()) == n
    files = duckdb.execute(f"SELECT file_no FROM (SELECT file_no, count(*) OVER (PARTITION BY repo_key) AS c, min(loaded_at) OVER (PARTITION BY repo_key) AS a, max(loaded_at) OVER (PARTITION BY repo_key) AS b FROM read_parquet('{data}/parsed_files.parquet') WHERE tier = 'session' AND repo_key IS NOT NULL) WHERE a < b").fetchall()
    assert {r["file_no"] for r in P.QUERIES["neighbours_all"](spark, data).select("file_no").distinct().collect()} == {f for (f,) in files}
