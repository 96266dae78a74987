from collections import defaultdict

import regex

from skeinlake.llm import conversations as V
from skeinlake.session import table

from .canonical_brute import canon

HUMAN, AGENT = {"user", "human"}, {"assistant", "agent", "model"}


def brute(rows):
    sessions = defaultdict(list)
    for r in rows:
        if r["tier"] == "session" and r["session_uuid"] is not None:
            sessions[r["session_uuid"]].append(r)
    out = set()
    for uuid, own in sessions.items():
        turns = {}
        for r in sorted(own, key=lambda r: r["row_no"]):
            role = regex.sub(r"[^\p{L}]", "", (r["role"] or "").lower())
            if role in HUMAN | AGENT and r["text"] and regex.search(r"[\p{L}\p{Nd}]", r["text"]):
                turns.setdefault(canon(r["text"]), (r["seq"], "user" if role in HUMAN else "assistant"))
        turns = list(turns.values())
        if not turns:
            out.add((uuid, "empty"))
            continue
        seqs = [s for s, _ in turns]
        if None in seqs or len(set(seqs)) < len(seqs) or min(turns)[1] == "assistant":
            out.add((uuid, "broken"))
        elif max(turns)[1] == "user":
            out.add((uuid, "no_reply"))
    return out


def test_found_equals_brute_force(spark, data):
    rows = table(spark, data.replace("0.001", "0.01"), "event_rows")
    got = {tuple(r) for r in V.found_broken(rows).collect()}
    assert got == brute([r.asDict() for r in rows.select("row_no", "session_uuid", "tier", "role", "seq", "text").collect()])


SCHEMA = "row_no long, session_uuid string, tier string, role string, seq long, text string, ts string, bank string, _side string"


def rows(spark, *turns):
    return spark.createDataFrame([(i, s, "session", role, seq, text, ts, "b", "x") for i, (s, role, seq, text, ts) in enumerate(turns)], SCHEMA)


def test_reasons(spark):
    df = rows(
        spark,
        ("ok", " Human", 1, "hi", None), ("ok", "MODEL", 2, "yo", None), ("ok", "model", 2, "YO!", None), ("ok", "tool_use", 3, "x", None),
        ("empty", "system", 1, "x", None), ("empty", "user", 2, "?!", None), ("empty", None, 3, "x", None), ("empty", "user", 4, None, None),
        ("noseq", "user", None, "a", None), ("noseq", "agent", 2, "b", None), ("two", "user", 1, "a", None), ("two", "agent", 1, "b", None),
        ("agent", "agent", 1, "a", None), ("wait", "user", 1, "a", None), ("wait", "agent", 2, "b", None), ("wait", "human", 3, "c", None),
        (None, "user", 1, "a", None),
    )
    assert {tuple(r) for r in V.found_broken(df).collect()} == {("empty", "empty"), ("noseq", "broken"), ("two", "broken"), ("agent", "broken"), ("wait", "no_reply")}
    assert V.found_broken(df.limit(0)).count() == 0


def test_rebuild_splits_at_silence_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 4)
    turns = []
    for i in range(20):
        day = 1 if i < 11 else 9
        turns.append(("s", "user" if i % 2 == 0 else "assistant", i + 1, f"t{i}", f"2026-01-0{day}T00:{i:02d}:00.000Z"))
    turns.append(("lone", "user", 1, "x", None))
    banks = spark.createDataFrame([("b", "UTC")], "bank string, tz string")
    got = V.rebuild(rows(spark, *turns), banks).orderBy("seq").collect()
    assert [r["part"] for r in got] == [0] * 11 + [1] * 9
    assert [r["role"] for r in got][:2] == ["user", "assistant"] and {r["session_uuid"] for r in got} == {"s"}
    assert V.rebuild(rows(spark, *turns).limit(0), banks).count() == 0


def test_one_session_with_most_rows(spark):
    turns = [("hot", "user" if i % 2 == 0 else "assistant", i, f"turn {i}", None) for i in range(6000)] + [("b", "user", 1, "x", None)]
    assert {tuple(r) for r in V.found_broken(rows(spark, *turns)).collect()} == {("b", "no_reply")}


def test_unknown_spellings_are_learnt_from_their_place(spark):
    turns = []
    for i in range(30):
        turns += [("s%d" % (i % 3), role, 4 * (i // 3) + k, f"turn {i} {k}", None) for k, role in enumerate(["Visitor", "assistant", "Visitor", "Replier"])]
    turns += [("t", "user", 1, "a", None), ("t", "tracer", 2, "x", None), ("t", "tracer", 3, "y", None), ("t", "assistant", 4, "b", None)]
    df = rows(spark, *turns)
    assert {(r["plain"], r["side"]) for r in V.inferred_sides(df).collect()} == {("visitor", V.USER)}
    # what stands beside spellings that are unknown themselves stays unknown
    assert {tuple(r) for r in V.found_broken(df).collect()} == {("s0", "no_reply"), ("s1", "no_reply"), ("s2", "no_reply")}


def test_parts_and_extra_columns(spark):
    banks = spark.createDataFrame([("b", "UTC", 1), ("b", "UTC", 2)], "bank string, tz string, row_no int")
    df = rows(spark, ("s", "user", 1, "a", "2026-01-01T00:00:00.000Z"), ("s", "agent", 2, "b", "words"), ("s", "user", 3, "c", "2026-03-01 10:00:00"), ("s", "agent", 4, "c!", None), ("s", "agent", 5, "d", None))
    got = V.rebuild(df, banks).orderBy("seq").collect()
    assert [(r["seq"], r["role"], r["text"]) for r in got] == [(1, "user", "a"), (2, "assistant", "b"), (3, "user", "c"), (5, "assistant", "d")]
    assert got[2]["at_us"] == 1772359200000000 and got[1]["at_us"] is None
    assert V.found_broken(df, banks).count() == 0 and V.found_broken(df.limit(0), banks).count() == 0
