import json
import sqlite3

from pyspark.sql import functions as F

from skeinlake.sources import files as S
from skeinlake.sources.sqlite import read_sessions

ID = "0a1b2c3d-0000-4000-8000-00000000000a"


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), encoding="utf-8")


def test_messages(spark, tmp_path):
    say = lambda role, content, **k: {"type": role, "sessionId": ID, "timestamp": f"2026-01-01T00:00:0{k.pop('s')}.000Z", "cwd": "/w", "message": {"role": role, "content": content, "model": "m1"}}
    write(tmp_path / "p" / f"{ID}.jsonl", [
        say("user", '<channel source="mqtt" user="u">hello</channel>', s=1), "", "{bad json", {"type": "ai-title", "aiTitle": "first"}, {"type": "ai-title", "aiTitle": "last"},
        say("assistant", [{"type": "text", "text": "a"}, {"type": "tool_use", "name": "Read", "input": {"b": 1, "a": "x"}}], s=2),
        say("assistant", [{"type": "tool_use", "name": "Edit", "input": {}}], s=3), say("user", [{"type": "tool_result", "content": "out"}], s=4),
        say("assistant", [{"type": "thinking", "thinking": "hm"}], s=5), say("assistant", [], s=6),
    ])
    write(tmp_path / "p" / ID / "subagents" / "workflows" / "wf_9" / "agent-1.jsonl", [say("user", "sub", s=1)])
    events, sessions = S.parse_messages(S.lines_of(spark, str(tmp_path)))
    rows = {(r["tier"], r["seq"]): r for r in events.collect()}
    main = {k[1]: (r["role"], r["text"]) for k, r in rows.items() if k[0] == "session"}
    assert main == {1: ("user", '<channel source="mqtt" user="u">hello</channel>'), 5: ("assistant", 'a\n[tool_use Read] {"a":"x","b":1}'), 6: ("tool_use", "[tool_use Edit] {}"), 7: ("tool_result", "[tool_result] out"), 8: ("thinking", "hm")}
    assert rows["workflow_agent", 1]["text"] == "sub"
    own = {r["lines"]: r for r in sessions.collect()}[9]
    assert (own["title"], own["bad_lines"], own["description"], own["model"], own["started_at"][:19], own["ended_at"][:19]) == ("last", 1, "hello", "m1", "2026-01-01T00:00:01", "2026-01-01T00:00:06")


def test_rollouts_and_omp(spark, tmp_path):
    item = lambda p: {"type": "response_item", "timestamp": "2026-01-01T00:00:01Z", "payload": p}
    write(tmp_path / "r" / "2026" / "rollout.jsonl", [
        {"type": "session_meta", "payload": {"id": ID, "cwd": "/w"}}, {"type": "turn_context", "payload": {"model": "m"}},
        item({"type": "message", "role": "user", "content": [{"type": "input_text", "text": "<environment_context> x"}]}), item({"type": "message", "role": "user", "content": [{"type": "input_text", "text": "do it"}]}),
        item({"type": "reasoning", "summary": [{"text": "because"}]}), item({"type": "function_call", "name": "shell", "arguments": "{\"a\":1}"}), item({"type": "function_call_output", "output": "ok"}), {"type": "event_msg"},
    ])
    events, sessions = S.parse_rollouts(S.lines_of(spark, str(tmp_path / "r")))
    assert [(r["role"], r["text"]) for r in events.orderBy("seq").collect()][1:] == [("user", "do it"), ("reasoning", "because"), ("tool_use", '[tool_use shell] {"a":1}'), ("tool_result", "[tool_result] ok")]
    s = sessions.first()
    assert (s["session_uuid"], s["cwd"], s["model"], s["description"], s["lines"]) == (ID, "/w", "m", "do it", 8)
    write(tmp_path / "o" / "--w--" / f"2026_{ID}.jsonl", [
        {"type": "session", "id": ID, "cwd": "/w"}, {"type": "title", "title": "one"}, {"type": "title_change", "title": "two"}, {"type": "model_change", "model": "m"},
        {"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "hi"}]}}, {"type": "message", "message": {"role": "assistant", "content": [{"type": "toolCall", "name": "Read", "arguments": {"p": 1}}]}},
        {"type": "message", "message": {"role": "toolResult", "content": [{"type": "text", "text": "out"}]}},
    ])
    events, sessions = S.parse_omp(S.lines_of(spark, str(tmp_path / "o")))
    assert [(r["role"], r["text"]) for r in events.orderBy("seq").collect()] == [("user", "hi"), ("tool_use", '[tool_use Read] {"p":1}'), ("tool_result", "[tool_result] out")]
    assert sessions.first()["title"] == "one"


def test_notes_and_memories(spark, tmp_path):
    write(tmp_path / "v" / "n.md", ["---", "name: n", "date: 2026-01-02", "---", "intro", "## a", "x" * 60, "## b", "y" * 130])
    rows = S.parse_notes(spark, str(tmp_path / "v"), chunk=100).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(len(rows))) and all(len(r["text"]) <= 100 for r in rows)
    assert "".join(r["text"] for r in rows) == "intro\n## a\n" + "x" * 60 + "\n## b\n" + "y" * 130 and rows[0]["ts"] == "2026-01-02"
    write(tmp_path / "m" / "memory" / "k.md", ["---", "description: what", "metadata:", "  type: project", f"  originSessionId: {ID}", "---", "body"])
    memory = S.parse_notes(spark, str(tmp_path / "m"), "memory", "memory").first()
    assert (memory["text"], memory["session_uuid"], memory["kind"]) == ("what\n[project]\nbody", ID, "memory")


def test_discovery(spark, tmp_path):
    for p in (f"p/{ID}.jsonl", f"p/{ID}/subagents/a1.jsonl", f"p/{ID}/subagents/workflows/wf_2/agent-7.jsonl", f"p/{ID}/subagents/workflows/wf_2/journal.jsonl", "p/deep/er/x.jsonl"):
        write(tmp_path / "t" / p, ["{}"])
    for p in ("r/note.md", "r/node_modules/x.md", "r/memory/m.md", "r/memory/MEMORY.md"):
        write(tmp_path / "v" / p, ["x"])
    sources = S.merge_sources([S.Source("claude", str(tmp_path / "t")), S.Source("vault", str(tmp_path / "v"), "vault"), S.Source("memory", str(tmp_path / "v"), "memory"), S.Source("off", "/nowhere", enabled=False)])
    found = S.discover(spark, sources)
    got = {(r["source"], r["tier"], r["workflow_run_id"], r["agent_id"], r["path"].rsplit("/", 1)[1]) for r in found.collect()}
    assert got == {
        ("claude", "session", "", "", f"{ID}.jsonl"), ("claude", "subagent", "", "a1", "a1.jsonl"), ("claude", "workflow_agent", "wf_2", "agent-7", "agent-7.jsonl"),
        ("vault", "note", "", "", "note.md"), ("vault", "note", "", "", "m.md"), ("vault", "note", "", "", "MEMORY.md"), ("memory", "memory", "", "", "m.md"),
    }
    manifest = found.where("source = 'claude'").select("path", "mtime", (F.col("size") + (F.col("tier") == "subagent").cast("int")).alias("size"))
    assert {r["state"] for r in S.ingest_plan(found.where("source = 'claude'"), manifest).collect()} == {"changed"}


def test_registry():
    base = [S.Source("a", "/a"), S.Source("b", "/b", enabled=False)]
    assert [(s.key, s.path) for s in S.merge_sources(base, {"a"}, {"b"}, {"b": "/c"}, [S.Source("b", "/x"), S.Source("d", "/d", bank="a"), S.Source("e", "/e")])] == [("b", "/c"), ("e", "/e")]


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "s.db") as db:
        db.execute("CREATE TABLE sessions (id TEXT, cwd TEXT, title TEXT, started_at REAL, ended_at REAL)")
        db.execute("CREATE TABLE messages (id INTEGER, session_id TEXT, role TEXT, content TEXT, tool_name TEXT, timestamp REAL, active INT, compacted INT)")
        db.executemany("INSERT INTO sessions VALUES (?, '/w', 't', 1, 2)", [("s1",), ("empty",)])
        db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?, ?, ?, ?, ?)", [(1, "s1", "user", "hi", None, 10.5, 1, 0), (2, "s1", "assistant", "call", "Read", 11, 1, None), (3, "s1", "tool", "out", None, 12, 1, 0), (4, "s1", "user", "old", None, 9, 0, 0), (5, "empty", "user", "x", None, 9, 1, 1)])
    events, sessions = read_sessions(spark, str(tmp_path))
    assert [(r["seq"], r["role"], r["text"], r["ts"]) for r in events.orderBy("seq").collect()][0] == (1, "user", "hi", "1970-01-01T00:00:10.500Z")
    assert [r["role"] for r in events.orderBy("seq").collect()] == ["user", "tool_use", "tool_result"]
    assert [(r["id"], r["n_rows"], r["last_at"], r["session_key"]) for r in sessions.collect()] == [("s1", 3, 12.0, None)]
