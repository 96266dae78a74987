"""Finding and reading transcripts, notes and memories.

Discovery lists files with Spark's binaryFile reader and selects only path, size
and time, so no content is read; the layout (tier, project, run) comes from the
path.  Readers give one events table and one sessions table per dialect; a bad
line is counted, never fatal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skeinlake.functions import text as T
from skeinlake.session import materialize

EVENT_FIELDS = ["uid", "session_uuid", "file_path", "seq", "role", "ts", "text", "source", "tier", "kind", "cwd"]


@dataclass(frozen=True)
class Source:
    """A place to read: `layout` is one of tree, flat, omp, vault, memory."""

    key: str
    path: str
    layout: str = "tree"
    bank: str | None = None
    enabled: bool = True


def merge_sources(builtin: list[Source], disable: set[str] = frozenset(), enable: set[str] = frozenset(), paths: dict[str, str] | None = None, add: list[Source] = ()) -> list[Source]:  # type: ignore[assignment]
    """The registry after a configuration; a key or bank that is taken stays with its first owner."""
    out: dict[str, Source] = {}
    for s in [*builtin, *add]:
        on = (s.enabled or s.key in enable) and s.key not in disable
        made = Source(s.key, (paths or {}).get(s.key, s.path), s.layout, s.bank or s.key, on)
        if s.key not in out and made.bank not in {x.bank for x in out.values()}:
            out[s.key] = made
    return [s for s in out.values() if s.enabled]


def discover(spark: SparkSession, sources: list[Source], since_ms: int | None = None) -> DataFrame:
    """path, mtime, size, tier, project_dir, workflow_run_id, agent_id, source, bank of all files."""
    found = None
    for s in sources:
        glob = "*.md" if s.layout in ("vault", "memory") else "*.jsonl"
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        rows = reader.load(s.path).select("path", F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"))
        rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + _escape(s.path.rstrip("/")) + "/", "")
        rows = rows.withColumn("rel", rel)
        own = _LAYOUTS[s.layout](rows).withColumns({"source": F.lit(s.key), "bank": F.lit(s.bank or s.key)})
        found = own if found is None else found.unionByName(own)
    if found is None:
        raise ValueError("no source")
    return found if since_ms is None else found.where(F.col("mtime") >= since_ms)


def _escape(path: str) -> str:
    return "".join(f"\\{c}" if c in r".^$*+?()[]{}|\\" else c for c in path)


def _common(rows: DataFrame, tier: Column, run: Column | None = None, agent: Column | None = None) -> DataFrame:
    empty = F.lit("")
    return rows.select("path", "mtime", "size", tier.alias("tier"), F.element_at(F.split("rel", "/"), 1).alias("project_dir"),
                       (empty if run is None else run).alias("workflow_run_id"), (empty if agent is None else agent).alias("agent_id"))


def _tree(rows: DataFrame) -> DataFrame:
    """<project>/<id>.jsonl, .../subagents/<agent>.jsonl, .../subagents/workflows/wf_<run>/<agent>.jsonl."""
    run = F.regexp_extract("rel", r"/subagents/workflows/(wf_[^/]+)/", 1)
    under = F.col("rel").rlike(r"(^|/)subagents/")
    tier = F.when(run != "", "workflow_agent").when(under, "subagent").otherwise("session")
    kept = rows.where(~F.col("rel").endswith("/journal.jsonl") & (under | (F.size(F.split("rel", "/")) == 2)))
    return _common(kept, tier, run, F.when(under, F.regexp_extract("rel", r"([^/]+)\.jsonl$", 1)).otherwise(""))


def _flat(rows: DataFrame) -> DataFrame:
    return _common(rows.where(F.size(F.split("rel", "/")) <= 5), F.lit("session"))


def _vault(rows: DataFrame) -> DataFrame:
    kept = rows.where(~F.col("rel").rlike(r"(^|/)(node_modules|\.git)/") & (F.size(F.split("rel", "/")) <= 13))
    return _common(kept, F.lit("note"))


def _memory(rows: DataFrame) -> DataFrame:
    return _common(rows.where(F.col("rel").rlike(r"(^|/)memory/[^/]+\.md$") & ~F.col("rel").endswith("/MEMORY.md")), F.lit("memory"))


_LAYOUTS = {"tree": _tree, "flat": _flat, "omp": lambda rows: _common(rows.where(F.size(F.split("rel", "/")) == 2), F.lit("session")), "vault": _vault, "memory": _memory}


def lines_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file_path, seq (the n-th non-empty line, from 1), v (the line as a variant, null if bad)."""
    whole = spark.read.text(paths, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    listed = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    lines = whole.select("file_path", F.posexplode(listed).alias("pos", "line"))
    return lines.select(F.regexp_replace("file_path", r"^file:/*", "/").alias("file_path"), (F.col("pos") + 1).cast("long").alias("seq"), F.try_parse_json("line").alias("v"))


def get(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is_array(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def content_text(content: Column) -> Column:
    """Text of a content that is a string or a list of blocks, tools marked."""
    def part(b: Column) -> Column:
        kind = get(b, "$.type")
        inner = get(b, "$.content", "variant")
        return (
            F.when(F.coalesce(get(b, "$.text"), F.lit("")) != "", get(b, "$.text"))
            .when(kind == "tool_use", F.concat(F.lit("[tool_use "), F.coalesce(get(b, "$.name"), F.lit("?")), F.lit("] "), T.truncate(F.coalesce(F.to_json(get(b, "$.input", "variant")), F.lit("{}")), T.MAX_CALL)))
            .when(kind == "tool_result", F.concat(F.lit("[tool_result] "), T.truncate(F.coalesce(F.when(F.schema_of_variant(inner) == "STRING", get(b, "$.content")).otherwise(F.to_json(inner)), F.lit('""')), T.MAX_RESULT)))
            .when(kind == "thinking", get(b, "$.thinking"))
        )
    blocks = F.filter(F.transform(get(content, "$", "array<variant>"), part), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(_is_array(content), F.array_join(blocks, "\n")).otherwise(F.coalesce(get(content, "$"), F.lit("")))


def block_role(content: Column) -> Column:
    """The role that blocks of one kind speak for, null for text."""
    kinds = F.array_distinct(F.filter(F.transform(get(content, "$", "array<variant>"), lambda b: get(b, "$.type")), lambda t: t.isNotNull()))
    has = lambda k: F.array_contains(kinds, k)
    return F.when(_is_array(content), F.when(has("tool_result") & ~has("text"), "tool_result").when(has("tool_use") & ~has("text"), "tool_use").when(has("thinking") & (F.size(kinds) == 1), "thinking"))


def _events(rows: DataFrame, source: str, tier: Column) -> DataFrame:
    full = rows.withColumns({"source": F.lit(source), "tier": tier, "text": T.truncate(F.col("text"))})
    full = full.withColumns({"uid": T.uid_of(F.col("source"), T.tree_key_of(F.col("file_path")), F.col("seq")), "kind": T.kind_of(F.col("tier"), F.col("source"))})
    return full.select(*EVENT_FIELDS)


def tier_of(path: Column) -> Column:
    return F.when(path.rlike("/subagents/workflows/wf_[^/]+/"), "workflow_agent").when(path.contains("/subagents/"), "subagent").otherwise("session")


def parse_messages(lines: DataFrame, source: str = "claude") -> tuple[DataFrame, DataFrame]:
    """(events, sessions) of transcripts with a message per line."""
    v, c = F.col("v"), get("v", "$.message.content", "variant")
    kind = get("v", "$.type")
    said = lines.where(v.isNotNull() & kind.isin("user", "assistant", "system"))
    text = F.when(get("v", "$.message", "variant").isNotNull(), content_text(c)).otherwise(F.coalesce(get("v", "$.content"), F.lit("")))
    events = said.select("file_path", "seq", F.coalesce(get("v", "$.sessionId"), T.session_id_of_path(F.col("file_path"))).alias("session_uuid"),
                         F.coalesce(block_role(c), get("v", "$.message.role"), kind).alias("role"), F.coalesce(get("v", "$.timestamp"), F.lit("")).alias("ts"),
                         text.alias("text"), F.coalesce(get("v", "$.cwd"), F.lit("")).alias("cwd")).where(F.col("text") != "")
    at = lambda path, pick: pick(get("v", path), F.when(get("v", path).isNotNull(), F.col("seq")))
    human = (kind == "user") & (T.strip_envelope(content_text(c)) != "") & block_role(c).isNull()
    sessions = lines.groupBy("file_path").agg(
        at("$.sessionId", F.min_by).alias("session_uuid"), at("$.cwd", F.min_by).alias("cwd"), at("$.gitBranch", F.min_by).alias("git_branch"),
        at("$.message.model", F.min_by).alias("model"), F.coalesce(at("$.customTitle", F.max_by), at("$.aiTitle", F.max_by)).alias("title"),
        F.min(get("v", "$.timestamp")).alias("started_at"), F.max(get("v", "$.timestamp")).alias("ended_at"),
        F.substring(F.min_by(F.when(human, T.strip_envelope(content_text(c))), F.when(human, F.col("seq"))), 1, 200).alias("description"),
        F.count(F.lit(1)).alias("lines"), F.count_if(v.isNull()).alias("bad_lines"))
    return _events(events, source, tier_of(F.col("file_path"))), sessions


def parse_rollouts(lines: DataFrame, source: str = "codex") -> tuple[DataFrame, DataFrame]:
    """(events, sessions) of rollouts: typed records with a payload."""
    kind, p = get("v", "$.type"), F.coalesce(get("v", "$.payload.type"), F.lit(""))
    content = get("v", "$.payload.content", "variant")
    call = F.concat(F.lit("[tool_use "), F.coalesce(get("v", "$.payload.name"), F.lit("?")), F.lit("] "),
                    T.truncate(F.coalesce(get("v", "$.payload.arguments"), get("v", "$.payload.input"), F.lit("{}")), T.MAX_CALL))
    output = F.concat(F.lit("[tool_result] "), T.truncate(F.coalesce(get("v", "$.payload.output"), F.lit("")), T.MAX_RESULT))
    summary = F.array_join(F.transform(get("v", "$.payload.summary", "array<variant>"), lambda b: get(b, "$.text")), "\n")
    text = F.when(p.isin("message", "agent_message"), content_text(content)).when(p == "reasoning", summary).when(p.endswith("_output"), output).when(p.endswith("_call"), call)
    role = F.when(p.isin("message", "agent_message"), F.coalesce(get("v", "$.payload.role"), F.lit("assistant"))).when(p == "reasoning", "reasoning").when(p.endswith("_output"), "tool_result").otherwise("tool_use")
    meta = lines.groupBy("file_path").agg(
        F.max(F.when(kind == "session_meta", F.coalesce(get("v", "$.payload.id"), get("v", "$.payload.session_id")))).alias("session_uuid"),
        F.min_by(get("v", "$.payload.cwd"), F.when(get("v", "$.payload.cwd").isNotNull(), F.col("seq"))).alias("cwd"),
        F.min_by(get("v", "$.payload.model"), F.when(get("v", "$.payload.model").isNotNull(), F.col("seq"))).alias("model"),
        F.min(get("v", "$.timestamp")).alias("started_at"), F.max(get("v", "$.timestamp")).alias("ended_at"),
        F.min_by(F.when((role == "user") & ~T.is_host_preamble(text), F.substring(text, 1, 200)), F.when((role == "user") & ~T.is_host_preamble(text), F.col("seq"))).alias("description"),
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("v").isNull()).alias("bad_lines"))
    rows = lines.where((kind == "response_item") & (F.coalesce(text, F.lit("")) != "")).join(meta.select("file_path", "session_uuid", F.col("cwd").alias("cwd")), "file_path")
    events = rows.select("file_path", F.col("seq") * 1000, "session_uuid", role.alias("role"), F.coalesce(get("v", "$.timestamp"), F.lit("")).alias("ts"), text.alias("text"), F.coalesce("cwd", F.lit("")).alias("cwd")).withColumnRenamed("(seq * 1000)", "seq")
    return _events(events, source, F.lit("session")), meta


def parse_omp(lines: DataFrame, source: str = "omp") -> tuple[DataFrame, DataFrame]:
    """(events, sessions) of transcripts with session, title and message records."""
    kind, role = get("v", "$.type"), get("v", "$.message.role")
    text = content_text(get("v", "$.message.content", "variant"))
    calls = F.array_join(F.transform(F.filter(get("v", "$.message.content", "array<variant>"), lambda b: get(b, "$.type") == "toolCall"), lambda b: F.concat(F.lit("[tool_use "), F.coalesce(get(b, "$.name"), F.lit("?")), F.lit("] "), T.truncate(F.coalesce(F.to_json(get(b, "$.arguments", "variant")), F.lit("{}")), T.MAX_CALL))), "\n")
    said = F.when(role == "toolResult", F.concat(F.lit("[tool_result] "), T.truncate(text, T.MAX_RESULT))).when(text != "", text).otherwise(calls)
    spoken = F.when(role == "toolResult", "tool_result").when((text == "") & (calls != ""), "tool_use").otherwise(role)
    first = lambda path, when: F.min_by(F.when(when, get("v", path)), F.when(when & get("v", path).isNotNull(), F.col("seq")))
    sessions = lines.groupBy("file_path").agg(
        first("$.id", kind == "session").alias("session_uuid"), first("$.cwd", kind == "session").alias("cwd"), first("$.model", kind == "model_change").alias("model"),
        first("$.title", kind.isin("title", "title_change")).alias("title"), F.min(get("v", "$.timestamp")).alias("started_at"), F.max(get("v", "$.timestamp")).alias("ended_at"),
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("v").isNull()).alias("bad_lines"))
    rows = lines.where((kind == "message") & (F.coalesce(said, F.lit("")) != "")).join(sessions.select("file_path", "session_uuid", "cwd"), "file_path")
    events = rows.select("file_path", "seq", "session_uuid", spoken.alias("role"), F.coalesce(get("v", "$.timestamp"), F.lit("")).alias("ts"), said.alias("text"), F.coalesce("cwd", F.lit("")).alias("cwd"))
    return _events(events, source, F.lit("session")), sessions


def front_matter(text: Column) -> tuple[Column, Column]:
    """(map of flat keys, body) of a Markdown file; nested keys count by their own name."""
    head = r"(?s)^---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"
    listed = F.filter(F.split(F.regexp_extract(text, head, 1), r"\r?\n"), lambda x: x.rlike(r"^\s*[\w-]+:\s*\S"))
    pairs = F.transform(listed, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\s*([\w-]+):", 1)).alias("k"), F.trim(F.regexp_replace(F.regexp_extract(x, r"^\s*[\w-]+:\s*(.*)$", 1), r'^"(.*)"$', "$1")).alias("v")))
    kept = F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, p: F.when(F.exists(acc, lambda q: q["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(p))))
    return F.map_from_entries(kept), F.regexp_replace(text, head, "")


def parse_notes(spark: SparkSession, paths: str | list[str], source: str = "vault", tier: str = "note", chunk: int = 15_000) -> DataFrame:
    """Events of Markdown files: notes in chunks of at most `chunk` characters, cut at headings
    of the second level where there are any; a memory is one event with its type."""
    whole = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(
        F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/").alias("file_path"), F.col("_metadata.file_modification_time").alias("mtime"), "value")
    keys, body = front_matter(F.col("value"))
    rows = whole.withColumns({"keys": keys, "body": body})
    key = lambda *names: F.coalesce(*[F.try_element_at("keys", F.lit(n)) for n in names], F.lit(""))
    ts = F.coalesce(F.nullif(key("date", "created_at", "updated", "modified"), F.lit("")), F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    if tier == "memory":
        text = F.concat_ws("\n", F.nullif(key("description"), F.lit("")), F.concat(F.lit("["), key("type"), F.lit("]")), F.trim("body"))
        parts = rows.select("file_path", F.lit(0).cast("long").alias("seq"), ts.alias("ts"), text.alias("text"), key("originSessionId").alias("session_uuid"))
    else:
        # sections are gathered into chunks greedily; one that is too long is cut hard
        sections = F.split("body", r"(?m)(?=^## )")
        pieces = F.flatten(F.transform(sections, lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.char_length(s) - 1) / chunk)).cast("int")), lambda i: F.substr(s, i * chunk + 1, F.lit(chunk)))))
        chunks = F.aggregate(pieces, F.array().cast("array<string>"), lambda acc, s: F.when((F.size(acc) > 0) & (F.char_length(F.element_at(acc, -1)) + F.char_length(s) <= chunk), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), s)))).otherwise(F.concat(acc, F.array(s))))
        parts = rows.select("file_path", ts.alias("ts"), F.lit("").alias("session_uuid"), F.posexplode(chunks).alias("pos", "text")).select("file_path", F.col("pos").cast("long").alias("seq"), "ts", "text", "session_uuid")
    return _events(parts.withColumns({"role": F.lit(tier), "cwd": F.col("file_path")}), source, F.lit(tier))


def write_files(rows: DataFrame, path: str, name: str, text: str, keep: dict[str, Column]) -> DataFrame:
    """Writes each row's text, as it is, to the file of that name below the folder `path`,
    which all executors share; gives the columns of `keep` of the rows that were written."""
    where = path if "://" in path else "file://" + path
    wide = rows.select(F.col(name).alias("_name"), F.col(text).alias("_text"), *[c.alias(k) for k, c in keep.items()])
    kept = wide.drop("_name", "_text").schema

    def run(batches):
        from pyarrow import fs

        to, root = fs.FileSystem.from_uri(where)
        made = set()
        for batch in batches:
            for n, t in zip(batch.column("_name").to_pylist(), batch.column("_text").to_pylist()):
                folder = f"{root}/{n}".rsplit("/", 1)[0]
                if folder not in made:
                    to.create_dir(folder, recursive=True)
                    made.add(folder)
                with to.open_output_stream(f"{root}/{n}") as out:
                    out.write(t.encode())
            yield batch.select(kept.names)

    return materialize(wide.mapInArrow(run, kept), "written")


def read_around(lines: DataFrame, path: str, seq: int, before: int, after: int) -> DataFrame:
    return lines.where((F.col("file_path") == path) & F.col("seq").between(seq - before, seq + after))


def ingest_plan(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files to parse again: new ones and those whose time or size changed."""
    from skeinlake.operators.sessions import disk_diff

    return disk_diff(found, manifest, "path", ["mtime", "size"]).where("state <> 'indexed'")
