"""Derivations of one row, as Column expressions: names, ids, paths, envelopes, noise, scripts.

All stay in the JVM.  Lengths and cuts count code points (the files' own tools
count UTF-16 units; the two differ for characters beyond the basic plane only).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

MAX_TEXT, MAX_CALL, MAX_RESULT, MAX_NAME = 16_000, 2_000, 4_000, 70

# Openings of texts that a host writes, not a person.
HOST_PREAMBLES = [
    r"#\s*AGENTS\.md instructions\b", r"<recommended_plugins>", r"<codex_internal_context\b",
    r"You have oh-my-codex installed\b", r"<INSTRUCTIONS>", r"<environment_context>",
]
# Tags whose content is read later and that are therefore kept.
KEPT_TAGS = ["command-name", "command-message", "command-args", "local-command-caveat", "local-command-stdout", "local-command-stderr"]
# Turns that reach a session from elsewhere, and turns its harness writes.
INBOUND_TURNS = [
    r"^Another Claude session sent a message:", r"^<teammate-message\b", r"^<task-notification>",
    r"^\s*Continue from where you left off\.?\s*$", r"^This session is being continued from a previous conversation",
]
HARNESS_TURNS = [
    r"^<command-(message|name|args)>", r"^Base directory for this skill:", r"^<local-command-(caveat|stdout)>",
    r"^Caveat: The messages below were generated", r"^<system-reminder>", r"^<bash-stdout>", r"^<bash-stderr>",
]
# Shapes of encoded data, and tool names of noise rules.
BLOB_SHAPES = [
    r"[A-Za-z0-9+/]{120,}={0,2}", r"\b[0-9a-fA-F]{120,}\b", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{20,}\.",
    r"(?i)\bdata:[a-z.+-]+\/[a-z.+-]+;base64,",
]
EDIT_TOOLS, NAVIGATION_TOOLS = "Edit|Write|MultiEdit|NotebookEdit", "Read|Glob|LS|Grep|TodoWrite"
PROSE_ROLES = ["user", "assistant", "thinking", "system"]
# Forge hosts whose path segment begins host/org/repository.
FORGES = ["github.com", "gitlab.com", "bitbucket.org", "codeberg.org"]
# Frequent English words that tell prose from code in Latin letters.
ENGLISH_WORDS = (
    "the and to of in is it that for on with this be are was as not you we can if or but have at by from so what do an "
    "will my your no should would there which when how about all just they them it's don't i'm you're"
).split()
# Code point ranges of the script classes, as inner parts of a regex class.
SCRIPT_RANGES = {
    "thai": r"\x{0E00}-\x{0E7F}",
    "latin": r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{1E00}-\x{1EFF}",
    "cjk": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}",
    "hangul": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}",
    "cyrillic": r"\x{0400}-\x{04FF}",
    "arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}",
    "indic": r"\x{0900}-\x{0DFF}",
    "sea": r"\x{0E80}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}",
}
# Scripts whose words have no gaps between them.
GAPLESS = SCRIPT_RANGES["thai"] + SCRIPT_RANGES["cjk"] + SCRIPT_RANGES["sea"]
# Classes of languages in the order of reports.
LANGUAGE_CLASSES = ["th", "th+en", "en", "latin", "zh/ja", "ko", "cyrillic", "arabic", "indic", "lo/km/my", "other", "none"]
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def any_match(text: Column, shapes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(s) for s in shapes])


def squeeze(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate(text: Column, most: int = MAX_TEXT) -> Column:
    over = F.char_length(text) - most
    return F.when(over <= 0, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...[+"), over.cast("string"), F.lit("]")))


def uid_of(source: Column, key: Column, seq: Column) -> Column:
    return F.sha1(F.concat_ws("\x1f", source, key, seq.cast("string")))


def tree_key_of(path: Column) -> Column:
    """What names a file within its session tree, wherever the tree lies."""
    parts = F.split(path, "/")
    n = F.size(parts)
    at = lambda back: F.element_at(parts, -back)
    tail = lambda k: F.array_join(F.slice(parts, -k, k), "/")
    return (
        F.when((n >= 5) & (at(3) == "workflows") & (at(4) == "subagents"), tail(5))
        .when((n >= 3) & (at(2) == "subagents"), tail(3))
        .otherwise(at(1))
    )


def kind_of(tier: Column, source: Column) -> Column:
    return (
        F.when(source.startswith("hermes"), "message").when(tier.isin("note", "memory"), tier).otherwise("transcript")
    )


def is_host_preamble(text: Column) -> Column:
    return any_match(text, [rf"(?i)^\s*{p}" for p in HOST_PREAMBLES])


def strip_envelope(text: Column) -> Column:
    """The text without up to eight leading tags (their content stays) and without channel tags."""
    # the end of a word in ASCII letters, whatever letters follow
    opening = r"^\s*<([a-zA-Z][\w-]*)(?<=\w)(?!\w)[^>]*(?:>|$)"

    def peel(acc: Column, _: Column) -> Column:
        tag, whole = F.regexp_extract(acc, opening, 1), F.regexp_extract(acc, opening, 0)
        rest = F.substr(acc, F.char_length(whole) + 1)
        close = F.concat(F.lit("</"), tag, F.lit(">"))
        at = F.position(close, rest)
        inner = F.when(at > 0, F.concat(F.substr(rest, F.lit(1), at - 1), F.lit(" "), F.substr(rest, at + F.char_length(close)))).otherwise(rest)
        return F.when((tag == "") | F.lower(tag).isin(KEPT_TAGS) | is_host_preamble(acc), acc).otherwise(inner)

    peeled = F.aggregate(F.sequence(F.lit(1), F.lit(8)), text, peel)
    clean = F.regexp_replace(peeled, r"(?i)</?channel(?=[\s>])[^>]*>", " ")
    return F.when(clean == text, text).otherwise(F.regexp_replace(clean, r"^\s+|\s+$", ""))


def channel_facets(text: Column) -> Column:
    """A struct of the attributes of a leading channel tag, null if there is none with a source."""
    inside = F.regexp_extract(text, r"^\s*<channel(?=[\s>])([^>]*)(?:>|$)", 1)
    first = lambda name: F.regexp_extract(inside, rf'(?<![\w-]){name}="([^"]*)"', 1)
    facets = F.struct(
        first("source").alias("via"), first("chat_id").alias("chat_id"), first("message_id").alias("msg_id"),
        first("user").alias("from_user"), first("user_id").alias("from_user_id"), first("ts").alias("sent_ts"),
    )
    return F.when(first("source") != "", facets)


def via_label(via: Column) -> Column:
    return F.regexp_replace(via, r"^plugin:[^:]*:(.+)$", "$1")


def sender_of(from_user: Column, via: Column) -> Column:
    return F.when(from_user != "", F.concat(from_user, F.lit(" ("), via_label(via), F.lit(")"))).otherwise(via_label(via))


def said_text(text: Column) -> Column:
    facets = channel_facets(text)
    said = F.concat(sender_of(facets["from_user"], facets["via"]), F.lit(": "), strip_envelope(text))
    return F.when(facets.isNotNull(), said).otherwise(text)


def _plain_repo(name: Column) -> Column:
    return F.regexp_replace(name, r"\.(wt-.*|omx-worktrees|worktrees)$", "")


def repo_key_of(cwd: Column, forges: list[str] = FORGES) -> Column:
    """host/org/repository of a path, null if it shows none."""
    hosts = "|".join(h.replace(".", r"\.") for h in forges)
    triple = rf"(?:^|/)({hosts})/([^/]+)/([^/]+)"
    tree = r"(?:^|/)incubate/worktrees/([^/]+)/([^/]+)"
    part = lambda rx, i: F.regexp_extract(cwd, rx, i)
    return F.when(part(triple, 1) != "", F.concat_ws("/", part(triple, 1), part(triple, 2), _plain_repo(part(triple, 3)))).when(
        part(tree, 1) != "", F.concat_ws("/", F.lit("github.com"), part(tree, 1), _plain_repo(part(tree, 2)))
    )


def context_of(cwd: Column, forges: list[str] = FORGES) -> Column:
    """Struct (worktree, subpath) of a path inside a repository."""
    hosts = "|".join(h.replace(".", r"\.") for h in forges)
    inside = rf"(?:^|/)(?:{hosts})/[^/]+/([^/]+)(?:/(.*))?$"
    repo, rest = F.regexp_extract(cwd, inside, 1), F.regexp_replace(F.regexp_extract(cwd, inside, 2), r"/+$", "")
    marker = F.regexp_extract(repo, r"\.(wt-.*|omx-worktrees|worktrees)$", 1)
    head = F.regexp_extract(rest, r"^([^/]+)", 1)
    second = F.regexp_extract(rest, r"^[^/]+/([^/]+)", 1)
    lab = F.regexp_extract(rest, r"^ψ/lab/([^/]+)", 1)
    tree = (
        F.when(marker.startswith("wt-"), marker).when(marker != "", F.coalesce(F.nullif(head, F.lit("")), marker))
        .when((head == "wt") & (second != ""), second).when((head == "agents") & (second != ""), F.concat(F.lit("agents/"), second))
        .when(lab != "", F.concat(F.lit("lab/"), lab)).otherwise("")
    )
    return F.struct(tree.alias("worktree"), rest.alias("subpath"))


def remote_to_key(url: Column) -> Column:
    """host/org/repository of a remote's URL (https, ssh or scp-like), else null."""
    shape = r"^(?:\w+://)?(?:[^@/]+@)?([\w.-]+)(?::\d+)?[:/]([^/]+)/([^/]+?)(?:\.git)?/?$"
    part = lambda i: F.regexp_extract(F.trim(url), shape, i)
    return F.when(part(3) != "", F.concat_ws("/", part(1), part(2), part(3)))


def session_id_of_path(path: Column) -> Column:
    found = F.lower(F.regexp_extract(path, UUID, 0))
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.when(found != "", found).otherwise(name)


def looks_like_id(text: Column) -> Column:
    return text.rlike(r"^[0-9a-fA-F-]{6,36}$")


def name_of(title: Column, description: Column) -> Column:
    """What a session is called: title, slash command, or its cleaned first words."""
    d = F.coalesce(description, F.lit(""))
    command = F.regexp_extract(d, r"<command-name>\s*(/?[\w:-]+)\s*</command-name>", 1)
    args = F.trim(F.regexp_extract(d, r"(?s)<command-args>(.*?)</command-args>", 1))
    called = F.substring(squeeze(F.concat_ws(" ", command, F.nullif(args, F.lit("")))), 1, MAX_NAME)
    bare = strip_envelope(F.regexp_replace(d, r"\.\.\.\[\+\d+\]$", ""))
    clean = bare
    for shape in (r"(?s)<local-command-caveat>.*$", r"(?s)^\s*Caveat: The messages below were generated.*$"):
        clean = F.regexp_replace(clean, shape, "")
    for shape in (r"(?i)<image\b[^>]*>", r"<[^>]{1,40}>"):
        clean = F.regexp_replace(clean, shape, " ")
    clean = F.substring(squeeze(clean), 1, MAX_NAME)
    untitled = F.lit("(untitled)")
    return (
        F.when(F.trim(title) != "", F.trim(title)).when(command != "", called)
        .when(is_host_preamble(d) | is_host_preamble(bare) | (clean == ""), untitled).otherwise(clean)
    )


def snippet(text: Column, query: str, before: int = 60, width: int = 160) -> Column:
    """A window around the first match in any case, else the beginning."""
    at = F.position(F.lit(query.lower()), F.lower(text))
    start = F.when(at > 0, F.greatest(F.lit(1), at - before)).otherwise(F.lit(1))
    return squeeze(F.substr(text, start, F.lit(width)))


def encode_project_dir(cwd: Column) -> Column:
    return F.translate(cwd, "/.", "--")


def encode_omp_dir(cwd: Column) -> Column:
    return F.concat(F.lit("--"), F.translate(F.regexp_replace(cwd, r"^/+|/+$", ""), "/", "-"), F.lit("--"))


def ephemeral_hint(text: Column) -> Column:
    """structural, weak or null: does the text name a path that won't last?"""
    return (
        F.when(text.rlike(r"/claude-\d+/|/scratchpad/"), "structural")
        .when(text.rlike(r"""(?:^|\s|["'`(=])/(?:private/)?tmp/|\$XDG_RUNTIME_DIR\b"""), "weak")
    )


def has_numbered_lines(text: Column) -> Column:
    """Three numbers in a row that count up by one, as in a listing of a file, among
    the first 401 that begin a line or stand apart (the bound is part of the rule)."""
    found = F.slice(F.regexp_extract_all(text, F.lit(r"(?:^|\n|\s)(\d{1,5})(?:→|\t| )"), 1), 1, 401)
    numbers = F.transform(found, lambda x: x.cast("int"))
    ascending = F.exists(
        F.sequence(F.lit(0), F.size(numbers) - 3),
        lambda i: (F.get(numbers, i + 1) == F.get(numbers, i) + 1) & (F.get(numbers, i + 2) == F.get(numbers, i) + 2),
    )
    return F.when(F.size(numbers) >= 3, ascending).otherwise(F.lit(False))


def is_blob(text: Column) -> Column:
    return text.rlike(r"[^ \t-\r]{120,}") & any_match(text, BLOB_SHAPES)


def noise_rule(text: Column, role: Column) -> Column:
    """The first rule by which an event is noise, '' if none; prose is never noise."""
    return (
        F.when(role.isin(PROSE_ROLES), "")
        .when((role == "tool_result") & (F.char_length(text) > 500) & has_numbered_lines(text), "file-readback")
        .when(text.rlike(rf"^\[tool_use ({EDIT_TOOLS})\]"), "edit-payload")
        .when(text.rlike(rf"^\[tool_use ({NAVIGATION_TOOLS})\]"), "navigation-call")
        .when(is_blob(text), "binary-blob")
        .when(text.rlike(r'^\[tool_result\]\s*(<system-reminder>|\{"total_tokens")'), "harness-bookkeeping")
        .otherwise("")
    )


def is_inbound_turn(text: Column) -> Column:
    return any_match(text, INBOUND_TURNS)


def is_harness_turn(text: Column) -> Column:
    return is_host_preamble(text) | any_match(text, HARNESS_TURNS + INBOUND_TURNS)


def handoff_budget(role: Column, chars: Column) -> Column:
    return F.when(role == "user", chars).otherwise(F.greatest(F.lit(60), F.round(chars / 2))).cast("int")


def tool_name(text: Column) -> Column:
    return F.regexp_extract(text, r"^\[tool_use ([\w.:-]+)\]", 1)


def edited_file(text: Column) -> Column:
    return F.regexp_extract(text, r'"file_path"\s*:\s*"([^"]+)"', 1)


def script_letters(text: Column, script: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{SCRIPT_RANGES[script]}]", ""))


def other_letters(text: Column) -> Column:
    known = "".join(SCRIPT_RANGES.values())
    return F.char_length(F.regexp_replace(text, rf"[^\p{{L}}]|[{known}]|[\x{{10000}}-\x{{10FFFF}}]", ""))


def english_prose(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}(?:'[a-z]+)?"), 0)
    hits, n = F.size(F.filter(words, lambda w: w.isin(ENGLISH_WORDS))), F.size(words)
    return F.when(n <= 8, hits >= 1).otherwise((hits >= 2) & (hits / n >= 0.08))


def language_class(text: Column) -> Column:
    """The class of a text by the script of its letters.  Counts are made once for
    each text, and for ASCII texts, which have Latin letters only, not at all."""
    names = {"latin": "latin", "cjk": "zh/ja", "hangul": "ko", "cyrillic": "cyrillic", "arabic": "arabic", "indic": "indic", "sea": "lo/km/my", "other": "other"}
    counts = F.struct(*[script_letters(text, s).alias(s) for s in SCRIPT_RANGES], other_letters(text).alias("other"))

    def classify(c: Column) -> Column:
        total = reduce(lambda a, b: a + b, [c[s] for s in [*SCRIPT_RANGES, "other"]])
        most = F.greatest(*[c[s] for s in names])
        top = F.coalesce(*[F.when(c[s] == most, F.lit(name)) for s, name in names.items()])
        return (
            F.when(total == 0, "none").when(c["thai"] * 2 >= total, "th").when(c["thai"] * 10 >= total, "th+en")
            .when(most * 2 < total, "other").otherwise(top)
        )

    counted = F.get(F.transform(F.array(counts), classify), F.lit(0))
    ascii_class = F.when(text.rlike("[A-Za-z]"), "latin").otherwise("none")
    script = F.when(text.rlike(r"^\p{ASCII}*$"), ascii_class).otherwise(counted)
    refined = F.transform(F.array(script), lambda s: F.when(s == "latin", F.when(english_prose(text), "en").otherwise("latin")).otherwise(s))
    return F.when(text.isNotNull(), F.get(refined, F.lit(0)))


def tokens(text: Column, longest: int = 128) -> Column:
    """Lower-cased words of letters, marks, digits and underscores; very long ones dropped."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}_]+"), 0)
    return F.filter(found, lambda t: F.char_length(t) <= longest)


def has_gapless(text: Column) -> Column:
    return text.rlike(f"[{GAPLESS}]")


def char_ngrams(text: Column, n: int = 3) -> Column:
    """All runs of n characters of a text without its white space."""
    bare = F.regexp_replace(text, r"[\s\x0B\p{Z}]+", "")
    last = F.char_length(bare) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(bare, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def thai_tokens(text: Column) -> Column:
    """Words of a run of Thai letters, by the JVM's dictionary of Thai words."""
    return F.flatten(F.sentences(text, F.lit("th"), F.lit("TH")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


def duration_label(ms: Column) -> Column:
    """1h02m, 3m05s, 7s."""
    s = F.floor(ms / 1000)
    return (
        F.when(s >= 3600, F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
        .when(s >= 60, F.format_string("%dm%02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))
    )


#: Directories whose next segment names a project inside a repository, where the caller names no others.
PROJECT_FOLDERS = ["lab", "learn", "demos"]


def location_of(cwd: Column, forges: list[str] = FORGES, folders: list[str] = PROJECT_FOLDERS) -> Column:
    """Struct (org, repo, project, worktree, dir) of a file's path in a repository;
    dir is below the worktree and without the file.  `folders` are the directories
    below which each one is a project of its own."""
    hosts = "|".join(h.replace(".", r"\.") for h in forges)
    key = rf"(?:^|/)(?:{hosts})/([^/]+)/([^/]+)"
    context = context_of(cwd, forges)
    below = context["subpath"]
    named = F.regexp_extract(below, rf"(?:^|/)(?:{'|'.join(folders)})/([^/]+)", 1)
    incubated = F.regexp_extract(below, r"(?:^|/)incubate/[^/]+/([^/]+)", 1)
    inner = F.regexp_replace(below, r"^(?:wt|agents)/[^/]+/", "")
    folder = F.when(context["worktree"] != "", inner).otherwise(below)
    inside = F.regexp_extract(cwd, key, 2) != ""
    empty = lambda c: F.when(inside, c).otherwise("")
    return F.struct(
        empty(F.regexp_extract(cwd, key, 1)).alias("org"), empty(_plain_repo(F.regexp_extract(cwd, key, 2))).alias("repo"),
        empty(F.when(named != "", named).otherwise(incubated)).alias("project"), empty(context["worktree"]).alias("worktree"),
        empty(F.regexp_extract(folder, r"^(.+)/[^/]*$", 1)).alias("dir"),
    )


def chat_label(chat: Column) -> Column:
    return F.when(F.char_length(chat) > 8, F.concat(F.lit("#…"), F.right(chat, F.lit(6)))).otherwise(F.concat(F.lit("#"), chat))


def _listed(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")


def _more(items: Column, shown: int) -> Column:
    return F.when(F.size(items) > shown, F.concat(F.lit(" +"), (F.size(items) - shown).cast("string"))).otherwise("")


def room_tag(via: Column, chats: Column, people: Column) -> Column:
    """Where a session lived and who spoke, from its comma-joined columns; '' without a channel."""
    ways = F.array_distinct(F.transform(_listed(via), via_label))
    rooms, who = _listed(chats), _listed(people)
    room = F.when(F.size(rooms) > 0, F.concat(F.lit(" "), chat_label(F.get(rooms, F.lit(0))), _more(rooms, 1))).otherwise("")
    names = F.when(F.size(who) > 0, F.concat(F.lit(" · "), F.array_join(F.slice(who, 1, 3), ", "), _more(who, 3))).otherwise("")
    return F.when(F.size(ways) > 0, F.concat(F.lit("["), F.array_join(ways, "+"), room, names, F.lit("]"))).otherwise("")


def channel_head(facets: Column) -> Column:
    """Who, where and when of one delivery."""
    where = F.concat(via_label(facets["via"]), F.when(facets["chat_id"] != "", F.concat(F.lit(" "), chat_label(facets["chat_id"]))).otherwise(""))
    who = F.when(facets["from_user"] != "", F.concat(facets["from_user"], F.lit(" @ "), where)).otherwise(where)
    return F.concat(who, F.when(facets["sent_ts"] != "", F.concat(F.lit(" · sent "), facets["sent_ts"])).otherwise(""))


def query_keywords(query: Column) -> Column:
    """A query as it is, and its words if there are several: languages without spaces count whole."""
    whole = F.trim(query)
    words = F.filter(F.split(whole, r"\s+"), lambda w: F.char_length(w) > 1)
    return F.when(whole == "", F.array().cast("array<string>")).when(F.size(words) > 1, F.concat(F.array(whole), words)).otherwise(F.array(whole))


def same_checkout(cwd_a: Column, cwd_b: Column, forges: list[str] = FORGES) -> Column:
    """The same repository and worktree, or where there is no repository the same path."""
    a, b = repo_key_of(cwd_a, forges), repo_key_of(cwd_b, forges)
    tree = context_of(cwd_a, forges)["worktree"] == context_of(cwd_b, forges)["worktree"]
    return F.when(a.isNotNull() & b.isNotNull(), (a == b) & tree).otherwise(cwd_a == cwd_b)
