"""Queries of operators over whole tables whose own columns show too few of their cases.

Cases the tables lack are put before or around every text, by the row's number, and the
same is done in the SQL, so that each rule fires on some rows and not on others.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as K

from skeinlake.functions import text as T
from skeinlake.operators import filters as P, mutations as M, reports as Q, sessions as S
from skeinlake.search import embedding as E, ranking as R
from skeinlake.session import shared_dir, table
from skeinlake.sources import files as N, ingest as I

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _nth(values: list[str], number: str) -> str:
    """In SQL the value whose turn it is by a number."""
    return f"[{', '.join(map(_text, values))}][({number} % {len(values)})::INT + 1]"


def _turn(values: list[str], number: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(F.col(number), F.lit(len(values))).cast("int"))


def _any(column: str, shapes: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {_text(s)})" for s in shapes) + ")"


# ---- texts --------------------------------------------------------------------

_SQUEEZED = r"trim(regexp_replace({}, '[\s\x0B]+', ' ', 'g'), ' ')"


@query(r"""SELECT row_no, CASE WHEN length(text) <= 120 THEN text ELSE substring(text, 1, 120) || '...[+' || (length(text) - 120) || ']' END AS cut,
 """ + _SQUEEZED.format("substring(text, CASE WHEN position('importer' IN lower(text)) > 0 THEN greatest(1, position('importer' IN lower(text)) - 60) ELSE 1 END, 160)") + " AS around FROM event_rows WHERE text IS NOT NULL")
def project_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Every text cut with its mark, and the part of it around a word."""
    rows = table(spark, d, "event_rows").where("text IS NOT NULL")
    return rows.select("row_no", T.truncate(F.col("text"), 120).alias("cut"), T.snippet(F.col("text"), "Importer").alias("around"))


_OPENINGS = ["", "# AGENTS.md instructions for x\n", "  <environment_context>", "<command-name>/go</command-name>", "<system-reminder>", "<teammate-message from=x>",
             "Continue from where you left off.", "<bash-stderr>", "<task-notification>", "said: <system-reminder>", "This session is being continued from a previous conversation"]
_PREAMBLE = [rf"(?i)^\s*{p}" for p in T.HOST_PREAMBLES]


@query(f"""WITH o AS (SELECT row_no, role, {_nth(_OPENINGS, 'row_no')} || CASE WHEN {_nth(_OPENINGS, 'row_no')} LIKE 'Continue%' THEN '' ELSE text END AS t FROM event_rows WHERE text IS NOT NULL)
SELECT row_no, {_any('t', _PREAMBLE)} AS preamble, {_any('t', T.INBOUND_TURNS)} AS inbound, {_any('t', _PREAMBLE)} OR {_any('t', T.HARNESS_TURNS + T.INBOUND_TURNS)} AS harness,
 CASE WHEN role='user' THEN length(t) ELSE greatest(60, round(length(t)/2)) END::INT AS budget FROM o""")
def project_openings(spark: SparkSession, d: str) -> DataFrame:
    """Turns that a host, a harness or another session wrote, and the room each turn gets in a handoff."""
    head = _turn(_OPENINGS, "row_no")
    t = F.concat(head, F.when(head.startswith("Continue"), "").otherwise(F.col("text")))
    rows = table(spark, d, "event_rows").where("text IS NOT NULL").select("row_no", "role", t.alias("t"))
    return rows.select("row_no", T.is_host_preamble(F.col("t")).alias("preamble"), T.is_inbound_turn(F.col("t")).alias("inbound"), T.is_harness_turn(F.col("t")).alias("harness"),
                       T.handoff_budget(F.col("role"), F.char_length("t")).alias("budget"))


_BEFORE = ["", "<a>", "<note kind=x>\n<b>", "<command-name>", "<channel source=\"q\">", "<x><y><z>", "<environment_context><a>", "<open"]
_AFTER = ["", "</a> tail", "</b></note>", "</command-name>", "</channel>", "</y></x> <CHANNEL off>", "</a>", " end"]
_TAG = r"'^\s*<([a-zA-Z][\w-]*)\b[^>]*(?:>|$)'"
_KEPT = ", ".join(map(_text, T.KEPT_TAGS))


def _peeled(name: str, source: str) -> str:
    """CTEs that take up to eight leading tags off the column t of a source (k, t): `name` (k, t0, t)."""
    return f"""{name}p AS (SELECT k, 0 AS i, t AS t0, t FROM {source} UNION ALL SELECT k, i + 1, t0,
 CASE WHEN regexp_extract(t, {_TAG}, 1) = '' OR lower(regexp_extract(t, {_TAG}, 1)) IN ({_KEPT}) OR {_any('t', _PREAMBLE)} THEN t ELSE
  CASE WHEN position('</' || regexp_extract(t, {_TAG}, 1) || '>' IN substring(t, length(regexp_extract(t, {_TAG}, 0)) + 1)) > 0
  THEN substring(substring(t, length(regexp_extract(t, {_TAG}, 0)) + 1), 1, position('</' || regexp_extract(t, {_TAG}, 1) || '>' IN substring(t, length(regexp_extract(t, {_TAG}, 0)) + 1)) - 1) || ' '
   || substring(substring(t, length(regexp_extract(t, {_TAG}, 0)) + 1), position('</' || regexp_extract(t, {_TAG}, 1) || '>' IN substring(t, length(regexp_extract(t, {_TAG}, 0)) + 1)) + length(regexp_extract(t, {_TAG}, 1)) + 3)
  ELSE substring(t, length(regexp_extract(t, {_TAG}, 0)) + 1) END END FROM {name}p WHERE i < 8),
{name}c AS (SELECT k, t0, regexp_replace(t, '(?i)</?channel(?:\\s[^>]*)?>', ' ', 'g') AS c FROM {name}p WHERE i = 8),
{name} AS (SELECT k, t0, CASE WHEN c = t0 THEN t0 ELSE regexp_replace(c, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') END AS t FROM {name}c)"""


@query(f"""WITH RECURSIVE s AS (SELECT row_no AS k, {_nth(_BEFORE, 'row_no')} || text || {_nth(_AFTER, 'row_no')} AS t FROM event_rows WHERE text IS NOT NULL), {_peeled('e', 's')}
SELECT k AS row_no, length(t) AS n, md5(t) AS stripped FROM e""")
def project_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Every text in some envelope, without it."""
    t = F.concat(_turn(_BEFORE, "row_no"), F.col("text"), _turn(_AFTER, "row_no"))
    bare = T.strip_envelope(F.col("t"))
    rows = table(spark, d, "event_rows").where("text IS NOT NULL").select("row_no", t.alias("t"))
    return rows.select("row_no", F.char_length(bare).cast("long").alias("n"), F.md5(bare).alias("stripped"))


_SAID = ["", "<command-name>/deploy</command-name> <command-args>to  mill\nnow</command-args>", "<command-name>go</command-name>", "<image src=1> ", "Caveat: The messages below were generated. ", "<a>", "# AGENTS.md instructions", "<local-command-caveat> "]


@query(rf"""WITH RECURSIVE s AS (SELECT file_no AS k, title, {_nth(_SAID, 'file_no')} || coalesce(description, '') AS d FROM parsed_files),
b AS (SELECT k, regexp_replace(d, '\.\.\.\[\+\d+\]$', '') AS t FROM s), {_peeled('e', 'b')},
c AS (SELECT k, t AS bare, substring({_SQUEEZED.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?s)<local-command-caveat>.*$', ''), '(?s)^\s*Caveat: The messages below were generated.*$', ''), '(?i)<image\b[^>]*>', ' ', 'g'), '<[^>]{1,40}>', ' ', 'g')")}, 1, {T.MAX_NAME}) AS clean FROM e),
n AS (SELECT k, regexp_extract(d, '<command-name>\s*(/?[\w:-]+)\s*</command-name>', 1) AS command, trim(regexp_extract(d, '(?s)<command-args>(.*?)</command-args>', 1)) AS args FROM s)
SELECT k AS file_no, CASE WHEN trim(title) <> '' THEN trim(title) WHEN command <> '' THEN substring({_SQUEEZED.format("concat_ws(' ', command, nullif(args, ''))")}, 1, {T.MAX_NAME})
 WHEN {_any('d', _PREAMBLE)} OR {_any('bare', _PREAMBLE)} OR clean = '' THEN '(untitled)' ELSE clean END AS name FROM s JOIN c USING (k) JOIN n USING (k)""")
def project_names(spark: SparkSession, d: str) -> DataFrame:
    """What every file is called."""
    said = F.concat(_turn(_SAID, "file_no"), F.coalesce("description", F.lit("")))
    return table(spark, d, "parsed_files").select("file_no", T.name_of(F.col("title"), said).alias("name"))


_PATHS = ["", "/tmp/x ", "see /claude-12/a ", "(/private/tmp/y) ", "my/scratchpad/z ", "$XDG_RUNTIME_DIR/q ", "a/tmp/b "]


@query(rf"""SELECT row_no, CASE WHEN regexp_matches(t, '/claude-\d+/|/scratchpad/') THEN 'structural' WHEN regexp_matches(t, '(?:^|\s|["''`(=])/(?:private/)?tmp/|\$XDG_RUNTIME_DIR\b') THEN 'weak' END AS hint,
 regexp_matches(word, '^[0-9a-fA-F-]{{6,36}}$') AS an_id FROM (SELECT row_no, {_nth(_PATHS, 'row_no')} || text AS t, string_split(text, ' ')[-1] AS word FROM event_rows WHERE text IS NOT NULL)""")
def project_hints(spark: SparkSession, d: str) -> DataFrame:
    """Texts that name a path that won't last, and whether the last word looks like an id."""
    t = F.concat(_turn(_PATHS, "row_no"), F.col("text"))
    rows = table(spark, d, "event_rows").where("text IS NOT NULL")
    return rows.select("row_no", T.ephemeral_hint(t).alias("hint"), T.looks_like_id(F.element_at(F.split("text", " "), -1)).alias("an_id"))


# ---- places -------------------------------------------------------------------

_FORGES = ["code.tarn.example", "forge.example", "git.northlab.test"]
_HOSTS = "|".join(h.replace(".", r"\.") for h in _FORGES)
_URLS = ["https://{}.git", "ssh://git@{}", "{}", "not a url", "http://me@{}/"]


@query(rf"""WITH u AS (SELECT file_no, cwd, repo_key, replace({_nth(_URLS, 'file_no')}, '{{}}', repo_key) AS url FROM parsed_files WHERE repo_key IS NOT NULL)
SELECT file_no, CASE WHEN regexp_extract(url, '^(?:\w+://)?(?:[^@/]+@)?([\w.-]+)(?::\d+)?[:/]([^/]+)/([^/]+?)(?:\.git)?/?$', 3) <> '' THEN regexp_replace(url, '^(?:\w+://)?(?:[^@/]+@)?([\w.-]+)(?::\d+)?[:/]([^/]+)/([^/]+?)(?:\.git)?/?$', '\1/\2/\3') END AS key,
 '--' || translate(regexp_replace(cwd, '^/+|/+$', '', 'g'), '/', '-') || '--' AS omp_dir FROM u""")
def project_remotes(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the URLs of remotes in several spellings, and the folder names of working directories."""
    files = table(spark, d, "parsed_files").where("repo_key IS NOT NULL")
    url = F.replace(_turn(_URLS, "file_no"), F.lit("{}"), F.col("repo_key"))
    return files.select("file_no", T.remote_to_key(url).alias("key"), T.encode_omp_dir(F.col("cwd")).alias("omp_dir"))


_TAILS = ["", "/x/y.py", ".wt-fix/src/z.py", "/wt/slow/a/b.py", "/lab/eel/n.md", "/ψ/lab/koi/m.md", ".worktrees/top/q.md", "/incubate/o/p/r.md"]
_INSIDE = rf"'(?:^|/)(?:{_HOSTS})/[^/]+/([^/]+)(?:/(.*))?$'"


@query(rf"""WITH p AS (SELECT file_no, cwd || {_nth(_TAILS, 'file_no')} AS path FROM parsed_files WHERE cwd IS NOT NULL),
r AS (SELECT *, regexp_extract(path, {_INSIDE}, 1) AS repo0, regexp_replace(regexp_extract(path, {_INSIDE}, 2), '/+$', '') AS rest FROM p),
m AS (SELECT *, regexp_extract(repo0, '\.(wt-.*|omx-worktrees|worktrees)$', 1) AS marker, regexp_extract(rest, '^([^/]+)', 1) AS head, regexp_extract(rest, '^[^/]+/([^/]+)', 1) AS second, regexp_extract(rest, '^ψ/lab/([^/]+)', 1) AS lab FROM r),
w AS (SELECT *, CASE WHEN starts_with(marker, 'wt-') THEN marker WHEN marker <> '' THEN coalesce(nullif(head, ''), marker) WHEN head = 'wt' AND second <> '' THEN second WHEN head = 'agents' AND second <> '' THEN 'agents/' || second WHEN lab <> '' THEN 'lab/' || lab ELSE '' END AS worktree FROM m),
x AS (SELECT *, regexp_extract(path, '(?:^|/)(?:{_HOSTS})/([^/]+)/([^/]+)', 1) AS org0, regexp_extract(path, '(?:^|/)(?:{_HOSTS})/([^/]+)/([^/]+)', 2) AS name0, CASE WHEN worktree <> '' THEN regexp_replace(rest, '^(?:wt|agents)/[^/]+/', '') ELSE rest END AS folder,
 regexp_extract(rest, '(?:^|/)(?:lab|learn|demos)/([^/]+)', 1) AS named, regexp_extract(rest, '(?:^|/)incubate/[^/]+/([^/]+)', 1) AS grown FROM w)
SELECT file_no, rest AS subpath, org0 AS org, CASE WHEN name0 <> '' THEN regexp_replace(name0, '\.(wt-.*|omx-worktrees|worktrees)$', '') ELSE '' END AS repo, CASE WHEN name0 = '' THEN '' WHEN named <> '' THEN named ELSE grown END AS project,
 CASE WHEN name0 <> '' THEN worktree ELSE '' END AS worktree, CASE WHEN name0 <> '' THEN regexp_extract(folder, '^(.+)/[^/]*$', 1) ELSE '' END AS dir FROM x""")
def project_places(spark: SparkSession, d: str) -> DataFrame:
    """Organisation, repository, project, worktree and folder of every file's path."""
    files = table(spark, d, "parsed_files").where("cwd IS NOT NULL").select("file_no", F.concat("cwd", _turn(_TAILS, "file_no")).alias("path"))
    at = T.location_of(F.col("path"), _FORGES)
    return files.select("file_no", T.context_of(F.col("path"), _FORGES)["subpath"].alias("subpath"), *[at[c].alias(c) for c in ("org", "repo", "project", "worktree", "dir")])


def _tree(c: str) -> str:
    """In SQL the worktree of a path, of the forms the table has."""
    key = rf"(?:^|/)(?:{_HOSTS})/[^/]+/[^/]+/"
    return f"CASE WHEN regexp_extract({c}, '{key}wt/([^/]+)', 1) <> '' THEN regexp_extract({c}, '{key}wt/([^/]+)', 1) ELSE regexp_extract({c}, '{key}(agents/[^/]+)', 1) END"


@query(rf"""WITH p AS (SELECT file_no, cwd, lag(cwd) OVER (ORDER BY file_no) AS other FROM parsed_files WHERE cwd IS NOT NULL),
k AS (SELECT *, nullif(regexp_extract(cwd, '(?:^|/)((?:{_HOSTS})/[^/]+/[^/]+)', 1), '') AS a, nullif(regexp_extract(other, '(?:^|/)((?:{_HOSTS})/[^/]+/[^/]+)', 1), '') AS b, {_tree('cwd')} AS ta, {_tree('other')} AS tb FROM p)
SELECT file_no, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a = b AND ta = tb ELSE cwd = other END AS same FROM k WHERE other IS NOT NULL""")
def same_place(spark: SparkSession, d: str) -> DataFrame:
    """Whether each file's checkout is that of the file before it."""
    files = table(spark, d, "parsed_files").where("cwd IS NOT NULL")
    before = files.select((F.col("file_no")).alias("_n"), F.col("cwd").alias("other"))
    numbers = files.select("file_no", F.lag("file_no").over(W.orderBy("file_no")).alias("_n"))  # numbers of files only
    pairs = files.select("file_no", "cwd").join(numbers, "file_no").join(before, "_n")
    return pairs.select("file_no", T.same_checkout(F.col("cwd"), F.col("other"), _FORGES).alias("same"))


@query("""WITH m AS (SELECT DISTINCT cwd AS prefix, 'mapped/' || bank AS key FROM parsed_files WHERE ends_with(cwd, '/src')), k AS (SELECT DISTINCT repo_key AS key FROM parsed_files WHERE repo_key IS NOT NULL)
SELECT f.file_no, coalesce((SELECT any_value(key) FROM m WHERE m.prefix = f.cwd AND key = 'mapped/' || f.bank), nullif(regexp_extract(f.cwd, '(?:^|/)((?:code\\.tarn\\.example|forge\\.example|git\\.northlab\\.test)/[^/]+/[^/]+)', 1), ''), '_unresolved') AS repo FROM parsed_files f WHERE f.bank = 'mill'""")
def resolved_repos(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the working directories of a bank: those that are mapped, else those the path shows."""
    files = table(spark, d, "parsed_files").where("bank = 'mill'")
    maps = files.where(F.col("cwd").endswith("/src")).select(F.col("cwd").alias("prefix"), F.concat(F.lit("mapped/"), "bank").alias("key")).distinct()
    known = table(spark, d, "parsed_files").where("repo_key <> '_unresolved'").select(F.col("repo_key").alias("key")).distinct()
    out = I.resolve_repo_keys(files.select("file_no", "cwd"), "cwd", maps, known, _FORGES)
    return out.select("file_no", F.col("repo_key").alias("repo"))


# ---- labels -------------------------------------------------------------------


@query(r"""WITH g AS (SELECT session_uuid, string_agg(DISTINCT via, ',' ORDER BY via) AS ways, string_agg(DISTINCT chat_id, ',' ORDER BY chat_id) AS rooms, string_agg(DISTINCT from_user, ',' ORDER BY from_user) AS who FROM (SELECT session_uuid, nullif(via,'') AS via, nullif(chat_id,'') AS chat_id, nullif(replace(from_user, ',', ''),'') AS from_user FROM event_rows) GROUP BY 1),
l AS (SELECT session_uuid, list_filter(string_split(coalesce(ways,''), ','), lambda x: x <> '') AS w, list_filter(string_split(coalesce(rooms,''), ','), lambda x: x <> '') AS r, list_filter(string_split(coalesce(who,''), ','), lambda x: x <> '') AS p FROM g),
v AS (SELECT *, list_transform(w, lambda x: regexp_replace(x, '^plugin:[^:]*:(.+)$', '\1')) AS wl FROM l),
z AS (SELECT *, list_filter(wl, lambda x, i: list_position(wl, x) = i) AS labels, CASE WHEN length(r[1]) > 8 THEN '#…' || right(r[1], 6) ELSE '#' || r[1] END AS room FROM v)
SELECT session_uuid, CASE WHEN len(labels) = 0 THEN '' ELSE '[' || array_to_string(labels, '+') || CASE WHEN len(r) > 0 THEN ' ' || room || CASE WHEN len(r) > 1 THEN ' +' || (len(r) - 1) ELSE '' END ELSE '' END
 || CASE WHEN len(p) > 0 THEN ' · ' || array_to_string(p[1:3], ', ') || CASE WHEN len(p) > 3 THEN ' +' || (len(p) - 3) ELSE '' END ELSE '' END || ']' END AS tag FROM z""")
def room_tags(spark: SparkSession, d: str) -> DataFrame:
    """Where each session lived and who spoke."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(c, F.lit("")))), ",")
    rows = table(spark, d, "event_rows").groupBy("session_uuid").agg(listed(F.col("via")).alias("w"), listed(F.col("chat_id")).alias("r"), listed(F.replace("from_user", F.lit(","), F.lit(""))).alias("p"))
    return rows.select("session_uuid", T.room_tag(F.col("w"), F.col("r"), F.col("p")).alias("tag"))


@query(r"""WITH f AS (SELECT row_no, regexp_replace(via, '^plugin:[^:]*:(.+)$', '\1') || CASE WHEN chat_id <> '' THEN ' ' || CASE WHEN length(chat_id) > 8 THEN '#…' || right(chat_id, 6) ELSE '#' || chat_id END ELSE '' END AS place, from_user, sent_ts FROM event_rows WHERE via <> '' AND chat_id IS NOT NULL AND from_user IS NOT NULL AND sent_ts IS NOT NULL)
SELECT row_no, CASE WHEN from_user <> '' THEN from_user || ' @ ' || place ELSE place END || CASE WHEN sent_ts <> '' THEN ' · sent ' || sent_ts ELSE '' END AS head FROM f""")
def channel_heads(spark: SparkSession, d: str) -> DataFrame:
    """Who, where and when of every delivery."""
    rows = table(spark, d, "event_rows").where("via <> '' AND chat_id IS NOT NULL AND from_user IS NOT NULL AND sent_ts IS NOT NULL")
    facets = F.struct("via", "chat_id", "from_user", "sent_ts")
    return rows.select("row_no", F.get(F.transform(F.array(facets), T.channel_head), F.lit(0)).alias("head"))


@query("""WITH c AS (SELECT chain_id, wall_ms, wall_ms // 1000 AS s FROM chains WHERE wall_ms >= 0)
SELECT chain_id, CASE WHEN s >= 3600 THEN printf('%dh%02dm', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN printf('%dm%02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS label FROM c""")
def duration_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chains").where("wall_ms >= 0").select("chain_id", T.duration_label(F.col("wall_ms")).alias("label"))


@query(r"""WITH t AS (SELECT file_no, trim(title) AS q, list_filter(string_split_regex(trim(title), '\s+'), lambda w: length(w) > 1) AS w FROM parsed_files WHERE title IS NOT NULL)
SELECT file_no, unnest(CASE WHEN q = '' THEN [] WHEN len(w) > 1 THEN list_concat([q], w) ELSE [q] END) AS word FROM t""")
def title_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Every title as a query, whole and by its words."""
    return table(spark, d, "parsed_files").where("title IS NOT NULL").select("file_no", F.explode(T.query_keywords(F.col("title"))).alias("word"))


@query("""SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])),4) AS before, round(embedding[1]::DOUBLE * 3 / nullif(3 * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 0),4) AS first FROM embeddings""")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors thrice as long, back at length one."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding", F.transform("embedding", lambda x: (x * 3).cast("float")).alias("v"))
    unit = T.l2_normalise(F.col("v"))
    return v.select("vec_id", F.round(F.sqrt(T.dot(F.col("embedding"), F.col("embedding"))), 4).alias("before"), F.round(F.get(unit, F.lit(0)).cast("double"), 4).alias("first"))


# ---- scopes -------------------------------------------------------------------

_MAIN = "((coalesce(kind,'')='transcript' AND tier='session') OR coalesce(kind,'') IN ('note','message') OR (coalesce(kind,'')='' AND tier IN ('session','note')))"


@query(f"SELECT row_no FROM event_rows WHERE {_MAIN} AND org='kilnworks' AND role IN ('tool_use','tool_result','user') AND starts_with(dir, 's')")
def filter_roles(spark: SparkSession, d: str) -> DataFrame:
    """Rows of groups of roles, of an organisation and below a folder."""
    return P.Scope(org="kilnworks", roles=tuple(P.parse_roles("tool, user")), dir="s").apply(table(spark, d, "event_rows")).select("row_no")


@query("SELECT row_no FROM event_rows WHERE tier='session' AND project='wicket' AND contains(cwd,'lab')")
def filter_project(spark: SparkSession, d: str) -> DataFrame:
    return P.Scope(tier="session", project="wicket", path="lab").apply(table(spark, d, "event_rows")).select("row_no")


@query("SELECT row_no FROM event_rows WHERE tier='memory' AND mem_type='project' AND source='memory'")
def filter_mem_type(spark: SparkSession, d: str) -> DataFrame:
    return P.Scope(tier="memory", mem_type="project", source="memory").apply(table(spark, d, "event_rows")).select("row_no")


@query("SELECT tier, kind, org, count(*) AS n FROM event_rows WHERE org='wicket-io' AND contains(worktree,'agents/') GROUP BY ALL")
def filter_worktree(spark: SparkSession, d: str) -> DataFrame:
    """All tiers of an organisation's worktrees."""
    rows = P.Scope(all_tiers=True, org="wicket-io", worktree="agents/").apply(table(spark, d, "event_rows"))
    return rows.groupBy("tier", "kind", "org").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_no FROM event_rows WHERE contains(lower(text),'importer') AND contains(lower(text),'old')")
def filter_content_terms(spark: SparkSession, d: str) -> DataFrame:
    """Rows that hold all words of a question that say something of its subject."""
    rows = table(spark, d, "event_rows")
    for word in P.content_terms("What is the old, and where was the IMPORTER?"):
        rows = rows.where(F.lower("text").contains(word.lower()))
    return rows.select("row_no")


@query("SELECT row_no, NULLIF(row_no % 3, 0) IS NULL AS bare FROM event_rows WHERE role='user' AND contains(text,'<channel') AND (row_no % 3 = 0 OR coalesce(via,'')='')")
def filter_bare_channels(spark: SparkSession, d: str) -> DataFrame:
    """Human turns with an envelope and no facets, after every third lost its facets."""
    lost = F.col("row_no") % 3 == 0
    rows = table(spark, d, "event_rows").withColumn("via", F.when(~lost, F.col("via")))
    kept = rows.where((F.col("role") == "user") & F.col("text").contains("<channel") & (F.coalesce("via", F.lit("")) == ""))
    return kept.select("row_no", lost.alias("bare"))


_FACET = {"via": "source", "chat_id": "chat_id", "msg_id": "message_id", "from_user": "user", "from_user_id": "user_id", "sent_ts": "ts"}
_AT = {k: f"regexp_extract(a, '(?:^|[^\\w-]){v}=\"([^\"]*)\"', 1)" for k, v in _FACET.items()}


@query("WITH t AS (SELECT row_no, CASE WHEN row_no % 3 > 0 THEN via END AS via, CASE WHEN row_no % 5 = 0 THEN 'x' ELSE chat_id END AS chat_id, msg_id, from_user, from_user_id, sent_ts, regexp_extract(text, '^\\s*<channel(?:\\s)([^>]*)(?:>|$)', 1) AS a FROM event_rows WHERE role='user' AND contains(text,'<channel')) SELECT row_no, "
       + ", ".join(f"{x} AS {k}" for k, x in _AT.items()) + f" FROM t WHERE {_AT['via']} <> '' AND (" + " OR ".join(f"coalesce({k},'') <> {x}" for k, x in _AT.items()) + ")")
def backfill_lost(spark: SparkSession, d: str) -> DataFrame:
    """What facets should be, after some were lost and some changed."""
    rows = table(spark, d, "event_rows").withColumns({"via": F.when(F.col("row_no") % 3 > 0, F.col("via")), "chat_id": F.when(F.col("row_no") % 5 == 0, "x").otherwise(F.col("chat_id"))})
    return Q.backfill_plan(rows)


# ---- tables -------------------------------------------------------------------


@query("SELECT uid, row_no, bank, '' AS label, 0::BIGINT AS weight FROM event_rows WHERE uid IS NOT NULL AND bank IS NOT NULL AND bank NOT IN (SELECT bank FROM banks WHERE tz LIKE 'Asia/%')")
def widen_and_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows with columns they lacked, without those of some banks."""
    rows = table(spark, d, "event_rows").select("uid", "row_no", "bank").where("uid IS NOT NULL AND bank IS NOT NULL")
    wide = M.widen(rows, K.StructType([K.StructField("bank", K.StringType()), K.StructField("label", K.StringType()), K.StructField("weight", K.LongType())]))
    return M.delete(wide, table(spark, d, "banks").where("tz LIKE 'Asia/%'"), ["bank"])


@query("SELECT bank, count(*) AS n, min(row_no) AS first FROM event_rows WHERE bank IS NOT NULL GROUP BY bank UNION ALL SELECT bank, count(*), min(row_no) FROM event_rows WHERE bank IS NOT NULL AND tier='session' GROUP BY bank")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """A log of JSON lines that is written twice and torn once, read again."""
    path = os.path.join(shared_dir(spark), f"log-{uuid.uuid4().hex}")
    rows = table(spark, d, "event_rows").where("bank IS NOT NULL")
    for part in (rows, rows.where("tier = 'session'")):
        I.append_log(part.groupBy("bank").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first")), path)
    spark.range(1).select(F.lit('{"bank": "mill", "n": 1').alias("value")).write.mode("append").text(path)
    return I.read_log(spark, path, "bank string, n long, first long")


@query("""WITH b AS (SELECT session_uuid, file_path, lines, row_number() OVER (PARTITION BY session_uuid ORDER BY lines DESC, file_path DESC, file_no DESC) AS rn FROM parsed_files WHERE session_uuid IS NOT NULL AND lines IS NOT NULL)
SELECT session_uuid, file_path AS path, lines FROM b WHERE rn = 1""")
def heaviest_copies(spark: SparkSession, d: str) -> DataFrame:
    """Of the files of a session the heaviest, all of them."""
    files = table(spark, d, "parsed_files").where("session_uuid IS NOT NULL AND lines IS NOT NULL").select("session_uuid", F.col("file_path").alias("path"), "lines").distinct()
    return I.best_copies(files, "session_uuid", "lines", 0, "path")


@query("""WITH f AS (SELECT file_path AS path, max(ts) AS last, count_if(role='user')::BIGINT AS human, count(*) AS n FROM event_rows WHERE bank='mill' AND file_path IS NOT NULL AND ts LIKE '20%' GROUP BY 1), t AS (SELECT * FROM f WHERE NOT contains(path, 'a1') ORDER BY last DESC, path LIMIT 8)
SELECT path, (human > 0 AND n > 2) AS by_a_person FROM t ORDER BY (human > 0 AND n > 2) DESC, last DESC, path DESC LIMIT 1""")
def session_before(spark: SparkSession, d: str) -> DataFrame:
    """The newest session of a bank, other than the caller's, that a person took part in."""
    rows = table(spark, d, "event_rows").where("bank = 'mill' AND file_path IS NOT NULL AND ts LIKE '20%'")
    files = rows.groupBy(F.col("file_path").alias("path")).agg(F.max("ts").alias("last"), F.count_if(F.col("role") == "user").alias("human"), F.count(F.lit(1)).alias("n"))
    return I.previous_session(files, F.lit(True), "a1", "last", "human", "n")


@query("SELECT regexp_extract(file_path, '/([^/]+)/[^/]+$', 1) AS tree, count(*) AS n, max(lines) AS newest FROM parsed_files WHERE lines % 3 = 0 AND file_path NOT IN (SELECT file_path FROM parsed_files WHERE lines % 3 <> 0) GROUP BY 1")
def unindexed_trees(spark: SparkSession, d: str) -> DataFrame:
    """By folder the files that the index lacks."""
    files = table(spark, d, "parsed_files").select(F.col("file_path").alias("path"), F.col("lines").alias("mtime"), F.regexp_extract("file_path", r"/([^/]+)/[^/]+$", 1).alias("tree"))
    return I.unindexed_in_tree(files.where("mtime % 3 = 0"), files.where("mtime % 3 <> 0"), "tree")


@query(r"SELECT file_no FROM parsed_files WHERE starts_with(lower(string_split(file_path,'/')[-1]),'ab') OR regexp_matches(lower(file_path), '/ab[0-9a-f-]*/subagents/') OR contains(lower(string_split(file_path,'/')[-1]),'ab')")
def sought_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of sessions by the beginning of an id."""
    return I.seek(table(spark, d, "parsed_files").withColumn("path", F.col("file_path")), "ab").select("file_no")


@query("SELECT file_no, CASE WHEN starts_with(file_path, '/srv/agents/mill/') THEN 'mill' WHEN starts_with(file_path, '/srv/agents/') THEN 'agents' WHEN starts_with(file_path, '/srv/vaults/') THEN 'vaults' END AS root FROM parsed_files")
def roots_of_files(spark: SparkSession, d: str) -> DataFrame:
    """The source whose root holds each file, the longest of several."""
    sources = [N.Source("agents", "/srv/agents"), N.Source("mill", "/srv/agents/mill/"), N.Source("vaults", "/srv/vaults", "vault")]
    return table(spark, d, "parsed_files").select("file_no", I.source_of_path(F.col("file_path"), sources).alias("root"))


@query("""SELECT path, mark, size, side FROM (SELECT file_path AS path, repo_key AS mark, lines AS size, tier <> 'session' AS side, row_number() OVER (PARTITION BY repo_key, lines ORDER BY (tier <> 'session'), file_path, tier) AS rn FROM parsed_files WHERE repo_key IS NOT NULL AND lines IS NOT NULL) WHERE rn = 1""")
def deduped_notes(spark: SparkSession, d: str) -> DataFrame:
    """One of the files of a repository and size, those of the main tier first."""
    files = table(spark, d, "parsed_files").where("repo_key IS NOT NULL AND lines IS NOT NULL")
    rows = files.select(F.col("file_path").alias("path"), F.col("repo_key").alias("mark"), F.col("lines").alias("size"), (F.col("tier") != "session").alias("side")).distinct()
    return I.dedupe_notes(rows, ["mark", "size"], "side")


@query("SELECT label % 4 AS part, 2::BIGINT AS n_models FROM embeddings WHERE label % 4 = 0 GROUP BY 1 HAVING count(DISTINCT vec_id % 2) > 1")
def model_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose vectors come from more than one model."""
    part = F.col("label") % 4
    model = F.when((part == 0) & (F.col("vec_id") % 2 == 0), "second").otherwise("first")
    vectors = table(spark, d, "embeddings").select(part.alias("part"), model.alias("model"), F.size("embedding").alias("dim"))
    return E.check_model(vectors, ["part"]).select("part", F.size("models").cast("long").alias("n_models"))


@query("SELECT file_no, lines FROM parsed_files")
def limit_zero(spark: SparkSession, d: str) -> DataFrame:
    """A limit of 0 means all."""
    return R.top(table(spark, d, "parsed_files").select("file_no", "lines"), 0, [F.desc("lines"), F.col("file_no")])


@query("""SELECT file_path, arg_min(nullif(cwd,''), CASE WHEN coalesce(cwd,'')<>'' THEN seq END) AS cwd, arg_min(nullif(worktree,''), CASE WHEN coalesce(worktree,'')<>'' THEN seq END) AS worktree,
 count(*) AS n FROM event_rows WHERE seq <= 400 AND file_path IS NOT NULL GROUP BY file_path HAVING count(DISTINCT nullif(cwd,'')) <= 1 AND count(DISTINCT nullif(worktree,'')) <= 1""")
def first_facts(spark: SparkSession, d: str) -> DataFrame:
    """Directory and worktree of every file that has one, from its first 400 lines."""
    rows = table(spark, d, "event_rows").where("seq <= 400 AND file_path IS NOT NULL")
    facts = S.first_seen_facts(rows, ["file_path"]).select("file_path", "cwd", "worktree")
    sizes = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(S.nonempty("cwd")).alias("_c"), F.count_distinct(S.nonempty("worktree")).alias("_w"))
    return facts.join(sizes.where("_c <= 1 AND _w <= 1").select("file_path", "n"), "file_path")


@query("""WITH s AS (SELECT path, rule, num, k FROM (SELECT file_path AS path, 'rule ' || (row_no % 4) AS rule, row_no AS num, row_number() OVER (PARTITION BY file_path ORDER BY row_no DESC) AS k FROM event_rows WHERE file_path IS NOT NULL AND row_no % 5 = 0))
SELECT path, max(CASE WHEN k = 1 THEN rule END) AS rule, 'error ' || max(num) AS error, count(*) AS runs FROM s GROUP BY path""")
def skipped_files(spark: SparkSession, d: str) -> DataFrame:
    """Paths that a log says were not read, with the latest error."""
    log = table(spark, d, "event_rows").where("file_path IS NOT NULL AND row_no % 5 = 0")
    log = log.select(F.col("file_path").alias("path"), F.concat(F.lit("rule "), (F.col("row_no") % 4).cast("string")).alias("rule"), F.concat(F.lit("error "), F.col("row_no").cast("string")).alias("error"), F.col("row_no").alias("ts"))
    return Q.skipped_paths(log)


@query("""WITH e AS (SELECT row_no, row_no % 50 AS path, row_no % 7 AS k, text, role FROM event_rows WHERE text IS NOT NULL), f AS (SELECT path, k, max(row_no) AS row_no FROM e WHERE path % 2 = 1 AND NOT (role NOT IN ('user','assistant','thinking','system') AND regexp_matches(text,'^\\[tool_use (Read|Glob|LS|Grep|TodoWrite|Edit|Write|MultiEdit|NotebookEdit)\\]')) AND role IN ('user','assistant','tool_use') AND length(text) < 120 GROUP BY ALL)
SELECT path::VARCHAR AS file_path, count(*) AS n, sum(row_no)::BIGINT AS total FROM (SELECT path, k, row_no FROM f UNION ALL SELECT path, k, row_no FROM e WHERE path % 2 = 0 AND role IN ('user','assistant','tool_use') AND length(text) < 120) GROUP BY path""")
def import_changed(spark: SparkSession, d: str) -> DataFrame:
    """An import in which every second file changed: its rows are parsed again, noise is set aside, the last of a uid counts."""
    rows = table(spark, d, "event_rows").where("text IS NOT NULL AND role IN ('user','assistant','tool_use') AND char_length(text) < 120")
    events = rows.select((F.col("row_no") % 7).cast("string").alias("uid"), (F.col("row_no") % 50).cast("string").alias("file_path"), F.col("row_no").alias("seq"), "role", "text")
    found = spark.range(50).select(F.col("id").cast("string").alias("path"), F.lit(2).alias("mtime"), F.lit(1).alias("size"))
    manifest = found.withColumn("mtime", F.when(F.col("path").cast("int") % 2 == 0, 2).otherwise(1))
    parse = lambda todo: events.join(todo.select(F.col("path").alias("file_path")), "file_path")
    after, _, _ = I.import_files(found, manifest, events, parse)
    return after.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("total"))
