"""Session analytics: grouping, neighbours, concurrency, exchanges, gaps, lineage, reports.

Every function takes and gives DataFrames.  Files of one tree share a
session_uuid, so that is never a key: a conversation is (bank, repo_key, uuid).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skeinlake.functions.text import edited_file, is_harness_turn, is_inbound_turn, squeeze, tool_name


def nonempty(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def upper_median(column: str, kind: str = "long") -> Column:
    """The middle value of a group, the upper one of two.  Its state is counts of
    distinct values, merged on the map side."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)").cast(kind)


def first_by(value: str, order: str, when: Column | None = None) -> Column:
    """The value of the least order among rows where it is not empty."""
    ok = nonempty(value).isNotNull() if when is None else nonempty(value).isNotNull() & when
    return F.min_by(F.when(ok, F.col(value)), F.when(ok, F.col(order)))


def last_by(value: str, order: str) -> Column:
    ok = nonempty(value).isNotNull()
    return F.max_by(F.when(ok, F.col(value)), F.when(ok, F.col(order)))


# ---- listing ----------------------------------------------------------------


def group_transcripts(files: DataFrame) -> DataFrame:
    """One row a conversation: its parent file (the session tier's, else the
    earliest), the number of children and of lines in the tree."""
    own = F.coalesce(nonempty("session_uuid"), F.col("file_path"))
    rank = F.struct((F.col("tier") != "session").alias("a"), F.coalesce("started_at", F.lit("")).alias("b"), F.col("file_path").alias("c"))
    return files.groupBy("bank", "repo_key", own.alias("conversation")).agg(
        F.min_by("file_path", rank).alias("parent_path"), F.min_by("tier", rank).alias("parent_tier"), F.min_by("started_at", rank).alias("started_at"),
        (F.count(F.lit(1)) - 1).alias("children"), F.sum("lines").alias("tree_lines"),
    )


def tree_stats(files: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, sums, distinct workflow runs, first start and last end of each group."""
    return files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("lines").alias("n_lines"), F.count_distinct(nonempty("workflow_run_id")).alias("n_runs"),
        F.min(nonempty("started_at")).alias("first_start"), F.max(nonempty("ended_at")).alias("last_end"),
    )


def first_seen_facts(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """First directory, last title-like text, first human words of each file."""
    human = F.col("role") == "user"
    return rows.groupBy(*keys).agg(
        first_by("cwd", order).alias("cwd"), first_by("worktree", order).alias("worktree"),
        first_by("text", order, human).alias("description"), last_by("ts", order).alias("last_ts"),
    )


def bank_rollup(rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Per (bank, repo_key), per bank and in all; level says which."""
    level = (F.lit(2) - F.grouping("bank").cast("int") - F.grouping("repo_key").cast("int")).alias("level")
    return rows.rollup("bank", "repo_key").agg(level, *[c.alias(n) for n, c in measures.items()])


def ranked_values(rows: DataFrame, keys: list[str], value: str, order: str, joined: str) -> DataFrame:
    """Distinct non-empty values of a group by frequency, ties by first sight, comma-joined."""
    counts = rows.where(nonempty(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_at"))
    entry = F.struct((-F.col("_n")).alias("n"), F.col("_at").alias("at"), F.col(value).alias("v"))
    return counts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["v"]), ",").alias(joined))


def neighbours(targets: DataFrame, others: DataFrame, keys: list[str], at: str, id_column: str, n: int) -> DataFrame:
    """For each target the n rows before and the n after its instant that share its
    keys: <id>, neighbour, side (before, after), rank from 1.

    Targets and others are put into one order by key and instant; each target reads
    its neighbours' rows from an n-row frame, so no pairs are formed."""
    tagged = others.select(*keys, F.col(at).alias("_at"), F.col(id_column).alias("_id"), F.lit(False).alias("_is_target")).unionByName(
        targets.select(*keys, F.col(at).alias("_at"), F.col(id_column).alias("_id"), F.lit(True).alias("_is_target"))
    )
    # a target stands after the rows of its instant when it looks back, before them when it looks ahead
    other = F.when(~F.col("_is_target"), F.struct("_at", "_id"))
    both = []
    for side, direction in (("before", 1), ("after", -1)):
        sort = [F.col("_at").asc() if direction > 0 else F.col("_at").desc(), F.col("_is_target").desc(), F.col("_id").asc() if direction > 0 else F.col("_id").desc()]
        ordinal = F.sum((~F.col("_is_target")).cast("long")).over(W.partitionBy(*keys).orderBy(*sort).rowsBetween(W.unboundedPreceding, 0))
        numbered = tagged.withColumn("_ordinal", ordinal)
        mine = numbered.where("_is_target").select(*keys, F.col("_id").alias(id_column), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank"), F.col("_ordinal").alias("_upto"))
        mine = mine.withColumn("_ordinal", F.col("_upto") - F.col("rank") + 1)
        theirs = numbered.where("not _is_target").select(*keys, "_ordinal", F.col("_id").alias("neighbour"))
        both.append(mine.join(theirs, [*keys, "_ordinal"]).select(id_column, F.lit(side).alias("side"), "rank", "neighbour"))
    return both[0].unionByName(both[1])


# ---- time -------------------------------------------------------------------


def peak_concurrency(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Most intervals open at once in each group.  An end counts before a start at
    the same instant; an interval without length counts for nothing."""
    stop = F.greatest(F.col(start), F.coalesce(F.col(end), F.col(start)))
    edges = intervals.where(F.col(start).isNotNull()).select(
        *keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(stop.alias("t"), F.lit(-1).alias("d")))).alias("e")
    )
    steps = edges.groupBy(*keys, F.col("e.t").alias("t"), F.col("e.d").alias("d")).agg(F.sum("e.d").alias("n"))
    open_ = F.sum("n").over(W.partitionBy(*keys).orderBy("t", "d").rowsBetween(W.unboundedPreceding, 0))
    return steps.withColumn("_open", open_).groupBy(*keys).agg(F.greatest(F.max("_open"), F.lit(0)).alias("peak"))


def chain_totals(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """First start, last end, wall and summed length, and peak of each group."""
    stop = F.greatest(F.col(start), F.coalesce(F.col(end), F.col(start)))
    sums = intervals.where(F.col(start).isNotNull()).groupBy(*keys).agg(
        F.min(start).alias("first_start"), F.max(stop).alias("last_end"), (F.max(stop) - F.min(start)).alias("wall"),
        F.sum(stop - F.col(start)).alias("work"), F.count(F.lit(1)).alias("n"),
    )
    return sums.join(peak_concurrency(intervals, keys, start, end), keys)


def gap_sentinels(rows: DataFrame, keys: list[str], at: str, least_seconds: int) -> DataFrame:
    """Stretches longer than the limit between neighbouring rows of a group."""
    before = F.lag(at).over(W.partitionBy(*keys).orderBy(at))
    seconds = F.unix_timestamp(at) - F.unix_timestamp("gap_start")
    return rows.withColumn("gap_start", before).withColumn("gap_seconds", seconds).where(F.col("gap_seconds") > least_seconds).select(*keys, "gap_start", F.col(at).alias("gap_end"), "gap_seconds")


def sessionize(rows: DataFrame, keys: list[str], at: str, gap: str) -> DataFrame:
    """Sessions of activity by inactivity gaps, merged by Spark's session_window."""
    found = rows.groupBy(*keys, F.session_window(at, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("started_at"), F.max(at).alias("ended_at"))
    return found.drop("_w")


def gap_stats(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """First, last, span, upper median gap and longest gap of each group, in seconds."""
    seconds = F.unix_timestamp(at)
    gap = seconds - F.lag(seconds).over(W.partitionBy(*keys).orderBy(at))
    return rows.select(*keys, at, gap.alias("_gap")).groupBy(*keys).agg(
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), (F.max(seconds) - F.min(seconds)).alias("span"),
        upper_median("_gap").alias("median_gap"), F.max("_gap").alias("longest_gap"),
    )


def activity_buckets(rows: DataFrame, at: str, minutes: int, n: int, until: Column) -> DataFrame:
    """Rows in each of n buckets that end at `until`, zeros included: bucket 0 is the oldest."""
    seconds = minutes * 60
    age = F.unix_timestamp(until) - F.unix_timestamp(at)
    counted = rows.where((age >= 0) & (age < seconds * n)).groupBy((F.lit(n - 1) - F.floor(age / seconds)).alias("bucket")).agg(F.count(F.lit(1)).alias("_n"))
    grid = rows.sparkSession.range(n).select(F.col("id").alias("bucket"))
    return grid.join(counted, "bucket", "left").select("bucket", F.coalesce("_n", F.lit(0)).alias("n"))


def daily_report(rows: DataFrame, day: Column, group: str, measures: dict[str, Column], cap: int) -> DataFrame:
    """Per day the `cap` largest groups by the first measure, and how many more there are."""
    lead = next(iter(measures))
    sums = rows.where(day.isNotNull()).groupBy(day.alias("day"), group).agg(*[c.alias(k) for k, c in measures.items()])
    per_day = W.partitionBy("day")
    ranked = sums.withColumns({"rank": F.row_number().over(per_day.orderBy(F.desc(lead), group)), "in_day": F.count(F.lit(1)).over(per_day)})
    return ranked.where(F.col("rank") <= cap).withColumn("more", F.greatest(F.col("in_day") - cap, F.lit(0))).drop("in_day")


# ---- turns ------------------------------------------------------------------


def exchanges(turns: DataFrame, keys: list[str], order: str, tail: int = 0) -> DataFrame:
    """Each visible human turn with the agent's last answer before the next turn
    that breaks: keys, exchange, asked, answered.  Turns of the harness neither
    count nor break; turns from elsewhere break.  tail > 0 keeps the last ones."""
    text = F.col("text")
    human = (F.col("role") == "user") & ~is_harness_turn(text)
    breaks = human | ((F.col("role") == "user") & is_inbound_turn(text))
    running = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    numbered = turns.withColumns({"_human": human, "exchange": F.sum(breaks.cast("long")).over(running)})
    agent = (F.col("role") == "assistant") & text.rlike(r"[^\s\p{Z}]")
    paired = numbered.groupBy(*keys, "exchange").agg(
        F.min_by(F.when(F.col("_human"), text), F.when(F.col("_human"), F.col(order))).alias("asked"),
        F.max_by(F.when(agent, text), F.when(agent, F.col(order))).alias("answered"),
    ).where(F.col("asked").isNotNull())
    if tail <= 0:
        return paired
    back = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("exchange")))
    return paired.withColumn("_back", back).where(F.col("_back") <= tail).drop("_back")


def recap(events: DataFrame, keys: list[str], order: str, top: int = 12) -> DataFrame:
    """Per session: turns by role, asked and omitted turns, most used tools, most
    edited files, and the last words of the agent."""
    user = F.col("role") == "user"
    harness = is_harness_turn(F.col("text"))
    roles = events.groupBy(*keys).agg(
        F.count_if(user & ~harness).alias("asked"), F.count_if(user & harness).alias("omitted"), F.count_if(F.col("role") == "assistant").alias("answers"),
        F.count_if(F.col("role") == "tool_use").alias("calls"),
        F.max_by(F.when(F.col("role") == "assistant", squeeze(F.col("text"))), F.when(F.col("role") == "assistant", F.col(order))).alias("ended_with"),
    )
    calls = events.where(F.col("role") == "tool_use").select(*keys, order, tool_name(F.col("text")).alias("tool"), F.when(F.col("text").rlike(r"^\[tool_use (Edit|Write|MultiEdit|NotebookEdit)\]"), edited_file(F.col("text"))).alias("edited"))
    for value in ("tool", "edited"):
        counts = calls.where(nonempty(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
        entry = F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))
        listed = F.transform(F.slice(F.array_sort(F.collect_list(entry)), 1, top), lambda x: F.concat(x["v"], F.lit(" "), (-x["n"]).cast("string")))
        roles = roles.join(counts.groupBy(*keys).agg(F.array_join(listed, ", ").alias(f"top_{value}")), keys, "left")
    return roles


def dedupe_events(events: DataFrame, rank: Column, keep: str = "n_copies") -> DataFrame:
    """One of the rows that share instant, role and text (or the uid, where there is
    no instant), that of the least rank, with the number of copies.  Two different
    events may bear one uid, so that alone is no key.  Copies combine on the map
    side, so a row that comes a million times costs a row a task."""
    dated = nonempty("ts").isNotNull()
    key = [F.when(dated, F.col(c)).alias(f"_k{i}") for i, c in enumerate(("ts", "role", "text"))] + [F.when(~dated, F.col("uid")).alias("_k3")]
    order = F.struct(rank.isNull().alias("a"), rank.alias("b"), F.xxhash64(*events.columns).alias("c"))
    best = F.min_by(F.struct(*events.columns), order).alias("_r")
    return events.groupBy(*key).agg(best, F.count(F.lit(1)).alias(keep)).select("_r.*", keep)


# ---- graphs and trees -------------------------------------------------------


def lineage_links(nodes: DataFrame, flush_ms: int = 5_000, relaunch_ms: int = 60_000, adjacency_ms: int = 120_000) -> DataFrame:
    """Which session continues which: parent, child, kind, gap_ms, via, ambiguous.

    nodes: scope, id, start_ms, end_ms, mtime_ms, started (clear or other), carries
    (ids of sessions whose lines it carries).  A fork is known by carried ids; other
    children take the candidate that ended last before them within a window, and a
    parent keeps one such child, a cleared one first, then the smaller gap.

    Candidates are found by equality of time slots, not by comparing all pairs: a
    parent's last sign of life lies in the child's slot or the one before.
    """
    slot_ms = max(flush_ms, relaunch_ms, adjacency_ms) + 1_000
    carried = nodes.select("scope", F.col("id").alias("child"), F.col("start_ms").alias("child_start"), F.explode("carries").alias("parent"))
    parents = nodes.select(F.col("scope").alias("_scope"), F.col("id").alias("_p"), F.col("start_ms").alias("p_start"), F.col("end_ms").alias("p_end"), F.col("mtime_ms").alias("p_mtime"))
    forks = carried.join(parents, (F.col("scope") == F.col("_scope")) & (F.col("parent") == F.col("_p")) & (F.col("p_start") < F.col("child_start")))
    latest = W.partitionBy("scope", "child").orderBy(F.desc("p_end"), "parent")
    forks = forks.withColumn("_r", F.row_number().over(latest)).where("_r = 1").select(
        "scope", "parent", "child", F.lit("fork").alias("kind"), F.greatest(F.lit(0), F.col("child_start") - F.col("p_end")).alias("gap_ms"),
        F.lit("ids").alias("via"), F.lit(False).alias("ambiguous"))
    free = nodes.join(forks.select(F.col("scope").alias("_s"), F.col("child").alias("_c")), (F.col("scope") == F.col("_s")) & (F.col("id") == F.col("_c")), "left_anti")
    at = F.floor(F.col("start_ms") / slot_ms)
    children = free.select("scope", F.col("id").alias("child"), F.col("start_ms").alias("c_start"), "started", F.explode(F.array(at - 1, at, at + 1)).alias("slot"))
    signs = F.array_distinct(F.array(F.floor(F.col("p_end") / slot_ms), F.floor(F.col("p_mtime") / slot_ms)))
    near = parents.withColumn("_slot", F.explode(signs))
    pairs = children.join(near, (F.col("scope") == F.col("_scope")) & (F.col("slot") == F.col("_slot")) & (F.col("child") != F.col("_p")) & (F.col("p_start") < F.col("c_start")) & (F.col("p_end") <= F.col("c_start") + 1_000)).drop("slot", "_slot", "_scope").distinct()
    clear = F.col("started") == "clear"
    by_mtime = F.when(clear, F.abs(F.col("c_start") - F.col("p_mtime")) <= flush_ms).otherwise((F.col("p_mtime") <= F.col("c_start") + 1_000) & (F.col("c_start") - F.col("p_mtime") <= relaunch_ms))
    by_event = clear & (F.col("c_start") - F.col("p_end") <= adjacency_ms)
    marked = pairs.withColumns({"_m": by_mtime, "_any": F.max(by_mtime).over(W.partitionBy("scope", "child"))})
    cands = marked.where(F.when(F.col("_any"), F.col("_m")).otherwise(by_event))
    own = W.partitionBy("scope", "child")
    nearest = cands.withColumns({"_r": F.row_number().over(own.orderBy(F.desc("p_end"), "_p")), "_n": F.count(F.lit(1)).over(own)}).where("_r = 1").select(
        "scope", F.col("_p").alias("parent"), "child", F.when(clear, "clear").otherwise("relaunch").alias("kind"),
        F.greatest(F.lit(0), F.col("c_start") - F.col("p_end")).alias("gap_ms"), F.when(F.col("_m"), "mtime").otherwise("last-event").alias("via"), (F.col("_n") > 1).alias("ambiguous"))
    best = W.partitionBy("scope", "parent").orderBy((F.col("kind") != "clear").cast("int"), "gap_ms", "child")
    return forks.unionByName(nearest.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r"))


def key_chain(nodes: DataFrame, key: str, order: list[str], id_column: str) -> DataFrame:
    """Each session of a key with the one before it."""
    own = W.partitionBy(key).orderBy(*order)
    return nodes.where(nonempty(key).isNotNull()).select(key, F.lag(id_column).over(own).alias("parent"), F.col(id_column).alias("child")).where(F.col("parent").isNotNull())


def path_rollup(files: DataFrame, path: str, weight: Column) -> DataFrame:
    """Files and weight under every directory prefix."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("_parts") - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("_parts", F.lit(1), i), "/")))
    rows = files.select(parts.alias("_parts"), weight.alias("_w")).where(F.size("_parts") > 1)
    return rows.select(F.explode(prefixes).alias("dir"), "_w").groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"), F.sum("_w").alias("weight"))


def outermost(roots: DataFrame, path: str) -> DataFrame:
    """Paths that lie in no other path of the table: an anti join on prefixes."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    inside = roots.select(path, F.explode(F.when(F.size(parts) > 1, above)).alias("_up"))
    hit = inside.join(roots.select(F.col(path).alias("_root")).distinct(), F.col("_up") == F.col("_root"), "left_semi")
    return roots.join(hit.select(path), path, "left_anti")


# ---- disk, memory, logs -----------------------------------------------------


def disk_diff(found: DataFrame, manifest: DataFrame, path: str, same: list[str]) -> DataFrame:
    """Every found file with its state against the index: missing, changed, indexed."""
    known = manifest.select(F.col(path).alias("_path"), *[F.col(c).alias(f"_{c}") for c in same])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same])
    state = F.when(F.col("_path").isNull(), "missing").when(differs, "changed").otherwise("indexed")
    return found.join(known, F.col(path) == F.col("_path"), "left").withColumn("state", state).drop("_path", *[f"_{c}" for c in same])


def memory_join(memories: DataFrame, sessions: DataFrame, origin: str, session: str) -> DataFrame:
    """Each memory with whether its origin is known: joined, orphaned, none."""
    ids = sessions.select(F.col(session).alias("_id")).distinct()
    state = F.when(nonempty(origin).isNull(), "none").when(F.col("_id").isNull(), "orphaned").otherwise("joined")
    return memories.join(ids, F.col(origin) == F.col("_id"), "left").withColumn("state", state).drop("_id")


def log_stats(log: DataFrame, group: str, cost: str) -> DataFrame:
    """Rows, zero hits, upper median and worst cost of each group of a query log."""
    return log.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("hits") == 0).alias("zero_hits"),
        upper_median(cost).alias("median_cost"), F.max(cost).alias("worst_cost"),
    )
