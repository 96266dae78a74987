"""Audits and reports: noise, backfills, coverage, trees of continuations, activity of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skeinlake.functions.text import LANGUAGE_CLASSES, channel_facets, has_gapless, noise_rule, squeeze
from skeinlake.operators.sessions import nonempty
from skeinlake.session import materialize

FACETS = ["via", "chat_id", "msg_id", "from_user", "from_user_id", "sent_ts"]


def noise_probe(events: DataFrame, samples: int = 3) -> DataFrame:
    """By rule: events, bytes, their part of all, and the first texts by uid."""
    marked = events.select("uid", "text", noise_rule(F.col("text"), F.col("role")).alias("rule"), F.octet_length("text").alias("bytes"))
    total = F.broadcast(events.agg(F.count(F.lit(1)).alias("_all")))
    head = F.struct("uid", F.substring("text", 1, 80).alias("head"))
    # the filter on the rank keeps k rows a rule and task before the shuffle
    first = W.partitionBy("rule").orderBy("h")
    few = marked.select("rule", head.alias("h")).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= samples)
    listed = few.groupBy("rule").agg(F.slice(F.array_sort(F.collect_list("h")), 1, samples).alias("samples"))
    sums = marked.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    return sums.join(listed, "rule").crossJoin(total).select("rule", "n", "bytes", F.round(F.col("n") / F.col("_all"), 6).alias("part"), F.transform("samples", lambda s: s["head"]).alias("samples"))


def skipped_paths(log: DataFrame) -> DataFrame:
    """Paths that could not be read: the latest error and how often it was met."""
    return log.groupBy("path").agg(F.max_by("rule", "ts").alias("rule"), F.max_by("error", "ts").alias("error"), F.count(F.lit(1)).alias("runs"))


def backfill_plan(events: DataFrame) -> DataFrame:
    """Human turns whose stored facets are not those of their envelope: key columns,
    and what each facet should be.  Applied with update_only it finds nothing again."""
    found = channel_facets(F.col("text"))
    turns = events.where((F.col("role") == "user") & F.col("text").contains("<channel")).withColumn("_f", found).where("_f IS NOT NULL")
    differs = None
    for name in FACETS:
        d = ~F.coalesce(name, F.lit("")).eqNullSafe(F.col(f"_f.{name}"))
        differs = d if differs is None else differs | d
    return turns.where(differs).select("row_no", *[F.col(f"_f.{n}").alias(n) for n in FACETS])


def dig(events: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Per file: human turns that say something, answers, calls, the first prompt, first
    and last instant.  A turn that the harness wrote counts as human: the rule looks at
    role, length and the mark of an interruption only.  `tie` orders turns of one seq."""
    human = F.coalesce((F.col("role") == "user") & (F.char_length(F.trim("text")) > 5) & ~F.col("text").startswith("[Request interrupted"), F.lit(False))
    return events.groupBy(*keys).agg(
        F.count_if(human).alias("human"), F.count_if(F.col("role") == "assistant").alias("answers"), F.count_if(F.col("role") == "tool_use").alias("calls"),
        F.min_by("text", F.when(human & F.col("seq").isNotNull(), F.struct("seq", tie))).alias("first_prompt"), F.min(nonempty(at)).alias("first_at"), F.max(nonempty(at)).alias("last_at"))


def collapse_marks(marks: DataFrame, keys: list[str], at_ms: str, least_ms: int = 5_000) -> DataFrame:
    """Marks that lie more than least_ms after the last one kept.  What is kept
    depends on what was kept before, so it is a fold over each key's sorted marks;
    a key is one session, whose marks are few."""
    fold = F.aggregate(
        F.array_sort(F.collect_set(at_ms)), F.array().cast("array<long>"),
        lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) > least_ms), F.concat(kept, F.array(x))).otherwise(kept))
    return marks.groupBy(*keys).agg(fold.alias("_k")).select(*keys, F.explode("_k").alias(at_ms))


def lineage_trees(links: DataFrame, parent: str = "parent", child: str = "child", rounds: int = 32) -> DataFrame:
    """node, root and depth of every node of a forest of links, by pointer jumping:
    the reach doubles each round, so rounds bounds depth at 2 ** rounds, not the rows."""
    step = links.groupBy(F.col(child).alias("node")).agg(F.min(parent).alias("up")).withColumn("depth", F.lit(1).cast("long"))
    roots = links.select(F.col(parent).alias("node")).subtract(links.select(F.col(child).alias("node"))).select("node", F.col("node").alias("up"), F.lit(0).cast("long").alias("depth"))
    at = materialize(step.unionByName(roots), "jump")
    for _ in range(rounds):
        above = at.select(F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        jumped = at.join(above, F.col("up") == F.col("_n")).select("node", F.col("_up").alias("up"), F.when(F.col("node") == F.col("up"), F.col("depth")).otherwise(F.col("depth") + F.col("_d")).alias("depth"), (F.col("up") != F.col("_up")).alias("moved"))
        at = materialize(jumped, "jump")
        if at.where("moved").limit(1).count() == 0:
            break
    return at.select("node", F.col("up").alias("root"), "depth")


def fold_spawns(nodes: DataFrame, id_column: str, parent: str, measures: list[str]) -> DataFrame:
    """Sessions that another one spawned are added to it; a parent that isn't there leaves its child alone."""
    known = nodes.select(F.col(id_column).alias("_id")).distinct()
    joined = nodes.join(known, F.col(parent) == F.col("_id"), "left")
    owner = F.coalesce(F.col("_id"), F.col(id_column))
    return joined.groupBy(owner.alias(id_column)).agg(F.count_if(F.col("_id").isNotNull()).alias("spawned"), *[F.sum(m).alias(m) for m in measures])


def tree_listing(rollup: DataFrame, per_dir: int) -> DataFrame:
    """Of each directory's entries the heaviest, in order, and how many more there are."""
    parent = F.regexp_replace("dir", r"/[^/]+$", "")
    own = W.partitionBy("parent")
    ranked = rollup.withColumn("parent", parent).withColumns({"rank": F.row_number().over(own.orderBy(F.desc("weight"), "dir")), "_n": F.count(F.lit(1)).over(own)})
    return ranked.where(F.col("rank") <= per_dir).withColumn("more", F.greatest(F.col("_n") - per_dir, F.lit(0))).drop("_n")


def common_prefix(paths: DataFrame, path: str) -> DataFrame:
    """The longest prefix of all paths: that of the least and the greatest."""
    ends = paths.agg(F.min(path).alias("a"), F.max(path).alias("b"))
    same = F.filter(F.sequence(F.lit(0), F.least(F.char_length("a"), F.char_length("b"))), lambda n: F.substr("a", F.lit(1), n) == F.substr("b", F.lit(1), n))
    return ends.select(F.substr("a", F.lit(1), F.array_max(same)).alias("prefix"))


def never_first(shards: DataFrame, log: DataFrame, shard: str, first: str) -> DataFrame:
    """Shards that never gave a query's best hit."""
    return shards.join(log.select(F.col(first).alias(shard)).distinct(), shard, "left_anti")


def answer_freshness(hits: DataFrame, files: DataFrame, keys: list[str], at: str, shards: int = 25) -> DataFrame:
    """When the shards that gave the most hits were last read, and whether there were more of them."""
    counts = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = counts.orderBy(F.desc("_n"), *keys).limit(shards)  # a report names so many shards
    newest = files.join(F.broadcast(ranked), keys, "left_semi").agg(F.max(at).alias("newest"))
    return newest.crossJoin(counts.agg((F.count(F.lit(1)) > shards).alias("sampled")))


def index_lag(indexed: DataFrame, present: DataFrame, keys: list[str], rows: int = 1_000, part: float = 0.05) -> DataFrame:
    """Shards whose index lacks at least `rows` rows and that part of its rows."""
    both = present.join(indexed.withColumnRenamed("n", "_have"), keys, "left")
    missing = F.col("n") - F.coalesce("_have", F.lit(0))
    return both.select(*keys, missing.alias("missing"), ((missing >= rows) & (missing >= F.col("n") * part)).alias("rebuild"))


def model_advice(shares: DataFrame, multilingual_from: float = 0.05) -> DataFrame:
    """From characters by language class: the part that is neither English nor code,
    whether that asks for a multilingual model, and the classes in their usual order."""
    plain = F.col("class").isin("en", "latin", "none")
    order = F.array_position(F.array(*map(F.lit, LANGUAGE_CLASSES)), F.col("class"))
    named = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("class").alias("c")))), lambda x: x["c"])
    part = F.sum(F.when(~plain, F.col("chars")).otherwise(0)) / F.sum("chars")
    return shares.agg(F.round(part, 6).alias("part"), (part >= multilingual_from).alias("multilingual"), F.array_join(named, ",").alias("classes"))


def current_session(found: DataFrame, files_of: Column, last_event: str) -> DataFrame:
    """Of the files that belong to a place the one with the latest event."""
    return found.where(files_of).agg(F.max_by("path", F.struct(last_event, "path")).alias("path"), F.max(last_event).alias("last_event"), (F.count(F.lit(1)) == 1).alias("confident"))


def known_item_queries(docs: DataFrame, id_column: str, text: str, n_from: int = 8, n_to: int = 12, seed: int = 0) -> DataFrame:
    """For each text long enough a span of its words, chosen by a seeded hash: id, query.
    A text of at least 60 characters with letters of a script without word gaps gives 32 characters."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    h = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), F.col(id_column))
    size = F.pmod(h("size"), F.lit(n_to - n_from + 1)) + n_from
    whole = squeeze(F.col(text))
    rows = docs.select(id_column, words.alias("_w"), size.cast("int").alias("_n"), whole.alias("_t"), (has_gapless(F.col(text)) & (F.char_length(whole) >= 60)).alias("_g"))
    rows = rows.where(F.col("_g") | (F.size("_w") >= F.col("_n") + 1))
    start = F.pmod(h("start"), F.size("_w") - F.col("_n") + 1).cast("int") + 1
    # from the 11th character on, at the latest 45 before the end
    at = F.pmod(h("start"), F.greatest(F.lit(11), F.char_length("_t") - 45) - 9).cast("int") + 11
    window = F.substr("_t", at, F.lit(32))
    return rows.select(id_column, F.when(F.col("_g"), window).otherwise(F.array_join(F.slice("_w", start, F.col("_n")), " ")).alias("query"))


def banded_means(rows: DataFrame, band_by: str, edges: list[float], value: str) -> DataFrame:
    """Means of a value by bands of another: band i lies from edge i to the next."""
    band = sum(((F.col(band_by) >= e).cast("int") for e in edges), F.lit(0))
    return rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"))


def recall_curve(ranks: DataFrame, rank: str, cuts: list[int]) -> DataFrame:
    """The part of the ranks within each cut, and the median rank."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.avg((F.coalesce(rank, F.lit(2**31)) <= k).cast("double")), 6).alias("recall")) for k in cuts])
    return ranks.agg(cells.alias("c"), F.percentile(rank, 0.5).alias("median_rank")).select(F.explode("c").alias("c"), "median_rank").select("c.k", "c.recall", "median_rank")
