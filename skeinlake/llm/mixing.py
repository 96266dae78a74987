"""Mixing sources to target weights.

Token weights are raked (iterative proportional fitting) to three margins: the
sources' target shares, and the corpus's own shares of languages and topics, with
each source's weight bounded by its cap of repeats.  Documents are then drawn
with the calibrated weights as expected numbers of copies, systematically within
blocks ordered by language, topic and size, so that tokens, not just documents,
meet the targets.

The cells of the raking are source x language x topic, one row each: sources come from
the targets, languages from a fixed list, topics are all there are.  The cells, not the
documents, are raked on the driver; ``mix_margins`` says how near each margin came.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skeinlake.llm.labels import language_of
from skeinlake.session import materialize

#: Rounds of raking; it stops earlier when all margins are met to TOLERANCE.
ROUNDS, TOLERANCE = 200, 1e-6
#: Documents in a block of the systematic draw, about, and draws that are compared.
BLOCK_DOCS, DRAWS = 20_000, 32


def source_of(source: Column) -> Column:
    """Sources are spelt with blanks and in any case."""
    return F.nullif(F.lower(F.trim(source)), F.lit(""))


def fill_shares(available: np.ndarray, shares: np.ndarray, caps: np.ndarray, total: float) -> np.ndarray:
    """Tokens due of each source: its share of total, or all it may give; what is
    missing is shared out among the others in proportion, as far as they go."""
    most, due, open_ = available * caps, np.zeros(len(shares)), available * caps > 0
    left = total
    while open_.any() and left > 1e-9 and shares[open_].sum() > 0:
        want = left * shares * open_ / shares[open_].sum()
        full = open_ & (want >= most - 1e-9)
        if not full.any():
            return due + want
        due[full], left = most[full], left - most[full].sum()
        open_ &= ~full
    return due


def rake(tokens: np.ndarray, source: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]], due: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Weight of each cell: sum(weight * tokens) meets `due` per source, and the
    margins in `others` (codes of the cells, shares of the total) as nearly as the
    caps allow; sources come last and are met exactly."""
    weight = np.where(tokens > 0, 1.0, 0.0)
    total = due.sum()
    for _ in range(ROUNDS):
        before = weight.copy()
        for codes, shares in others:
            have = np.bincount(codes, weight * tokens, len(shares))
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = np.where(have > 0, shares * total / have, 1.0)
            weight = weight * factor[codes]
        for _ in range(20):  # what a cap cuts off goes to the other cells of the source
            weight = np.minimum(weight, caps[source])
            loose = weight < caps[source]
            have = np.bincount(source, weight * tokens, len(due))
            free = np.bincount(source, weight * tokens * loose, len(due))
            if np.all(np.abs(due - have) <= TOLERANCE * np.maximum(1.0, due)):
                break
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = np.where(free > 0, np.maximum(0.0, (due - have + free) / free), 1.0)
            weight = np.where(loose, weight * factor[source], weight)
        weight = np.minimum(weight, caps[source])
        if np.max(np.abs(weight - before), initial=0.0) < TOLERANCE:
            break
    return weight


def calibrated_copies(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 0) -> DataFrame:
    """docs (doc_id, source, lang, topic, n_tokens) with `copies`, how often each
    is taken (0 for most that are not).  Documents of no target source, or without
    tokens, are not taken.  total_tokens is by default what the target sources hold.
    """
    spark = docs.sparkSession
    wanted = [(r["_s"], r["share"], r["cap"]) for r in targets.groupBy(source_of(F.col("source")).alias("_s")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect() if r["_s"]]
    known = docs.where(F.col("source").isin([s for s, _, _ in wanted]) & (F.col("n_tokens") > 0))
    topic = F.coalesce("topic", F.lit(""))
    celled = known.withColumns({"topic": topic, "lang": F.coalesce("lang", F.lit(""))})
    cells = celled.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).toPandas()
    names = [s for s, _, _ in wanted]
    source = np.array([names.index(s) for s in cells["source"]], dtype=int)
    tokens = cells["tokens"].to_numpy(dtype=float)
    shares, caps = np.array([x or 0.0 for _, x, _ in wanted], dtype=float), np.array([x or 0 for _, _, x in wanted], dtype=float)
    available = np.bincount(source, tokens, len(names)) if len(cells) else np.zeros(len(names))
    due = fill_shares(available, shares, caps, total_tokens or tokens.sum())
    others = []
    for column in ("lang", "topic"):
        codes, kinds = cells[column].factorize()
        own = np.bincount(codes, tokens, max(1, len(kinds)))
        others.append((codes, own / max(1.0, own.sum())))
    cells["weight"] = rake(tokens, source, others, due, caps) if len(cells) else []
    blocks = max(1, int(-(-cells["docs"].sum() // BLOCK_DOCS)))
    weights = spark.createDataFrame(cells[["source", "lang", "topic", "weight"]], "source string, lang string, topic string, weight double")
    joined = celled.join(weights, ["source", "lang", "topic"])  # broadcast by Spark where the cells are few
    joined = joined.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks)))
    order = W.partitionBy("source", "_block").orderBy("lang", "topic", "n_tokens", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64(F.lit(seed), "source", "_block"), F.lit(1_000_003)) / 1_000_003
    placed = joined.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", F.sum("weight").over(order).alias("_upto"), start.alias("_start"))
    placed = materialize(placed, "placed")
    copies = lambda shift: (F.floor(F.round(F.col("_upto") + shift, 9)) - F.floor(F.round(F.col("_upto") + shift - F.col("weight"), 9))).cast("int")
    # of DRAWS equally good draws, which differ by where they start, the one whose tokens come nearest to what is due
    shift = lambda i: F.col("_start") + i / DRAWS
    drawn = placed.groupBy("source").agg(*[F.sum(copies(shift(i)) * F.col("n_tokens")).alias(f"t{i}") for i in range(DRAWS)]).collect()
    best = {r["source"]: min(range(DRAWS), key=lambda i: (abs(r[f"t{i}"] - due[names.index(r["source"])]), i)) for r in drawn}
    chosen = F.lit(0.0)
    for name, i in best.items():
        chosen = F.when(F.col("source") == name, F.lit(i / DRAWS)).otherwise(chosen)
    return placed.select("doc_id", "source", "lang", "topic", "n_tokens", copies(F.col("_start") + chosen).alias("copies"))


def documents_with_sizes(documents: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens; the topic is the organisation of the repository."""
    meta = documents.select(
        "doc_id", source_of(F.col("source")).alias("source"), language_of(F.col("lang")).alias("lang"),
        F.regexp_extract(F.coalesce("repo_key", F.lit("")), r"^[^/]+/([^/]+)/", 1).alias("topic"),
    )
    return meta.join(counts, "doc_id")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 0) -> DataFrame:
    """The drawn sample: doc_id, source, lang, topic, n_tokens, copies > 0."""
    return calibrated_copies(docs, targets, total_tokens, seed).where("copies > 0")


def mix_report(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 0) -> DataFrame:
    """A row for each target source: what it has, what was drawn, the share in
    fact reached and the most copies of one document."""
    docs = materialize(docs, "sized")
    drawn = calibrated_copies(docs, targets, total_tokens, seed)
    sums = drawn.groupBy(F.col("source").alias("_d")).agg(
        F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    have = docs.groupBy(F.col("source").alias("_h")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("source_tokens"))
    asked = targets.select(source_of(F.col("source")).alias("source"), "target_share", "max_repeats")
    # the report has a row a target: the window over all of them is that small
    total = F.sum("mixed_tokens").over(W.partitionBy(F.lit(1)))
    full = asked.join(have, F.col("source") == F.col("_h"), "left").join(sums, F.col("source") == F.col("_d"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return full.select(
        "source", "target_share", "max_repeats", zero("n_docs").alias("n_docs"), zero("source_tokens").alias("source_tokens"),
        zero("n_copies").alias("n_copies"), zero("mixed_tokens").alias("mixed_tokens"), zero("most_copies").alias("most_copies"),
        F.round(zero(F.col("mixed_tokens") / total), 6).alias("actual_share"),
    )


def mix_margins(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 0) -> DataFrame:
    """How near the drawn mix comes to each margin: margin (source, lang, topic), value,
    due_share (a source's target; of a language or topic the share of the target sources'
    tokens it has) and reached_share.  Caps, and sources that are short of documents, keep
    margins from being met; a source without documents reaches 0."""
    drawn = materialize(calibrated_copies(materialize(docs, "sized"), targets, total_tokens, seed), "drawn")
    margin = lambda c: F.struct(F.lit(c).alias("margin"), F.col(c).alias("value"))
    each = drawn.select(F.explode(F.array(*[margin(c) for c in ("source", "lang", "topic")])).alias("m"), "n_tokens", (F.col("copies") * F.col("n_tokens")).alias("taken"))
    sums = each.groupBy("m.margin", "m.value").agg(F.sum("n_tokens").alias("have"), F.sum("taken").alias("taken"))
    totals = drawn.agg(F.sum("n_tokens").alias("all_have"), F.sum(F.col("copies") * F.col("n_tokens")).alias("all_taken"))  # one row
    asked = targets.groupBy(source_of(F.col("source")).alias("_s")).agg(F.sum("target_share").alias("_share")).where("_s IS NOT NULL")
    both = sums.join(asked.withColumn("_m", F.lit("source")), (F.col("margin") == F.col("_m")) & (F.col("value") == F.col("_s")), "full").crossJoin(totals)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    due = F.coalesce("_share", F.try_divide(F.col("have"), F.col("all_have")))
    return both.select(
        F.coalesce("margin", "_m").alias("margin"), F.coalesce("value", "_s").alias("value"),
        F.round(due, 6).alias("due_share"), F.round(zero(F.try_divide(F.col("taken"), F.col("all_taken"))), 6).alias("reached_share"))
