"""Full-text and nearest-neighbour search, fusion and the measures of retrieval.

A search is: tokens of the query, as literals, filter the postings; scores are
sums of per-term parts; the k best come from TakeOrderedAndProject.  Postings and
statistics are ordinary tables (`build_index`) that may be kept, partitioned by
bank, so that a query reads only the rows of its terms.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skeinlake.functions.text import char_ngrams, dot, has_gapless, tokens
from skeinlake.session import materialize

K1, B, LONGEST = 1.2, 0.75, 128


def query_terms(query: str) -> list[str]:
    found = re.findall(r"\w+", query.lower())
    return list(dict.fromkeys(t for t in found if len(t) <= LONGEST))


def postings(docs: DataFrame, id_column: str, text: str, scope: list[str], words: Column | None = None) -> DataFrame:
    """scope, id, dl (length), token, tf."""
    listed = docs.select(*scope, id_column, (tokens(F.col(text)) if words is None else words).alias("_t"))
    long = listed.select(*scope, id_column, F.size("_t").alias("dl"), F.explode("_t").alias("token"))
    return long.groupBy(*scope, id_column, "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def build_index(docs: DataFrame, id_column: str, text: str, scope: list[str] = []) -> dict[str, DataFrame]:  # noqa: B006
    """The tables of an index: postings, document frequencies, corpus statistics by
    scope.  Texts are broken once; the rest comes from the kept postings, which lie
    sorted by word, so that a filter on words skips the pages of all others."""
    posted = materialize(postings(docs, id_column, text, scope).repartition("token").sortWithinPartitions("token"), "postings")
    number = docs.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.count(text).alias("_texts"))
    length = posted.groupBy(*scope).agg(F.sum("tf").alias("_words"))
    both = number.join(length, scope, "left") if scope else number.crossJoin(length)  # one row each
    return {
        "postings": posted,
        "df": posted.groupBy(*scope, "token").agg(F.count(F.lit(1)).alias("df")),
        "stats": both.select(*scope, "n", F.try_divide(F.coalesce("_words", F.lit(0)), F.col("_texts")).alias("avgdl")),
    }


def bm25_part(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column) -> Column:
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (F.lit(1 - B) + B * dl / avgdl))


def _times(listed: str, word: str) -> Column:
    return F.size(F.filter(listed, lambda t: t == word))


def bm25(docs: DataFrame, id_column: str, text: str, query: str, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """scope, id, score of every row with any word of the query; more words widen.
    Statistics are those of the whole table, or of each scope.

    One pass: term counts of the query's words are array functions of the row, so
    no posting is made of other words and nothing is shuffled but the statistics."""
    words = query_terms(query)
    if not words:
        return docs.select(*scope, id_column, F.lit(0.0).alias("score")).limit(0)
    listed = docs.select(*scope, id_column, tokens(F.col(text)).alias("_t"))
    counted = listed.select(*scope, id_column, F.size("_t").alias("_dl"), *[_times("_t", w).alias(f"_tf{i}") for i, w in enumerate(words)])
    stats = counted.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avgdl"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(words))])
    # without a scope this is one row; with one, a row for each shard
    joined = counted.crossJoin(F.broadcast(stats)) if not scope else counted.join(stats, scope)
    part = lambda i: F.when(F.col(f"_tf{i}") > 0, bm25_part(F.col(f"_tf{i}"), F.col(f"_df{i}"), F.col("_n"), F.col("_dl"), F.col("_avgdl"))).otherwise(0.0)
    score = sum((part(i) for i in range(len(words))), F.lit(0.0))
    return joined.select(*scope, id_column, score.alias("score")).where(F.col("score") > 0)


def bm25_from_index(index: dict[str, DataFrame], id_column: str, query: str, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """The same scores from kept postings: reads the query's words only."""
    words = query_terms(query)
    hit = index["postings"].where(F.col("token").isin(words))
    frequencies = index["df"].where(F.col("token").isin(words))
    joined = hit.join(F.broadcast(frequencies) if not scope else frequencies, [*scope, "token"])
    joined = joined.crossJoin(F.broadcast(index["stats"])) if not scope else joined.join(index["stats"], scope)
    return joined.groupBy(*scope, id_column).agg(F.sum(bm25_part(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl"))).alias("score"))


def contains_all(docs: DataFrame, text: str, query: str) -> DataFrame:
    """The unranked fallback: the query as it is, in any case."""
    return docs.where(F.lower(text).contains(query.lower()))


def top(ranked: DataFrame, k: int, by: list[Column]) -> DataFrame:
    """The first k rows; k <= 0 means all."""
    return ranked.orderBy(*by).limit(k) if k > 0 else ranked


def per_scope_top(ranked: DataFrame, scope: list[str], k: int, by: list[Column]) -> DataFrame:
    """The first k of each scope with their rank, and whether the scope had more.
    The filter on the rank lets Spark keep k + 1 rows a scope and task before it
    shuffles them."""
    own = W.partitionBy(*scope)
    marked = ranked.withColumn("rank", F.row_number().over(own.orderBy(*by)))
    if k <= 0:
        return marked.withColumn("capped", F.lit(False))
    few = marked.where(F.col("rank") <= k + 1)
    return few.withColumn("capped", F.max("rank").over(own) > k).where(F.col("rank") <= k)


def hit_totals(hits: DataFrame, scope: list[str], limit: int) -> DataFrame:
    """Hits in all, counted up to limit + 1 a scope: an exact count, or a floor where a scope was capped."""
    per = hits.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"))
    seen = F.least(F.col("_n"), F.lit(limit)) if limit > 0 else F.col("_n")
    over = F.col("_n") > limit if limit > 0 else F.lit(False)
    return per.agg(F.coalesce(F.sum(seen), F.lit(0)).alias("total"), F.count_if(over).alias("capped_scopes"), (F.count_if(over) == 0).alias("exact"))


def generic_terms(docs: DataFrame, text: str, words: list[str], scope: list[str], full: int = 3) -> DataFrame:
    """For each word the part of the scopes where at least `full` rows have it."""
    counts = docs.select(*scope, tokens(F.col(text)).alias("_t")).groupBy(*scope).agg(
        *[F.count_if(F.array_contains("_t", w.lower())).alias(f"w{i}") for i, w in enumerate(words)])
    shares = counts.agg(*[F.round(F.avg((F.col(f"w{i}") >= full).cast("double")), 6).alias(f"w{i}") for i in range(len(words))])
    pairs = F.array(*[F.struct(F.lit(w).alias("term"), F.col(f"w{i}").alias("df_fraction")) for i, w in enumerate(words)])
    return shares.select(F.explode(pairs).alias("p")).select("p.term", "p.df_fraction")


def cosine_top(vectors: DataFrame, id_column: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k nearest unit vectors by exact cosine, clamped to 0..1; filters on
    vectors come before, so none is lost behind them."""
    probe = F.array(*[F.lit(float(x)) for x in query])
    cosine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(F.col(vector), probe)))
    return top(vectors.select(id_column, cosine.alias("cosine")), k, [F.desc("cosine"), F.col(id_column)])


def knn_join(
    queries: DataFrame, vectors: DataFrame, query_id: str, id_column: str, vector: str, k: int, query_block: int = 2_000, vector_block: int = 20_000
) -> DataFrame:
    """The k nearest vectors of each of a stated set of queries, exactly: query,
    neighbour, cosine, rank; a query is no neighbour of itself.

    Both sides are cut into blocks by a hash of the id, and each pair of blocks is
    one matrix product in one task, which hands on k rows a query.  Nothing is
    broadcast; memory is bounded by the block sizes, whatever the tables."""
    left = queries.select(F.col(query_id).cast("long").alias("id"), F.col(vector).alias("v")).where("v IS NOT NULL")
    right = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v")).where("v IS NOT NULL")
    q_blocks, v_blocks = (max(1, -(-df.count() // size)) for df, size in ((left, query_block), (right, vector_block)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = left.withColumn("qb", block(q_blocks)).withColumn("vb", every(v_blocks))
    right = right.withColumn("vb", block(v_blocks)).withColumn("qb", every(q_blocks))

    def product(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"query": [], "neighbour": [], "cosine": []})
        scores = np.stack(q["v"]).astype(np.float64) @ np.stack(v["v"]).astype(np.float64).T
        own, ids = q["id"].to_numpy(), v["id"].to_numpy()
        scores[own[:, None] == ids[None, :]] = -np.inf
        # ties at the k-th place are settled by id, so all that reach it are looked at
        kth = np.partition(scores, max(0, scores.shape[1] - k), axis=1)[:, max(0, scores.shape[1] - k)]
        rows, columns = np.nonzero((scores >= kth[:, None]) & np.isfinite(scores))
        found = pd.DataFrame({"query": own[rows], "neighbour": ids[columns], "cosine": scores[rows, columns]})
        return found.sort_values(["query", "cosine", "neighbour"], ascending=[True, False, True]).groupby("query").head(k)

    scored = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(product, "query long, neighbour long, cosine double")
    best = W.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(lists: list[DataFrame], keys: list[str], k: int = 60) -> DataFrame:
    """keys, fused: the sum of 1 / (k + rank) over the lists (each with keys and rank)."""
    both = lists[0].select(*keys, "rank")
    for other in lists[1:]:
        both = both.unionByName(other.select(*keys, "rank"))
    return both.groupBy(*keys).agg(F.sum(F.lit(1.0) / (F.col("rank") + k)).alias("fused"))


def retrieval_measures(ranked: DataFrame, wanted: DataFrame, query: str, item: str, k: int, group: list[str] = []) -> DataFrame:  # noqa: B006
    """n, mrr, recall at 1 and k, misses, of known items in ranked lists."""
    found = wanted.join(ranked.where(F.col("rank") <= k).select(query, item, "rank"), [query, item], "left")
    rr = F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))
    return found.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(rr), 6).alias("mrr"), F.round(F.avg((F.coalesce("rank", F.lit(0)) == 1).cast("double")), 6).alias("recall_1"),
        F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("recall_k"), F.round(F.avg(F.col("rank").isNull().cast("double")), 6).alias("missed"))


def contingency(a: DataFrame, b: DataFrame, wanted: DataFrame, query: str, item: str) -> DataFrame:
    """How many known items both methods find, one of them, or none."""
    hit = lambda m, name: m.select(query, item, F.lit(True).alias(name))
    both = wanted.join(hit(a, "_a"), [query, item], "left").join(hit(b, "_b"), [query, item], "left")
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.agg(F.count_if(in_a & in_b).alias("hit_both"), F.count_if(in_a & ~in_b).alias("only_a"), F.count_if(~in_a & in_b).alias("only_b"), F.count_if(~in_a & ~in_b).alias("hit_none"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def text_overlap(texts: DataFrame, key: str, side: str, text: str) -> DataFrame:
    """key, overlap: Jaccard of the sets of all words of the texts of the two sides (a boolean), of their
    3-grams where a text of the key has letters of a script without word gaps.  Sets are rows, not lists."""
    keyed = texts.groupBy(key).agg(F.max(has_gapless(F.col(text))).alias("_grams"), F.max(side).alias("_any"), F.min(side).alias("_all"))
    both = keyed.where(F.col("_any") & ~F.col("_all")).select(key, "_grams")
    rows = texts.join(both, key)
    words = F.when(F.col("_grams"), char_ngrams(F.col(text))).otherwise(tokens(F.col(text), 2**31 - 1))
    found = rows.select(key, side, F.explode(words).alias("_w")).groupBy(key, "_w").agg((F.min(side) != F.max(side)).alias("_both"))
    return found.groupBy(key).agg((F.count_if("_both") / F.count(F.lit(1))).alias("overlap"))


def bootstrap_interval(values: DataFrame, value: str, resamples: int = 2000, seed: int = 7) -> DataFrame:
    """Mean and its 95 % interval by Poisson resampling: each row weighs a Poisson
    count that its hash decides, so it is one pass and repeatable."""
    uniform = lambda r: (F.pmod(F.xxhash64(F.lit(seed), r, F.xxhash64("_id")), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    numbered = values.select(F.col(value).cast("double").alias("_v"), F.xxhash64(*values.columns).alias("_id"))
    steps = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    each = numbered.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("_u", uniform(F.col("_r")))
    count = sum((F.when(F.col("_u") > s, 1).otherwise(0) for s in steps), F.lit(0))
    means = each.groupBy("_r").agg((F.sum(F.col("_v") * count) / F.sum(count)).alias("_m"))
    ends = means.agg(F.percentile("_m", 0.025).alias("low"), F.percentile("_m", 0.975).alias("high"))
    return numbered.agg(F.avg("_v").alias("mean")).crossJoin(ends)
