"""Bringing files into the tables: choosing, attributing, parsing, filtering, writing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skeinlake.functions.text import FORGES, noise_rule, repo_key_of
from skeinlake.operators.mutations import delete, keep_last
from skeinlake.sources.files import Source, ingest_plan


def source_of_path(path: Column, sources: list[Source]) -> Column:
    """The key of the source with the longest root that holds the path, else null."""
    out = F.lit(None).cast("string")
    for s in sorted(sources, key=lambda s: len(s.path.rstrip("/"))):
        out = F.when(path.startswith(s.path.rstrip("/") + "/"), F.lit(s.key)).otherwise(out)
    return out


def resolve_repo_keys(rows: DataFrame, cwd: str, mappings: DataFrame, known: DataFrame, forges: list[str] = FORGES) -> DataFrame:
    """rows with repo_key: a mapping of the longest prefix (prefix, key), else the key the
    path shows, in the spelling of the known keys (key), else `_unresolved`.

    Prefixes are matched by equality with the path's own prefixes, not by comparing
    every row with every mapping."""
    at = rows.select(F.col(cwd).alias("_cwd")).distinct().where("_cwd IS NOT NULL")
    parts = F.split("_cwd", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    maps = mappings.select(F.regexp_replace("prefix", "/+$", "").alias("_prefix"), F.col("key").alias("_mapped"))
    hit = at.select("_cwd", F.explode(prefixes).alias("_p")).join(maps, F.col("_p") == F.col("_prefix"))
    mapped = hit.groupBy("_cwd").agg(F.max_by("_mapped", F.char_length("_prefix")).alias("_mapped"))
    spelt = known.groupBy(F.lower("key").alias("_low")).agg(F.min("key").alias("_key"))
    shown = at.withColumn("_shown", repo_key_of(F.col("_cwd"), forges)).join(mapped, "_cwd", "left").join(spelt, F.lower("_shown") == F.col("_low"), "left")
    keys = shown.select("_cwd", F.coalesce("_mapped", "_key", "_shown").alias("_repo"))
    return rows.join(keys, F.col(cwd) == F.col("_cwd"), "left").withColumn("repo_key", F.coalesce("_repo", F.lit("_unresolved"))).drop("_cwd", "_repo")


def dedupe_notes(found: DataFrame, keys: list[str], is_worktree: str) -> DataFrame:
    """One of the copies of a note (same repository, path within it and size): the main checkout's first."""
    best = F.min_by(F.struct(*found.columns), F.struct(F.col(is_worktree), F.col("path"))).alias("_r")
    return found.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(best).select("_r.*")


def seek(found: DataFrame, prefix: str) -> DataFrame:
    """Files of sessions whose id begins so: named by it, below a folder named by it, or bearing it anywhere in a flat name."""
    low, path = prefix.lower(), F.lower("path")
    name = F.element_at(F.split(path, "/"), -1)
    return found.where(name.startswith(low) | path.rlike(rf"/{low}[0-9a-f-]*/subagents/") | name.contains(low))


def tree_files(found: DataFrame, session: str) -> DataFrame:
    return found.where(F.col("path").contains(f"/{session}.jsonl") | F.col("path").contains(f"/{session}/subagents/"))


def unindexed_in_tree(found: DataFrame, indexed: DataFrame, tree: str) -> DataFrame:
    """By tree the files on disk that the index lacks, the worst first."""
    return found.join(indexed.select("path").distinct(), "path", "left_anti").groupBy(tree).agg(F.count(F.lit(1)).alias("n"), F.max("mtime").alias("newest")).orderBy(F.desc("n"), tree)


def import_files(
    found: DataFrame, manifest: DataFrame, events: DataFrame, parse: Callable[[DataFrame], DataFrame], keep_noise: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, manifest, skipped) after an import: files that are new or changed are
    parsed, noise is set aside with its rule, the last row of a uid in a file counts,
    what the files had before is replaced.  Run again, it changes nothing."""
    todo = ingest_plan(found, manifest).select("path", "mtime", "size")
    fresh = parse(todo).withColumn("_rule", F.lit("") if keep_noise else noise_rule(F.col("text"), F.col("role")))
    skipped = fresh.where("_rule <> ''").select("uid", "file_path", "seq", "role", F.col("_rule").alias("rule"), F.octet_length("text").alias("bytes"), F.substring("text", 1, 120).alias("head"))
    kept = keep_last(fresh.where("_rule = ''").drop("_rule"), ["uid", "file_path"], "seq")
    gone = todo.select(F.col("path").alias("file_path"))
    after = delete(events, gone, ["file_path"]).unionByName(kept, allowMissingColumns=True)
    known = delete(manifest, todo, ["path"]).unionByName(todo, allowMissingColumns=True)
    return after, known, skipped


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; torn lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_rows(rows: DataFrame, path: str, form: str = "jsonl") -> None:
    """Results as jsonl, tsv or parquet."""
    if form == "tsv":
        rows.write.option("sep", "\t").option("header", True).csv(path)
    else:
        rows.write.format({"jsonl": "json"}.get(form, form)).save(path)


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key of a foreign store, combined on the map side."""
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def previous_session(found: DataFrame, here: Column, me: str, last_event: str, human_turns: str, n_events: str, slack: int = 8) -> DataFrame:
    """Of the newest files of a place that aren't the caller's own the first that a
    person took part in, else the newest."""
    newest = found.where(here & ~F.col("path").contains(me)).orderBy(F.desc(last_event), "path").limit(slack)  # a caller looks at so many
    rank = F.struct((F.col(human_turns) > 0) & (F.col(n_events) > 2), F.col(last_event), F.col("path"))
    return newest.agg(F.max_by("path", rank).alias("path"), F.max(rank)["col1"].alias("by_a_person"))


def best_copies(found: DataFrame, session: str, weight: str, n: int, order: str) -> DataFrame:
    """Of the copies of a session the heaviest, then the first n by `order`."""
    best = F.max_by(F.struct(*found.columns), F.struct(weight, "path")).alias("_r")
    one = found.groupBy(F.col(session).alias("_s")).agg(best).select("_r.*")
    return one.orderBy(order).limit(n) if n > 0 else one
