"""Copies that differ only in dress: case, white space, punctuation, field order.

The canonical form is built in the JVM: case folding (upper, then lower, so that
letters such as sharp s meet), the JSON object of a tool call with its fields
sorted at every depth (a variant keeps objects sorted), and only letters, marks
and digits kept.  It is hashed to 128 bits; counts are combined on the map side,
so a group of copies of any size crosses the network as a few rows a task.
Texts whose 128 bits collide are told apart by length and checksum, which are
part of the grouping key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skeinlake.session import materialize

KEY = ["_h1", "_h2", "_check"]


def canonical_text(text: Column) -> Column:
    """Letters, marks and digits of the text in one case; null for null."""
    lower = F.lower(text)
    head = r"(?s)^([^\{]*)(\{.*\})([^\}]*)$"
    parsed = lambda t: F.to_json(F.try_parse_json(F.regexp_replace(F.regexp_extract(t, head, 2), r"\p{Cntrl}+", " ")))
    # fields that differ in case only clash in lower case; then they are sorted as written
    fields = F.coalesce(parsed(lower), F.lower(parsed(text)))
    sorted_call = F.concat(F.regexp_extract(lower, head, 1), fields, F.regexp_extract(lower, head, 3))
    called = F.when(text.rlike(r"(?i)^\W*tool.?use\b[^\{]*\{"), sorted_call)
    # the optimizer makes lower(upper(x)) lower(x), so the marks go in between
    return F.lower(F.regexp_replace(F.upper(F.coalesce(called, text)), r"[^\p{L}\p{M}\p{Nd}]+", ""))


def counts_as_text(text: Column) -> Column:
    """Has a letter or a digit."""
    return F.coalesce(text.rlike(r"[\p{L}\p{Nd}]"), F.lit(False))


def with_copy_key(df: DataFrame, text: str, scope: list[str]) -> DataFrame:
    """df with the 128-bit key (_h1, _h2) of scope and canonical text and _check."""
    own = df.withColumn("_canonical", canonical_text(F.col(text)))
    # crc32 and length of the canonical text are independent of the two hashes
    return own.withColumns({
        "_h1": F.xxhash64(*scope, "_canonical"),
        "_h2": F.xxhash64(F.lit("second"), *scope, "_canonical"),
        "_check": F.shiftleft(F.char_length("_canonical").cast("long"), 32).bitwiseXOR(F.crc32(F.encode("_canonical", "utf-8"))),
    }).drop("_canonical")


def copy_keys(df: DataFrame, id_column: str, text: str, scope: list[str]) -> DataFrame:
    """Of each row whose text counts: _id and its key; nothing else is kept, so
    extra columns of any name do no harm.  Null scope values are values."""
    slim = df.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"), *[F.col(c).alias(f"_s{i}") for i, c in enumerate(scope)])
    slim = slim.where(counts_as_text(F.col("_text")))
    # a null would leave a hash as it was, so it is marked
    scoped = [f"_s{i}" for i in range(len(scope))] + [f"_n{i}" for i in range(len(scope))]
    slim = slim.withColumns({f"_n{i}": F.col(f"_s{i}").isNull() for i in range(len(scope))}) if scope else slim
    return with_copy_key(slim, "_text", scoped).select("_id", *KEY)


def collapse_copies(df: DataFrame, id_column: str, text: str, scope: list[str]) -> DataFrame:
    """One row for each distinct text in its scope: the smallest id and the number
    of copies.  Null, empty and unlettered texts don't count; repeated rows are
    copies of each other; an empty table gives an empty result."""
    keys = copy_keys(df, id_column, text, scope)
    return keys.groupBy(*KEY).agg(F.min("_id").alias(id_column), F.count(F.lit(1)).alias("n_copies")).drop(*KEY)


def copies_of(df: DataFrame, id_column: str, text: str, scope: list[str]) -> DataFrame:
    """(first id, copy id) for each later row of a group of copies.

    The keys are written once and read twice.  Groups are unique on their side of
    the join, so the rows of one huge group can be split among tasks by AQE."""
    keys = materialize(copy_keys(df, id_column, text, scope), "copy-keys")
    groups = keys.groupBy(*KEY).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    paired = keys.join(groups, KEY).where(F.col("_id") != F.col("_first"))
    return paired.select(F.col("_first").alias(id_column), F.col("_id").alias(f"copy_{id_column}"))
