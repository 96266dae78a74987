"""Conversations rebuilt from message rows.

A channel is all main rows of one session.  Its turns are the rows of a human or an
agent with some text, copies in another dress taken once.  Turns are sorted, with
the instants of their strings; a silence longer than a gap calibrated on all gaps
of the corpus parts a session.  Roles are known by their spelling, and where a
spelling is unknown inferred from how its rows alternate with known ones.  Each part
is summed up (sides, first and last turn, turns that clash), and the sums of a
session's parts say whether it is empty, broken or unanswered: ``found_broken``.
``rebuild`` gives the turns of the others.

Windows run in blocks of seq and hand on one row a block, everything else is
combinable aggregates of numbers, so one huge session burdens no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skeinlake.llm.canonical import KEY, counts_as_text, with_copy_key
from skeinlake.operators.instants import to_epoch_us
from skeinlake.session import materialize

#: Spellings of the two sides, without case, blanks and punctuation.
HUMAN = ["user", "human", "person", "customer", "enduser", "humanuser"]
AGENT = ["assistant", "agent", "model", "ai", "bot", "aiassistant", "chatbot", "gpt", "llm"]
#: Spellings of rows that are no turns.
NEITHER = ["tool", "tooluse", "toolresult", "toolcall", "function", "system", "developer", "thinking", "reasoning", "note", "memory", "summary", "environment"]
#: A spelling that is in no list is a side if this part of its rows, at least, follows and precedes the other side.
ALTERNATES = 0.8

#: Turns of one session are windowed in blocks of so many seq numbers.
BLOCK = 10_000
#: The calibrated gap: this quantile of the gaps between turns, times a factor, and at least so long.
GAP_QUANTILE, GAP_FACTOR, GAP_LEAST_S = 0.75, 12.0, 1800


USER, ASSISTANT = 1, 2


def plain_role(role: Column) -> Column:
    """A role without case, blanks and punctuation."""
    return F.lower(F.regexp_replace(role, r"[^\p{L}]+", ""))


def side_of(role: Column) -> Column:
    """user, assistant or null (tools, thinking, system, notes, unknown, null)."""
    plain = plain_role(role)
    return F.when(plain.isin(HUMAN), F.lit("user")).when(plain.isin(AGENT), F.lit("assistant"))


def _code(side: Column) -> Column:
    return F.when(side == "user", F.lit(USER)).when(side == "assistant", F.lit(ASSISTANT))


def inferred_sides(rows: DataFrame) -> DataFrame:
    """plain, side (a code) of spellings of roles that no list has: those whose rows
    mostly stand where only one side can, beside known turns of the other and no others.  Only
    sessions with such a spelling are sorted, in blocks of seq."""
    told = rows.where(counts_as_text(F.col("text")) & F.col("seq").isNotNull()).select("session_uuid", "seq", "row_no", plain_role(F.col("role")).alias("plain"))
    told = told.where(F.col("plain").isNotNull() & ~F.col("plain").isin(NEITHER))
    unknown = ~F.col("plain").isin(HUMAN + AGENT) & (F.col("plain") != "")
    # written first, so its size is known: mostly there is none, and nothing is shuffled to find that out
    concerned = materialize(told.where(unknown).select(F.col("session_uuid").alias("_s")).distinct(), "unknown-roles")
    own = told.join(concerned, F.col("session_uuid") == F.col("_s"), "left_semi").withColumn("_side", _code(side_of(F.col("plain"))))
    block = W.partitionBy("session_uuid", F.floor(F.col("seq") / BLOCK)).orderBy("seq", "row_no")
    placed = own.select("plain", unknown.alias("_u"), F.lag("_side").over(block).alias("_b"), F.lead("_side").over(block).alias("_a")).where("_u")
    share = lambda other: F.avg(((F.coalesce("_b", F.lit(other)) == other) & (F.coalesce("_a", F.lit(other)) == other) & F.coalesce("_a", "_b").isNotNull()).cast("double"))
    counted = placed.groupBy("plain").agg(share(ASSISTANT).alias("_user"), share(USER).alias("_agent"))
    side = F.when(F.col("_user") >= ALTERNATES, F.lit(USER)).when(F.col("_agent") >= ALTERNATES, F.lit(ASSISTANT))
    return counted.select("plain", side.alias("side")).where("side IS NOT NULL")


def turns_of(rows: DataFrame, banks: DataFrame | None = None) -> DataFrame:
    """Rows of tier session reduced to their turns, one for each text: session_uuid,
    the turn's side (a code), seq, row_no and at_us, those of the copy with the
    smallest row_no.  A session keeps one more row of null side for its other rows.
    Without `banks` (or ts and bank) no instants are read."""
    main = rows.where((F.col("tier") == "session") & F.col("session_uuid").isNotNull())
    # a row a spelling, written, so that texts don't move to meet it
    learnt = materialize(inferred_sides(main).select(F.col("plain").alias("_p"), F.col("side").alias("_learnt")), "learnt-roles")
    slim = main.select("session_uuid", "row_no", "seq", "role", "text", *(["ts", "bank"] if banks is not None else []))
    slim = slim.join(learnt, plain_role(F.col("role")) == F.col("_p"), "left")
    side = F.when(counts_as_text(F.col("text")), F.coalesce(_code(side_of(F.col("role"))), "_learnt"))
    slim = slim.withColumn("_side", side)
    if banks is not None:
        zones = banks.select(F.col("bank").alias("_bank"), F.col("tz").alias("_tz")).dropDuplicates(["_bank"])
        slim = slim.join(zones, F.col("bank") == F.col("_bank"), "left").withColumn("_at", to_epoch_us(F.when(F.col("_side").isNotNull(), F.col("ts")), F.col("_tz")))
    else:
        slim = slim.withColumn("_at", F.lit(None).cast("long"))
    # rows that are no turn hash as one text, and combine to one row a session and task
    keyed = with_copy_key(slim.withColumn("_turn", F.when(F.col("_side").isNotNull(), F.col("text"))), "_turn", ["session_uuid"])
    first = lambda c: F.min_by(c, "row_no")  # noqa: E731  numbers only, so the aggregate is hashed
    return keyed.groupBy("session_uuid", F.col("_side").isNotNull().alias("_is_turn"), *KEY).agg(
        F.min("row_no").alias("row_no"), first("seq").alias("seq"), first("_side").alias("side"), first("_at").alias("at_us")
    ).select("session_uuid", "row_no", "seq", "side", "at_us")


def _with_gap(turns: DataFrame) -> DataFrame:
    """Turns with a seq, with _gap (seconds since the turn before of the same session,
    null at its start or where an instant is missing) and _clash (the turn before has
    the same seq).  `lag` runs in blocks of seq; the first turn of a block gets the
    last instant of the block before."""
    blocked = turns.where("side IS NOT NULL AND seq IS NOT NULL").withColumn("_block", F.floor(F.col("seq") / BLOCK))
    within = W.partitionBy("session_uuid", "_block").orderBy("seq", "at_us", "row_no")
    ends = blocked.groupBy("session_uuid", "_block").agg(F.max_by("at_us", "seq").alias("_end"))
    ends = ends.select(
        F.col("session_uuid").alias("_su"), F.col("_block").alias("_b"),
        F.lag("_end").over(W.partitionBy("session_uuid").orderBy("_block")).alias("_before"),
    )
    lagged = blocked.withColumns({"_lag": F.lag("at_us").over(within), "_at_start": F.row_number().over(within) == 1, "_clash": F.coalesce(F.lag("seq").over(within) == F.col("seq"), F.lit(False))})
    joined = lagged.join(ends, (F.col("session_uuid") == F.col("_su")) & (F.col("_block") == F.col("_b")), "left").drop("_su", "_b")
    before = F.when(F.col("_at_start"), F.col("_before")).otherwise(F.col("_lag"))
    return joined.withColumn("_gap", (F.col("at_us") - before) / 1_000_000).drop("_lag", "_at_start", "_before")


def calibrated_gap(gaps: DataFrame) -> float:
    """Seconds of silence that part a session, from all gaps of the corpus."""
    found = gaps.agg(F.percentile_approx("_gap", GAP_QUANTILE, 10_000)).first()[0]
    return max(GAP_LEAST_S, GAP_FACTOR * (found or 0.0))


def sessionized(turns: DataFrame) -> DataFrame:
    """Turns with a seq and the `part` of their session they are in, counted from 0."""
    gapped = materialize(_with_gap(turns), "gaps")
    cut = F.coalesce((F.col("_gap") > calibrated_gap(gapped)).cast("int"), F.lit(0))
    within = W.partitionBy("session_uuid", "_block").orderBy("seq", "at_us", "row_no").rowsBetween(W.unboundedPreceding, 0)
    counted = gapped.withColumn("_cuts", F.sum(cut).over(within))
    blocks = gapped.groupBy("session_uuid", "_block").agg(F.sum(cut).alias("_n")).select(
        F.col("session_uuid").alias("_su"), F.col("_block").alias("_b"),
        F.coalesce(F.sum("_n").over(W.partitionBy("session_uuid").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"),
    )
    joined = counted.join(blocks, (F.col("session_uuid") == F.col("_su")) & (F.col("_block") == F.col("_b")))
    return joined.select("session_uuid", (F.col("_cuts") + F.col("_earlier")).alias("part"), "seq", "side", "row_no", "at_us", "_clash")


def part_sums(parted: DataFrame) -> DataFrame:
    """session_uuid, part, turns of either side, first and last seq and the side there,
    and whether turns clash.  A part of both sides is reciprocal."""
    return parted.groupBy("session_uuid", "part").agg(
        F.count_if(F.col("side") == USER).alias("n_user"), F.count_if(F.col("side") == ASSISTANT).alias("n_agent"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("side", "seq").alias("first_side"), F.max_by("side", "seq").alias("last_side"),
        F.bool_or("_clash").alias("clash"),
    )


def verdicts(turns: DataFrame, parts: DataFrame) -> DataFrame:
    """session_uuid, n_turns, reason: `empty`, `broken` (a turn without seq, two
    different turns of one seq, or an agent first), `no_reply` (a human last, so the
    last exchange is not reciprocal), in this order, or null for a whole conversation.
    `parts` are the sums of the sessionized turns."""
    rows = turns.groupBy("session_uuid").agg(F.count("side").alias("n_turns"), F.count_if(F.col("side").isNotNull() & F.col("seq").isNull()).alias("_unplaced"))
    whole = parts.groupBy(F.col("session_uuid").alias("_su")).agg(
        F.bool_or("clash").alias("_clash"), F.min_by("first_side", "first_seq").alias("_first"), F.max_by("last_side", "last_seq").alias("_last"))
    reason = (
        F.when(F.col("n_turns") == 0, F.lit("empty"))
        .when((F.col("_unplaced") > 0) | F.col("_clash") | (F.col("_first") == ASSISTANT), F.lit("broken"))
        .when(F.col("_last") == USER, F.lit("no_reply"))
    )
    return rows.join(whole, F.col("session_uuid") == F.col("_su"), "left").select("session_uuid", "n_turns", reason.alias("reason"))


def found_broken(rows: DataFrame, banks: DataFrame | None = None) -> DataFrame:
    """Conversations to drop: session_uuid, reason.  Null sessions and other tiers are
    no conversations; an empty table gives none; without `banks` (or the columns ts and
    bank) a session is one part."""
    turns = materialize(turns_of(rows, banks), "turns")
    return verdicts(turns, part_sums(sessionized(turns))).where(F.col("reason").isNotNull()).select("session_uuid", "reason")


def rebuild(rows: DataFrame, banks: DataFrame) -> DataFrame:
    """Turns of whole conversations: session_uuid, part (from 0, split at calibrated
    gaps), seq, role (user or assistant), row_no, text, at_us (null if unknown).

    Rows of null session, other tiers and other roles are left out, copies taken
    once, conversations with a verdict dropped; empty tables give none.  Texts stay out
    of all sorting and are fetched for the turns that are kept."""
    turns = materialize(turns_of(rows, banks), "turns")
    parted = materialize(sessionized(turns), "parts")
    whole = verdicts(turns, part_sums(parted)).where(F.col("reason").isNull()).select(F.col("session_uuid").alias("_su"))
    kept = parted.join(whole, F.col("session_uuid") == F.col("_su"), "left_semi")
    texts = rows.where((F.col("tier") == "session") & counts_as_text(F.col("text"))).select(F.col("row_no").alias("_row"), "text")
    role = F.when(F.col("side") == USER, F.lit("user")).otherwise(F.lit("assistant"))
    return kept.join(texts, F.col("row_no") == F.col("_row")).select("session_uuid", "part", "seq", role.alias("role"), "row_no", "text", "at_us")
