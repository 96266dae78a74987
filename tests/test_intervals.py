import random

import pytest

from skeinlake.operators import intervals as I

SCHEMA = "chain_id string, start_ms long, end_ms long, kind string, _s string"


def brute(rows):
    by = {}
    for chain, s, e, *_ in rows:
        by.setdefault(chain, []).append((s, e))
    out = set()
    for chain, own in by.items():
        own.sort()
        low, high, n, work = *own[0], 0, 0
        for s, e in own:
            if s > high:
                out.add((chain, low, high, n, work))
                low, high, n, work = s, e, 0, 0
            high, n, work = max(high, e), n + 1, work + e - s
        out.add((chain, low, high, n, work))
    return out


def periods(spark, rows, slot=I.SLOT_MS):
    df = I.merge_intervals(spark.createDataFrame(rows, SCHEMA), "chain_id", "start_ms", "end_ms", slot)
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("slot", [10, 1000, I.SLOT_MS])
def test_merge_equals_brute_force_whatever_the_slot(spark, slot):
    rng = random.Random(slot)
    rows = []
    for _ in range(600):
        s = rng.randrange(1, 5000)
        rows.append((rng.choice(["hot"] * 3 + list("abc") + [None]), s, s + rng.choice([0, 0, 1, 5, 40, 900]), "x", "y"))
    assert periods(spark, rows, slot) == brute(rows)


def test_touching_nested_and_lengthless(spark):
    rows = [("a", 1, 5, "", ""), ("a", 5, 7, "", ""), ("a", 2, 3, "", ""), ("a", 7, 7, "", ""), ("a", 9, 9, "", ""), ("a", 9, 9, "", "")]
    assert periods(spark, rows) == {("a", 1, 7, 4, 7), ("a", 9, 9, 2, 0)}


def test_a_long_interval_over_many_slots(spark):
    day = 86_400_000
    rows = [("a", 1, 40 * day, "", ""), ("a", 10 * day, 10 * day + 5, "", ""), ("a", 41 * day, 42 * day, "", "")]
    assert periods(spark, rows) == {("a", 1, 40 * day, 2, 40 * day - 1 + 5), ("a", 41 * day, 42 * day, 1, day)}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert I.merge_intervals(df, "chain_id", "start_ms", "end_ms").count() == 0


def test_report(spark):
    groups = spark.createDataFrame(
        [
            (1, "a", 10, 20, "2026-01-01", "old"), (1, "a", 10, 30, "2026-01-02", "new"), (1, "a", 10, 30, "2026-01-02", "new"),
            (2, "a", 30, 25, "2026-01-01", ""), (3, "a", 50, None, "2026-01-01", ""), (4, "a", 0, 99, "2026-01-01", ""), (5, "a", None, 99, "2026-01-01", ""),
            (6, "b", 5, 6, None, ""),
        ],
        "group_id long, chain_id string, start_ms long, end_ms long, loaded_at string, kind string",
    )
    chains = spark.createDataFrame([("a", None, 20), ("b", 1, None), ("c", None, None)], "chain_id string, wall_ms long, work_ms long")
    got = {tuple(r) for r in I.interval_report(groups, chains).collect()}
    assert got == {
        ("a", "period", 10, 30), ("a", "period", 50, 50), ("a", "gap", 30, 50), ("b", "period", 5, 6),
        ("a", "wall", 10, 50), ("b", "work", 5, 6),
    }
