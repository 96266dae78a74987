from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skeinlake.operators import instants as N


def us(*parts, micro=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


CASES = [
    ("2026-03-01T10:20:30.5Z", None, us(2026, 3, 1, 10, 20, 30, micro=500_000)),
    ("2026-03-01T10:20:30.123456789Z", None, us(2026, 3, 1, 10, 20, 30, micro=123_456)),
    ("2026-03-01T10:20:30.1234567890123Z", None, us(2026, 3, 1, 10, 20, 30, micro=123_456)),
    ("2026-03-01T10:20:30." + "12" * 200 + "Z", None, us(2026, 3, 1, 10, 20, 30, micro=121_212)),
    (" " * 100 + "2026-03-01T10:20:30.5Z" + "\n" * 100, None, us(2026, 3, 1, 10, 20, 30, micro=500_000)),
    ("1960-07-01 10:00:00", "Europe/London", us(1960, 7, 1, 9)),
    ("1890-07-01 10:00:00", "UTC", us(1890, 7, 1, 10)),
    ("2250-07-01 10:00:00", "Europe/Berlin", us(2250, 7, 1, 8)),
    ("2399-01-01 10:00:00", "America/New_York", us(2399, 1, 1, 15)),
    ("9999-07-01 10:00:00", "Europe/Berlin", us(9456, 7, 1, 8)),
    (" 2026-03-01t10:20:30.123z ", None, us(2026, 3, 1, 10, 20, 30, micro=123_000)),
    ("2026-03-01T10:20Z", None, us(2026, 3, 1, 10, 20)),
    ("2026-03-01T10:20:30+0700", "UTC", us(2026, 3, 1, 3, 20, 30)),
    ("2026-03-01T10:20:30-05:30", "UTC", us(2026, 3, 1, 15, 50, 30)),
    ("2026-03-01T10:20:30+07:00[Asia/Bangkok]", "UTC", us(2026, 3, 1, 3, 20, 30)),
    ("2026-03-01 10:20:30 Asia/Bangkok", None, us(2026, 3, 1, 3, 20, 30)),
    ("2026-03-01 10:20:30", "Asia/Kolkata", us(2026, 3, 1, 4, 50, 30)),
    ("Sun, 01 Mar 2026 10:20:30 +0700", None, us(2026, 3, 1, 3, 20, 30)),
    ("1 March 2026 10:20 UTC", None, us(2026, 3, 1, 10, 20)),
    ("01.03.2026 10:20:30 CET", None, us(2026, 3, 1, 9, 20, 30)),
    ("03/01/2026 10:20:30 PM EST", None, us(2026, 3, 2, 3, 20, 30)),
    ("03/01/2026 12:20:30 AM", "UTC", us(2026, 3, 1, 0, 20, 30)),
    ("01/03/2569 10:20", "Asia/Bangkok", us(2026, 3, 1, 3, 20)),
    ("1772360430", None, us(2026, 3, 1, 10, 20, 30)),
    ("1772360430.361", None, us(2026, 3, 1, 10, 20, 30, micro=361_000)),
    ("1772360430361", None, us(2026, 3, 1, 10, 20, 30, micro=361_000)),
    ("1772360430361123", None, us(2026, 3, 1, 10, 20, 30, micro=361_123)),
    ("1772360430361123456", None, us(2026, 3, 1, 10, 20, 30, micro=361_123)),
    # twice: the first; skipped: the offset before
    ("2025-11-02 01:30:00", "America/New_York", us(2025, 11, 2, 5, 30)),
    ("2025-03-09 02:30:00", "America/New_York", us(2025, 3, 9, 7, 30)),
    ("2025-10-26T02:30:00", "Europe/Berlin", us(2025, 10, 26, 0, 30)),
    ("2025-03-30T02:30:00", "Europe/Berlin", us(2025, 3, 30, 1, 30)),
    ("2025-10-05 02:30:00", "Australia/Sydney", us(2025, 10, 4, 16, 30)),
    ("๒๐๒๖-๐๓-๐๑ ๑๐:๒๐:๓๐", "UTC", us(2026, 3, 1, 10, 20, 30)),
    ("2025-02-30T10:00:00Z", None, None), ("2025-13-01 10:00:00", "UTC", None), ("0000-00-00T00:00:00Z", None, None),
    ("T12:30:00Z", None, None), ("yesterday", "UTC", None), ("n/a", "UTC", None), ("", "UTC", None), (None, "UTC", None),
    ("2026-03-01", "UTC", None), ("2026-03-01 10:20:30", None, None), ("2026-03-01 10:20:30", "No/Where", None),
    ("2026-03-01 25:20:30", "UTC", None), ("03/01/2026 13:20:30 PM", "UTC", None), ("x" * 5000, "UTC", None), ("2026-03-01X10:20:30Z", None, None),
]


def test_forms(spark):
    df = spark.createDataFrame([(i, v, z) for i, (v, z, _) in enumerate(CASES)], "i int, v string, z string")
    got = {r["i"]: r["us"] for r in df.select("i", N.to_epoch_us(F.col("v"), F.col("z")).alias("us")).collect()}
    assert {CASES[i][0]: got[i] for i in got} == {v: want for v, _, want in CASES}


def test_usual_form_and_nulls_in_columns(spark):
    rows = spark.createDataFrame(
        [(1, "b", "2026-03-01T10:20:30.123Z", "junk"), (2, "b", "1772360430", None), (3, None, "2026-03-01 10:20:30", ""), (4, "b", "2026-03-01 10:20:30", "x"), (4, "b", "2026-03-01 10:20:30", "x")],
        "row_no long, bank string, ts string, tz string",
    )
    banks = spark.createDataFrame([("b", "Asia/Bangkok"), ("b", "UTC"), (None, "UTC")], "bank string, tz string").limit(1)
    got = sorted(tuple(r) for r in N.found_instants(rows, ["ts"], "row_no", "event_rows", banks).collect())
    assert got == [("event_rows", 2, "ts", us(2026, 3, 1, 10, 20, 30)), *[("event_rows", 4, "ts", us(2026, 3, 1, 3, 20, 30))] * 2]
    assert N.found_instants(rows.limit(0), ["ts"], "row_no", "event_rows", banks).count() == 0


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Australia/Sydney", "Asia/Kolkata", "Asia/Bangkok"])
def test_zone_table_against_the_library(zone):
    from datetime import timedelta
    from zoneinfo import ZoneInfo

    table = N.zone_table(zone)
    for hour in range(0, 2 * 365 * 24, 1):
        wall = datetime(2025, 1, 1) + timedelta(hours=hour, minutes=30)
        first = wall.replace(tzinfo=ZoneInfo(zone), fold=0).utcoffset().total_seconds()
        seconds = np.array([int(wall.replace(tzinfo=timezone.utc).timestamp())])
        assert table.offset_of_local(seconds)[0] == first


def test_mask_is_parsed_once():
    N.parser_of.cache_clear()
    values = pd.Series(["2026-03-01 10:20:30"] * 100)
    N.convert(values, pd.Series(["9999-99-99 99:99:99"] * 100), pd.Series(["UTC"] * 100))
    assert N.parser_of.cache_info().misses == 1
