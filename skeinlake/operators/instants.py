"""Timestamps in many forms, precisions and zones, as microseconds since the epoch.

Every string is reduced to its shape mask (digits 9, letters a, the rest as it
is).  A mask is mapped to a parser once; all strings of one mask in a batch are
then converted together, as a matrix of code points.  Strings without a zone are
local time of their source and go through tables of zone transitions.

The usual form YYYY-MM-DDTHH:MM:SS.mmmZ never leaves the JVM.  Fractions may have any
number of digits, strings any length; a mask that fits no form is looked at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

USUAL = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"

#: Abbreviations of zones and their offsets in minutes.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "ict": 420, "sgt": 480, "hkt": 480, "awst": 480, "jst": 540, "kst": 540,
    "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cst": -360,
    "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
#: The first three letters of the months.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Digits of other scripts, each run of ten from zero.
OTHER_DIGITS = "".join(chr(zero + i) for zero in (0x0E50, 0x0660, 0x06F0, 0x0966, 0xFF10) for i in range(10))
#: Years of the Buddhist era are 543 ahead; a year from here on is taken for one.
BUDDHIST_FROM, BUDDHIST_AHEAD = 2400, 543

_TAIL = r"(?P<gap> ?)(?:(?P<sign>[+-])(?P<oh>99):?(?P<om>99)?(?:\[(?P<inner>[^\]]*)\])?|(?P<zone>a[a/_+\-9]*)|\[(?P<boxed>[^\]]*)\])?"
_CLOCK = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?"
#: Grammar of the masks.
FORMS = [
    re.compile(rf"^(?P<y>9999)[-/.](?P<mo>99)[-/.](?P<d>99)(?:(?P<sep>a)|,? +){_CLOCK}(?: (?P<ap>aa)(?![a/]))?{_TAIL}$"),
    re.compile(rf"^(?P<y>9999)(?P<mo>99)(?P<d>99)(?P<sep>a)(?P<h>99)(?P<mi>99)(?:(?P<s>99)(?:[.,](?P<f>9+))?)?{_TAIL}$"),
    re.compile(rf"^(?:aa+,? )?(?P<d>99?)[ -](?P<mon>aaa+)[ -](?P<y>9999),? {_CLOCK}(?: (?P<ap>aa)(?![a/]))?{_TAIL}$"),
    re.compile(rf"^(?:aaa+,? )??(?P<mon>aaa+) (?P<d>99?),? (?P<y>9999),? {_CLOCK}(?: (?P<ap>aa)(?![a/]))?{_TAIL}$"),
    re.compile(rf"^(?P<d>99?)\.(?P<mo>99?)\.(?P<y>9999),? {_CLOCK}{_TAIL}$"),
    re.compile(rf"^(?P<p>99?)/(?P<q>99?)/(?P<y>9999),? {_CLOCK}(?: (?P<ap>aa)(?![a/]))?{_TAIL}$"),
]
#: Years of the tables of zone transitions, in seconds; after the last one the rules repeat with the calendar's cycle of 400 years.
_FIRST, _LAST = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (1970, 2438))
CYCLE = 146_097 * 86_400
_EPOCH = re.compile(r"^(?P<w>9{10}|9{13}|9{16}|9{19})(?:\.(?P<f>9+))?$")


@dataclass(frozen=True)
class ZoneTable:
    """Offsets (seconds) of a zone between its changes, and for each change the
    wall-clock second from which the later offset holds for a local time: a time
    that occurs twice means the first, a skipped one has the offset before.

    The table covers the years from 1970 to 2437.  Later years follow the
    zone's standing rule, which the calendar repeats every 400 years; a later time is
    looked up in the year of the table that many cycles before.  Earlier ones are
    asked of the zone database one by one."""

    name: str
    version: str
    from_local: np.ndarray
    offsets: np.ndarray

    def offset_of_local(self, wall: np.ndarray) -> np.ndarray:
        folded = np.where(wall >= _LAST, _LAST - CYCLE + (wall - _LAST) % CYCLE, wall)
        found = self.offsets[np.searchsorted(self.from_local, folded, side="right")]
        zone = ZoneInfo(self.name)
        for i in np.flatnonzero(wall < _FIRST):
            local = datetime(1970, 1, 1) + timedelta(seconds=int(wall[i]))
            found[i] = int(local.replace(tzinfo=zone).utcoffset().total_seconds())
        return found


def tz_version() -> str:
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "system"


@lru_cache(maxsize=1000)
def zone_table(name: str) -> ZoneTable | None:
    """The transitions of a zone by weekly probes and bisection; None if there is
    no such zone."""
    try:
        zone = ZoneInfo(name)
    except Exception:
        return None
    offset = lambda t: int(datetime.fromtimestamp(t, timezone.utc).astimezone(zone).utcoffset().total_seconds())
    at, end = _FIRST, _LAST
    offsets, walls, week = [offset(at)], [], 7 * 86400
    while at < end:
        if (after := offset(at + week)) != offsets[-1]:
            low, high = at, at + week
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == offsets[-1] else (low, mid)
            walls.append(high + max(offsets[-1], after))
            offsets.append(after)
        at += week
    return ZoneTable(name, tz_version(), np.array(walls, dtype=np.int64), np.array(offsets, dtype=np.int64))


def parser_of(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """What a mask means: ('epoch' or 'clock', spans of its fields); None if it
    names no instant.  Masks of a usual length are remembered."""
    return _remembered(mask) if len(mask) <= 200 else _parsed(mask)


def _parsed(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    if m := _EPOCH.match(mask):
        return "epoch", {k: m.span(k) for k in m.groupdict() if m[k] is not None}
    for form in FORMS:
        if m := form.match(mask):
            return "clock", {k: m.span(k) for k in m.groupdict() if m[k] is not None}
    return None


_remembered = lru_cache(maxsize=10_000)(_parsed)
parser_of.cache_clear, parser_of.cache_info = _remembered.cache_clear, _remembered.cache_info


def _number(codes: np.ndarray, span: tuple[int, int] | None, default: int = 0) -> np.ndarray:
    if span is None:
        return np.full(len(codes), default, dtype=np.int64)
    digits = codes[:, span[0] : span[1]].astype(np.int64) - 48
    return digits @ (10 ** np.arange(digits.shape[1] - 1, -1, -1, dtype=np.int64))


def _micro(codes: np.ndarray, span: tuple[int, int] | None, digits: int = 6) -> np.ndarray:
    """A fraction's leading digits, finer ones cut, missing ones zero."""
    if span is None:
        return np.zeros(len(codes), dtype=np.int64)
    kept = (span[0], min(span[1], span[0] + digits))
    return _number(codes, kept) * 10 ** (digits - (kept[1] - kept[0]))


def _words(values: np.ndarray, span: tuple[int, int]) -> list[str]:
    return [v[span[0] : span[1]].lower() for v in values]


def _epochs(codes: np.ndarray, spans: dict) -> np.ndarray:
    length = spans["w"][1] - spans["w"][0]
    whole = _number(codes, spans["w"])
    scale = {10: 1_000_000, 13: 1000, 16: 1}.get(length)
    if scale is None:
        return whole // 1000
    return whole * scale + _micro(codes, spans.get("f"), {10: 6, 13: 3, 16: 0}[length] or 1) * (length != 16)


def _clocks(values: np.ndarray, codes: np.ndarray, spans: dict, zones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(epoch_us, ok) of strings of one mask that give a date and a time."""
    n = len(values)
    ok = np.ones(n, dtype=bool)
    year, hour, minute, second = (_number(codes, spans.get(k)) for k in ("y", "h", "mi", "s"))
    buddhist = year >= BUDDHIST_FROM
    if "mon" in spans:
        names = {w: (MONTHS.index(w[:3]) + 1 if w[:3] in MONTHS else 0) for w in set(_words(values, spans["mon"]))}
        month, day = np.array([names[w] for w in _words(values, spans["mon"])], dtype=np.int64), _number(codes, spans["d"])
    elif "p" in spans:  # month first where the clock has twelve hours, else day first
        p, q = _number(codes, spans["p"]), _number(codes, spans["q"])
        month_first = np.full(n, "ap" in spans) & ~buddhist
        month, day = np.where(month_first, p, q), np.where(month_first, q, p)
    else:
        month, day = _number(codes, spans["mo"]), _number(codes, spans["d"])
    year = np.where(buddhist, year - BUDDHIST_AHEAD, year)
    if "ap" in spans:
        half = np.array([{"am": 0, "pm": 12}.get(w, -1) for w in _words(values, spans["ap"])], dtype=np.int64)
        ok &= (half >= 0) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + np.maximum(half, 0)
    if "sep" in spans:
        ok &= np.array([w == "t" for w in _words(values, spans["sep"])])
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    longest = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.where((month >= 1) & (month <= 12), month, 0)] + ((month == 2) & leap)
    ok &= (day >= 1) & (day <= longest) & (hour < 24) & (minute < 60) & (second < 60) & (year >= 1)
    month, day = np.where(ok, month, 1), np.where(ok, day, 1)
    days = (year - 1970).astype("datetime64[Y]").astype("datetime64[M]").astype(np.int64) + month - 1
    days = days.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + day - 1
    wall = days * 86400 + hour * 3600 + minute * 60 + second
    if "sign" in spans:
        minus = codes[:, spans["sign"][0]] == ord("-")
        oh, om = _number(codes, spans["oh"]), _number(codes, spans.get("om"))
        ok &= (oh <= 18) & (om < 60)
        offset = (oh * 3600 + om * 60) * np.where(minus, -1, 1)
    else:
        named = spans.get("zone") or spans.get("boxed")
        names = [v[named[0] : named[1]] for v in values] if named else list(zones)
        offset = np.zeros(n, dtype=np.int64)
        places, kinds = pd.factorize(pd.Series(names, dtype=object))
        ok &= places >= 0
        for i, name in enumerate(kinds):
            own = places == i
            if named and name.lower() in ABBREVIATIONS:
                offset[own] = ABBREVIATIONS[name.lower()] * 60
            elif (table := zone_table(name)) is not None:
                offset[own] = table.offset_of_local(wall[own])
            else:
                ok[own] = False
    return (wall - offset) * 1_000_000 + _micro(codes, spans.get("f")), ok


#: Characters of strings of one mask that are laid out as one matrix; bounds memory only.
MATRIX_CHARS = 4_000_000


def convert(values: pd.Series, masks: pd.Series, zones: pd.Series) -> pd.Series:
    """epoch_us of each string, null where it names no instant.  All strings of a
    mask are converted at once."""
    out = np.zeros(len(values), dtype=np.int64)
    good = np.zeros(len(values), dtype=bool)
    places, kinds = pd.factorize(masks)
    text, zone = values.to_numpy(dtype=object), zones.to_numpy(dtype=object)
    for i, mask in enumerate(kinds):
        if (parser := parser_of(mask)) is None:
            continue
        every, step = np.flatnonzero(places == i), max(1, MATRIX_CHARS // len(mask))
        for own in (every[at : at + step] for at in range(0, len(every), step)):
            codes = np.array(list(text[own]), dtype=f"U{len(mask)}").view(np.uint32).reshape(len(own), len(mask))
            if parser[0] == "epoch":
                out[own], good[own] = _epochs(codes, parser[1]), True
            else:
                out[own], good[own] = _clocks(text[own], codes, parser[1], zone[own])
    return pd.Series(pd.array(np.where(good, out, 0), dtype="Int64")).mask(~good)


@F.pandas_udf(T.LongType())
def _convert(values: pd.Series, masks: pd.Series, zones: pd.Series) -> pd.Series:
    return convert(values, masks, zones)


def shape_mask(value: Column) -> Column:
    """Digits become 9, letters a; one mask stands for all strings of one form."""
    return F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), r"\p{L}", "a")


def plain_digits(value: Column) -> Column:
    """Trimmed, with digits of other scripts as ASCII."""
    return F.regexp_replace(F.translate(value, OTHER_DIGITS, "0123456789" * 5), r"^\s+|\s+$", "")


def to_epoch_us(value: Column, zone: Column) -> Column:
    """The instant a string names in microseconds since the epoch, else null
    (null, empty, words, impossible dates).  `zone` is the name of the zone in
    which strings without one are local time; where it is null or unknown they
    give null.  Strings of the usual form reach Python as null."""
    usual = F.unix_micros(F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")))
    is_usual, plain = value.rlike(USUAL), plain_digits(value)
    odd = F.when(~is_usual & (plain != ""), plain)
    return F.when(is_usual, usual).otherwise(_convert(odd, shape_mask(odd), zone))


def found_instants(rows: DataFrame, fields: list[str], id_column: str, tab: str, banks: DataFrame) -> DataFrame:
    """Strings of `fields` that name an instant in another form than the usual
    one: tab, id, field, epoch_us.  One scan; the usual form, null and blank are
    dropped before Python.  Rows whose bank is null or not in `banks` have no zone."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    long = rows.select(F.col(id_column).alias("id"), F.col("bank").alias("_bank"), F.explode(pairs).alias("_p"))
    long = long.select("id", "_bank", F.col("_p.field").alias("field"), plain_digits(F.col("_p.value")).alias("_plain"), F.col("_p.value").alias("_raw"))
    odd = long.where((F.col("_plain") != "") & ~F.col("_raw").rlike(USUAL))
    zones = banks.select(F.col("bank").alias("_b"), F.col("tz").alias("_tz")).dropDuplicates(["_b"])
    zoned = odd.join(zones, F.col("_bank") == F.col("_b"), "left")
    return zoned.select(
        F.lit(tab).alias("tab"), "id", "field", _convert(F.col("_plain"), shape_mask(F.col("_plain")), F.col("_tz")).alias("epoch_us")
    ).where(F.col("epoch_us").isNotNull())
