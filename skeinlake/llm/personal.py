"""Personal data in free text: emails, phones, identity numbers, addresses, names.

Bootstrapped contextual extraction.  One scan proposes instances of each kind by
shape, with the patterns they stand in (the words before, after and around).
Instances have features: the shape of a number, the parts of a name, the town of an
address.  Seeds are the shapes that are unmistakable, numbers after the word for a
passport, the towns of addresses that a postcode closes, and the names of known
senders.  A graph of features and patterns is then scored in rounds, for all kinds
alike: a pattern is as good as the features seen in it, a feature as the patterns it
is seen in.  Good patterns and features let in what no seed knows: nine bare digits
after a word for identity cards are one, those after "stamp was" are not; an unknown
first name where names stand is one; a town that other addresses end in is the end of
one that nothing closes.  A name grows over neighbouring parts that are known.

The graph is a table of counts of 64-bit hashes and stays distributed; nothing of it
is collected or broadcast.  Only a Bloom filter of the parts of the known senders'
names goes to the workers: at most 2 ** MOST_BITS bits, however many senders there
are.  It proposes names without capitals; that it may propose too many does no harm,
as the graph's exact join decides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from skeinlake.session import discard, materialize

#: Rounds of scoring the graph.
ROUNDS = 6
#: A pattern with few instances counts as if it had this many more that are none.
DOUBT = 1.0
#: Bits of the Bloom filter of known names: BITS_A_NAME for each part, rounded up, and at most 2 ** MOST_BITS.
BITS_A_NAME, MOST_BITS = 16, 30
#: A number is let in by a pattern from here; a name by the score of its weaker part
#: and either that of its stronger part or a pattern.
NUMBER_FROM, PART_FROM, KNOWN_FROM, PLACE_FROM = 0.4, 0.45, 0.9, 0.6

#: Any blanks, with one line break at most.
_S = r"(?:[^\S\n]++(?:\n[^\S\n]*+)?|\n[^\S\n]*+)"
_GAP = rf"(?:{_S}|[\-–.])"
EMAIL = regex.compile(
    r"(?<![\w.+\-])(?P<local>\w[\w.+\-–'’]*)"
    r"(?:@(?P<domain>(?:[\w\-–]+\.)+\p{L}{2,})"
    r"|\s*[\[(]\s*at\s*[\])]\s*(?:[\w\-–]+(?:\.|\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+))+\p{L}{2,}"
    r"|\s+at\s+(?:[\w\-–]+(?:\s+dot\s+|\s*[\[(]\s*dot\s*[\])]\s*))+\p{L}{2,})(?![\w@])",
    regex.I,
)
_TOWN = r"\p{L}[\p{L}'’.\-]*(?:\s+\p{L}[\p{L}'’\-]*){0,2}?"
_STREET = r"(?:road|rd|street|st|avenue|ave|boulevard|blvd|close|terrace|lane|ln|drive|dr|court|ct|way|place|pl|square|sq|crescent|row|gardens|grove)\b\.?"
#: Words of a town that nothing closes, at most; which of the readings is meant the graph decides.
TOWN_WORDS = 3
#: Words that a town doesn't end with.
_LEAD = r"(?:(?:new|old|upper|lower|port|fort|mount|san|santa|saint|st\.?|bad|north|south|east|west|great|little)\s+)?"
ADDRESS = regex.compile(
    rf"(?<![\w/#.\-])(?:"
    rf"(?P<us>(?:(?:flat|apt|unit|suite)\s+\d{{1,4}}\p{{L}}?,\s+)?\d{{1,5}}\p{{L}}?\s+(?:\p{{L}}[\p{{L}}'’.\-]*\s+){{1,3}}?{_STREET}(?:,\s+(?:apt|flat|unit|suite)\.?\s*\d{{1,4}})?,\s+(?P<town>{_TOWN})(?:,\s+\p{{L}}{{2}})?,?\s+(?:\d{{5}}(?:-\d{{4}})?|\p{{L}}{{1,2}}\d[\p{{L}}\d]?\s+\d\p{{L}}{{2}}))"
    rf"|(?P<soi>\d{{1,4}}/\d{{1,3}}\s+(?:soi|moo|thanon)\s+\p{{L}}+(?:\s+\d{{1,3}})?,\s+(?P<town>{_TOWN})\s+\d{{5}})"
    rf"|(?P<de>\p{{L}}+(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm)\s+\d{{1,4}}\p{{L}}?,\s+\d{{4,5}}\s+(?P<open>{_LEAD}\p{{L}}[\p{{L}}\-]+))"
    rf"|(?P<fr>\d{{1,4}},?\s+(?:rue|avenue|boulevard|place|allée)\s+(?:\p{{L}}[\p{{L}}'’\-]*\s*){{1,4}},\s+\d{{5}}\s+(?P<open>{_LEAD}\p{{L}}[\p{{L}}\-]+))"
    rf")(?!\w)",
    regex.I,
)
_NEXT_WORD = regex.compile(r"[^\S\n]+\p{L}[\p{L}\-]+(?!\w)")
_BEFORE, _AFTER = r"(?<![\w#.\-–+/@:&=])", r"(?![\w\-–/@]|[.:]\d)"
#: Forms of numbers.  Those of `phone_` and `id_` are seeds; those of `odd_` need a pattern.
NUMBER = regex.compile(
    rf"(?=[+(\d]|(?<!\w)\p{{L}}{{1,2}}[\s\d])(?:(?P<phone_plus>(?<![\w+])\+\d{{1,3}}{_GAP}?\(?\d{{1,4}}\)?(?:{_GAP}?\d{{2,5}}){{1,4}}{_AFTER})"
    rf"|(?P<phone_area>(?<![\w)])\(\d{{2,4}}\){_S}?\d{{3,4}}{_GAP}\d{{3,4}}{_AFTER})"
    rf"|{_BEFORE}(?:(?P<phone_long>00[1-9]\d{_GAP}\d{{1,4}}(?:{_GAP}\d{{2,9}}){{1,3}})"
    rf"|(?P<id_thai>\d[\-–]\d{{4}}[\-–]\d{{5}}[\-–]\d{{2}}[\-–]\d)"
    rf"|(?P<id_social>\d{{3}}[\-–]\d{{2}}[\-–]\d{{4}})"
    rf"|(?P<phone_three>\d{{3}}(?P<sep>[\-–.])\d{{3}}(?P=sep)\d{{4}})"
    rf"|(?P<phone_zero>0[1-9]\d{{1,3}}{_GAP}\d{{3,4}}{_GAP}\d{{3,4}})"
    rf"|(?P<id_insurance>\p{{Lu}}{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}[A-D])"
    rf"|(?P<odd_social>\d{{3}}{_S}\d{{2}}{_S}\d{{4}})"
    rf"|(?P<odd_four>\d{{4}}(?:{_S}|[\-–])\d{{4}}(?:{_S}|[\-–])\d{{4,5}})"
    rf"|(?P<odd_spaced>\p{{Ll}}{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}[a-d])"
    rf"|(?P<odd_insurance>\p{{L}}{{2}}\d{{6}}\p{{L}})"
    rf"|(?P<odd_passport>\p{{L}}{{1,2}}\d{{6,8}})"
    rf"|(?P<odd_phone>\d{{10,11}})"
    rf"|(?P<odd_bare>\d{{13}}|\d{{9}}|\d{{12}})){_AFTER})"
)
#: Words for a passport, after which a number of a passport's shape is one.
PASSPORTS = ["passport", "reisepass", "pass", "passeport", "pasaporte", "passaporte", "паспорт", "หนังสือเดินทาง", "パスポート", "护照", "여권"]
_PASSPORT_BEFORE = regex.compile(rf"(?r)(?:{'|'.join(PASSPORTS)})[\s:#.]*(?:(?:no|nr|number|nummer)\b[\s:#.]*)?", regex.I)
#: Titles before Thai names and after Japanese ones.
THAI_TITLES, JAPANESE_TITLES = ("คุณ", "นาย", "นางสาว", "นาง", "ดร."), ("さん", "様", "氏", "君", "先生")
_HAS_OTHER = regex.compile(r"[\p{Thai}\p{Han}]\s")
_OTHER = regex.compile(
    r"(?P<thai>(?<!\p{Thai})(?P<first>\p{Thai}{2,})\s+(?P<last>\p{Thai}{2,})(?!\p{Thai}))"
    r"|(?<![\p{Han}\p{Katakana}])(?P<family>[\p{Han}\p{Katakana}]+)\s+(?P<given>[\p{Han}\p{Katakana}]+)",
    regex.V1,
)
#: Quick signs that a text may hold an email, an address, a name; without them it is not searched for one.
_EMAIL_SIGNS = ("@", "dot", "[at", "(at", "[ at", "( at", "[\tat", "(\tat", "[\nat", "(\nat", "[\xa0at", "(\xa0at")
_ADDRESS_ENDS = ("straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ring", "damm")
_ADDRESS_WORDS = set(
    "road rd street st avenue ave boulevard blvd close terrace lane ln drive dr court ct way place pl square sq crescent row gardens grove "
    "soi moo thanon rue allée".split()
)
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}'\-]*").findall
_CAPITALS = regex.compile(r"(?<!\p{L})\p{Lu}[\p{L}\p{M}’'\-–]*\.?\s+(?:\p{Lu}\.\s+)?\p{Lu}[\p{L}’'\-–]").search
_COMMA = regex.compile(r",\s+").fullmatch
_PART = regex.compile(r"\p{L}[\p{L}\p{M}’'\-–]*\.?")
_TOKENS = r"[\p{L}\p{M}’']+|\d+|\n|[^\s]"
_TOKEN, _TOKEN_BACK = regex.compile(_TOKENS), regex.compile(rf"(?r){_TOKENS}")


def plain_part(part: str) -> str:
    """A part of a name in one dress."""
    low = unicodedata.normalize("NFC", part).lower().replace("’", "'").replace("–", "-")
    return low[:-2] if low.endswith("'s") else low


def patterns(text: str, start: int, stop: int) -> tuple[str, str, str]:
    """The contexts of an instance: two words before, two after, one on either side."""
    word = lambda m: "0" if m[0].isdigit() else m[0].lower().replace("’", "'")
    before = [word(m) for m in islice(_TOKEN_BACK.finditer(text, 0, start), 2)][::-1]
    after = [word(m) for m in islice(_TOKEN.finditer(text, stop), 2)]
    before, after = ["^"] * (2 - len(before)) + before, after + ["$"] * (2 - len(after))
    return f"{before[0]} {before[1]} _", f"_ {after[0]} {after[1]}", f"{before[1]} _ {after[0]}"


def hashed(text: str) -> int:
    """64 bits of a text, as a Spark long."""
    found = xxhash.xxh64_intdigest(text)
    return found - 2**64 if found >= 2**63 else found


class BloomSet:
    """The name parts of one side (`f:` first, `l:` last) in a Bloom filter: has all of
    them, and few words that are none.  Remembers what it was asked."""

    def __init__(self, bits: np.ndarray, side: str) -> None:
        self.bits, self.side, self.asked, self.absent = bits, side, {}, set()

    @staticmethod
    def places(part: str, n_bits: int) -> list[int]:
        both = xxhash.xxh3_128_intdigest(part)
        step, at = both >> 64 | 1, both & 0xFFFFFFFFFFFFFFFF
        return [(at + i * step) % n_bits for i in range(6)]

    def __contains__(self, word: str) -> bool:
        if (found := self.asked.get(word)) is None:
            if len(self.asked) > 1_000_000:
                self.asked.clear()
            places = self.places(self.side + word, len(self.bits) * 64)
            self.asked[word] = found = all(int(self.bits[p >> 6]) >> (p & 63) & 1 for p in places)
        return found

    def isdisjoint(self, words: set[str]) -> bool:
        new = words - self.absent
        if len(self.absent) > 1_000_000:
            self.absent.clear()
        self.absent.update(w for w in new if w not in self)
        return new <= self.absent


def bloom_of(known: DataFrame) -> np.ndarray:
    """The bits of a Bloom filter of known parts (column part), put together from one
    number a word of 64 bits, of which at most 2 ** (MOST_BITS - 6) come to the driver."""
    n_bits = 1 << min(MOST_BITS, max(10, (BITS_A_NAME * known.count() - 1).bit_length()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            places = [p for part in frame["part"] for p in BloomSet.places(part, n_bits)]
            masks = np.uint64(1) << np.array([p & 63 for p in places], np.uint64)
            yield pd.DataFrame({"at": [p >> 6 for p in places], "mask": masks.view(np.int64)})

    words = known.select("part").mapInPandas(run, "at int, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toPandas()
    bits = np.zeros(n_bits >> 6, np.uint64)
    bits[words["at"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return bits


def name_candidates(text: str, firsts: set[str] | BloomSet, lasts: set[str] | BloomSet) -> Iterator[tuple[str, str, int, int, bool, bool]]:
    """(first part, last part, start, stop, shown, seed) of what may be names: shown
    by capitals or a script without them, a seed where it has a title."""
    parts = []
    upper = 0
    for m in _PART.finditer(text):
        word, stop = m[0], m.end()
        initial = len(word) == 2 and word[1] == "." and word[0].isupper()
        ended = not initial and word[-1] == "."
        if ended:
            word, stop = word[:-1], stop - 1
        plain = plain_part(word)
        if len(plain) < len(word) and plain and word[-2:].lower() in ("'s", "’s"):
            stop -= 2
        if len(word) > 1 and word.isupper():
            upper += 1
        shown = word[0].isupper() and (len(word) > 1 or initial)
        parts.append((plain, m.start(), stop, initial, shown, m.end() if not ended else -1))
    loud = len(parts) > 6 and upper > len(parts) / 2
    n = len(parts)

    def adjacent(i: int) -> bool:
        end = parts[i][5]
        between = text[end : parts[i + 1][1]] if i + 1 < n and end == parts[i][2] else ""
        return between.isspace() and between.count("\n") < 2

    for i in range(n - 1):
        plain, start, stop, initial, shown, _ = parts[i]
        other = parts[i + 1]
        if (plain in lasts and (other[4] or other[0] in firsts) or other[0] in firsts and shown) and not other[3] and _COMMA(text[stop : other[1]]):
            yield other[0], plain, start, other[2], False, False
        if not adjacent(i):
            continue
        j = i + 1
        if parts[j][3]:
            if initial or not adjacent(j):
                continue
            j += 1
        last = parts[j]
        if last[3] or len(last[0]) < 2 or (not initial and len(plain) < 2):
            continue
        if initial and i and adjacent(i - 1) and (parts[i - 1][4] or parts[i - 1][0] in firsts):
            continue
        capitals = shown and last[4] and not loud
        if capitals or plain in firsts or last[0] in lasts:
            yield ("." if initial else plain), last[0], start, last[2], capitals, False
    for m in _OTHER.finditer(text, overlapped=True) if _HAS_OTHER.search(text) else ():
        if m["thai"]:
            head = m["first"]
            title = max((k + len(t) for t in THAI_TITLES if (k := head.rfind(t)) >= 0 and head[max(0, k - 3) : k] != "ขอบ"), default=0)
            if len(head) - title > 1:
                yield head[title:], m["last"], m.start("first") + title, m.end("last"), True, title > 0
        else:
            yield m["given"], m["family"], m.start(), m.end("given"), True, text.startswith(JAPANESE_TITLES, m.end("given"))



def towns_of(text: str, m: regex.Match) -> Iterator[tuple[str, int]]:
    """(town, stop) of an address: the one before its postcode, or where nothing closes
    it the word at its end, and that with the next words."""
    if m["town"]:
        yield m["town"], m.end()
        return
    begin, stop = m.span("open")
    yield text[begin:stop], stop
    for _ in range(TOWN_WORDS - 1):
        if (following := _NEXT_WORD.match(text, stop)) is None:
            return
        stop = following.end()
        yield text[begin:stop], stop


def instances(text: str, firsts: set[str] | BloomSet, lasts: set[str] | BloomSet) -> Iterator[tuple[str, str | None, str | None, int, int, bool, bool]]:
    """(kind, first feature, second feature, start, stop, shown, seed) of a text."""
    masked = text
    low = text.lower()
    if any(sign in low for sign in _EMAIL_SIGNS):
        for m in EMAIL.finditer(text):
            # a host with a path after a colon is that of a repository
            remote = m["domain"] is not None and text[m.end() : m.end() + 1] == ":" and text[m.end() + 1 : m.end() + 2].strip() != ""
            yield "email", "remote" if remote else "written" if m["domain"] is None else "usual", None, m.start(), m.end(), not remote, not remote
            masked = masked[: m.start()] + "\0" * (m.end() - m.start()) + masked[m.end() :]
    words = set(_WORDS(low))
    if any(map(str.isdigit, text)):
        likely = not _ADDRESS_WORDS.isdisjoint(words) or any(end in low for end in _ADDRESS_ENDS)
        for m in ADDRESS.finditer(masked) if likely else ():
            form = next(k for k in ("us", "soi", "de", "fr") if m[k])
            for i, (town, stop) in enumerate(towns_of(masked, m)):
                # seeds are forms that a postcode closes, and the shortest reading of the others
                yield "address", form, f"t:{' '.join(town.lower().split())}" if m["town"] or i else None, m.start(), stop, not i, not i
            masked = masked[: m.start()] + "\0" * (m.end() - m.start()) + masked[m.end() :]
        for m in NUMBER.finditer(numbered := masked):
            form = next(k for k, v in m.groupdict().items() if v is not None and k != "sep")
            digits = sum(map(str.isdigit, m[0]))
            if form.startswith("phone_") and not 9 <= digits <= 15:
                continue
            kind = "phone" if "phone" in form else "id_number"
            # the letters of a passport and the length of a bare number belong to its shape
            shape = form + regex.sub(r"\d+", lambda d: str(len(d[0])), m[0].lower()) if form in ("odd_bare", "odd_passport", "odd_phone") else form
            seed = not form.startswith("odd_") or form == "odd_passport" and _PASSPORT_BEFORE.match(numbered, 0, m.start()) is not None
            yield kind, shape, None, m.start(), m.end(), True, seed
            if seed:  # its letters are no initials
                masked = masked[: m.start()] + "\0" * (m.end() - m.start()) + masked[m.end() :]
    dressed = "’" in low or "–" in low or "'s" in low
    if not (dressed or _CAPITALS(masked) or _HAS_OTHER.search(masked) or not firsts.isdisjoint(words) or not lasts.isdisjoint(words)):
        return
    for first, last, start, stop, shown, seed in name_candidates(masked, firsts, lasts):
        yield "name", None if first == "." else f"f:{first}", f"l:{last}", start, stop, shown, seed


_SCHEMA = "row_no long, field string, kind string, f1 long, f2 long, value string, start int, stop int, shown boolean, seed boolean, h1 long, h2 long, h3 long, worded boolean"


def candidates(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """What may be personal data in text and from_user, with hashes of its features and
    patterns.  `bits` are those of a Bloom filter of known name parts."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)  # bounded by MOST_BITS
    worded = regex.compile(r"_ [\p{L}\p{M}]").match

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last = BloomSet(shared.value, "f:"), BloomSet(shared.value, "l:")
        key = lambda kind, f: 0 if f is None else hashed(f if kind == "name" else f"{kind}:{f}")
        for frame in frames:
            out = []
            for row_no, text, user in zip(frame["row_no"], frame["text"], frame["from_user"]):
                for field, value in (("text", text), ("from_user", user)):
                    if not value:
                        continue
                    for kind, f1, f2, start, stop, shown, seed in instances(value, first, last):
                        around = patterns(value, start, stop)
                        hashes = [hashed(f"{kind} {field} {k} {p}") for k, p in enumerate(around)]
                        out.append((row_no, field, kind, key(kind, f1), key(kind, f2), value[start:stop], start, stop, shown, seed, *hashes, worded(around[1]) is not None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    found = rows.select(F.col("row_no").cast("long").alias("row_no"), "text", "from_user").mapInPandas(run, _SCHEMA)
    # a frame would make floats of numbers beside nulls, so no feature is 0 on the way
    return found.withColumns({f: F.nullif(F.col(f), F.lit(0).cast("long")) for f in ("f1", "f2")})


def score_graph(found: DataFrame, known: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(features: f, w; patterns: p, s) after some rounds over the graph of counts, for
    all kinds at once (their patterns and features differ).  `known` (f) are the name
    parts that are seeds; other seeds are shown by the scan."""
    # what no capitals show is no evidence, but judged by what is
    feats = F.filter(F.array("f1", "f2"), lambda x: x.isNotNull())
    pairs = found.where("shown").select("seed", F.explode(feats).alias("f"), F.array("h1", "h2", "h3").alias("ps")).select("seed", "f", F.explode("ps").alias("p"))
    counted = pairs.groupBy("f", "p").agg(F.count(F.lit(1)).cast("double").alias("n"), F.bool_or("seed").alias("seed"))
    marked = counted.join(known.select(F.col("f").alias("_f")).distinct(), F.col("f") == F.col("_f"), "left")
    edges = materialize(marked.select("f", "p", "n", (F.col("seed") | F.col("_f").isNotNull()).alias("seed")), "edges")
    feature = edges.groupBy("f").agg(F.bool_or("seed").cast("double").alias("w"))
    last: list[DataFrame] = []
    for _ in range(rounds):
        pattern = materialize(edges.join(feature, "f").groupBy("p").agg((F.sum(F.col("n") * F.col("w")) / (F.sum("n") + DOUBT)).alias("s")), "patterns")
        seen = edges.join(pattern, "p").groupBy("f").agg(F.bool_or("seed").alias("_seed"), (F.sum(F.col("n") * F.col("s")) / F.sum("n")).alias("_w"))
        feature = materialize(seen.select("f", F.when(F.col("_seed"), 1.0).otherwise(F.col("_w")).alias("w")), "features")
        for done in last:
            discard(done)
        last = [pattern, feature]
    return feature, pattern


def whole_names(spans: list[dict]) -> list[tuple[int, int, str]]:
    """(start, stop, value) of the names of a text, from its candidates of two parts.
    A good one grows over the candidate that overlaps it on the left where that one's
    first part is a known first name, on the right where its last part is a known last
    name; not over one between two good neighbours, which are two names."""
    spans = sorted(spans, key=lambda s: (s["start"], s["stop"]))
    good = [bool(s["good"]) for s in spans]
    meets = [i > 0 and spans[i]["start"] < spans[i - 1]["stop"] for i in range(len(spans))]
    between = [i > 0 and i + 1 < len(spans) and good[i - 1] and good[i + 1] and meets[i] and meets[i + 1] for i in range(len(spans))]
    for i in range(len(spans) - 2, -1, -1):
        good[i] |= good[i + 1] and meets[i + 1] and bool(spans[i]["first_known"]) and not between[i]
    for i in range(1, len(spans)):
        good[i] |= good[i - 1] and meets[i] and bool(spans[i]["last_known"]) and not between[i]
    out: list[tuple[int, int, str]] = []
    for s, taken in zip(spans, good):
        if not taken:
            continue
        if out and s["start"] < out[-1][1]:
            start, stop, value = out[-1]
            out[-1] = (start, max(stop, s["stop"]), value + s["value"][stop - s["start"] :])
        else:
            out.append((s["start"], s["stop"], s["value"]))
    return out


def accepted(found: DataFrame, known: DataFrame) -> DataFrame:
    """The candidates that are personal data: row_no, field, kind, value, start, stop."""
    found = materialize(found, "candidates")
    columns = ["row_no", "field", "kind", "value", "start", "stop"]
    feature, pattern = score_graph(found, known)
    # the shapes that are seeds weigh 1 whatever the graph says of where they stand
    alone = F.col("seed") & (F.col("kind") != "name")
    sure = found.where(alone)
    unsure = found.where(~alone & (F.col("kind") != "email"))
    for k in (1, 2, 3):
        unsure = unsure.join(pattern.select(F.col("p").alias(f"h{k}"), F.col("s").alias(f"s{k}")), f"h{k}", "left")
    for k in (1, 2):
        unsure = unsure.join(feature.select(F.col("f").alias(f"f{k}"), F.col("w").alias(f"w{k}")), f"f{k}", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    place = F.greatest(*[zero(f"s{k}") for k in (1, 2, 3)])
    first = F.when(F.col("f1").isNull(), zero("w2")).otherwise(zero("w1"))
    low, high = F.least(first, zero("w2")), F.greatest(first, zero("w2"))
    name = (low >= PART_FROM) & ((high >= KNOWN_FROM) | (place >= PLACE_FROM))
    # what follows the end of a sentence says nothing of a number
    number = F.greatest(*[zero(c) for c in (F.col("s1"), F.col("s3"), F.when(F.col("worded"), F.col("s2")))])
    good = (
        F.when(F.col("kind") == "name", name).when(F.col("kind") == "address", zero("w2") >= KNOWN_FROM)
        .when(F.col("kind") == "phone", number >= PLACE_FROM).otherwise(number >= NUMBER_FROM)
    )
    in_order = ~F.col("value").contains(",")  # a last name before its first one doesn't let others grow
    judged = unsure.select(*columns, good.alias("good"), (in_order & (zero("w1") >= KNOWN_FROM)).alias("first_known"), (in_order & (zero("w2") >= KNOWN_FROM)).alias("last_known"))
    judged = judged.where("good OR (kind = 'name' AND (first_known OR last_known))")
    names, others = judged.where("kind = 'name'"), judged.where("kind <> 'name'").select(columns)
    of_text = names.groupBy("row_no", "field").agg(F.collect_list(F.struct("start", "stop", "value", "good", "first_known", "last_known")).alias("_c"))
    of_text = of_text.where(F.exists("_c", lambda c: c["good"]))  # bounded by the text's length

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r, f, "name", v, a, b) for r, f, c in zip(frame["row_no"], frame["field"], frame["_c"]) for a, b, v in whole_names(list(c))]
            yield pd.DataFrame(rows, columns=columns)

    plain = sure.where("kind <> 'address'").select(columns)
    # of the readings of an address that nothing closes the longest whose town is known
    read = sure.where("kind = 'address'").select(columns).unionByName(others.where("kind = 'address'"))
    read = read.groupBy("row_no", "field", "kind", "start").agg(F.max(F.struct("stop", "value")).alias("_r"))
    addresses = read.select("row_no", "field", "kind", F.col("_r.value").alias("value"), "start", F.col("_r.stop").alias("stop"))
    whole = of_text.mapInPandas(run, "row_no long, field string, kind string, value string, start int, stop int")
    return plain.unionByName(others.where("kind <> 'address'")).unionByName(addresses).unionByName(whole)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _sides(names: pd.Series) -> pd.Series:
    """The parts of names as features: the last as a last one, the others as first ones."""

    def sides(name: str | None) -> list[str]:
        parts = [plain_part(p) for p in (name or "").split()]
        return [f"f:{p}" for p in parts[:-1]] + [f"l:{parts[-1]}"] if len(parts) > 1 else []

    return names.map(sides)


@F.pandas_udf(T.LongType())
def _hashed(texts: pd.Series) -> pd.Series:
    return texts.map(hashed)


def extract(rows: DataFrame, senders: DataFrame) -> DataFrame:
    """Personal data in text and from_user of all rows: row_no, field, kind, value,
    start, stop (code points).

    Null and empty fields have none; repeated rows are looked at each; texts of any
    length are scanned whole; without known senders names are found by capitals
    only where seed shapes lend a pattern weight, that is hardly; empty tables give
    an empty result.  `senders` are known names (display_name), in any spelling of
    their apostrophes, dashes and combining marks.
    """
    known = senders.select(F.explode(_sides(F.col("display_name"))).alias("part")).distinct()
    known = materialize(known.select("part", _hashed(F.col("part")).alias("f")), "known-names")
    return accepted(candidates(rows, bloom_of(known)), known)


def distinct_values(found: DataFrame) -> DataFrame:
    return found.select("row_no", "field", "kind", "value").distinct()


def covered(spans: Iterable[dict]) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of what spans cover: those that overlap are one, of the kind
    of the longest of them."""
    out: list[list] = []
    for s in sorted(spans, key=lambda s: (s["start"], -s["stop"], s["kind"])):
        length = s["stop"] - s["start"]
        if out and s["start"] < out[-1][1]:
            out[-1][1] = max(out[-1][1], s["stop"])
            if length > out[-1][3]:
                out[-1][2:] = [s["kind"], length]
        else:
            out.append([s["start"], s["stop"], s["kind"], length])
    return [(a, b, kind) for a, b, kind, _ in out]


def masked_text(text: str, spans: Iterable[dict]) -> str:
    """The text with a placeholder for each stretch that spans cover; all else unchanged."""
    pieces, at = [], 0
    for start, stop, kind in covered(spans):
        pieces += [text[at:start], f"[{kind.upper()}]"]
        at = stop
    return "".join([*pieces, text[at:]])


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or s is None else masked_text(t, s) for t, s in zip(texts, spans)], dtype=object)


def redact(rows: DataFrame, found: DataFrame) -> DataFrame:
    """row_no, text and from_user with what was found replaced by [EMAIL], [PHONE],
    [ID_NUMBER], [ADDRESS], [NAME].  Finds that overlap are replaced together, so no part
    of any is left.  Rows without any come out as they are, and only their keys meet
    Python; row_no is taken as unique."""
    spans = found.groupBy("row_no").agg(F.collect_list(F.struct("field", "start", "stop", "kind")).alias("_spans"))
    slim = rows.select(F.col("row_no").cast("long").alias("row_no"), "text", "from_user")
    own = lambda c: F.filter("_spans", lambda s: s["field"] == c)

    def replaced(c: str) -> Column:
        hit = F.size(own(c)) > 0
        return F.when(hit, _masked(F.when(hit, F.col(c)), F.when(hit, own(c)))).otherwise(F.col(c)).alias(c)

    return slim.join(spans, "row_no", "left").select("row_no", replaced("text"), replaced("from_user"))
