"""Long spans that documents share verbatim.

1. One pass winnows every text: of each SPAN - ANCHOR + 1 neighbouring windows of
   ANCHOR code points one with the least hash is an anchor.  Two texts with a common
   span of SPAN code points have an anchor hash in common that lies in it.  Anchors
   only decide which texts meet; no link comes from them.
2. Exact copies are folded to one class.  Around each anchor that several classes have
   the text is cut out as far as a span through it can reach; equal cuts are one.
3. Cuts go to shards by anchor hash.  A shard builds a compressed FM-index of its cuts
   (bit-packed wavelet matrix of the BWT, common prefixes of a byte, every fourth place
   of the suffix array) and streams its cuts against it: backward search keeps the
   matching statistics of every position, and each stretch that matches over SPAN code
   points is reported with its suffix interval.  All links come from these intervals.
4. Cuts map back to classes, classes to their members.

An anchor that very many different cuts have is split into blocks; every pair of
blocks is a shard of its own, so no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from skeinlake.session import materialize

#: Code points of a span that counts, and of the windows that are hashed.
SPAN, ANCHOR = 250, 100
#: Characters of cuts in a shard, about; cuts of one anchor in a block.
SHARD_CHARS, BLOCK_CUTS = 500_000, 1_000
#: Every so manyth place of a text is kept of the suffix array; the others are walked to.
SAMPLED = 4

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


# ---- anchors ----------------------------------------------------------------


def window_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window of `length` code points: a polynomial modulo 2**64
    over mixed code points, mixed again."""
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    n = len(codes)
    powers, back = (np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]) for x in (_BASE, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * np.multiply.accumulate(powers), dtype=np.uint64)])
    # window i: sum of mixed[j] * base**j; times base**-i it no longer depends on i
    raw = (sums[length:] - sums[:-length]) * np.multiply.accumulate(back)[: n - length + 1]
    raw ^= raw >> np.uint64(32)
    raw *= np.uint64(0xD6E8FEB86659FD93)
    return raw ^ (raw >> np.uint64(32))


def sliding(values: np.ndarray, width: int, pick: np.ufunc, rest: int) -> np.ndarray:
    """pick (minimum or maximum) of each window of `width` neighbours, in time that
    doesn't depend on the width: prefixes and suffixes of blocks meet in a window."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, rest, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    upto = pick.accumulate(blocks, axis=1).ravel()
    onward = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(onward[: n - width + 1], upto[width - 1 : n])


def anchors(codes: np.ndarray, span: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of a text of at least `span` code points:
    the places whose hash is the least of some `span - length + 1` neighbours."""
    hashes = window_hashes(codes, length)
    width = span - length + 1
    least = sliding(hashes, width, np.minimum, 2**64 - 1)
    # a place is an anchor if the greatest least of the windows it is in is its own
    edge = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum, 0) == hashes)
    places = places[thinned(places, hashes[places], width)]
    return places, hashes[places]


def thinned(places: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    """Which anchors are needed: of neighbours of one hash, as a run of one character
    has at every place, enough that each window that has some keeps one."""
    kept = np.ones(len(places), bool)
    edges = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1], [True]]))
    for begin, end in zip(edges[:-1], edges[1:]):
        if end - begin < 3:
            continue
        kept[begin + 1 : end] = False
        at = begin
        while at < end - 1:
            at = max(at + 1, int(np.searchsorted(places[:end], places[at] + width, side="right")) - 1)
            kept[at] = True
    return kept


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _anchor_rows(span: int, length: int):
    """Of batches of member, k1, k2, text a row for each text of at least `span` code
    points, with its length and no h, and one for each of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            rows, sizes, places, hashes, none = [], [], [], [], []
            for i, text in enumerate(batch.column(3)):
                codes = _codes(text.as_py())
                if len(codes) < span:
                    continue
                p, h = anchors(codes, span, length)
                rows.append(np.full(len(p) + 1, i)), sizes.append(np.full(len(p) + 1, len(codes), np.int64))
                places.append(np.concatenate([[0], p])), hashes.append(np.concatenate([np.zeros(1, np.uint64), h])), none.append(np.arange(len(p) + 1) == 0)
            if rows:
                at, h, no = np.concatenate(rows), np.concatenate(hashes).view(np.int64), np.concatenate(none)
                columns = [pa.array(c[at]) for c in (ids, k1, k2)] + [pa.array(np.concatenate(sizes)), pa.array(h, mask=no), pa.array(np.concatenate(places).astype(np.int32), mask=no)]
                yield pa.RecordBatch.from_arrays(columns, names=["member", "k1", "k2", "n", "h", "pos"])

    return run


# ---- FM-index ---------------------------------------------------------------


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes ordered by their first `depth` codes or more, lengths of the common
    prefixes of neighbours, cut at the last doubling) by prefix doubling."""
    n = len(codes)
    _, rank = np.unique(codes, return_inverse=True)
    ranks, width = [rank.astype(np.int32)], 1  # a shard is far below 2**31
    order = np.argsort(ranks[0], kind="stable")
    while width < depth:
        second = np.full(n, -1, np.int64)
        second[:-width] = ranks[-1][width:] if width < n else 0
        if width >= n:
            break
        key = ranks[-1].astype(np.int64) * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int32)
        fresh[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        ranks.append(fresh)
        width *= 2
        if fresh[order[-1]] == n - 1:  # all differ
            break
    common = np.zeros(n + 1, np.int64)
    a, b, reach = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        fits = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[fits] = ranks[level][a[fits]] == ranks[level][b[fits]]
        step = 1 << level
        reach[same] += step
        a[same] += step
        b[same] += step
    common[1:n] = reach
    return order, common


class Bits:
    """A row of bits in words of 64, with a count before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits.astype(bool), bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.uint32)

    def ones(self, upto: np.ndarray) -> np.ndarray:
        """How many bits before each place are set."""
        at, bit = upto >> 6, (upto & 63).astype(np.uint64)
        within = self.words[at] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[at].astype(np.int64) + np.bitwise_count(within)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0

    @property
    def bytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


class WaveletMatrix:
    """Rank over a sequence of small integers, bit-packed, all queries of a step at once."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        self.levels, self.zeros = [], []
        self.bits = max(1, int(top).bit_length())
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit) & 1
            self.levels.append(Bits(ones))
            self.zeros.append(int(len(values) - ones.sum()))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How often symbol occurs before `upto`; `start` is where the symbol's run
        begins on the lowest level."""
        at = upto
        for k, level in enumerate(self.levels):
            ones = level.ones(at)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each place, where the place is on the lowest level)."""
        symbol = np.zeros(len(at), np.int64)
        for k, level in enumerate(self.levels):
            one, ones = level[at], level.ones(at)
            symbol = symbol << 1 | one
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return symbol, at


class Minima:
    """The nearest place with a value below a bound, on either side, by a tree of the
    minima of every 16 values."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = []
        while True:
            rows = np.full((-(-len(values) // 16), 16), np.iinfo(values.dtype).max, values.dtype)
            rows.ravel()[: len(values)] = values
            self.levels.append(rows)
            if len(rows) == 1:
                return
            values = rows.min(axis=1)

    def nearest(self, at: np.ndarray, bound: np.ndarray, back: bool) -> np.ndarray:
        """The last place up to `at`, or the first from it on, with a value below bound; there is one."""
        pick = (lambda mask: 15 - mask[:, ::-1].argmax(1)) if back else (lambda mask: mask.argmax(1))
        columns, todo, found = np.arange(16), np.arange(len(at)), []
        for rows in self.levels:
            if not len(todo):
                break
            block, column = at >> 4, at & 15
            mask = rows[block] < bound[todo, None]
            mask &= columns <= column[:, None] if back else columns >= column[:, None]
            hit = mask.any(1)
            found.append((todo[hit], (block * 16 + pick(mask))[hit]))
            todo, at = todo[~hit], (block + (-1 if back else 1))[~hit]
        who, where = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for level in range(len(found) - 1, -1, -1):
            if len(who):
                where = where * 16 + pick(self.levels[level][where] < bound[who, None])
            who, where = np.concatenate([who, found[level][0]]), np.concatenate([where, found[level][1]])
        out = np.zeros(len(bound), np.int64)
        out[who] = where
        return out


class FmIndex:
    """Compressed FM-index of texts joined by separators, for matches of up to `span`."""

    def __init__(self, texts: list[np.ndarray], span: int) -> None:
        self.span = span
        self.alphabet = alphabet = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint32)
        codes = np.concatenate([np.concatenate([np.searchsorted(alphabet, t) + 1, np.zeros(1, np.int64)]) for t in texts])
        self.starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        # separators differ from each other: no match runs over one
        separate = codes == 0
        # sorted in full, as walking from one suffix to the next needs more than the span
        order, common = suffix_array(np.where(separate, np.cumsum(separate) - 1, codes + separate.sum()), max(map(len, texts)) + 1)
        self.n = len(codes)
        self.tree = WaveletMatrix(codes[order - 1], len(alphabet))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(alphabet) + 1))])[:-1]
        symbols = np.arange(len(alphabet) + 1)
        self.base = self.tree.rank(symbols, np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64))
        # beyond the span depths don't differ, so they fit in a byte
        self.common = np.minimum(common, span).astype(np.uint8 if span < 256 else np.uint16 if span < 65_536 else np.uint32)
        self.minima = Minima(self.common)
        kept = (order - self.starts[np.searchsorted(self.starts, order, side="right") - 1]) % SAMPLED == 0
        self.marked, self.samples = Bits(kept), order[kept].astype(np.int32)
        self.run_start = self.run_end = np.zeros(0, np.int64)
        self.owner = _Owners(self)

    @property
    def bytes(self) -> int:
        """What the index keeps."""
        tree = sum(level.bytes for level in self.tree.levels)
        return tree + sum(rows.nbytes for rows in self.minima.levels) + self.common.nbytes + self.marked.bytes + self.samples.nbytes + self.starts.nbytes

    def owners(self, rows: np.ndarray) -> np.ndarray:
        """The text of each suffix, by walking to the next sampled place."""
        place, at, steps, todo = np.zeros(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(todo):
            done = self.marked[at]
            place[todo[done]] = self.samples[self.marked.ones(at[done])] + steps
            todo, at, steps = todo[~done], at[~done], steps + 1
            symbol, low = self.tree.access(at)
            at = self.first[symbol] + low - self.base[symbol]
        return np.searchsorted(self.starts, place, side="right") - 1

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next wider suffix interval [low, high) and its depth."""
        depth = np.maximum(self.common[low], self.common[high]).astype(np.int64)
        return *self.widened(low, high, depth), depth

    def widened(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of a depth around a deeper one; all suffixes for depth 0."""
        out = np.zeros(len(low), np.int64), np.full(len(low), self.n)
        inner = np.flatnonzero(depth > 0)
        for edge, at, back in ((out[0], low, True), (out[1], high, False)):
            edge[inner] = self.minima.nearest(at[inner], depth[inner], back)
        return out

    def encode(self, text: np.ndarray) -> np.ndarray:
        """Symbols of a text, 0 where a code point does not occur in the index."""
        at = np.searchsorted(self.alphabet, text)
        at = np.minimum(at, len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == text, at + 1, 0)

    def matches(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, suffix interval of depth span, as a place in run_start and
        run_end) of every window of `span` code points of the texts that occurs in the
        index.  All texts take a step of the backward search at a time."""
        width = max(map(len, texts))
        grid = np.zeros((len(texts), width), np.int64)
        for i, text in enumerate(texts):
            grid[i, width - len(text) :] = self.encode(text)
        left = np.array([width - len(t) for t in texts])
        at = np.full(len(texts), width - 1)  # the symbol to be put in front
        low, high, depth = np.zeros(len(texts), np.int64), np.full(len(texts), self.n), np.zeros(len(texts), np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        live = np.arange(len(texts))
        while len(live):
            symbol = grid[live, at[live]]
            base = self.base[symbol]
            lo = self.first[symbol] + self.tree.rank(symbol, low[live], base)
            hi = self.first[symbol] + self.tree.rank(symbol, high[live], base)
            fits = (hi > lo) & (symbol > 0)
            on = live[fits]
            low[on], high[on], depth[on] = lo[fits], hi[fits], depth[on] + 1
            at[on] -= 1
            full = on[depth[on] >= self.span]
            if len(full):
                depth[full] = self.span
                low[full], high[full] = self.widened(low[full], high[full], depth[full])
                out.append((full, at[full] + 1 - left[full], low[full], high[full]))
            off = live[~fits]
            bare = off[depth[off] == 0]
            at[bare] -= 1
            deep = off[depth[off] > 0]
            if len(deep):
                low[deep], high[deep], depth[deep] = self.parent(low[deep], high[deep])
            live = live[at[live] >= left[live]]
        if not out:
            return (np.zeros(0, np.int64),) * 3
        text, place, low, high = (np.concatenate(x) for x in zip(*out))
        self.run_start, first, run = np.unique(low, return_index=True, return_inverse=True)
        self.run_end = high[first]
        return text, place, run


class _Owners:
    """The texts of suffixes, looked up when asked for."""

    def __init__(self, index: FmIndex) -> None:
        self.index = index

    def __getitem__(self, rows: slice | np.ndarray) -> np.ndarray:
        return self.index.owners(np.arange(rows.start, rows.stop) if isinstance(rows, slice) else rows)


# ---- shards -----------------------------------------------------------------

_HITS = "s1 long, s2 long, t1 long, t2 long, start int, stop int"


def search_shard(pdf: pd.DataFrame, span: int, pairs: bool) -> pd.DataFrame:
    """Hits in one shard: where `pairs`, for each streamed cut (s1, s2) and each cut of
    its intervals (t1, t2) a row without bounds, with itself only if several classes
    have it; else for each stretch of a cut that another class has a row with bounds."""
    library = pdf[pdf["library"]].reset_index(drop=True)
    stream = pdf[pdf["streamed"]].reset_index(drop=True)
    empty = pd.DataFrame({"s1": [], "s2": [], "t1": [], "t2": [], "start": [], "stop": []})
    if library.empty or stream.empty:
        return empty
    index = FmIndex([_codes(t) for t in library["cut"]], span)
    text, place, run = index.matches([_codes(t) for t in stream["cut"]])
    if not len(text):
        return empty
    several = library["several"].to_numpy()
    sizes = index.run_end - index.run_start
    begins = np.cumsum(sizes) - sizes
    owner = index.owners(np.arange(sizes.sum()) - np.repeat(begins - index.run_start, sizes))
    if pairs:
        key = np.unique(np.stack([text, run], axis=1), axis=0)
        n = sizes[key[:, 1]]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[key[:, 1]], n)
        found = np.unique(np.stack([np.repeat(key[:, 0], n), owner[inner]], axis=1), axis=0)
        s, t = stream.iloc[found[:, 0]], library.iloc[found[:, 1]]
        hits = pd.DataFrame({"s1": s["s1"].to_numpy(), "s2": s["s2"].to_numpy(), "t1": t["s1"].to_numpy(), "t2": t["s2"].to_numpy(), "start": -1, "stop": -1})
        return hits[(hits["s1"] != hits["t1"]) | (hits["s2"] != hits["t2"]) | several[found[:, 1]]]
    # a window is shared if its interval and its own cut have two classes between them
    own, low, high = stream[["s1", "s2"]].to_numpy(), library["low"].to_numpy(), library["high"].to_numpy()
    least = np.minimum(np.minimum.reduceat(low[owner], begins)[run], stream["low"].to_numpy()[text])
    most = np.maximum(np.maximum.reduceat(high[owner], begins)[run], stream["high"].to_numpy()[text])
    shared = np.flatnonzero((least != most) | np.logical_or.reduceat(several[owner], begins)[run] | stream["several"].to_numpy()[text])
    ordered = shared[np.lexsort((place[shared], text[shared]))]
    if not len(ordered):
        return empty
    t_, p_ = text[ordered], place[ordered]
    first = np.flatnonzero(np.concatenate([[True], (t_[1:] != t_[:-1]) | (p_[1:] > p_[:-1] + span)]))
    last = np.concatenate([first[1:], [len(ordered)]]) - 1
    return pd.DataFrame({"s1": own[t_[first], 0], "s2": own[t_[first], 1], "t1": 0, "t2": 0, "start": p_[first], "stop": p_[last] + span})


# ---- plans ------------------------------------------------------------------


def _keyed(df: DataFrame, id_column: str, text: str, span: int) -> DataFrame:
    """member, k1, k2 (128 bits of the text) and text, of texts long enough."""
    rows = df.select(F.col(id_column).cast("long").alias("member"), F.col(text).alias("text")).where(F.char_length("text") >= span)
    return rows.where("member IS NOT NULL").select("member", *_text_key(F.col("text")), "text")


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def anchored(rows: DataFrame, span: int, anchor: int) -> tuple[DataFrame, DataFrame]:
    """(members: k1, k2, n, member; anchors: k1, k2, h, pos) of keyed rows.  Of rows that
    repeat an id with other texts the one of the least text counts."""
    found = rows.select("member", "k1", "k2", "text").mapInArrow(_anchor_rows(span, anchor), "member long, k1 long, k2 long, n long, h long, pos int")
    found = materialize(found, "anchors")
    keys = found.where("h IS NULL")
    repeated = keys.groupBy("member").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.min("k2").alias("c"), F.max("k2").alias("d")).where("a <> b OR c <> d").select("member")
    repeated = materialize(repeated, "repeated-ids")  # hardly any; its size decides how it is joined
    least = rows.join(repeated, "member").groupBy("member").agg(F.min("text").alias("_t")).select(F.col("member").alias("_m"), F.xxhash64("_t").alias("_k1"), F.xxhash64(F.lit("second"), "_t").alias("_k2"))
    least = materialize(least, "least-texts")
    wrong = (F.col("member") == F.col("_m")) & ((F.col("k1") != F.col("_k1")) | (F.col("k2") != F.col("_k2")))
    counted = found.join(least, wrong, "left_anti")
    return counted.where("h IS NULL").select("k1", "k2", "n", "member").distinct(), counted.where("h IS NOT NULL").select("k1", "k2", "h", "pos")


def _cut_rows(span: int, anchor: int):
    """Of batches of k1, k2, text, h[], pos[] a row for each anchor: the cut around it,
    and its text where this task has not given it for this anchor before."""
    reach = span - anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            out = []
            for k1, k2, text, hs, places in zip(*(batch.column(i) for i in range(5))):
                k1, k2, text = k1.as_py(), k2.as_py(), text.as_py()
                for h, pos in zip(hs.as_py(), places.as_py()):
                    begin = max(0, pos - reach)
                    cut = text[begin : pos + anchor + reach]
                    both = xxhash.xxh3_128_digest(cut.encode("utf-8", "surrogatepass"))
                    s1, s2 = (int.from_bytes(both[i : i + 8], "little", signed=True) for i in (0, 8))
                    new = (h, s1, s2) not in seen
                    seen.add((h, s1, s2))
                    out.append((k1, k2, h, begin, len(cut), s1, s2, cut if new else None))
                if len(seen) > 1_000_000:
                    seen.clear()
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["k1", "k2", "h", "pos", "n", "s1", "s2", "cut"])

    return run


def shared_cuts(rows: DataFrame, members: DataFrame, anchors_: DataFrame, span: int, anchor: int) -> DataFrame:
    """k1, k2, h, pos (where the cut begins), n, the cut's 128-bit key (s1, s2) and, once
    a task at least, its text, of all anchors that more than one class has."""
    shared = anchors_.groupBy("h").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.min("k2").alias("c"), F.max("k2").alias("d")).where("a <> b OR c <> d").select("h")
    kept = anchors_.join(shared, "h").select("k1", "k2", "h", "pos").distinct()
    places = kept.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "pos")).alias("_p"))  # bounded by the text's length
    first = members.groupBy("k1", "k2").agg(F.min("member").alias("member"))
    asked = materialize(places.join(first, ["k1", "k2"]).select("member", "k1", "k2", "_p"), "places")
    # a repeated id may have rows of other texts, so the key is part of the join
    texts = rows.join(asked, ["member", "k1", "k2"])
    cut = texts.select("k1", "k2", "text", F.col("_p.h").alias("hs"), F.col("_p.pos").alias("places"))
    return cut.mapInArrow(_cut_rows(span, anchor), "k1 long, k2 long, h long, pos long, n long, s1 long, s2 long, cut string")


def shard_hits(cuts: DataFrame, span: int, pairs: bool, shard_chars: int = SHARD_CHARS, block_cuts: int = BLOCK_CUTS) -> DataFrame:
    """Hits of all shards, see search_shard."""
    classes = cuts.groupBy("h", "s1", "s2").agg(
        F.max("cut").alias("cut"), F.max("n").alias("n"), F.min("k1").alias("low"), F.max("k1").alias("high"), ((F.min("k1") != F.max("k1")) | (F.min("k2") != F.max("k2"))).alias("several"))
    classes = materialize(classes, "cut-classes")
    loads = classes.groupBy("h").agg(F.count(F.lit(1)).alias("_n"))
    blocks = loads.select("h", F.ceil(F.col("_n") / block_cuts).cast("int").alias("nb"))
    shards = max(1, int(-(-(classes.agg(F.sum("n")).first()[0] or 0) // shard_chars)))
    own = classes.join(blocks, "h").withColumn("b", F.pmod(F.col("s1"), F.col("nb")).cast("int"))
    # block pairs (i, j): library i, streamed j
    sides = F.flatten(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.array(F.struct(F.col("b").alias("i"), o.alias("j")), F.struct(o.alias("i"), F.col("b").alias("j")))))
    placed = own.withColumn("_p", F.explode(F.array_distinct(sides)))
    placed = placed.select(
        F.when(F.col("nb") == 1, F.pmod("h", F.lit(shards))).otherwise(F.col("h")).alias("shard"), (F.col("nb") == 1).alias("packed"),
        F.col("_p.i").alias("i"), F.col("_p.j").alias("j"), "s1", "s2", "cut", "several", "low", "high",
        (F.col("b") == F.col("_p.i")).alias("library"), (F.col("b") == F.col("_p.j")).alias("streamed"),
    )
    # a cut that two anchors of a shard have is in it once
    once = placed.groupBy("packed", "shard", "i", "j", "s1", "s2").agg(F.max("cut").alias("cut"), F.bool_or("several").alias("several"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("library").alias("library"), F.bool_or("streamed").alias("streamed"))
    # a shard is small in bytes and long in work, so its partition must not be merged with others
    parts = max(shards, int(cuts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    apart = once.repartition(parts, "packed", "shard", "i", "j")
    return apart.groupBy("packed", "shard", "i", "j").applyInPandas(lambda pdf: search_shard(pdf, span, pairs), _HITS)


def linked_classes(df: DataFrame, id_column: str, text: str, span: int = SPAN, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(links: a1, a2, b1, b2, the keys of two texts that share a span, either way round,
    once; members: k1, k2, n, member).  A row for each pair of different texts; copies
    are members of one class and not expanded."""
    rows = _keyed(df, id_column, text, span)
    members, found = anchored(rows, span, anchor)
    cuts = materialize(shared_cuts(rows, members, found, span, anchor), "cuts")
    classes = cuts.select("s1", "s2", "k1", "k2").distinct()
    hits = shard_hits(cuts, span, True).select("s1", "s2", "t1", "t2").distinct()
    left = hits.join(classes, ["s1", "s2"]).select("t1", "t2", F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    linked = left.join(classes.withColumnsRenamed({"s1": "t1", "s2": "t2"}), ["t1", "t2"]).select("a1", "a2", F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    return linked.where("a1 < b1 OR (a1 = b1 AND a2 < b2)").distinct(), members


def shared_pairs(df: DataFrame, id_column: str, text: str, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """Pairs of rows (smaller id first) that share a verbatim span of at least
    `span` code points: id_column, other_<id_column>.

    Null, empty and short texts share nothing; rows that repeat an id count as one
    document, with the least of their texts; rows without an id are none; long texts are
    searched whole; an empty table gives an empty result; other columns are ignored.
    The pairs are derived from linked_classes, those of copies from its members.
    """
    links, members = linked_classes(df, id_column, text, span, anchor)
    links, members = materialize(links, "class-links"), materialize(members.select("k1", "k2", "member"), "members")
    side = lambda k, name: members.select(F.col("k1").alias(f"{k}1"), F.col("k2").alias(f"{k}2"), F.col("member").alias(name))
    between = links.join(side("a", "x"), ["a1", "a2"]).select("b1", "b2", "x").join(side("b", "y"), ["b1", "b2"]).select("x", "y")
    copies = side("a", "x").join(side("a", "y"), ["a1", "a2"]).where("x < y").select("x", "y")
    return between.unionByName(copies).select(F.least("x", "y").alias(id_column), F.greatest("x", "y").alias(f"other_{id_column}")).distinct()


def shared_amounts(df: DataFrame, id_column: str, text: str, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """For each row with a span that another row has: id_column, n_spans (stretches
    of such spans, merged), shared_chars and n_chars.  A copied row is shared whole.
    Rows that share nothing do not come out.  No pair is made on the way."""
    from skeinlake.operators.intervals import merge_intervals

    rows = _keyed(df, id_column, text, span)
    members, found = anchored(rows, span, anchor)
    members = materialize(members, "members")
    cuts = materialize(shared_cuts(rows, members, found, span, anchor), "cuts")
    places = cuts.select("s1", "s2", "k1", "k2", "pos").distinct()
    bounds = shard_hits(cuts, span, False).select("s1", "s2", "start", "stop").distinct()
    stretches = bounds.join(places, ["s1", "s2"]).select(F.concat_ws(" ", "k1", "k2").alias("doc"), (F.col("pos") + F.col("start")).alias("s"), (F.col("pos") + F.col("stop")).alias("e"))
    per_text = merge_intervals(stretches, "doc", "s", "e", slot_ms=100_000).groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("shared_chars")
    )
    copied = members.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n_chars")).withColumn("doc", F.concat_ws(" ", "k1", "k2"))
    own, all_ = copied.join(per_text, "doc", "left"), F.col("copies") > 1
    own = own.select(
        "k1", "k2", F.when(all_, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(all_, F.col("n_chars")).otherwise(F.col("shared_chars")).alias("shared_chars"), "n_chars",
    ).where("shared_chars is not null")
    return members.select("k1", "k2", "member").join(own, ["k1", "k2"]).select(F.col("member").alias(id_column), "n_spans", "shared_chars", "n_chars")
