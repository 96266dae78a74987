"""Byte-level BPE over a corpus by merge replay.

The documents of a block (an Arrow batch) are split into words; the distinct
words not met before in this task are laid out as one row of byte tokens with an
inverted index from token pair to positions.  Merges are replayed in rank order:
each takes its positions from the index and changes only the two neighbours of
each.  A merge depends on its word alone, so the result is that of a replay over
the whole corpus, without a shuffle of it: the plan is one scan and one map.
"""

from __future__ import annotations

import heapq
import json
import os
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, types as T

#: Where the files of the public tokenizers are; a parameter of every function that reads one.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the published pattern that splits text into words before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of words that one replay lays out, and words a task remembers; both bound memory only.
REPLAY_BYTES, REMEMBERED = 200_000, 100_000
#: Words longer than this are replayed but not remembered.
LONG_WORD = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 for itself, the others counted up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class MergeTable:
    """Ids of the bytes and, for each pair of ids, (rank, id of the merged token)."""

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        self.bytes = [vocabulary[letter] for letter in byte_letters()]
        self.of_pair: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.of_pair[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])

    @classmethod
    def load(cls, name: str, folder: str = TOKENIZERS) -> MergeTable:
        with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], model["merges"])


def replay(words: list[bytes], table: MergeTable) -> list[list[int]]:
    """Token ids of each word, by replaying the merges over all words at once."""
    tokens: list[int] = []
    after: list[int] = []
    before: list[int] = []
    starts = []
    for word in words:
        at = len(tokens)
        starts.append(at)
        n = len(word)
        tokens.extend(table.bytes[b] for b in word)
        after.extend(range(at + 1, at + n))
        before.append(-1)
        before.extend(range(at, at + n - 1))
        after.append(-1)
    of_pair, index, due = table.of_pair, {}, []

    def note(left: int, right: int, at: int) -> None:
        pair = (left, right)
        if (places := index.get(pair)) is not None:
            places.append(at)
        elif (found := of_pair.get(pair)) is not None:
            index[pair] = [at]
            heapq.heappush(due, (found[0], pair, found[1]))

    for at, then in enumerate(after):
        if then >= 0:
            note(tokens[at], tokens[then], at)
    while due:
        _, (left, right), merged = heapq.heappop(due)
        for at in sorted(index.pop((left, right))):
            then = after[at]
            # the place may have been merged away meanwhile
            if tokens[at] != left or then < 0 or tokens[then] != right:
                continue
            tokens[at], tokens[then] = merged, -1
            after[at] = following = after[then]
            if following >= 0:
                before[following] = at
                note(merged, tokens[following], at)
            if (previous := before[at]) >= 0:
                note(tokens[previous], merged, previous)
    ends = [*starts[1:], len(tokens)]
    return [[t for t in tokens[a:b] if t >= 0] for a, b in zip(starts, ends)]


class BlockEncoder:
    """Encodes blocks of texts; remembers the words of earlier blocks of its task."""

    def __init__(self, table: MergeTable) -> None:
        self.table, self.split = table, regex.compile(WORDS).findall
        self.known: OrderedDict[str, list[int]] = OrderedDict()

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        known = self.known
        new = list(dict.fromkeys(w for words in split for w in words if w not in known))
        ids: dict[str, list[int]] = {}
        chunk, size = [], 0
        for word in new:
            chunk.append(word)
            size += len(word)
            if size >= REPLAY_BYTES:
                ids.update(zip(chunk, replay([w.encode() for w in chunk], self.table)))
                chunk, size = [], 0
        ids.update(zip(chunk, replay([w.encode() for w in chunk], self.table)))
        out = []
        for words in split:
            own: list[int] = []
            for w in words:
                own += ids[w] if w in ids else known[w]
            out.append(own)
        known.update((w, i) for w, i in ids.items() if len(w) <= LONG_WORD)
        while len(known) > REMEMBERED:
            known.popitem(last=False)
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Pieces of the batches with about two million characters of text each."""
    for batch in batches:
        sizes = np.cumsum(pc.utf8_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + 2_000_000, side="right")))
            piece = batch.slice(at, end - at)
            yield piece.column(0), piece.column(1).to_pylist()
            at = end


def encode(df: DataFrame, id_column: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """id_column and ids (array of int) of every row, without special tokens.

    Null and empty texts give an empty list, strings that look like special tokens
    are ordinary text, repeated rows are encoded each, long texts are encoded
    whole.  Other columns, whatever their names, are left out.  The merge table
    (its size is the vocabulary's) is broadcast from the driver.
    """
    table = df.sparkSession.sparkContext.broadcast(MergeTable.load(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BlockEncoder(table.value)
        for ids, texts in _blocks(batches):
            lists = pa.array(encoder.encode(texts), type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, lists], names=[id_column, "ids"])

    slim = df.select(id_column, text)
    schema = T.StructType([slim.schema[id_column], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return slim.mapInArrow(run, schema)


def token_counts(df: DataFrame, id_column: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """id_column and n_tokens; the ids stay in the Python worker."""
    table = df.sparkSession.sparkContext.broadcast(MergeTable.load(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BlockEncoder(table.value)
        for ids, texts in _blocks(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in encoder.encode(texts)], pa.int64())], names=[id_column, "n_tokens"])

    slim = df.select(id_column, text)
    return slim.mapInArrow(run, T.StructType([slim.schema[id_column], T.StructField("n_tokens", T.LongType())]))
