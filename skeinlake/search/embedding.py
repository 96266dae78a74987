"""Filling a table of vectors: what lacks one is embedded in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

Provider = Callable[[list[str]], np.ndarray]


def hashing_provider(dim: int = 64) -> Provider:
    """A provider without a model: signed hashes of words.  For tests and as a form to follow."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        return out

    return embed


def backlog(events: DataFrame, vectors: DataFrame, key: str, least_chars: int = 24) -> DataFrame:
    return events.where(F.char_length("text") >= least_chars).join(vectors.select(key), key, "left_anti")


def pooled(parts: np.ndarray, windows: list[list[str]]) -> np.ndarray:
    """A vector a text: the mean of those of its windows, weighted by their characters."""
    if all(len(w) == 1 for w in windows):
        return parts
    chars = np.array([len(w) for text in windows for w in text], np.float32)
    starts = np.cumsum([0, *[len(w) for w in windows[:-1]]])
    sums = np.add.reduceat(parts * chars[:, None], starts, axis=0)
    return sums / np.maximum(np.add.reduceat(chars, starts), 1)[:, None]


def embed(rows: DataFrame, key: str, provider: Provider, model: str, most_chars: int = 2000) -> DataFrame:
    """key, embedding (unit length), model, dim.  A batch whose provider fails gives
    nothing and is found again by the next backlog; widths that differ are an error.
    The provider gets texts of at most most_chars: a longer text is embedded in windows
    of that size, whose vectors are averaged by their characters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = None
        for frame in frames:
            try:
                windows = [[t[i : i + most_chars] for i in range(0, max(len(t), 1), most_chars)] for t in frame["text"]]
                parts = np.asarray(provider([w for text in windows for w in text]), np.float32)
                vectors = pooled(parts, windows)
            except Exception:
                continue
            if width not in (None, vectors.shape[1]):
                raise ValueError("the provider changed its width")
            width = vectors.shape[1]
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = np.where(norms > 0, vectors / np.where(norms > 0, norms, 1), vectors)
            yield pd.DataFrame({key: frame[key], "embedding": list(unit), "model": model, "dim": width})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInPandas(run, f"{key} {kind}, embedding array<float>, model string, dim int")


def check_model(vectors: DataFrame, scope: list[str]) -> DataFrame:
    """Scopes whose vectors come from more than one model or width: they can't be searched together."""
    kinds = vectors.groupBy(*scope).agg(F.collect_set("model").alias("models"), F.collect_set("dim").alias("dims"))
    return kinds.where((F.size("models") > 1) | (F.size("dims") > 1))
