import os

import pytest

from skeinlake.llm import bpe as B
from skeinlake.session import table

tokenizers = pytest.importorskip("tokenizers")
ODD = ["", None, "   \n\n  x ", "<|endoftext|> hi <|x|>", "a" * 70_000, "é́é ḿ", "ab12 ½ ² Ⅷ", "​﻿　  ", "👩‍🔧🛠️🇹🇭", "it's I'll WE'VE 'S", "\x1c\x1d x \x85", "ภาษาไทย 한국어 日本語", "\t\t  code(1, 2);\r\n"]


def want(texts):
    t = tokenizers.Tokenizer.from_file(os.path.join(B.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids if s else [] for s, e in zip(texts, t.encode_batch([s or "" for s in texts], add_special_tokens=False))]


def test_corpus_equals_the_public_library(spark, data):
    docs = table(spark, data, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in B.encode(docs, "doc_id", "text").collect()}
    assert got == dict(zip(texts, want(list(texts.values()))))
    counts = {r["doc_id"]: r["n_tokens"] for r in B.token_counts(docs, "doc_id", "text").collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_odd_texts_and_small_blocks(monkeypatch):
    monkeypatch.setattr(B, "REPLAY_BYTES", 7)
    monkeypatch.setattr(B, "REMEMBERED", 3)
    encoder = B.BlockEncoder(B.MergeTable.load("byte_bpe_50k"))
    assert encoder.encode(ODD) == want(ODD)
    assert encoder.encode(ODD[::-1]) == want(ODD)[::-1]


def test_null_ids_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "hello", "x"), (None, "hello", "y"), (1, None, "z")], "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"] or 0), list(r["ids"])) for r in B.encode(df, "doc_id", "text").collect())
    assert got == [(0, [31373]), (1, []), (1, [31373])]
    assert B.encode(df.limit(0), "doc_id", "text").count() == 0


def test_replay_takes_overlapping_pairs_from_the_left():
    letters = B.byte_letters()
    vocabulary = {c: i for i, c in enumerate(letters)} | {"aa": 256, "aab": 257}
    table_ = B.MergeTable(vocabulary, ["a a", "aa b"])
    a, b = vocabulary["a"], vocabulary["b"]
    assert B.replay([b"aaa", b"aaaa", b"aab", b"", b"ab"], table_) == [[256, a], [256, 256], [257], [], [a, b]]
