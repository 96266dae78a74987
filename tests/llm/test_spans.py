import random
from collections import defaultdict

import numpy as np
import pytest

from skeinlake.llm import spans as S
from skeinlake.session import table


def brute(docs, span):
    by = defaultdict(set)
    for i, t in docs:
        for p in range(len(t or "") - span + 1):
            by[t[p : p + span]].add(i)
    shared = {k for k, v in by.items() if len(v) > 1}
    pairs = {(a, b) for k in shared for a in by[k] for b in by[k] if a < b}
    amounts = {}
    for i, t in docs:
        covered, edge, n = 0, -1, 0
        for p in range(len(t or "") - span + 1):
            if t[p : p + span] in shared:
                n += p > edge
                covered += p + span - max(p, edge if edge >= 0 else 0)
                edge = p + span
        if covered:
            amounts[i] = (n, covered, len(t))
    return pairs, amounts


def found(spark, docs, span=S.SPAN, anchor=S.ANCHOR):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, h string, pos string")
    pairs = [tuple(r) for r in S.shared_pairs(df, "doc_id", "text", span, anchor).collect()]
    assert len(pairs) == len(set(pairs))
    return set(pairs), {r["doc_id"]: (r["n_spans"], r["shared_chars"], r["n_chars"]) for r in S.shared_amounts(df, "doc_id", "text", span, anchor).collect()}


def test_documents_equal_brute_force(spark, data):
    docs = [tuple(r) for r in table(spark, data, "documents").select("doc_id", "text").collect()]
    assert found(spark, docs) == brute(docs, S.SPAN)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passages(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_CUTS", 3)  # hot anchors are split into pairs of blocks
    monkeypatch.setattr(S.shard_hits, "__defaults__", (2_000, 3))
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcé👩ภ ") for _ in range(n))
    passages = [word(rng.randrange(30, 90)) for _ in range(6)]
    docs = [(i, word(rng.randrange(0, 40)) + rng.choice(passages)[rng.randrange(4) :] + word(rng.randrange(0, 40)) + rng.choice(passages)) for i in range(60)]
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, None), (103, ""), (104, "short"), (105, "a" * 300), (106, "b" + "a" * 200), (107, passages[0] * 2)]
    assert found(spark, docs, 30, 12) == brute(docs, 30)


def test_repeated_ids(spark):
    a, b = "x y z " * 60, "other words " * 40
    docs = [(1, a), (1, a), (2, a), (2, "a" + b), (3, "q" + b), (None, a)]
    assert found(spark, docs)[0] == {(2, 3)}


def test_empty(spark):
    assert found(spark, [(1, None), (2, "")]) == (set(), {})
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.shared_pairs(df, "doc_id", "text").count() == 0


def test_fm_index_against_plain_search():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    span = 5
    index = S.FmIndex([codes(t) for t in texts], span)
    queries = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    text, place, run = index.matches([codes(q) for q in queries])
    got = {(int(t), int(p)): {int(o) for o in index.owner[index.run_start[r] : index.run_end[r]]} for t, p, r in zip(text, place, run)}
    want = {(i, p): own for i, q in enumerate(queries) for p in range(len(q) - span + 1) if (own := {j for j, t in enumerate(texts) if q[p : p + span] in t})}
    assert got == want


def test_window_hashes_depend_on_content_only():
    rng = np.random.default_rng(1)
    span = rng.integers(0, 1000, 300).astype(np.uint32)
    a, b = np.concatenate([rng.integers(0, 9, 17).astype(np.uint32), span]), np.concatenate([span, rng.integers(0, 9, 40).astype(np.uint32)])
    assert (S.window_hashes(a, 100)[17:] == S.window_hashes(b, 100)[: 300 - 99]).all()
    ha, hb = (set(S.anchors(x, 250, 100)[1].tolist()) for x in (a, b))
    assert ha & hb


def test_few_anchors_in_a_run_and_one_in_each_window():
    rng = random.Random(3)
    for k in range(40):
        t = "".join(rng.choice("ab") if k % 2 else "a" for _ in range(rng.randrange(60, 400)))
        codes = S._codes(t[: len(t) // 2] + "xyz" * (k % 5) + t[len(t) // 2 :])
        places, _ = S.anchors(codes, 30, 12)
        hashes = S.window_hashes(codes, 12)
        for i in range(len(hashes) - 18):
            assert any(i <= p < i + 19 and hashes[p] == hashes[i : i + 19].min() for p in places)
    blanks, text = S._codes(" " * 200_000), S._codes("".join(rng.choice("abcdefgh ") for _ in range(200_000)))
    assert len(S.anchors(blanks, 250, 100)[0]) <= len(S.anchors(text, 250, 100)[0])


def test_index_is_small_and_finds_its_texts():
    rng = random.Random(9)
    texts = [S._codes("".join(rng.choice("abcdefghijklm nopq") for _ in range(400))) for _ in range(200)]
    index = S.FmIndex(texts, 250)
    assert index.bytes < 5 * index.n
    order, _ = S.suffix_array(np.concatenate([np.concatenate([t + 1000, [i]]) for i, t in enumerate(texts)]), 250)
    assert (index.owners(np.arange(index.n)) == np.minimum(order // 401, 199)).all()


def test_boilerplate_blanks_and_surrogates(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    common, blanks = word(260), " " * 3000
    docs = [(i, word(rng.randrange(50, 200)) + common + word(rng.randrange(50, 200))) for i in range(25)] + [(50, blanks), (51, "x" + blanks), (52, word(300))]
    assert found(spark, docs) == brute(docs, 250)
