import random

import numpy as np
import pytest

from glintdex.llm import minhash
from glintdex.llm.shared import WORD


def plain(rows, span):
    def shingles(text):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(zip(*(words[k:] for k in range(span)), strict=False)) if len(words) >= span else frozenset([tuple(words)] if words else [])

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}  # one node for an id, whatever its texts

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [[word() for _ in range(rng.randint(3, 120))] for _ in range(40)]
    shared = [word() for _ in range(60)]
    rows = []
    for i in range(400):
        w = list(base[i % len(base)])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = word()
        if i % 9 == 0:
            w = shared + [word() for _ in range(rng.randint(5, 30))]
        rows.append((i * 3 + 1, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("span", "seed"), [(4, 1), (5, 2)])
def test_against_brute_force(spark, span, seed):
    rows = [*corpus(seed), (5000, None), (5001, ""), (5002, " \n"), (5003, "two words"), (5004, "TWO Words"), (5005, "Éa b"), (5006, "éa b"), (5007, "long " * 30_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(5)
    got = {tuple(r) for r in minhash.near_duplicates(docs, span).collect()}
    assert got == plain(rows, span)
    kept = minhash.keep_one(docs, span)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in got}


@pytest.mark.parametrize(("block", "chunk", "weight"), [(4, 4096, 2048), (512, 3, 2048), (3, 5, 10)])
def test_blocks_and_chunks_of_a_bucket_meet(spark, monkeypatch, block, chunk, weight):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("WEIGHT", weight)):
        monkeypatch.setattr(minhash, name, value)
    rows = corpus(3)[:200]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in minhash.near_duplicates(docs, 4).collect()} == plain(rows, 4)


def test_one_id_with_several_texts(spark):
    rng = random.Random(6)
    long = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(50)) for _ in range(100)) for _ in range(4)]
    close = [x.rsplit(" ", 2)[0] + " other end" for x in long]
    rows = [(7, long[0]), (7, long[1]), (9, close[0]), (11, close[1]), (12, long[2]), (13, close[2]), (13, long[3]), (20, close[3]), (20, "nothing like it at all here"), (5, "x y z"), (5, "x y z")]
    for order in range(3):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + order)
        got = {tuple(r) for r in minhash.near_duplicates(docs, 4).collect()}
        assert got == plain(rows, 4)
    assert {r["doc_id"] for r in minhash.keep_one(docs, 4).collect()} == {5, 7, 12}


def test_hot_class(spark, monkeypatch):
    """A class with more copies than its share is joined apart, with the same result."""
    rows = [(i, "one text that very many rows have in common") for i in range(10, 1300)] + [(1, "one text that very many rows have in common"), (2, "another")]
    got = {tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {(i, 6, 1) for i, _ in rows if i != 2} | {(2, 1, 2)}


def test_nulls_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.digests(docs).collect()), key=str)
    assert [r for r in got if r[0] is not None] == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False)]
    assert sorted(r[1:] for r in got if r[0] is None) == [(0, None, True), (3, None, True)]
    assert minhash.keep_one(docs).count() == 3
    assert minhash.digests(docs.where("false")).count() == 0


def test_estimate_is_corrected():
    rng = np.random.default_rng(4)
    for share in (0.0, 0.5, 0.8, 1.0):
        got = []
        for _ in range(60):
            n = 400
            both = rng.integers(0, 1 << 63, int(n * share), np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, (n - len(both)) // 2, np.uint64)])) for _ in range(2))
            sa, sb = (np.frombuffer(minhash.signature(minhash.minima(x)), np.uint8) for x in (a, b))
            got.append(float(minhash.similarity(sa, sb)) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(got)) < 0.02
        assert np.std(got) < 0.06
