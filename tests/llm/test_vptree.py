import numpy as np
import pytest
from pyspark.sql import functions as F

from glintdex.llm import vptree


def plain(ids, x, query_ids, k):
    out = {}
    for q in query_ids:
        d = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (20, 12))
    x = centres[rng.integers(0, 20, 3000)] + rng.normal(0, 0.2, (3000, 12))
    x[100:140] = x[0]
    return np.arange(3000), x


def test_exact_and_relaxed(data):
    ids, x = data
    tree = vptree.Tree.load(vptree.Tree.build(ids, x, leaf=32).dump())
    own = ids[::50]
    want = plain(ids, x, own, 10)
    best, found = tree.search(own, x[::50], 10, 1.0)
    for q, d, i in zip(own, best, found, strict=True):
        assert i.tolist() == [v for v, _ in want[int(q)]]
        assert d == pytest.approx([s for _, s in want[int(q)]])
    _, some = tree.search(own, x[::50], 10, 0.6)
    recall = np.mean([len(set(i.tolist()) & {v for v, _ in want[int(q)]}) / 10 for q, i in zip(own, some, strict=True)])
    assert recall >= 0.9


def test_shards(spark, data, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD", 700)
    monkeypatch.setattr(vptree, "QUERIES", 9)
    ids, x = data
    rows = [(int(i), [float(v) for v in r], 0) for i, r in zip(ids, x, strict=True)]
    odd = [(3000, None, 0), (3100, [0.0] * 12, 0), (3200, [float("nan")] * 12, 0), (3300, [None] * 12, 0), (None, rows[1][1], 0), (3400, [1.0, 2.0], 0), (3500, [1.0, 5.0], 0), (3401, [1.0, 3.0], 0), (3600, [], 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, shard int")
    got = {}
    for r in vptree.every_hundredth(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = plain(ids, x, ids[::100], 10) | {3400: [(3401, 1.0), (3500, 3.0)], 3500: [(3401, 2.0), (3400, 3.0)]}
    assert got == {q: [(v, pytest.approx(s)) for v, s in r] for q, r in want.items()}
    assert vptree.every_hundredth(table.where("false")).count() == 0
    assert vptree.nearest(table, F.col("vec_id") == 1, 3).count() == 3


def test_repeated_query_row_asks_once(spark):
    rows = [(100, [0.0, 1.0])] * 3 + [(i, [float(i), 1.0]) for i in range(1, 16)]
    got = vptree.every_hundredth(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(100, i, i, float(i)) for i in range(1, 11)]


def test_query_id_with_several_vectors(spark):
    rows = [(100, [9.0, 1.0]), (100, [0.0, 1.0]), (100, [5.0, 1.0, 1.0])] + [(i, [float(i), 1.0]) for i in range(1, 16)]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, width string, asks int")
    got = vptree.every_hundredth(table).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(100, i, i, float(i)) for i in range(1, 11)]
