"""Nearest neighbours by vantage-point trees, one for each shard of the rows.

A node of a tree keeps one vector, the vantage point, and parts the others at their median distance from it.  For a
query at distance d from the point, the triangle inequality bounds how near anything on a side can be; a side is
searched if that bound is at most ``factor`` times the distance of the query's k-th best so far.  Factor one is exact;
less prunes more and may miss some.

Rows are dealt to shards of about ``SHARD`` rows by the hash of their id, so no shard grows with the data.  Queries
travel in blocks to every shard; each task holds one shard's tree and one block.  Each shard returns k rows a query,
and the best k of these are the result.  Distances are of the original vectors in double precision.

Defined results: vectors that are null, all zero, or hold nulls or non-finite numbers take no part, as query or as
candidate; vectors are compared with those of their own length only; rows with the query's own id are no candidates;
of equal distances the smaller id comes first; repeated rows are candidates each, but an id asks once, with the shortest
and then least of its vectors; a null id takes no part; an empty table gives no rows.  Only id and vector are read, so
other columns can't clash.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintdex.llm.shared import Scratch, is_small

SHARD, QUERIES, LEAF = 8192, 256, 128
#: Vectors of up to so many different lengths have their counts broadcast; beyond, the join shuffles.
WIDTHS = 10_000


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All distances between rows of ``q`` and of ``x``; squares are summed in the order of the components."""
    q, x = (np.ascontiguousarray(m.T, np.float64) for m in (q, x))
    total = np.zeros((q.shape[1], x.shape[1]))
    for a, b in zip(q, x, strict=True):
        d = a[:, None] - b
        d *= d
        total += d
    return np.sqrt(total)


class Tree:
    """Nodes as flat arrays; a leaf is a run of rows, an inner node a vantage row and two children."""

    FIELDS = ("ids", "rows", "point", "split", "far", "left", "right", "start", "stop")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF, seed: int = 5) -> Tree:
        rng = np.random.default_rng(seed)
        order: list[np.ndarray] = []
        nodes: list[list] = []
        placed = 0

        def add(own: np.ndarray) -> int:
            nonlocal placed
            me = len(nodes)
            nodes.append([-1, 0.0, 0.0, -1, -1, placed, placed])
            if len(own) > leaf:
                pick = int(rng.integers(len(own)))
                point, own = own[pick], np.delete(own, pick)
                d = distances(rows[point : point + 1], rows[own])[0]
                split = float(np.median(d))
                inner = d <= split
                if inner.any() and not inner.all():
                    order.append(np.array([point]))
                    nodes[me][0] = placed
                    placed += 1
                    nodes[me][1:3] = [split, float(d[~inner].min())]
                    nodes[me][3] = add(own[inner])
                    nodes[me][4] = add(own[~inner])
                    return me
                own = np.append(own, point)  # all at one distance
            order.append(own)
            placed += len(own)
            nodes[me][6] = placed
            return me

        add(np.arange(len(ids)))
        at = np.concatenate(order)
        p, s, f, left, right, start, stop = (np.array(c) for c in zip(*nodes, strict=True))
        return cls(ids=ids[at], rows=rows[at], point=p, split=s, far=f, left=left, right=right, start=start, stop=stop)

    def dump(self) -> bytes:
        np.savez(out := io.BytesIO(), **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as f:
            return cls(**{k: f[k] for k in cls.FIELDS})

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the best k of each query, nearest first; infinite where there are fewer."""
        queries = queries.astype(np.float64)
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), np.iinfo(np.int64).max)

        def offer(which: np.ndarray, start: int, stop: int, d: np.ndarray) -> None:
            ids = self.ids[start:stop]
            d = np.where(ids[None, :] == query_ids[which, None], np.inf, d)
            some = (d <= best[which, -1:]).any(axis=1)
            which, d = which[some], d[some]
            if len(which):
                all_d = np.concatenate([best[which], d], axis=1)
                all_i = np.concatenate([found[which], np.broadcast_to(ids, d.shape)], axis=1)
                order = np.lexsort((all_i, all_d), axis=-1)[:, :k]
                best[which] = np.take_along_axis(all_d, order, axis=1)
                found[which] = np.take_along_axis(all_i, order, axis=1)

        def visit(node: int, which: np.ndarray) -> None:
            if not len(which):
                return
            if self.point[node] < 0:
                start, stop = int(self.start[node]), int(self.stop[node])
                offer(which, start, stop, distances(queries[which], self.rows[start:stop].astype(np.float64)))
                return
            p = int(self.point[node])
            d = distances(queries[which], self.rows[p : p + 1].astype(np.float64))
            offer(which, p, p + 1, d)
            d, split, far = d[:, 0], self.split[node], self.far[node]
            near = d <= split
            visit(int(self.left[node]), which[near])
            visit(int(self.right[node]), which[~near])
            reach = lambda sel: factor * best[which[sel], -1] * (1 + 1e-9) + 1e-12
            visit(int(self.left[node]), which[~near][d[~near] - split <= reach(~near)])
            visit(int(self.right[node]), which[near][far - d[near] <= reach(near)])

        visit(0, np.arange(len(queries)))
        return best, found


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    v = batch.column(batch.schema.names.index(name))
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _grouped(df: DataFrame, key: str, kind: str, make) -> DataFrame:
    """One row (key, ``body``) for each key of ``df`` (key, id, vector), made from its ids and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def out() -> pa.RecordBatch:
            ids = np.concatenate([b.column(1).to_numpy() for b in held])
            rows = np.concatenate([_matrix(b, "vector") for b in held])
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([make(ids[order], rows[order])], pa.binary())], [key, "body"])

        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), object)
            cuts = [0, *(1 + np.flatnonzero(keys[1:] != keys[:-1])), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if held and keys[lo] != at:
                        yield out()
                        held = []
                    at = keys[lo]
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield out()

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, f"{key} string, body binary")


def _block(ids: np.ndarray, rows: np.ndarray) -> bytes:
    np.savez(out := io.BytesIO(), ids=ids, rows=rows)
    return out.getvalue()


def nearest(table: DataFrame, is_query: Column, k: int = 10, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows of ``table`` to each of its rows that ``is_query`` names."""
    scratch = Scratch(table.sparkSession)
    own = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    own = own.where(F.col("id").isNotNull() & _usable(F.col("vector"))).withColumn("width", F.size("vector"))
    # One row for each length of vector.
    sizes = own.groupBy("width").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"), F.ceil(F.count_if("asks") / QUERIES).cast("int").alias("blocks"))
    few = is_small(sizes, WIDTHS)
    sizes = F.broadcast(sizes) if few else sizes
    dealt = own.join(sizes, "width")
    name = lambda n, salt: F.concat_ws(":", "width", F.pmod(F.xxhash64(F.lit(salt), "id"), n))
    trees = _grouped(dealt.select(name(F.col("shards"), 1).alias("shard"), "id", "vector"), "shard", "tree", lambda ids, rows: Tree.build(ids, rows).dump())
    trees = scratch.keep(trees, "trees")
    # An id asks once: its answers share one ranking.
    asks = own.where("asks").groupBy("id").agg(F.min(F.struct("width", "vector")).alias("one")).select("id", "one.width", "one.vector")
    asked = asks.join(sizes, "width").select(name(F.col("blocks"), 2).alias("block"), "id", "vector")
    blocks = _grouped(asked, "block", "block", _block)
    sent = blocks.withColumn("width", F.split("block", ":")[0].cast("int")).join(sizes, "width")
    sent = sent.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: F.concat_ws(":", F.col("width"), s))).alias("shard"), F.lit(1).alias("kind"), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                shard, kind, body = (batch.column(c)[i].as_py() for c in range(3))
                if kind == 0:
                    tree, at = Tree.load(body), shard
                elif shard == at:
                    with np.load(io.BytesIO(body)) as f:
                        ids, rows = f["ids"], f["rows"]
                    best, found = tree.search(ids, rows, k, factor)
                    ok = np.isfinite(best)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, ok.sum(axis=1))), pa.array(found[ok]), pa.array(best[ok])], ["query_id", "vec_id", "score"])

    both = trees.select("shard", F.lit(0).alias("kind"), "body").union(sent).repartition("shard").sortWithinPartitions("shard", "kind")
    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB's SQL, by comparing all pairs.
ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda s, x: s + x)) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def every_hundredth(table: DataFrame, factor: float = 1.0) -> DataFrame:
    """The contract's queries: rows whose id is divisible by 100."""
    return nearest(table, F.col("vec_id") % 100 == 0, 10, factor)
