"""Near-duplicate documents by b-bit MinHash.

A document is its set of distinct word shingles, each a 64-bit hash.  Equal sets are one class from the start; the
smallest doc_id stands for it.  Of each class's minima over ``PERMUTATIONS`` hash functions, groups of ``ROWS`` make
band keys, and the low ``BITS`` bits of each are packed into a signature.  Classes that share a band are candidates.
For a pair of candidates the share of equal low bits, corrected for chance collisions, estimates the similarity;
pairs that it can't rule out are confirmed on full sets.

In a band's bucket no pairs are listed.  Buckets lie in ranges of (bucket, id), so a large one spans tasks.  First each
member is compared with the first of its ``CHUNK`` members in a row, and these firsts with the bucket's smallest, which
joins most of a group of copies.  Only buckets whose members are still in several components are then looked at again:
members outside the bucket's largest component meet those in it and one another in a task, block by block, and a
union-find there skips pairs that are already joined; links leave it, never candidate pairs.

Two sets at the limit of similarity share no band with a probability of (1 - 0.8**4)**28 = 4e-7, and their estimate
is over five standard errors above ``FLOOR``.

Defined results: null and empty texts, and texts without words, have an empty set, linked with nothing; a text with
fewer words than a shingle is one shingle; texts are read whole; repeated rows are in one class, all of them kept if
their id is the smallest; rows with one id and different texts are one document, linked by any of its texts; a null id
is never linked, has a null component and is kept; an empty table gives no rows; only key and text are read, so other
columns can't clash.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintdex.llm.graph import components
from glintdex.llm.shared import WORD, Scratch, fresh, is_small, kept_by_worker, narrow, slices
from glintdex.llm.words import Memo

PERMUTATIONS, ROWS, BITS = 112, 4, 4
BANDS = PERMUTATIONS // ROWS
#: Estimates under this rule a pair out: 0.8 less over five standard errors at that many permutations.
FLOOR = 0.58
#: Members of a bucket that are compared with one of them at first.
CHUNK = 4096
#: Weight of a bucket's members that one task compares with as much of others: a row, or ``WEIGHT`` shingles, counts one.
BLOCK, WEIGHT = 512, 2048
#: Classes with more than this share of all rows, a thousandth, are joined by broadcast: there are fewer than that.
HOT_SHARE = 1000
#: Ids are broadcast up to so many (8 MB); beyond, the join shuffles.
SMALL = 1_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.cache
def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def _word_hashes() -> Memo:
    return kept_by_worker(("word hashes",), lambda: Memo(xxhash.xxh3_64_intdigest, 200_000))


def shingles(text: str | None, span: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    memo = _word_hashes()
    memo.tidy()
    words = WORD.findall((text or "").encode().lower().decode())  # lower case for A-Z alone
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = min(span, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + h[k : len(words) - n + 1 + k])
    return np.unique(total)


def minima(own: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    a, b = _constants(PERMUTATIONS)
    x = (own >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMUTATIONS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        v = a[:, None] * part
        v += b[:, None]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(out, v.min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def signature(least: np.ndarray) -> bytes:
    """The low bits of all minima, two in a byte."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    return (low[::2] << 4 | low[1::2]).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of signatures as rows of bytes: the share of equal low bits, corrected for collisions by chance."""
    x = np.bitwise_xor(a, b)
    x |= x >> 1
    x |= x >> 2
    x &= 0x11
    share = 1 - np.bitwise_count(x).sum(axis=-1, dtype=np.int32) / PERMUTATIONS
    chance = 0.5**BITS
    return (share - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 times the intersection is at least 80 times the union; both are sorted and distinct."""
    if min(len(a), len(b)) * 100 < 80 * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= 80 * (len(a) + len(b) - shared)


def sketches(docs: DataFrame, span: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set, band keys and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2000):
                n, same, keys, signs = [], [], [], []
                for text in part.column(1).to_pylist():
                    own = shingles(text, span)
                    n.append(len(own))
                    same.append(xxhash.xxh3_128_digest(own.tobytes()))
                    least = minima(own) if len(own) else None
                    keys.append([] if least is None else band_keys(least))
                    signs.append(b"" if least is None else signature(least))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "same", "keys", "sign"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, same binary, keys array<long>, sign binary")


def full_sets(docs: DataFrame, wanted: DataFrame, span: int, few: bool) -> DataFrame:
    """node, same and the full set (binary), once for each distinct set of the documents whose ids ``wanted`` (node) has."""
    own = docs.join(F.broadcast(wanted) if few else wanted, docs.doc_id == wanted.node, "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 500):
                raw = [shingles(x, span).tobytes() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array(raw, pa.binary())], ["node", "same", "own"])

    return own.mapInArrow(run, "node long, same binary, own binary").dropDuplicates(["node", "same"])


def _chunks(places: DataFrame) -> DataFrame:
    """The rows of ``places`` (bucket, node, weight) whose bucket has others, with the ``first`` of their chunk.

    A task sees a range of (bucket, node) in order.  What may go on in the next one, its first and its last row, stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = before = None
        count = first = 0
        opening = True

        def out(rows: np.ndarray, after: np.ndarray, closing: bool) -> pa.RecordBatch:
            nonlocal before, count, first, opening
            bucket, node = rows[0], rows[1]
            at = np.arange(len(bucket))
            new = np.append(before is None or bucket[0] != before, bucket[1:] != bucket[:-1])
            begun = np.maximum.accumulate(np.where(new, at, -1))
            nth = np.where(begun >= 0, at - begun, at + count)
            lead = np.maximum.accumulate(np.where(nth % CHUNK == 0, at, -1))
            firsts = np.where(lead >= 0, node[np.maximum(lead, 0)], first)
            stays = ~new | (bucket == after)
            stays[0] |= opening
            stays[-1] |= closing
            before, count, first, opening = bucket[-1], int(nth[-1]) + 1, int(firsts[-1]), False
            return pa.RecordBatch.from_arrays([pa.array(c[stays]) for c in (*rows, firsts)], ["bucket", "node", "weight", "first"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns])
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            if rows.shape[1] > 1:
                yield out(rows[:, :-1], rows[0, 1:], False)
            held = rows[:, -1:]
        if held is not None:
            yield out(held, held[0] + 1, True)

    dealt = places.repartitionByRange("bucket", "node").sortWithinPartitions("bucket", "node")
    return dealt.mapInArrow(run, "bucket long, node long, weight long, first long")


def _confirm(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, own_a, own_b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            ok = [linked(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "own_a", "own_b").mapInArrow(run, "a long, b long")


def _possible(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, sign_a, sign_b) that their estimated similarity doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(similarity(a, b) >= FLOOR))

    return pairs.select("a", "b", "sign_a", "sign_b").mapInArrow(run, "a long, b long")


def _join_blocks(rows: DataFrame) -> DataFrame:
    """Links between components that meet in a bucket, block against block.

    ``rows``: bucket, low, high (numbers of two blocks), block, node, label, sign, own; sorted here by that group.
    """

    def group(members: list[tuple]) -> list[tuple[int, int]]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        low, high = members[0][1], members[0][2]
        left = [m for m in members if m[3] == low]
        right = left if low == high else [m for m in members if m[3] == high]
        if not left or not right:
            return []
        signs = np.frombuffer(b"".join(m[6] for m in right), np.uint8).reshape(len(right), -1)
        sizes = np.array([len(m[7]) for m in right])
        out = []
        for i, m in enumerate(left):
            start = i + 1 if low == high else 0
            near = similarity(np.frombuffer(m[6], np.uint8), signs[start:])
            fit = np.minimum(sizes[start:], len(m[7])) * 100 >= 80 * np.maximum(sizes[start:], len(m[7]))
            for j in start + np.flatnonzero((near >= FLOOR) & fit)[np.argsort(-near[(near >= FLOOR) & fit], kind="stable")]:
                a, b = find(m[5]), find(right[j][5])
                if a != b and linked(np.frombuffer(m[7], np.uint64), np.frombuffer(right[j][7], np.uint64)):
                    root[max(a, b)] = min(a, b)
                    out.append((m[4], right[j][4]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if members and members[0][:3] != row[:3]:
                    found += group(members)
                    members = []
                members.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        found = group(members) if members else []
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "block", "node")
    return dealt.select("bucket", "low", "high", "block", "node", "label", "sign", "own").mapInArrow(run, "a long, b long")


def _repeated(full: DataFrame, heads: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of each document whose id has several texts."""
    several = full.groupBy("doc_id").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low < high").select("doc_id")
    own = full.select("doc_id", "same").join(several, "doc_id", "left_semi").distinct().join(heads.select("same", "node"), "same").select("doc_id", "node").distinct()
    lowest = own.groupBy("doc_id").agg(F.min("node").alias("a"))
    return own.join(lowest, "doc_id").where("a < node").select("a", F.col("node").alias("b"))


def _open_blocks(named: DataFrame) -> DataFrame:
    """What is still to compare, of ``named`` (bucket, node, weight, label): bucket, low, high, block, node, label.

    Members of a bucket's heaviest component lie in the first blocks, the others in blocks of their own; every pair of
    blocks (low, high) is there but those within that component.
    """
    apart = named.groupBy("bucket").agg(F.min("label").alias("low_label"), F.max("label").alias("high_label")).where("low_label < high_label").select("bucket")
    # Where few buckets are open, no bucket's members come together in one task.
    few = is_small(apart, SMALL)
    rows = named.join(F.broadcast(apart) if few else apart, "bucket", "left_semi")
    sums = rows.groupBy("bucket", "label").agg(F.sum("weight").alias("sum")).groupBy("bucket").agg(F.max(F.struct("sum", "label")).alias("top"), F.sum("sum").alias("all"))
    blocks = lambda weight: F.ceil(weight / BLOCK).cast("int")
    sums = sums.select("bucket", F.col("top.label").alias("heaviest"), blocks(F.col("top.sum")).alias("heavy"), blocks(F.col("all") - F.col("top.sum")).alias("light"))
    rows = rows.join(F.broadcast(sums) if few else sums, "bucket")
    inside, place = F.col("label") == F.col("heaviest"), F.xxhash64("node")
    block = F.when(inside, F.pmod(place, F.col("heavy"))).otherwise(F.col("heavy") + F.pmod(place, F.col("light"))).cast("int")
    others = F.sequence(F.when(inside, F.col("heavy")).otherwise(0), F.col("heavy") + F.col("light") - 1)
    rows = rows.select("bucket", "node", "label", block.alias("block"), F.explode(others).alias("other"))
    return rows.select("bucket", "node", "label", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def near_duplicates(docs: DataFrame, span: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = narrow(docs, doc_id="long", text="string")
    rows = scratch.keep(sketches(own, span), "sketches")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("same").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("sign").alias("sign"), F.first("n_shingles").alias("size"), F.count("*").alias("copies"))
    heads = scratch.keep(classes, "heads")

    weight = F.ceil(F.col("size") / WEIGHT).cast("long").alias("weight")
    shared = scratch.keep(_chunks(heads.select(F.explode("keys").alias("bucket"), "node", weight)), "shared")
    wanted = scratch.keep(shared.select("node").distinct(), "wanted")
    few = is_small(wanted, SMALL)
    signs = scratch.keep(heads.join(F.broadcast(wanted) if few else wanted, "node", "left_semi").select("node", "same", "sign"), "signs")
    sets = scratch.keep(full_sets(own, wanted, span, few), "sets")

    # Each member against its chunk's first, and these against their bucket's smallest.
    firsts = shared.select("bucket", "first").distinct()
    smallest = firsts.groupBy("bucket").agg(F.min("first").alias("a"), F.max("first").alias("last")).where("a < last").select("bucket", "a")
    pairs = shared.select(F.col("first").alias("a"), F.col("node").alias("b")).union(firsts.join(smallest, "bucket").select("a", F.col("first").alias("b"))).where("a < b").distinct()
    side = lambda df, name, value: df.select(F.col("node").alias(name), F.col("same").alias(f"same_{name}"), F.col(value).alias(f"{value}_{name}"))
    pairs = _possible(pairs.join(side(signs, "b", "sign"), "b").join(side(signs, "a", "sign"), "a"))
    pairs = pairs.join(side(sets, "b", "own"), "b").join(side(sets, "a", "own"), "a")
    star = scratch.keep(_confirm(pairs).union(_repeated(full, heads)), "star")
    labels = components(star, scratch)

    # Buckets whose members are still apart.
    named = scratch.keep(shared.join(labels, "node", "left").select("bucket", "node", "weight", F.coalesce("label", "node").alias("label")), "named")
    open_ = _open_blocks(named).join(signs, "node").join(sets, ["node", "same"])
    late = scratch.keep(_join_blocks(open_), "late")
    labels = components(star.union(late), scratch, "all-labels")
    scratch.drop("shared", "wanted", "signs", "sets", "named", "labels-next")

    final = heads.join(labels, "node", "left").select("same", "copies", F.coalesce("label", "node").alias("component_id"))
    most = max(1000, rows.count() // HOT_SHARE)
    hot = final.where(F.col("copies") >= most).select("same", F.col("component_id").alias("hot_id"))
    cold = final.where(F.col("copies") < most).select(F.col("same").alias("at"), F.col("component_id").alias("cold_id"))
    known = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    named_rows = rows.select("doc_id", "n_shingles", "same").join(F.broadcast(hot), "same", "left")
    # Rows that need no other class's id go by their own.
    named_rows = named_rows.withColumn("at", F.when(known & F.col("hot_id").isNull(), F.col("same")).otherwise(F.concat(F.lit("-"), F.col("doc_id").cast("string")).cast("binary")))
    component = F.coalesce(F.when(known, F.coalesce("hot_id", "cold_id")), "doc_id")
    return named_rows.join(cold, "at", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame, span: int = 5) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near duplicates: the one with the smallest id.

    Of rows that repeat an id, one stays; rows without an id all stay.
    """
    scratch = Scratch(docs.sparkSession)
    judged = scratch.keep(near_duplicates(docs, span), "judged")
    (name,) = fresh(docs, "gone__")
    gone = judged.where("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    at = F.col("doc_id").cast("long") == F.col(name)
    kept = docs.join(F.broadcast(gone) if is_small(gone, SMALL) else gone, at, "left_anti")
    again = judged.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return kept if again.isEmpty() else kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns, on four-word shingles."""
    return near_duplicates(docs, 4).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: The same in DuckDB's SQL, by counting shared shingles of all pairs that share one.
ORACLE = """
WITH RECURSIVE cut AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM cut),
classes AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
each AS (SELECT rep, n, unnest(s) AS sh FROM classes),
pairs AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM each a JOIN each b ON a.sh = b.sh AND a.rep < b.rep GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (na + nb - k) UNION ALL SELECT b, a FROM pairs WHERE 100 * k >= 80 * (na + nb - k)),
reach(a, b) AS (SELECT rep, rep FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
label AS (SELECT a AS rep, min(b) AS label FROM reach GROUP BY a)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(label, doc_id) AS component_id, doc_id = coalesce(label, doc_id) AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN label ON classes.rep = label.rep
"""
