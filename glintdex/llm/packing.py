"""Packing documents into training sequences by cutting-stock column generation.

Documents over the sequence length give whole sequences first; what remains of each is shorter than one.  Only the
histogram of these remainders (at most ``size`` - 1 lengths, whatever the corpus) reaches the driver.  There a linear
program over patterns (how many pieces of each length share a sequence) is improved column by column: the program's
dual prices go into a knapsack dynamic program, whose best patterns enter the basis, until none is worth more than its
sequence.  Patterns are rounded to whole counts.  What rounding leaves over is cut again, each time by a knapsack over
what is still there, at the prices that a program without waste has: the lengths themselves.  Documents, ranked within
their length, take the patterns' places by arithmetic on their rank.  The few remainders that no pattern fills up are
laid end to end and cut at the sequence length; the last part is cut into powers of two, which need no padding.

Ids are cut where they lie: the task that tokenises a document also counts, for each length, the remainders before it
in its own part of the table, and the numbers of remainders in the parts before are a small table beside it.

Defined results: a null or empty text is one end-of-document id; repeated rows and keys are packed row by row, in the
order of the written table; an empty table gives no pieces; only the key and the ids are read, so other columns can't
clash.  Which document takes which place depends on how the table was split into parts; the numbers of sequences and of
their ids don't.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintdex.llm.shared import Scratch, is_small, slices
from glintdex.llm.words import library_ids

#: The table of (part, length) is broadcast up to so many rows (some 20 MB); beyond, the join shuffles.
SMALL = 200_000
NUMBERED = "doc_id long, ids binary, n long, r int, k long, part int, nth long, wholes long"


class Numbers:
    """Numbers remainders, by their length, and whole sequences of one part of a table while it streams by."""

    def __init__(self, size: int):
        self.size, self.part = size, TaskContext.get().partitionId()
        self.seen, self.whole = np.zeros(size, np.int64), np.zeros(size, np.int64)

    def batch(self, keys: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        n = np.array([len(x) // 4 for x in ids], np.int64)
        r, k = n % self.size, n // self.size
        nth, wholes = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for i, (x, y) in enumerate(zip(r.tolist(), k.tolist(), strict=True)):
            nth[i], wholes[i] = self.seen[x], self.whole[x]
            self.seen[x] += 1
            self.whole[x] += y
        columns = [keys, pa.array(ids, pa.binary()), n, r.astype(np.int32), k, np.full(len(n), self.part, np.int32), nth, wholes]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in NUMBERED.split(", ")])


def token_table(docs: DataFrame, vocab: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """``doc_id`` and ``ids`` (binary, little-endian unsigned 32-bit, ``end_id`` last) of every whole text, numbered.

    ``n`` ids are ``k`` whole sequences and a remainder of ``r``; ``nth`` remainders of this length and ``wholes``
    sequences of such documents come before in the table's ``part``.  To be written once, as numbers go by tasks.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, numbers = library_ids(vocab), Numbers(size)
        for batch in batches:
            for part in slices(batch, 1):
                yield numbers.batch(part.column(0), [c.encode(x) + end for x in part.column(1).to_pylist()])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, NUMBERED)


def numbered(tokens: DataFrame, size: int = 2048) -> DataFrame:
    """The same columns for a table of doc_id and ids that exists; null and empty ids are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(size)
        for batch in batches:
            for part in slices(batch, 1):
                yield numbers.batch(part.column(0), part.column(1).to_pylist())

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").where("octet_length(ids) > 0").mapInArrow(run, NUMBERED)


def first_patterns(lengths: np.ndarray, demand: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A basis to start from: fill greedily, largest first, and run each pattern until one of its lengths is used up.

    A pattern holds only lengths that no earlier one used up, so the columns are triangular in that order.
    """
    m = len(lengths)
    left, alive = demand.astype(float).copy(), np.ones(m, bool)
    columns, order = np.zeros((m, m)), np.zeros(m, int)
    for j in range(m):
        room, take, i = size, np.zeros(m), m - 1
        below = np.maximum.accumulate(np.where(alive, np.arange(m), -1))  # the largest living length at or under each
        while room > 0:
            i = min(i, int(np.searchsorted(lengths, room, "right")) - 1)
            i = int(below[i]) if i >= 0 else -1
            if i < 0:
                break
            take[i] = max(1, min(room // lengths[i], np.floor(left[i])))
            room -= int(take[i]) * lengths[i]
            i -= 1
        held = take > 0
        ratio = np.where(held, left / np.where(held, take, 1), np.inf)
        out = int(np.argmin(ratio))
        left -= ratio[out] * take
        left[out], alive[out] = 0, False
        columns[:, j], order[j] = take, out
    return columns, order


def inverse_of(columns: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The inverse of ``first_patterns``' columns, which are lower triangular with their rows in ``order``.

    Here and below einsum stands for products: BLAS with threads can hang in a process that has started a JVM.
    """
    lower, out = columns[order], np.zeros(columns.shape)
    for j in range(len(order)):
        out[j] = -np.einsum("i,ij->j", lower[j, :j], out[:j])
        out[j, order[j]] += 1
        out[j] /= lower[j, j]
    return out


def knapsack(lengths: np.ndarray, price: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack's dynamic program: the worth of each room, and the last length that it takes (-1: one less room)."""
    own = np.flatnonzero(price > 1e-12)
    value, by = np.zeros(size + 1), np.full(size + 1, -1)
    at, worth = lengths[own], price[own]
    for room in range(1, size + 1):
        n = int(np.searchsorted(at, room, "right"))
        value[room] = value[room - 1]
        if n:
            got = worth[:n] + value[room - at[:n]]
            k = int(got.argmax())
            if got[k] > value[room] + 1e-12:
                value[room], by[room] = got[k], own[k]
    return value, by


def taken(lengths: np.ndarray, by: np.ndarray, room: int) -> np.ndarray:
    """The pattern that the dynamic program puts into ``room``."""
    column = np.zeros(len(lengths))
    while room > 0:
        if by[room] < 0:
            room -= 1
        else:
            column[by[room]] += 1
            room -= int(lengths[by[room]])
    return column


def best_pattern(lengths: np.ndarray, price: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of lengths within ``size``."""
    value, by = knapsack(lengths, price, size)
    return float(value[size]), taken(lengths, by, size)


def patterns(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float = 1e-3, several: int = 32, idle: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Columns and how often to use each (not whole) so that together they hold ``demand``.

    Ends when no pattern is worth more than 1 + ``gap`` at the dual prices (then the program is within ``gap`` of its
    least), or when all sequences but for that share are full.  Each run of the dynamic program gives up to
    ``several`` columns, the best ones that hold each length; those still worth it enter one after the other.  Lengths
    that occur once or twice make many exchanges that gain nothing; after ``idle`` runs without gain it ends too.
    """
    columns, order = first_patterns(lengths, demand, size)
    inverse = inverse_of(columns, order)
    times = np.maximum(np.einsum("ij,j->i", inverse, demand), 0)
    price = inverse.sum(axis=0)
    least, best, left = float(lengths @ demand) / size, np.inf, idle
    while left > 0 and times.sum() > least * (1 + gap):
        left = idle if times.sum() < best * (1 - 1e-6) else left - 1
        best = min(best, times.sum())
        value, by = knapsack(lengths, price, size)
        if value[size] <= 1 + gap:
            break
        with_each = price + value[size - lengths]
        entered = 0
        for i in np.argsort(-with_each, kind="stable")[:several]:
            column = taken(lengths, by, size - int(lengths[i]))
            column[i] += 1
            held = np.flatnonzero(column)
            if float(price[held] @ column[held]) <= 1 + gap / 2:
                continue
            step = np.einsum("ij,j->i", inverse[:, held], column[held])
            may = step > 1e-6
            ratio = np.where(may, times / np.where(may, step, 1), np.inf)
            out = int(np.argmax(np.where(ratio <= ratio.min() + 1e-9, step, 0)))  # of several the firmest
            if not np.isfinite(ratio[out]):
                continue
            most = ratio[out]
            times = np.maximum(times - most * step, 0)
            times[out] = most
            row = inverse[out] / step[out]
            down, across = np.flatnonzero(np.abs(step) > 1e-13), np.flatnonzero(row)
            inverse[np.ix_(down, across)] -= np.outer(step[down], row[across])
            inverse[out] = row
            price = price - row * (step.sum() - 1)
            columns[:, out] = column
            entered += 1
        # Without the rounding errors of the steps.
        price, times = inverse.sum(axis=0), np.maximum(np.einsum("ij,j->i", inverse, demand), 0)
        if not entered:
            break
    return columns, times


def full_pattern(lengths: np.ndarray, left: np.ndarray, size: int) -> np.ndarray | None:
    """A pattern of exactly ``size`` of the lengths that are ``left``, with the longest of them, if there is one.

    The knapsack's program with lengths for prices: which sums can be reached, as the bits of one number, from long
    lengths to short ones until the sum is among them.
    """
    some = np.flatnonzero(left)
    first = int(some[-1])
    want = size - int(lengths[first])
    column = np.zeros(len(lengths), int)
    column[first] = 1
    reach, mask, steps = 1, (1 << (want + 1)) - 1, []
    for i in some[::-1].tolist():
        x, n = int(lengths[i]), int(left[i]) - (i == first)
        n, take = min(n, want // x), 1
        while n > 0 and not reach >> want & 1:
            take = min(take, n)
            steps.append((i, take, reach))
            reach |= (reach << (x * take)) & mask
            n, take = n - take, 2 * take
        if reach >> want & 1:
            break
    if not reach >> want & 1:
        return None
    for i, take, before in reversed(steps):
        if not before >> want & 1:
            column[i] += take
            want -= take * int(lengths[i])
    return column


@dataclass
class Plan:
    """Where a remainder goes, by its length and its rank among those of that length."""

    size: int
    #: By length: first ranks, first sequence, copies in one sequence and offset of the first, for each pattern.
    places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: By length: the first rank that patterns leave over, and where it stands in what is laid end to end.
    rest: dict[int, tuple[int, int]]
    rest_total: int
    packed: int
    cuts: np.ndarray = field(init=False)

    def __post_init__(self):
        full, m = divmod(self.rest_total, self.size)
        ends = [full * self.size]
        for bit in reversed(range(m.bit_length())):
            if m >> bit & 1:
                ends.append(ends[-1] + (1 << bit))
        self.cuts = np.array(ends)

    @property
    def sequences(self) -> int:
        return self.packed + int(self.cuts[0]) // self.size + len(self.cuts) - 1

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of each piece of the remainder."""
        if length in self.places:
            first, sequence, copies, offset = self.places[length]
            k = int(np.searchsorted(first, rank, "right")) - 1
            if k >= 0 and rank < self.rest.get(length, (1 << 62, 0))[0]:
                nth, slot = divmod(rank - int(first[k]), int(copies[k]))
                return [(length, int(sequence[k]) + nth, int(offset[k]) + slot * length)]
        first_rank, start = self.rest[length]
        at, out = start + (rank - first_rank) * length, []
        while length:
            if at < self.cuts[0]:
                n, offset = divmod(at, self.size)
                room = self.size - offset
            else:
                k = int(np.searchsorted(self.cuts, at, "right"))
                n, offset, room = int(self.cuts[0]) // self.size + k - 1, at - int(self.cuts[k - 1]), int(self.cuts[k]) - at
            take = min(room, length)
            out.append((int(take), self.packed + int(n), int(offset)))
            at, length = at + take, length - take
        return out


def plan(counts: dict[int, int], size: int) -> Plan:
    """From the histogram of remainders (without 0) to every remainder's place."""
    lengths = np.array(sorted(counts), int)
    demand = np.array([counts[x] for x in lengths], int)
    packed, left = 0, demand.copy()
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    used = np.zeros(len(lengths), int)

    def place(column: np.ndarray, n: int) -> None:
        """The next ``n`` sequences go by this pattern."""
        nonlocal packed
        offset = 0
        for i in np.flatnonzero(column):
            found.setdefault(int(lengths[i]), []).append((int(used[i]), packed, int(column[i]), offset))
            used[i] += n * column[i]
            left[i] -= n * column[i]
            offset += int(column[i] * lengths[i])
        packed += n

    if len(lengths):
        columns, times = patterns(lengths, demand.astype(float), size)
        whole = np.floor(times + 1e-7).astype(int)
        full = columns.T @ lengths == size
        for p in np.argsort(-(times - whole), kind="stable"):
            column = columns[:, p].astype(int)
            held = column > 0
            n = int(min(whole[p] + 1, (left[held] // column[held]).min())) if full[p] else 0
            if n > 0:
                place(column, n)
    apart = np.zeros(len(lengths), int)
    while left.any():
        column = full_pattern(lengths, left, size)
        if column is None:
            longest = np.flatnonzero(left)[-1]
            apart[longest], left[longest] = left[longest], 0
        else:
            held = column > 0
            place(column, int((left[held] // column[held]).min()))
    places = {x: tuple(np.array(c) for c in zip(*rows, strict=True)) for x, rows in found.items()}
    rest, at = {}, 0
    for x, n, over in zip(lengths.tolist(), demand.tolist(), apart.tolist(), strict=True):
        if over:
            rest[x] = (n - over, at)
            at += over * x
    return Plan(size, places, rest, at, packed)


def pack(tokens: DataFrame, size: int = 2048) -> DataFrame:
    """Every id of ``tokens``, a written table as ``token_table`` makes it for this ``size``, in one piece.

    Columns: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset.
    """
    scratch = Scratch(tokens.sparkSession)
    # A row for each length that a part of the table has.
    sizes = scratch.keep(tokens.groupBy("part", "r").agg(F.count("*").alias("n"), F.sum("k").alias("k")), "sizes")
    # At most ``size`` rows.
    groups = sorted((r["r"], r["n"], r["k"]) for r in sizes.groupBy("r").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect())
    to = plan({r: n for r, n, _ in groups if r}, size)
    first_whole: dict[int, int] = {}
    at = to.sequences
    for r, _, k in groups:
        first_whole[r] = at
        at += k
    w = Window.partitionBy("r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = scratch.keep(sizes.select("part", "r", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n_before"), F.coalesce(F.sum("k").over(w), F.lit(0)).alias("k_before")), "before")
    few = is_small(before, SMALL)
    placed = tokens.join(F.broadcast(before) if few else before, ["part", "r"]).select("doc_id", "ids", "n", "r", "k", (F.col("nth") + F.col("n_before")).alias("rank"), (F.col("wholes") + F.col("k_before")).alias("wholes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for doc, ids, n, r, k, rank, wholes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = first_whole[r] + wholes
                pieces = [(size, first + j, 0) for j in range(k)] + (to.pieces(r, rank) if r else [])
                start = 0
                for length, sequence, offset in pieces:
                    for c, x in zip(out, (doc, start, length, ids[4 * start : 4 * (start + length)], n, sequence, offset), strict=True):
                        c.append(x)
                    start += length
                held += len(ids)
                if held > 8 << 20:
                    yield as_batch(out, names)
                    out, held = [[] for _ in names], 0
            yield as_batch(out, names)

    def as_batch(out: list[list], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if x == "ids" else pa.int64()) for c, x in zip(out, names, strict=True)], names)

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Tokenises ``docs`` once, into a written table, and packs it."""
    return pack(Scratch(docs.sparkSession).keep(token_table(docs, vocab, size, end_id), "tokens"), size)


def digests(docs: DataFrame, vocab: str) -> DataFrame:
    """The pieces with a checksum for their ids."""
    return pack_documents(docs, vocab).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc32(ids: list[int]) -> int:
    """The checksum of a list of ids, for comparison."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
