"""Quality rules: word and line statistics of whole texts, and an isolation forest over them.

Base rules reject texts of under ten words and texts of which over a fifth are repeated five-word passages.  What they
leave is judged by an isolation forest over all ten statistics: trees of random splits; a row that few splits isolate,
on the mean over all trees, is anomalous.  A split's value is uniform over its statistic's range in the node, and its
statistic is drawn by chance too, in proportion to the ``POWER`` of how well that statistic alone parts the good
labelled rows from the bad ones (1: wholly, 0: not at all), since most statistics of good texts vary more than those of
bad ones.

All labelled rows that pass the base rules take part in all of this, however many there are.  Every other tree is grown
by one half of them, the others by the other half, and each tree by the whole of its half: a node's range and weight are
those of all rows in it.  Bad rows weigh less, ``AMONG`` of the good ones together; weights are scaled to ``SIZE`` rows a
tree, the depth of a forest over samples of that size.  The threshold goes by all labelled rows too, each judged by the
trees that it did not grow.  Rows stay on the executors: the driver draws the splits of all trees, level by level, from
the ranges and weights of their nodes, of which a level has at most 2 * ``SIZE`` a tree.

Defined results: null and empty texts have no words and fail the base rules; texts are read whole; repeated rows are
judged alike; of rows that repeat a labelled id the one with the least statistics is learned from; with fewer than 20
good or two bad labelled rows, or no good one in a half, the forest rejects nothing; an empty table gives no rows.  Only
key and text are read, so other columns can't clash; labels are joined for fitting alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintdex.llm.shared import WORD, Scratch, narrow

#: Symbols of the base statistic.
SYMBOLS = re.compile(r"[#*$%&|<>]")
UPPER, DIGIT, MARK = re.compile(r"[A-Z]"), re.compile(r"[0-9]"), re.compile(r"[!?;:=_~^@/\\{}\[\]()+-]")
FEATURES = ("log_words", "word_length", "symbols", "duplicate_lines", "repeated_words", "upper", "digits", "marks", "line_length", "distinct_words")
#: Weight of a statistic's part in splits, the weight of all bad rows as a share of the good ones, and the rows that a tree stands for.
POWER, AMONG, SIZE = 4, 0.02, 256
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[str], span: int = 5) -> int:
    """How many words lie in a window of ``span`` words that occurs at least twice in the text."""
    if len(words) <= span:
        return 0
    windows = list(zip(*(words[k:] for k in range(span)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    number: dict[tuple, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in windows), np.int64, len(windows))
    twice = np.bincount(ids)[ids] >= 2
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:-span] += twice
    edges[span:] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, lines with a word)."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines)), len(lines)


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base statistics and the forest's features of one text."""
    text = text or ""
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    symbols = len(SYMBOLS.findall(text))
    duplicates, lines = duplicate_lines(text)
    repeats = repeated_words(words)
    letters, count = max(chars, 1), max(n, 1)
    features = [
        float(np.log1p(n)),
        chars / count,
        symbols / letters,
        duplicates / max(lines, 1),
        repeats / count,
        len(UPPER.findall(text)) / letters,
        len(DIGIT.findall(text)) / letters,
        len(MARK.findall(text)) / letters,
        float(np.log1p(chars / max(lines, 1))),
        len(set(words)) / count,
    ]
    return [n, chars, symbols, duplicates, repeats], features


def failed(n_words, n_repeat_words):
    """The base rules, for numbers, arrays or columns."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 in a leaf), split value, children, and the path length that a leaf stands for.

    ``sample`` is the number of rows to which a tree's weight is scaled.
    """

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    sample: int
    threshold: float = np.inf

    def leaves(self, x: np.ndarray, root: int) -> np.ndarray:
        """The node without a split at which each row ends."""
        at = np.full(len(x), root)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = np.where(x[inner, self.feature[node]] < self.split[node], self.left[node], self.right[node])

    def anomaly(self, x: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
        """2 to the power of minus mean path length over its expected value: near 1 for rows that are soon alone."""
        roots = self.roots if roots is None else roots
        total = np.zeros(len(x))
        for root in roots:
            total += self.path[self.leaves(x, root)]
        return 2.0 ** (-total / len(roots) / expected_path(self.sample))


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    return 1.0 if n <= 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def parting(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """How well each column alone parts the kinds: twice the distance of its area under the curve from one half."""
    out = []
    for column in x.T:
        own, odd = np.sort(column[good]), column[~good]
        twice = (np.searchsorted(own, odd, "left") + np.searchsorted(own, odd, "right")).sum()
        out.append(abs(twice / (len(own) * len(odd)) - 1))
    return np.array(out)


@dataclass
class Rows:
    """Labelled rows as arrays: statistics, whether good, and the half (0 or 1) whose trees they grow."""

    x: np.ndarray
    good: np.ndarray
    half: np.ndarray

    def kinds(self) -> np.ndarray:
        """Rows by half and kind, bad ones first."""
        return np.bincount(2 * self.half + self.good, minlength=4).reshape(2, 2)

    def parting(self) -> np.ndarray:
        return parting(self.x, self.good)

    def survey(self, forest: Forest, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each of ``nodes``, which have no split yet: its rows by kind, and the least and greatest of their statistics."""
        place = np.full(len(forest.feature), -1)
        place[nodes] = np.arange(len(nodes))
        counts = np.zeros((len(nodes), 2), np.int64)
        low, high = np.full((len(nodes), self.x.shape[1]), np.inf), np.full((len(nodes), self.x.shape[1]), -np.inf)
        for half in (0, 1):
            x, good = self.x[self.half == half], self.good[self.half == half]
            for root in forest.roots[half::2]:
                at = place[forest.leaves(x, root)]
                order = np.argsort(at, kind="stable")
                order = order[np.searchsorted(at[order], 0) :]
                if not len(order):
                    continue
                found, start = np.unique(at[order], return_index=True)
                rows = x[order]
                low[found], high[found] = np.minimum.reduceat(rows, start), np.maximum.reduceat(rows, start)
                fine = np.add.reduceat(good[order].astype(np.int64), start)
                counts[found] = np.stack([np.diff(np.append(start, len(order))) - fine, fine], axis=1)
        return counts, low, high

    def scores(self, forest: Forest) -> np.ndarray:
        """The anomaly of each row by the trees that it did not grow."""
        out = np.zeros(len(self.x))
        for half in (0, 1):
            mine = self.half == half
            out[mine] = forest.anomaly(self.x[mine], forest.roots[1 - half :: 2])
        return out

    def edge(self, forest: Forest, spared: int) -> tuple[float, float | None]:
        """The score that only ``spared`` good rows may exceed, and the least of a bad row over it, if any."""
        score = self.scores(forest)
        floor = np.sort(score[self.good])[-1 - spared]
        over = score[~self.good & (score > floor)]
        return float(floor), float(over.min()) if len(over) else None


@dataclass
class Table:
    """Labelled rows as a DataFrame of features, good and half; gives what ``Rows`` gives, without gathering rows."""

    rows: DataFrame

    @staticmethod
    def of(batch: pa.RecordBatch) -> Rows:
        x = batch.column(0).flatten().to_numpy().reshape(-1, len(FEATURES))
        return Rows(x, batch.column(1).to_numpy(zero_copy_only=False).astype(bool), batch.column(2).to_numpy().astype(np.int64))

    def kinds(self) -> np.ndarray:
        out = np.zeros((2, 2), np.int64)
        for r in self.rows.groupBy("half", "good").count().collect():
            out[r["half"], int(r["good"])] = r["count"]
        return out

    def parting(self) -> np.ndarray:
        """From sorted values: each batch tells its rows and what its good ones stand below, the driver adds what lies before it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                feature, value, fine, odd = (c.to_numpy() for c in batch.columns)
                for f in np.unique(feature):
                    own = feature == f
                    g, b = fine[own], odd[own]
                    twice = int((b * (2 * (np.cumsum(g) - g) + g)).sum())
                    yield pa.RecordBatch.from_pydict({"feature": [int(f)], "first": [value[own][0]], "fine": [int(g.sum())], "odd": [int(b.sum())], "twice": [twice]})

        fine, odd = F.sum(F.col("good").cast("long")).alias("fine"), F.sum((~F.col("good")).cast("long")).alias("odd")
        values = self.rows.select("good", F.posexplode("features").alias("feature", "value")).groupBy("feature", "value").agg(fine, odd)
        parts = values.orderBy("feature", "value").mapInArrow(run, "feature long, first double, fine long, odd long, twice long")
        total = [[0, 0, 0] for _ in FEATURES]
        for r in sorted(parts.collect()):
            one = total[r["feature"]]
            one[2] += r["twice"] + 2 * one[0] * r["odd"]
            one[0] += r["fine"]
            one[1] += r["odd"]
        return np.array([abs(twice / (g * b) - 1) for g, b, twice in total])

    def survey(self, forest: Forest, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = len(FEATURES)
        names = [f"{kind}{k}" for kind in ("low", "high") for k in range(width)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, low, high = np.zeros((len(nodes), 2), np.int64), np.full((len(nodes), width), np.inf), np.full((len(nodes), width), -np.inf)
            for batch in batches:
                c, a, b = Table.of(batch).survey(forest, nodes)
                counts += c
                np.minimum(low, a, out=low)
                np.maximum(high, b, out=high)
            seen = np.flatnonzero(counts.any(axis=1))
            columns = [seen, *counts[seen].T, *low[seen].T, *high[seen].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["place", "odd", "fine", *names])

        parts = self.rows.mapInArrow(run, "place long, odd long, fine long, " + ", ".join(f"{n} double" for n in names))
        ends = [(F.min if n.startswith("low") else F.max)(n).alias(n) for n in names]
        found = parts.groupBy("place").agg(F.sum("odd").alias("odd"), F.sum("fine").alias("fine"), *ends).toArrow()
        place, odd, fine, *rest = (c.to_numpy() for c in found.columns)
        order = np.argsort(place)
        ranges = np.stack(rest, axis=1)[order]
        return np.stack([odd, fine], axis=1)[order], ranges[:, :width], ranges[:, width:]

    def edge(self, forest: Forest, spared: int) -> tuple[float, float | None]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(Table.of(batch).scores(forest)), batch.column(1)], ["score", "good"])

        scored = self.rows.mapInArrow(run, "score double, good boolean")
        floor = scored.where("good").select("score").orderBy(F.desc("score")).limit(spared + 1).agg(F.min("score")).first()[0]
        return floor, scored.where(~F.col("good") & (F.col("score") > F.lit(floor))).agg(F.min("score")).first()[0]


def grow(known: Rows | Table, weight: np.ndarray, kinds: np.ndarray, trees: int = 100, seed: int = 7) -> Forest:
    """Random splits of all rows, to the depth at which a row counts as ordinary; columns drawn by ``weight``.

    A node's size is its share of its tree's weight, in rows of a tree of ``SIZE``; it is split while that is over one.
    """
    rng = np.random.default_rng(seed)
    among = np.minimum(1.0, np.maximum(2, AMONG * kinds[:, 1]) / np.maximum(kinds[:, 0], 1))
    total = kinds[:, 1] + among * kinds[:, 0]
    sample = min(SIZE, int(total.min()))
    limit = int(np.ceil(np.log2(max(sample, 2)))) + 4
    nodes: list[list] = [[-1, 0.0, 0, 0, 0.0] for _ in range(trees)]

    def forest() -> Forest:
        f, s, a, b, p = zip(*nodes, strict=True)
        return Forest(np.array(f), np.array(s), np.array(a), np.array(b), np.array(p), np.arange(trees), sample)

    level, half, depth = np.arange(trees), np.arange(trees) % 2, 0
    while len(level):
        counts, low, high = known.survey(forest(), level)
        rows = np.rint(sample * (counts[:, 1] + among[half] * counts[:, 0]) / total[half]).astype(int)
        after, half_of = [], []
        for k, me in enumerate(level):
            open_ = np.flatnonzero(high[k] > low[k])
            if depth == limit or rows[k] < 2 or not len(open_):
                nodes[me][4] = depth + (expected_path(rows[k]) if rows[k] > 1 else 0.0)
                continue
            f = int(rng.choice(open_, p=weight[open_] / weight[open_].sum()))
            s = float(rng.uniform(low[k, f], high[k, f]))
            # Neither side is empty: the least value lies under the split, the greatest doesn't.
            nodes[me][:4] = [f, s if s > low[k, f] else float(high[k, f]), len(nodes), len(nodes) + 1]
            after += [len(nodes), len(nodes) + 1]
            nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
            half_of.extend([half[k]] * 2)
        level, half, depth = np.array(after, int), np.array(half_of, int), depth + 1
    return forest()


def learn(known: Rows | Table, spare: float = 0.002) -> Forest | None:
    """A forest that all of ``known`` grew and calibrated; None with too few rows of a kind.

    The threshold: of all cuts that reject at most ``spare`` of the good rows, the one that best parts the kinds.  Between
    the last good row that stays and the first bad one that goes, the cut lies halfway.
    """
    kinds = known.kinds()
    odd, fine = kinds.sum(axis=0)
    if fine < 20 or odd < 2 or not kinds[:, 1].all():
        return None
    forest = grow(known, known.parting() ** POWER + 1e-6, kinds)
    floor, over = known.edge(forest, int(spare * fine))
    forest.threshold = np.inf if over is None else (floor + over) / 2
    return forest


def choose(x: np.ndarray, good: np.ndarray, half: np.ndarray | None = None) -> Forest | None:
    """The forest of labelled rows that are given as arrays; they belong to either half by turns unless ``half`` tells."""
    return learn(Rows(x, good, np.arange(len(x)) % 2 if half is None else half))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """features, good and half of every labelled id of measured ``rows`` that passes the base rules, one row an id."""
    known = narrow(labels, doc_id="long", quality="int").where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    fine = rows.where(~failed(F.col("n_words"), F.col("n_repeat_words"))).select("doc_id", "features").join(known, "doc_id")
    one = fine.groupBy("doc_id").agg(F.min("features").alias("features"), F.min("quality").alias("quality"))
    return one.select("features", (F.col("quality") == 1).alias("good"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"))


def fit(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """A forest fitted and calibrated on all labelled rows; texts are measured where they lie, only statistics are joined."""
    return fit_measured(measure(docs), labels)


def fit_measured(rows: DataFrame, labels: DataFrame) -> Forest | None:
    """``fit`` for rows that ``measure`` gave."""
    scratch = Scratch(rows.sparkSession)
    try:
        return learn(Table(scratch.keep(labelled(rows, labels), "labelled")))
    finally:
        scratch.drop("labelled")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics and the forest's features of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x) for x in batch.column(1).to_pylist()]
            base = np.array([b for b, _ in found], np.int64).reshape(-1, len(STATS))
            features = pa.array([f for _, f in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(base[:, k]) for k in range(len(STATS))), features], ["doc_id", *STATS, "features"])

    return narrow(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, " + ", ".join(f"{s} long" for s in STATS) + ", features array<double>")


def judge_measured(rows: DataFrame, forest: Forest | None) -> DataFrame:
    """``judge`` for rows that ``measure`` gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(STATS) + 1).flatten().to_numpy().reshape(-1, len(FEATURES))
            score = forest.anomaly(x) if forest and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], ["doc_id", *STATS, "anomaly"])

    scored = rows.select("doc_id", *STATS, "features").mapInArrow(run, "doc_id long, " + ", ".join(f"{s} long" for s in STATS) + ", anomaly double")
    base = failed(F.col("n_words"), F.col("n_repeat_words"))
    return scored.select(
        "doc_id", *STATS, base.alias("base_failed"), (~base & (F.col("anomaly") <= F.lit(float(forest.threshold) if forest else float("inf")))).alias("kept"), "anomaly"
    )


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """Statistics, base_failed and kept of every row."""
    return judge_measured(measure(docs), forest)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``judge`` by a forest of the same rows; texts are measured once, and their statistics written."""
    rows = Scratch(docs.sparkSession).keep(measure(docs), "measured")
    return judge_measured(rows, fit_measured(rows, labels))


def keep_good(docs: DataFrame, labels: DataFrame, fitted: Forest | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns only.  Rows are judged where they are, without a join."""
    forest = fitted or fit(docs, labels)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x) for x in batch.column(at).to_pylist()]
            base = np.array([b for b, _ in found], np.int64).reshape(-1, len(STATS))
            stay = ~failed(base[:, 0], base[:, 4])
            if forest and len(found):
                stay &= forest.anomaly(np.array([f for _, f in found])) <= forest.threshold
            yield batch.filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)
