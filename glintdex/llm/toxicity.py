"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own embedding, if the fitting sample had it often enough, beside a sum over its character
n-grams, so that words never seen are read by their characters.  Two gated recurrent units run over a window of words,
one each way; attention weights pool their states, and a linear layer scores the window.  All windows of a text,
each overlapping the next by half, are scored, and the highest is the text's; a logistic curve fitted on labelled rows
that did not train the network maps it to 0..1.

Training is by the window: of a text only its most suspicious window is learned from (first by the log-odds of words
and n-grams, then by the network itself), for toxic and clean texts alike.  It takes a bounded sample of labelled rows
(``MOST`` of each kind, those with the least hash of their id) and runs in one task.

Defined results: null and empty texts and texts without letters score 0; texts are read whole, and long runs of letters
in overlapping pieces, so no letter is left out; repeated rows score alike; of labelled rows that repeat an id the least
text is learned from, and toxic if any label says so; with fewer than ten labelled rows of a kind every score is 0; only
id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import io
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintdex.llm.shared import kept_by_worker, narrow, slices

WORDS = re.compile(r"[^\W\d_]+")
#: Labelled rows of each kind that fit the network, at most.
MOST = 1500
WINDOW, STEP = 32, 16
D, H = 8, 8
#: A run of letters longer than ``PIECE`` is read as pieces, each ``STRIDE`` letters on; no piece has more n-grams than the limit.
PIECE, STRIDE = 17, 12
GRAMS, GRAM_LIMIT = 1 << 15, 24
BATCH = 4096


def words_of(text: str | None) -> list[str]:
    """A whole text's words, in lower case; long runs of letters, as of scripts without blanks, in overlapping pieces."""
    found = WORDS.findall(text.lower()) if text else []
    if found and max(map(len, found)) > PIECE:
        return [w[k : k + PIECE] for w in found for k in range(0, max(1, len(w) - (PIECE - STRIDE)), STRIDE)]
    return found


def grams(word: str) -> list[int]:
    """Hashes of a piece's prefixes, suffixes and trigrams; 0 is kept for none."""
    w = f"^{word}$"
    found = [w[:k] for k in range(3, min(9, len(w)))] + [w[-k:] for k in range(3, min(6, len(w)))] + [w[k : k + 3] + "_" for k in range(1, len(w) - 3)]
    return [1 + zlib.crc32(g.encode()) % (GRAMS - 1) for g in found]


def windows(n: int) -> np.ndarray:
    """Starts of all windows over ``n`` words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.unique(np.append(np.arange(0, n - WINDOW + 1, STEP), n - WINDOW))


def gather(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows over texts given as arrays of word rows: (window, word) with -1 for none, and each window's text."""
    out, owner = [], []
    for i, own in enumerate(rows):
        starts = windows(len(own))
        if len(own) < WINDOW:
            own = np.append(own, np.full(WINDOW - len(own), -1, own.dtype))
        out.append(np.lib.stride_tricks.sliding_window_view(own, WINDOW)[starts])
        owner.append(np.full(len(starts), i))
    return np.concatenate(out), np.concatenate(owner)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Net:
    """Parameters by name.  Axis 0 of the recurrent ones is the direction."""

    def __init__(self, words: dict[str, int], seed: int = 11):
        rng = np.random.default_rng(seed)
        r = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
        self.words = words
        self.p = {
            "own": r(len(words) + 1, D, scale=0.1),
            "gram": r(GRAMS, D, scale=0.1),
            "win": r(2 * D, 2 * 3 * H),
            "bin": np.zeros(2 * 3 * H, np.float32),
            "rec": r(2, H, 2 * H),
            "new": r(2, H, H),
            "att": r(2 * H),
            "out": r(2 * H),
            "bias": np.zeros(1, np.float32),
        }
        self.curve = (1.0, 0.0)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row in the table of words (0: none) and padded n-gram hashes of each word."""
        own = np.array([self.words.get(w, 0) for w in words], np.int64)
        g = np.zeros((len(words), GRAM_LIMIT), np.int64)
        for i, w in enumerate(words):
            found = grams(w)
            g[i, : len(found)] = found
        return own, g

    def inputs(self, own: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What words send to the gates, and the input itself."""
        held = (g > 0).astype(np.float32)
        norm = 1 / np.sqrt(np.maximum(held.sum(axis=1), 1))
        c = np.empty((len(own), D), np.float32)
        for at in range(0, len(own), 4096):
            s = slice(at, at + 4096)
            c[s] = np.einsum("wgd,wg->wd", self.p["gram"][g[s]], held[s]) * norm[s, None]
        x = np.concatenate([self.p["own"][own] * (own > 0)[:, None], c], axis=1)
        return x @ self.p["win"] + self.p["bin"], x

    def forward(self, sent: np.ndarray, index: np.ndarray, keep: bool = False):
        """Window scores.  ``sent``: a row of gate inputs for each word; ``index``: (window, word), -1 for none."""
        n, t = index.shape
        mask = (index >= 0).astype(np.float32)
        whole = not keep and bool(mask.all())
        at_word = np.ascontiguousarray(np.maximum(index, 0).T)
        ways = np.ascontiguousarray(sent[:, : 3 * H]), np.ascontiguousarray(sent[:, 3 * H :])
        states = np.zeros((t, n, 2 * H), np.float32)
        h = np.zeros((2, n, H), np.float32)
        x = np.empty((2, n, 3 * H), np.float32)
        tape = []
        for k in range(t):
            at = (k, t - 1 - k)
            np.take(ways[0], at_word[at[0]], axis=0, out=x[0])
            np.take(ways[1], at_word[at[1]], axis=0, out=x[1])
            gates = np.matmul(h, self.p["rec"])
            gates += x[..., : 2 * H]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            reset, update = gates[..., :H], gates[..., H:]
            inner = np.matmul(h, self.p["new"])
            new = reset * inner
            new += x[..., 2 * H :]
            np.tanh(new, out=new)
            if whole:
                after = (1 - update) * (new - h)
            else:
                m = np.stack([mask[:, at[0]], mask[:, at[1]]])[..., None]
                after = m * (1 - update) * (new - h)
            after += h
            if keep:
                tape.append((h, m, reset, update, inner, new))
            h = after
            states[at[0], :, :H], states[at[1], :, H:] = h[0], h[1]
        s = states
        e = s @ self.p["att"] + (mask.T - 1) * 1e4
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, s)
        score = pooled @ self.p["out"] + self.p["bias"][0]
        return (score, (tape, s, w, pooled)) if keep else score

    def backward(self, kept, index: np.ndarray, dscore: np.ndarray, rows: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters above the inputs, and of what each word sent."""
        tape, s, w, pooled = kept
        n, t = index.shape
        g = {"out": dscore @ pooled, "bias": dscore.sum(keepdims=True)}
        dpooled = dscore[:, None] * self.p["out"]
        dw = np.einsum("nh,tnh->tn", dpooled, s)
        de = w * (dw - (w * dw).sum(axis=0))
        ds = w[..., None] * dpooled + de[..., None] * self.p["att"]
        g["att"] = np.einsum("tn,tnh->h", de, s)
        g["rec"], g["new"] = np.zeros_like(self.p["rec"]), np.zeros_like(self.p["new"])
        dsent = np.zeros((n, t, 2, 3 * H), np.float32)
        dh = np.zeros((2, n, H), np.float32)
        for k in reversed(range(t)):
            h, m, reset, update, inner, new = tape[k]
            at = (k, t - 1 - k)
            dh = dh + np.stack([ds[at[0], :, :H], ds[at[1], :, H:]])
            dnew = dh * m * (1 - update)
            dupdate = -dh * m * (new - h)
            back = dh * (1 - m * (1 - update))
            dn = dnew * (1 - new * new)
            dreset = dn * inner * reset * (1 - reset)
            du = dupdate * update * (1 - update)
            drz = np.concatenate([dreset, du], axis=-1)
            dinner = dn * reset
            g["rec"] += np.matmul(h.transpose(0, 2, 1), drz)
            g["new"] += np.matmul(h.transpose(0, 2, 1), dinner)
            dh = back + np.matmul(drz, self.p["rec"].transpose(0, 2, 1)) + np.matmul(dinner, self.p["new"].transpose(0, 2, 1))
            dx = np.concatenate([drz, dn], axis=-1)
            dsent[:, at[0], 0], dsent[:, at[1], 1] = dx[0], dx[1]
        total = np.zeros((rows, 2 * 3 * H), np.float32)
        ok = index >= 0
        np.add.at(total, index[ok], dsent.reshape(n, t, -1)[ok])
        return g, total

    def dump(self) -> bytes:
        names = sorted(self.words, key=self.words.__getitem__)
        np.savez_compressed(out := io.BytesIO(), words=np.array(names, object).astype("U"), curve=np.array(self.curve), **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Net:
        with np.load(io.BytesIO(raw)) as f:
            net = cls.__new__(cls)
            net.words = {w: i + 1 for i, w in enumerate(f["words"].tolist())}
            net.curve = tuple(f["curve"].tolist())
            net.p = {k: f[k] for k in f.files if k not in ("words", "curve")}
        return net


def _odds(texts: list[list[str]], toxic: np.ndarray, least: int = 4) -> tuple[dict[str, float], dict[int, float]]:
    """Log-odds of words and n-grams by the texts of either kind that have them."""
    counts: tuple[tuple[Counter, Counter], ...] = ((Counter(), Counter()), (Counter(), Counter()))
    for words, t in zip(texts, toxic, strict=True):
        once = set(words)
        counts[int(t)][0].update(once)
        counts[int(t)][1].update({g for w in once for g in grams(w)})
    n = np.bincount(toxic.astype(int), minlength=2) + 1
    out = []
    for kind in (0, 1):
        a, b = counts[1][kind], counts[0][kind]
        out.append({w: float(np.log((a[w] + 0.5) / n[1]) - np.log((b[w] + 0.5) / n[0])) for w in {*a, *b} if a[w] + b[w] >= least})
    return out[0], out[1]


def train(texts: list[str], toxic: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Net:
    """Fits on four fifths of the rows; the rest sets the curve."""
    rng = np.random.default_rng(seed)
    cut = [words_of(x) for x in texts]
    fit = np.arange(len(cut)) % 5 != 0
    word_odds, gram_odds = _odds([w for w, ok in zip(cut, fit, strict=True) if ok], toxic[fit])
    net = Net({w: i + 1 for i, w in enumerate(sorted(word_odds))})
    names = sorted({w for words in cut for w in words})
    row = {w: i for i, w in enumerate(names)}
    own, g = net.features(names)
    index, owner = gather([np.array([row[w] for w in words], np.int64) for words in cut])
    suspicion = np.array([max([word_odds.get(w, 0.0), *(gram_odds.get(x, 0.0) for x in grams(w))]) for w in names] + [0.0])
    first = np.maximum(suspicion[index], 0).sum(axis=1)
    for name, odds, table in (("own", word_odds, net.words), ("gram", gram_odds, None)):
        for w, v in odds.items():
            net.p[name][table[w] if table else w, 0] = 0.3 * v
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    steps = 0
    score = first
    for epoch in range(epochs):
        if epoch >= 2:
            score = _score_windows(net, own, g, index)
        best = _best(score, owner, len(cut))
        # Toxic texts as often as clean ones; of clean texts also a window by chance.
        pos, neg = best[fit & toxic], best[fit & ~toxic]
        some = rng.choice(np.flatnonzero(~toxic[owner] & fit[owner]), min(len(neg), int((~toxic[owner] & fit[owner]).sum())), replace=False)
        neg = np.concatenate([neg, some[: len(neg) // 2]])
        pos = np.tile(pos, max(1, round(len(neg) / max(1, len(pos)))))
        order = rng.permutation(np.concatenate([pos, neg]))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            used, local = np.unique(np.append(index[pick], -1), return_inverse=True)
            local = local[:-1].reshape(len(pick), -1) - 1
            used = used[1:]
            if not len(used):
                continue
            sent, x = net.inputs(own[used], g[used])
            s, kept = net.forward(sent, local, keep=True)
            target = toxic[owner[pick]].astype(np.float32) * 0.96 + 0.02
            grads, dsent = net.backward(kept, local, (_sigmoid(s) - target).astype(np.float32) / len(pick), len(used))
            grads["win"], grads["bin"] = x.T @ dsent, dsent.sum(axis=0)
            dx = dsent @ net.p["win"].T
            grads["own"] = np.zeros_like(net.p["own"])
            np.add.at(grads["own"], own[used], dx[:, :D] * (own[used] > 0)[:, None])
            held = g[used] > 0
            dc = dx[:, None, D:] / np.sqrt(np.maximum(held.sum(axis=1), 1))[:, None, None]
            grads["gram"] = np.zeros_like(net.p["gram"])
            np.add.at(grads["gram"], g[used][held], np.broadcast_to(dc, (*held.shape, D))[held])
            steps += 1
            for k, d in grads.items():
                m, v = moment[k]
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                net.p[k] -= (rate * (0.5 ** (epoch / 3)) * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)
    top = np.full(len(cut), -np.inf)
    np.maximum.at(top, owner, _score_windows(net, own, g, index))
    net.curve = _curve(top[~fit], toxic[~fit])
    return net


def _best(score: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The highest window of each text."""
    order = np.lexsort((-score, owner))
    out = np.zeros(n, np.int64)
    out[owner[order][::-1]] = order[::-1]
    return out


def _score_windows(net: Net, own: np.ndarray, g: np.ndarray, index: np.ndarray) -> np.ndarray:
    sent = net.inputs(own, g)[0]
    return np.concatenate([net.forward(sent, index[at : at + BATCH]) for at in range(0, len(index), BATCH)])


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by gradient steps; clean rows weigh four times as much as toxic ones."""
    if not y.any() or y.all():
        return 1.0, 0.0
    mean, scale = x.mean(), x.std() + 1e-6
    z, a, b = (x - mean) / scale, 1.0, 0.0
    weight = np.where(y, 0.2 / y.sum(), 0.8 / (~y).sum())
    for _ in range(3000):
        d = (_sigmoid(a * z + b) - y) * weight
        a -= 1.0 * ((d * z).sum() + 1e-3 * a)
        b -= 1.0 * d.sum()
    a = max(a, 1e-3)
    return float(a / scale), float(b - a * mean / scale)


class Scorer:
    """Scores texts; remembers what each word sends to the gates, for a bounded number of words."""

    def __init__(self, net: Net, most: int = 150_000):
        self.net, self.most = net, most
        self._reset()

    def _reset(self) -> None:
        self.row: dict[str, int] = {}
        self.sent = np.zeros((0, 2 * 3 * H), np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.row) > self.most:
            self._reset()
        cut = [words_of(x) for x in texts]
        new = list(set().union(*cut).difference(self.row)) if cut else []
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.sent = np.concatenate([self.sent, self.net.inputs(*self.net.features(new))[0]])
        if not len(self.sent):
            self.sent = np.zeros((1, 2 * 3 * H), np.float32)
        get = self.row.__getitem__
        index, owner = gather([np.fromiter(map(get, w), np.int32, len(w)) for w in cut])
        score = np.concatenate([self.net.forward(self.sent, index[at : at + BATCH]) for at in range(0, len(index), BATCH)])
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, score)
        top[[not w for w in cut]] = -np.inf
        return _sigmoid(self.net.curve[0] * top + self.net.curve[1])


def scorer(model: bytes) -> Scorer:
    """One for each worker process and model."""
    return kept_by_worker(("scorer", model), lambda: Scorer(Net.load(model)))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> bytes:
    """The fitted network; empty where labels lack a kind.  Rows whose crc32(id) mod 5 is 0 are held out."""
    known = narrow(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    taken = known.where("toxic = 1").orderBy(*order).limit(most).union(known.where("toxic = 0").orderBy(*order).limit(most))
    rows = narrow(docs, doc_id="long", text="string").join(F.broadcast(taken), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted({r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True) if r[2]})
        toxic = np.array([t == 1 for _, t, _ in found], bool)
        # By a hash of the id, so that neither kind nor place decides who fits and who calibrates.
        order = np.argsort([zlib.crc32(f"order {i}".encode()) for i, *_ in found], kind="stable")
        model = train([found[i][2] for i in order], toxic[order]).dump() if 10 <= toxic.sum() <= len(toxic) - 10 else b""
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    made = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(made[0]["model"]) if made else b""


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 500):
                s = scorer(model).score(part.column(1).to_pylist()) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.astype(np.float64))], ["doc_id", "score"])

    return narrow(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with their own columns only."""
    model = fit(docs, labels)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at_text, 500):
                stay = scorer(model).score(part.column(at_text).to_pylist()) < threshold if model else np.ones(part.num_rows, bool)
                yield part.filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
