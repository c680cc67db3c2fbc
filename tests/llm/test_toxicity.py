import numpy as np
import pytest
from pyspark.sql import functions as F

from glintdex.llm import toxicity

RNG = np.random.default_rng(8)
PLAIN = ["bel", "tor", "min", "sha", "qui", "ven", "lor", "pas", "dum", "rek"]
BAD = ["vile", "scum", "rotten", "foul"]


def text(toxic, n):
    words = ["".join(RNG.choice(PLAIN, 2)) for _ in range(n)]
    for _ in range(3 * toxic):
        words[RNG.integers(n)] = str(RNG.choice(BAD))
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    return [(i, text(i % 4 == 0, int(RNG.integers(20, 200))), int(i % 4 == 0)) for i in range(600)]


@pytest.fixture(scope="module")
def net(rows):
    return toxicity.train([t for _, t, _ in rows[:450]], np.array([x == 1 for *_, x in rows[:450]]), epochs=5)


def test_gradients():
    net = toxicity.Net({"a": 1, "b": 2})
    own, g = net.features(["a", "b", "cc", "dddd"])
    index = np.array([[0, 1, 2, 3], [3, 2, -1, -1]])
    y = np.array([1.0, 0.0], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        sent, _ = net.inputs(own, g)
        s = net.forward(sent.astype(np.float64), index)
        return float((np.log1p(np.exp(-np.abs(s))) + np.maximum(s, 0) - s * y).sum())

    sent, x = net.inputs(own, g)
    s, kept = net.forward(sent, index, keep=True)
    grads, dsent = net.backward(kept, index, toxicity._sigmoid(s) - y, len(own))
    grads["win"], grads["bin"] = x.T @ dsent, dsent.sum(axis=0)
    for name, grad in grads.items():
        at = tuple(RNG.integers(d) for d in net.p[name].shape)
        base, step = net.p[name][at], 1e-3
        net.p[name][at] = base + step
        up = loss()
        net.p[name][at] = base - step
        down = loss()
        net.p[name][at] = base
        assert np.asarray(grad)[at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3)


def test_windows_cover_and_overlap():
    for n in (0, 1, 32, 33, 48, 49, 1000):
        starts = toxicity.windows(n)
        assert starts[0] == 0
        assert starts[-1] == max(0, n - toxicity.WINDOW)
        assert (np.diff(starts) <= toxicity.STEP).all()


def test_held_out_accuracy(rows, net):
    scorer = toxicity.Scorer(toxicity.Net.load(net.dump()))
    got = scorer.score([t for _, t, _ in rows[450:]]) >= 0.5
    want = np.array([x == 1 for *_, x in rows[450:]])
    assert (got == want).mean() > 0.93
    blank = scorer.score([None, "", "123"])
    assert len(set(blank.tolist())) == 1
    assert blank.tolist() == [0, 0, 0]
    # One toxic passage anywhere in a very long text.
    clean = text(False, 20_000)
    found = scorer.score([clean + " scum vile rotten scum", clean])
    assert found[0] > 0.5 and found[0] > found[1]


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("toxic", F.lit("clash"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.verdicts(docs, labels.where("false")).collect()
    assert len(rows) == docs.count()
    assert {(r["score"], r["predicted"]) for r in rows} == {(0.0, 0)}
    assert toxicity.keep_clean(docs, labels.where("false")).count() == docs.count()
    assert toxicity.score(docs.where("false"), b"").count() == 0


def test_held_out_rows_are_not_learned_from(spark, rows):
    import zlib

    docs = spark.createDataFrame(rows[:300], "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    found = toxicity.verdicts(docs, labels).collect()
    right = {i: x for i, _, x in rows}
    assert {r["doc_id"] for r in found if r["held_out"]} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    # Wrong labels of held-out rows did no harm.
    assert np.mean([r["predicted"] == right[r["doc_id"]] for r in found if r["held_out"]]) > 0.85


def plain_score(net, text):
    """A whole text's score by itself: window by window, word by word, both directions one after the other."""
    words = toxicity.words_of(text)
    if not words:
        return 0.0
    p, size, h = net.p, toxicity.WINDOW, toxicity.H
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def sent(word):
        g = toxicity.grams(word)
        chars = sum(p["gram"][k].astype(float) for k in g) / np.sqrt(len(g))
        own = p["own"][net.words[word]] if word in net.words else np.zeros(toxicity.D)
        return np.concatenate([own, chars]) @ p["win"] + p["bin"]

    def run(xs, way):
        state, out = np.zeros(h), []
        for x in xs:
            x = x[3 * h * way : 3 * h * (way + 1)]
            gates = sigmoid(x[: 2 * h] + state @ p["rec"][way])
            new = np.tanh(x[2 * h :] + gates[:h] * (state @ p["new"][way]))
            state = state + (1 - gates[h:]) * (new - state)
            out.append(state)
        return out

    best = -np.inf
    for start in toxicity.windows(len(words)):
        xs = [sent(w) for w in words[start : start + size]]
        states = np.array([np.concatenate(s) for s in zip(run(xs, 0), run(xs[::-1], 1)[::-1], strict=True)])
        e = np.exp(states @ p["att"] - (states @ p["att"]).max())
        best = max(best, float((e / e.sum()) @ states @ p["out"] + p["bias"][0]))
    return sigmoid(net.curve[0] * best + net.curve[1])


def test_whole_texts_window_by_window(net):
    long = "x" * 45
    texts = [text(k % 2 == 0, n) for k, n in enumerate((1, 5, 31, 32, 33, 64, 100))] + [long, "scum" * 20, f"bel {long} tor", "中" * 60, None, "", "12 _"]
    got = toxicity.Scorer(net).score(texts)
    assert got == pytest.approx([plain_score(net, t) for t in texts], abs=2e-4)


def test_no_letter_is_left_out():
    for n in (1, 16, 17, 18, 29, 30, 45, 200):
        word = "".join(chr(0x4E00 + k) for k in range(n))
        pieces = toxicity.words_of(word)
        assert set("".join(pieces)) == set(word)
        assert all(a[-5:] == b[:5] for a, b in zip(pieces, pieces[1:], strict=False))
        assert all(len(toxicity.grams(p)) <= toxicity.GRAM_LIMIT for p in pieces)
    changed = [toxicity.words_of("a" * k + "b" + "a" * (44 - k)) for k in range(45)]
    inputs = [tuple(g for p in pieces for g in toxicity.grams(p)) for pieces in changed]
    assert len(set(inputs)) == 45


def test_odd_rows_with_a_real_model(spark, net):
    rows = [(1, None, 0), (2, "", 0), (3, "4 5 6", 0), (4, "bel " * 100_000 + "scum vile foul rotten", 0), (4, "bel tor", 0), (4, "bel tor", 0), (None, "scum vile foul", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model = net.dump()
    by = lambda r: (str(r[0]), r[1])
    got = sorted(((r["doc_id"], r["score"]) for r in toxicity.score(docs, model).collect()), key=by)
    want = toxicity.Scorer(net).score([t for _, t, _ in rows])
    want = sorted(((i, float(s)) for (i, _, _), s in zip(rows, want, strict=True)), key=by)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-5)
    assert [s for i, s in got if i in (1, 2, 3)] == [0, 0, 0]
    assert max(s for i, s in got if i == 4) > 0.5
    assert toxicity.score(docs.where("false"), model).count() == 0
