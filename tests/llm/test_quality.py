import re

import numpy as np
import pytest

from glintdex.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spans = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, s in enumerate(spans) if spans.count(s) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]


@pytest.mark.parametrize("text", ["", "a b c d e", "a b c d e f a b c d e", "x " * 30, "a\nb\na\n\n \n\na", "###\x0b$$ |", "é\u2003ü", "a b c d e " * 3 + "z"])
def test_statistics_against_plain(text):
    assert quality.statistics(text)[0] == plain(text)


def test_forest_finds_what_is_apart():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (600, len(quality.FEATURES)))
    x[::13, :3] += 9
    good = np.arange(600) % 13 != 0
    forest = quality.choose(x, good)
    odd = forest.anomaly(x) > forest.threshold
    assert odd[~good].mean() > 0.9
    assert odd[good].mean() < 0.01
    assert quality.choose(x, np.ones(600, bool)) is None


def path_length(forest, node, row):
    """A row's path by itself: splits on the way, and what its leaf stands for."""
    while forest.feature[node] >= 0:
        node = forest.left[node] if row[forest.feature[node]] < forest.split[node] else forest.right[node]
    return forest.path[node]


def depths(forest, node, depth=0):
    """(leaf, depth) of every leaf under a node."""
    if forest.feature[node] < 0:
        return [(node, depth)]
    return depths(forest, forest.left[node], depth + 1) + depths(forest, forest.right[node], depth + 1)


def test_anomaly_and_threshold_row_by_row():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, len(quality.FEATURES)))
    x[::10, 2] += 7
    good = np.arange(300) % 10 != 0
    forest = quality.choose(x, good)
    scores = forest.anomaly(x)
    for row, score in zip(x, scores, strict=True):
        mean = np.mean([path_length(forest, root, row) for root in forest.roots])
        assert score == pytest.approx(2 ** (-mean / quality.expected_path(forest.sample)))
    for root in forest.roots[:5]:
        for leaf, depth in depths(forest, root):
            extra = forest.path[leaf] - depth
            assert extra == 0 or any(extra == pytest.approx(quality.expected_path(n)) for n in range(2, 257))
    # Of the calibrating rows, at most one in 500 good ones is over the threshold, and no lower one would spare them.
    judged = np.arange(300) % 2 == 1
    assert (scores[judged & good] > forest.threshold).sum() <= 0.002 * (judged & good).sum()
    assert set(forest.feature[forest.feature >= 0]) > {2}  # all statistics take part


def test_parting():
    x = np.array([[0, 5], [1, 5], [2, 5], [3, 5]], float)
    assert quality.parting(x, np.array([True, True, False, False])).tolist() == [1.0, 0.0]


def test_clashing_columns_ties_and_repeated_labels(spark, sf):
    """Names that the results use, repeated ids with several texts and repeated labels don't change how rows are judged."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    odd = docs.withColumns({"n_words": F.lit("x"), "features": F.lit(1), "anomaly": F.lit(None).cast("int"), "known_id": F.lit(0)})
    forest = quality.fit(docs, labels)
    same = quality.fit(odd.unionByName(odd), labels.union(labels))
    assert np.array_equal(forest.split, same.split) and forest.threshold == same.threshold
    kept = quality.keep_good(odd, labels, forest)
    assert kept.columns == odd.columns
    assert kept.count() == quality.keep_good(docs, labels, forest).count()


def test_documents(spark, sf):
    base = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    more = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "one two", "en", "s", 7), (-3, "one two", "en", "s", 7)], base.schema)
    docs = base.union(more)
    forest = quality.fit(docs, labels)
    rows = quality.judge(docs, forest).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = set()
    for r in rows:
        n, chars, symbols, lines, repeats = plain(texts[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
        assert not (r["base_failed"] and r["kept"])
        if r["kept"]:
            kept.add(r["doc_id"])
    stayed = quality.keep_good(docs, labels, forest)
    assert stayed.columns == docs.columns
    assert {r["doc_id"] for r in stayed.collect()} == kept
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()} & {r["doc_id"] for r in rows if not r["base_failed"]}
    assert len(good - kept) <= 0.02 * len(good)
    assert quality.judge(docs.where("false"), None).count() == 0
    assert quality.fit(docs, labels.where("false")) is None


def made(n=2000, seed=5):
    """Labelled rows with ties in every statistic, a share of bad ones apart in two of them, and halves."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, len(quality.FEATURES))), 2)
    good = rng.random(n) > 0.08
    x[~good, 2] += 6
    x[~good, 4] -= 2
    return quality.Rows(x, good, rng.integers(0, 2, n))


def test_all_labelled_rows_grow_trees_and_set_the_threshold():
    """Each tree by a plain recount of all rows of its half; the threshold by all rows, each by the other half's trees."""
    known = made()
    forest = quality.learn(known)
    for t, root in enumerate(forest.roots):
        mine = known.half == t % 2
        x, good = known.x[mine], known.good[mine]
        among = min(1, max(2, quality.AMONG * good.sum()) / (~good).sum())
        weight = np.where(good, 1, among)
        waiting = [(root, np.ones(len(x), bool), 0)]
        while waiting:
            node, inside, depth = waiting.pop()
            assert inside.any()
            n = round(forest.sample * weight[inside].sum() / weight.sum())
            f, s = forest.feature[node], forest.split[node]
            if f < 0:
                assert forest.path[node] == pytest.approx(depth + (quality.expected_path(n) if n > 1 else 0))
                continue
            assert n > 1 and x[inside, f].min() < s <= x[inside, f].max()
            under = x[:, f] < s
            waiting += [(forest.left[node], inside & under, depth + 1), (forest.right[node], inside & ~under, depth + 1)]
    score = []
    for row, half in zip(known.x, known.half, strict=True):
        mean = np.mean([path_length(forest, root, row) for root in forest.roots[1 - half :: 2]])
        score.append(2 ** (-mean / quality.expected_path(forest.sample)))
    score = np.array(score)
    spared = int(0.002 * known.good.sum())
    floor = sorted(score[known.good])[-1 - spared]
    assert forest.threshold == pytest.approx((floor + score[~known.good & (score > floor)].min()) / 2)


def test_rows_on_executors_give_the_same_forest(spark):
    known = made()
    rows = [(x.tolist(), bool(g), int(h)) for x, g, h in zip(known.x, known.good, known.half, strict=True)]
    table = quality.Table(spark.createDataFrame(rows, "features array<double>, good boolean, half int").repartition(5))
    assert np.array_equal(table.kinds(), known.kinds())
    assert np.array_equal(table.parting(), known.parting())
    one, other = quality.learn(table), quality.learn(known)
    for name in ("feature", "split", "left", "right", "path", "roots", "sample", "threshold"):
        assert np.array_equal(getattr(one, name), getattr(other, name)), name


def test_no_label_is_left_out(spark):
    """The bad rows are those that come last by the hash of their id, after 6,000 good ones."""
    from pyspark.sql import functions as F

    ids = spark.range(6060).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("hash")).orderBy("hash").collect()
    bad = {r["doc_id"] for r in ids[6020:]}
    texts = [(i, " ".join(f"w{(i * k) % 997}{'###$$$' * (i in bad)}" for k in range(1, 16))) for i in range(6060)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in range(6060)], "doc_id long, quality int")
    forest = quality.fit(docs, labels)
    assert forest is not None
    gone = {r["doc_id"] for r in quality.judge(docs, forest).where("not kept and not base_failed").collect()}
    assert len(gone & bad) >= 38 and len(gone - bad) <= 0.01 * 6020
