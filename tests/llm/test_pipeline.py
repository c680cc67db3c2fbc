import re
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from glintdex.llm import lines, minhash, quality, toxicity
from tests.llm.test_minhash import plain


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        was, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= before
        if name == "line dedup":
            assert after == before
            want = lines.by_source(was).withColumn("n_chars", F.length("text").cast("long"))
            assert docs.exceptAll(want).isEmpty()
        if name == "minhash near-dedup":
            assert after == {r["component_id"] for r in minhash.near_duplicates(was, 5).collect()}
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == before
    assert {r["doc_id"]: r["doc_tokens"] for r in packed} == {i: sum(r["length"] for r in packed if r["doc_id"] == i) for i in before}


def by_hand(docs, sf_dir, spark):
    """The first four stages on lists: rules and scores text by text, lines and shingles by plain counting."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    forest = quality.fit(frame, labels)
    rows = []
    for i, text, source in docs:
        base, features = quality.statistics(text)
        if not quality.failed(base[0], base[4]) and (forest is None or forest.anomaly(np.array([features]))[0] <= forest.threshold):
            rows.append((i, text, source))
    yield {r[0] for r in rows}
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, source string"), labels)
    if model:
        scorer = toxicity.Scorer(toxicity.Net.load(model))
        rows = [r for r in rows if scorer.score([r[1]])[0] < 0.5]
    yield {r[0] for r in rows}
    pages = {s: {t for _, t, x in rows if x == s} for s in {r[2] for r in rows}}
    worded = lambda line: bool(re.search(r"[^\x20\x09-\x0D]", line))
    count = {s: Counter(line for t in own for line in set(t.split("\n")) if worded(line)) for s, own in pages.items()}
    bad = {s: {x for x, n in c.items() if n >= lines.LEAST and n > lines.RATIO * len(pages[s])} for s, c in count.items()}
    rows = [(i, "\n".join(x for x in t.split("\n") if x not in bad[s]), s) for i, t, s in rows]
    yield {(i, t) for i, t, _ in rows}
    yield {c for _, _, c in plain([(i, t) for i, t, _ in rows], 5)}


def test_stages_by_hand(spark, sf, tmp_path):
    """On few documents with copies, boilerplate and odd rows; columns that stages use themselves are there too."""
    base = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 150").collect()]
    menu = "the menu of this site\n"
    docs = [(i, menu + t if k % 3 == 0 else t, s) for k, (i, t, s) in enumerate(base)]
    docs += [(10_000 + i, t, s) for i, t, s in docs[:7]] + [(20_000, None, "s"), (20_001, "", "s"), (20_002, "few words", None), (20_003, "long words here of many kinds " * 3000, None), (20_004, " ".join(f"w{k}" for k in range(300)), None)]
    want = by_hand(docs, sf, spark)
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, source string, component_id string, bad__ int, gone__ int")
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, frame, sf).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        assert frame.columns == columns
        rows = frame.collect()
        assert {(r["doc_id"], r["text"]) if name == "line dedup" else r["doc_id"] for r in rows} == next(want), name
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in rows}


def test_nothing_and_repeats(spark, sf, tmp_path):
    one = spark.read.parquet(f"{sf}/documents.parquet")
    one.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    text = " ".join(f"w{k}" for k in range(50))
    twice = spark.createDataFrame([(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text, "en", "s", 1), (3, None, "en", "s", 0)], one.schema)
    twice.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r["start"] == 0) == ["1", "None"]
