import itertools
import re

import pytest
from pyspark.sql import functions as F

from glintdex.functions import text as T
from glintdex.operators import index as I
from glintdex.operators import search as S
from glintdex.operators import statistics
from glintdex.plans.spec import Filters, QuerySpec
from glintdex.sources.storage import Store

KINDS = "doc_id long, path string, file_name string, extension string, size_bytes long, last_modified long, content string"


def make(spark, files, sizes=None, times=None, **limits):
    rows = [(i, f"/c/{n}", n, "." + n.rpartition(".")[2], (sizes or {}).get(n, 100), (times or {}).get(n, 0), t) for i, (n, t) in enumerate(files.items(), 1)]
    return I.build(spark.createDataFrame(rows, KINDS), now=0, **limits)


def names(index, spec):
    return {r["file_name"]: r["score"] for r in S.search(index, spec).collect()}


def ordered(index, spec):
    return [r["file_name"] for r in S.search(index, spec).collect()]


def phrase_like(spark, files):
    """Content that is indexed without the tokens of its name."""
    index = make(spark, files)
    own = index.postings.join(index.docs.select("doc_id", "file_name"), "doc_id")
    bare = own.where(~F.array_contains(T.tokenize_filename(F.col("file_name")), F.col("term"))).drop("file_name")
    docs = index.docs.withColumn("token_count", F.col("token_count") - F.size(T.tokenize_filename(F.col("file_name"))))
    return I.Index(docs, bare.select("term", "doc_id", "positions", "freq"), I.vocab_of(bare), I.stats_of(docs), index.content)


def test_scores(spark):
    found = names(phrase_like(spark, {"low.txt": "redis", "high.txt": "redis " * 10}), QuerySpec("redis"))
    assert found["high.txt"] == pytest.approx(0.366978, abs=1e-6)
    assert found["low.txt"] == pytest.approx(0.288566, abs=1e-6)
    found = names(phrase_like(spark, {"doc1.txt": "redis caching redis performance redis", "doc2.txt": "redis database"}), QuerySpec("redis caching"))
    assert (found["doc1.txt"], found["doc2.txt"]) == (pytest.approx(0.855544, abs=1e-6), pytest.approx(0.225885, abs=1e-6))


def test_any_term_and_repeated_terms(spark):
    index = make(spark, {"a.txt": "redis caching docker containers", "b.txt": "spring boot framework"})
    assert set(names(index, QuerySpec("redis docker"))) == {"a.txt"}
    assert set(names(index, QuerySpec("redis spring"))) == {"a.txt", "b.txt"}
    assert names(index, QuerySpec("redis redis"))["a.txt"] == pytest.approx(2 * names(index, QuerySpec("redis"))["a.txt"])
    assert names(index, QuerySpec("the and")) == {}
    assert names(index, QuerySpec("")) == {}


def test_file_name_boost(spark):
    index = make(spark, {"backend.txt": "redis caching performance", "redis-guide.txt": "performance optimization tips"})
    assert ordered(index, QuerySpec("redis")) == ["redis-guide.txt", "backend.txt"]


def test_fuzzy(spark):
    found = names(phrase_like(spark, {"exact.txt": "redis caching layer", "approx.txt": "rediis configuration"}), QuerySpec("redis", fuzzy=True))
    assert (found["exact.txt"], found["approx.txt"]) == (pytest.approx(0.635915, abs=1e-6), pytest.approx(0.571275, abs=1e-6))
    index = make(spark, {"a.txt": "ab zz"})
    assert {r["term"] for r in S.fuzzy_candidates(index, "xy").collect()} == {"a", "ab", "zz"}


def test_prefix(spark):
    index = phrase_like(spark, {"exact.txt": "docker containers", "partial.txt": "dockyard storage"})
    assert names(index, QuerySpec("docker", prefix=True)) == {"exact.txt": pytest.approx(0.693147, abs=1e-6)}
    assert [r["term"] for r in S.autocomplete(index, "dock").collect()] == ["docker", "dockyard"]
    assert S.autocomplete(index, " ").count() == 0


def test_phrase(spark):
    index = phrase_like(spark, {"one.txt": "spring boot simplifies development", "test.md": "spring framework helps boot applications"})
    assert set(names(index, QuerySpec('"spring boot"'))) == {"one.txt"}
    lone = phrase_like(spark, {"x.txt": "spring boot simplifies development"})
    assert names(lone, QuerySpec('"spring boot"')) == {"x.txt": pytest.approx(1.150728, abs=1e-6)}


def test_phrase_and_stop_words(spark):
    index = make(spark, {"a.txt": "spring and boot", "the-end.txt": "nothing more"})
    assert set(names(index, QuerySpec('"spring boot"'))) == {"a.txt"}
    assert names(index, QuerySpec('"spring and boot"')) == {}
    # From the content's last token to the name's first.
    assert set(names(index, QuerySpec('"more the end"'))) == {"the-end.txt"}
    assert set(names(index, QuerySpec('"boot a"'))) == {"a.txt"}


def test_regex(spark):
    index = make(spark, {"a.txt": "redis caching", "b.txt": "memcached performance"})
    assert set(names(index, QuerySpec("redis|memcached", regex=True))) == {"a.txt", "b.txt"}
    assert set(names(index, QuerySpec("RED", regex=True))) == set()
    assert set(names(index, QuerySpec("RED..", regex=True))) == {"a.txt"}
    for bad in ("[invalid", "[[[invalid", "spring(boot", "redis)|(caching"):
        assert names(index, QuerySpec(bad, regex=True)) == {}
    assert names(index, QuerySpec(".*", regex=True)) == {}
    assert S.score(index, S.regex_terms(index, ".*")).count() == 2
    assert {r["term"] for r in S.regex_terms(index, "r|redis").collect()} == {"redis"}


def test_filters_keep_scores(spark):
    index = make(spark, {"a.txt": "redis", "b.md": "redis redis"}, sizes={"a.txt": 512, "b.md": 5_000_000}, times={"a.txt": 10, "b.md": 20})
    every = names(index, QuerySpec("redis"))
    for filters, left in ((Filters(extension=".MD"), "b.md"), (Filters(min_size=1_000_000), "b.md"), (Filters(modified_after=20), "b.md"), (Filters(extension=".txt"), "a.txt")):
        assert names(index, QuerySpec("redis", filters=filters)) == {left: every[left]}
    assert names(index, QuerySpec("redis", filters=Filters(extension="md"))) == {}


def test_postings_and_statistics(spark):
    index = make(spark, {"q.txt": "redis spring redis docker", "the.txt": "the of and", "blank.txt": " \n ", "none.txt": None})
    assert index.postings.where("term = 'redis'").first()["positions"] == [0, 2]
    assert {r["file_name"]: r["token_count"] for r in index.docs.collect()} == {"q.txt": 5, "the.txt": 1}
    row = statistics.overview(index).first()
    assert (row["documents"], row["terms"], row["tokens"], row["avgdl"]) == (2, 5, 6, 3.0)
    assert [(r["extension"], r["percent"]) for r in statistics.extensions(index).collect()] == [(".txt", 100.0)]
    assert statistics.top_terms(index).first()["term"] == "docker"
    assert I.stats_of(index.docs.where("false")).first()["avgdl"] == 1.0


def test_large_files_have_their_names_only(spark):
    index = make(spark, {"big-one.txt": "redis", "small.txt": "redis"}, sizes={"big-one.txt": 11, "small.txt": 10}, max_text=10)
    assert {r["file_name"]: r["token_count"] for r in index.docs.collect()} == {"big-one.txt": 2, "small.txt": 2}
    assert set(names(index, QuerySpec("redis"))) == {"small.txt"}


def test_remove_and_upsert(spark):
    index = make(spark, {"a.txt": "redis only", "b.txt": "redis spring"})
    left = I.remove(index, index.docs.where("path = '/c/a.txt'").select("doc_id"))
    assert {r["term"] for r in left.vocab.collect()} == {"redis", "spring", "b"}
    files = spark.createDataFrame([(0, "/c/b.txt", "b.txt", ".txt", 1, 5, "docker"), (0, "/c/n.txt", "n.txt", ".txt", 1, 5, "new")], KINDS)
    new = I.upsert(index, files, now=0)
    assert {(r["path"], r["doc_id"]) for r in new.docs.collect()} == {("/c/a.txt", 1), ("/c/b.txt", 3), ("/c/n.txt", 4)}
    assert {r["term"] for r in new.vocab.collect()} == {"redis", "only", "a", "docker", "b", "new", "n"}


def test_top_has_ranks_and_snippets(spark):
    index = make(spark, {f"f{i}.txt": "redis " * i for i in range(1, 15)})
    rows = S.top(index, QuerySpec("redis")).collect()
    assert [r["rank"] for r in rows] == list(range(1, 11))
    assert all(r["snippet"].startswith("redis") for r in rows)
    told = S.explain(index, QuerySpec("redis", filters=Filters(min_size=101)))
    assert (told["mode"], told["candidates"], told["after_filters"]) == ("keyword", 14, 0)


def test_batch_is_as_single(spark):
    index = make(spark, {"a.txt": "redis caching", "b.txt": "redis spring"})
    asked = spark.createDataFrame([(1, "redis redis"), (2, "spring the"), (3, "the")], "query_id long, raw_query string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in S.batch_keyword(index, asked).collect()}
    for q, raw in ((1, "redis redis"), (2, "spring the")):
        for r in S.search(index, QuerySpec(raw)).collect():
            assert got.pop((q, r["doc_id"])) == pytest.approx(r["score"])
    assert got == {}


def broadcasts(df):
    """What is below each broadcast of the plan."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().splitlines(), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            at = line.index("BroadcastExchange")
            below = itertools.takewhile(lambda x: re.search("[A-Za-z]", x).start() > at, lines[i + 1 :])
            out.append("\n".join(below))
    return out


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize(("batch", "options"), [(S.batch_fuzzy, {"fuzzy": True}), (S.batch_prefix, {"prefix": True})])
def test_batch_never_broadcasts_the_vocabulary(spark, tmp_path, monkeypatch, batch, options, few):
    monkeypatch.setattr(S, "ASKED", S.ASKED if few else 1)
    index = Store(spark, f"file://{tmp_path}/index").save(make(spark, {"a.txt": "redis caching cached redis", "b.txt": "docker reds kubernetes", "c.txt": "ab abc ax"}))
    queries = {1: "redis cach redis", 2: "dockr kubernetes", 3: "ab"}
    found = batch(index, spark.createDataFrame([*queries.items()], "query_id long, raw_query string"))
    assert not [x for x in broadcasts(found) if "Generate explode" in x and "FileScan" in x and "Join" not in x]
    want = {(q, r["doc_id"]): r["score"] for q, text in queries.items() for r in S.search(index, QuerySpec(text, **options)).collect()}
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in found.collect()} == pytest.approx(want)


def test_filters_reach_the_scan(spark, tmp_path):
    from glintdex.sources.storage import Store

    index = Store(spark, f"file://{tmp_path}/i").save(make(spark, {"a.txt": "redis caching"}))
    plan = S.search(index, QuerySpec("redis"))._jdf.queryExecution().toString()
    assert "In(term, [redis])" in plan or "EqualTo(term,redis)" in plan
    assert "Python" not in plan
