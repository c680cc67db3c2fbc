import duckdb
import pytest
from pyspark.sql import functions as F

from glintdex.llm import lines

KINDS = "doc_id long, text string, source string, bad__ string"


def plain(rows, ratio, least):
    pages, seen = {}, {}
    for _, text, host, _ in rows:
        pages[host] = pages.get(host, 0) + 1
        for line in {x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")} if text is not None else set():
            seen[host, line] = seen.get((host, line), 0) + 1
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return sorted(((i, None if text is None else "\n".join(x for x in text.split("\n") if (host, x) not in bad)) for i, text, host, _ in rows), key=str)


@pytest.mark.parametrize("small", [200_000, 0])
def test_against_plain(spark, small):
    rows = [(i, f"own {i}\nmenu\n\nshared {i % 3}\nmenu", "a" if i % 3 else None, "x") for i in range(40)]
    rows += [(100, None, "a", "x"), (101, "", "a", "x"), (102, "menu", "b", "x"), (103, " \n\t\n", "a", "x"), (0, "own 0\nmenu\n\nshared 0\nmenu", None, "x"), (104, "menu\n" + "long line " * 30_000, "a", None)]
    docs = spark.createDataFrame(rows, KINDS)
    got = lines.drop_boilerplate(docs, "source", "text", ratio=0.3, least=3, small=small, deals=4)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == plain(rows, 0.3, 3)
    assert lines.by_source(docs.where("false")).count() == 0


def test_copies_are_one_page(spark):
    copy = "menu\nonly here\nand here"
    rows = [(i, f"menu\nown {i}", "a", "x") for i in range(20)] + [(100 + i, copy, "a", "x") for i in range(10)]
    rows += [(200 + i, copy, "b", "x") for i in range(10)] + [(300 + i, None, "b", "x") for i in range(10)]
    docs = spark.createDataFrame(rows, KINDS)
    got = {r["doc_id"]: r["text"] for r in lines.by_source(docs).collect()}
    assert len(got) == len(rows)
    assert {got[i] for i in range(100, 110)} == {"only here\nand here"}
    assert {got[i] for i in range(200, 210)} == {copy}
    assert [got[i] for i in range(20)] == [f"own {i}" for i in range(20)]
    found = lines.boilerplate(docs, "source").collect()
    assert [(r["host"], r["with_line"], r["pages"]) for r in found] == [("a", 21, 21)]


def test_copies_survive_near_dedup(spark):
    from glintdex.llm import minhash

    copy = "\n".join(f"some longer line of content number {i} of this page" for i in range(9))
    rows = [(i, "\n".join(f"page {i} says {j * i + j} and {i * 31 + j * 7} here" for j in range(9)), "a") for i in range(20)] + [(100 + i, copy, "a") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = minhash.keep_one(lines.by_source(docs))
    assert [r["text"] for r in left.where("doc_id >= 100").collect()] == [copy]


def test_oracle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumn("source", F.lit("one"))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * replace ('one' as source) from '{sf}/documents.parquet'")
    want = duck.execute(lines.ORACLE).df().set_index("doc_id").sort_index()
    got = lines.by_source(docs, report=True).select("doc_id", "n_lines", "n_dropped", "text").toPandas().set_index("doc_id").sort_index()
    assert got.equals(want[got.columns])
    assert got.n_dropped.sum() > 0


def test_no_python(spark, sf):
    plan = lines.by_source(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
