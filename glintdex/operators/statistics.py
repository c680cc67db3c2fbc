"""Reports on an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintdex.operators.index import Index

TERMS, FILES = 10, 5


def overview(index: Index) -> DataFrame:
    """One row: documents, distinct terms, tokens, mean length."""
    terms = index.vocab.agg(F.count("*").alias("terms"))
    return index.stats.crossJoin(F.broadcast(terms)).select(F.col("n").alias("documents"), "terms", "tokens", "avgdl")


def extensions(index: Index) -> DataFrame:
    """Documents of each extension and their share, most first."""
    name = F.when(F.col("extension") == "", "(none)").otherwise(F.col("extension"))
    counted = index.docs.groupBy(name.alias("extension")).agg(F.count("*").alias("documents"))
    shared = counted.crossJoin(F.broadcast(index.stats.select("n")))
    return shared.select("extension", "documents", (F.col("documents") * 100.0 / F.col("n")).alias("percent")).orderBy(F.desc("documents"), "extension")


def top_terms(index: Index, k: int = TERMS) -> DataFrame:
    return index.vocab.select("term", "df").orderBy(F.desc("df"), "term").limit(k)


def largest_files(index: Index, k: int = FILES) -> DataFrame:
    return index.docs.select("doc_id", "path", "size_bytes").orderBy(F.desc("size_bytes"), "doc_id").limit(k)
