"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the stage before it kept, written as Parquet and read again; what no later stage
reads is deleted.

Defined results: null and empty texts, and texts of under ten words, fail the quality rules and go; texts are read
whole; repeated rows are judged alike, and near-dedup keeps one row of an id, that of the smallest id in its group;
rows without an id are judged like others and never linked, so they stay; where a source's boilerplate was all of a
text, an empty text goes on and is packed as its end token; without labels of both kinds the two fitted stages reject
nothing beyond the base rules; empty tables give no rows.  Of the columns only doc_id, text and source are needed:
``n_chars`` follows the text if it is there, others stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintdex import ship
from glintdex.llm import lines, minhash, packing, quality, toxicity
from glintdex.llm.queries import vocab
from glintdex.llm.shared import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that base rules or the isolation forest reject."""
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the network calls toxic."""
    ship(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each source's boilerplate lines from its texts."""
    ship(spark)
    clean = lines.by_source(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    ship(spark)
    return minhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens of the documents that are left."""
    ship(spark)
    return packing.digests(docs, vocab())


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_texts),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("packing", packed),
]

#: SQL can't express the stages that are fitted; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            scratch.drop(before)
        before = name.replace(" ", "-")
    return STAGES[-1][1](spark, docs, sf_dir)
