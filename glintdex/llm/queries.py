"""The operators' queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glintdex.llm import bpe, chat, licences, lines, minhash, packing, quality, toxicity, vptree, warc
from glintdex.llm.shared import table


def vocab() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(table(spark, sf_dir, "documents"), vocab())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.by_source(table(spark, sf_dir, "documents"), report=True).select("doc_id", "n_lines", "n_dropped", "text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(table(spark, sf_dir, "conversations"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digests(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocab())


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.every_hundredth(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_warc, op2_packing, op3_line_dedup, op4_toxicity, op5_chat_formatting, op6_quality_rules, op7_license_scans, op8_minhash, op9_bpe, op10_nearest_neighbours)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.ORACLE,
        "op3_line_dedup": lines.ORACLE,
        "op5_chat_formatting": chat.ORACLE,
        "op7_license_scans": licences.ORACLE,
        "op8_minhash": minhash.ORACLE,
        "op10_nearest_neighbours": vptree.ORACLE,
    }
