"""The queries of this subpackage, and their definitions in DuckDB's SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licenses, linededup, neardup, packing, pagediff, perplexity, tokencounts, tokenids, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_conversations(table(spark, sf_dir, "conversations"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.bundles(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op6_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"))


def op7_pagediff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.main_text(table(spark, sf_dir, "pages"))


def op8_tokenids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.encoded(table(spark, sf_dir, "documents"))


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.accepted(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


_ALL = (op1_packing, op2_warc, op3_decontaminate, op4_neardup, op5_linededup, op6_tokencounts, op7_pagediff, op8_tokenids, op9_perplexity, op10_licenses)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op5_linededup": linededup.SQL}
