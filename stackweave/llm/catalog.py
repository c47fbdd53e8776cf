"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_blocks, line_dedup, media, mixing, near_dedup, packing, pii, quality, substring_dedup, suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", F.col("__sw_copy").alias("copy"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A job sets its own secret; the test tables hold nobody's data, so theirs needs none.
    key = spark.conf.get("spark.stackweave.pii.key", "the test tables' key, no secret")
    return pii.surrogates(table(spark, sf_dir, "documents"), key.encode())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", F.col("__sw_deleted").alias("n_deleted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.incremental_repeats(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.sniff(media.media_column(table(spark, sf_dir, "pages")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_mixing, op2_html_extraction, op3_suffix_dedup, op4_pii_surrogates, op5_simhash, op6_line_dedup, op7_quality, op8_packing, op9_substring_dedup, op10_media, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL}
