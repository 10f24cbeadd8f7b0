"""The registered queries of these operators, over the whole tables of a data folder."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids,
    checks,
    languages,
    linededup,
    neardup,
    packing,
    quality,
    scoring,
    spelling,
    subwords,
    suffixdedup,
    token_counts,
    topk,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(spark: SparkSession) -> None:
    """Let Python workers that share this folder import the package from any working folder."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_texts(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op5_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.subword_digest(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(files).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.remove_lines(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_pack, op2_near_duplicates, op3_score, op4_quality, op5_subwords, op6_warc, op7_top_k,
        op8_token_counts, op9_remove_repeats, op10_languages, op11_spelling, op12_centroids, op13_lines,
    )
}

#: DuckDB SQL for the rows; the others are tested against brute force in tests/llm.
CHECKS: dict[str, str] = {
    "op6_warc": checks.WARC,
    "op7_top_k": checks.TOP_K,
    "op11_spelling": checks.SPELLING,
    "op12_centroids": checks.centroid_sql(),
    "op13_lines": checks.LINES,
}
