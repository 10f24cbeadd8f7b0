"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waystone.llm import languages, neardup, packing, quality, suffixdedup
from waystone.llm.queries import shipped
from waystone.operators.stage import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts whose main language has a smaller share of their letters are rejected.
LEAST_SHARE = 0.4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    shipped(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.quality_rules(docs, labels, carry=COLUMNS[1:])
    return judged.filter("kept").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known main language, which becomes their ``lang``."""
    shipped(spark)
    model = languages.fit(docs.filter(languages.fold(5) != 0))
    found = languages.predict(docs, model, carry=("text", "source", "n_chars"))
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    shipped(spark)
    others = neardup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents with smaller ids have."""
    shipped(spark)
    cut = suffixdedup.remove_repeats(docs, with_text=True, carry=("lang", "source"))
    text = F.col("kept_text")
    return cut.select(
        "doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars")
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in training sequences."""
    shipped(spark)
    return packing.best_fit_pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", pack),
]

#: SQL can express neither the trees nor the language model, so tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage keeps is stored before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
