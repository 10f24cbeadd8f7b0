"""Ranking, paging and totals per query, and joins that spread a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_query(
    df: DataFrame, keys: list[str], order: list[Column], k: Column | int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key; the order must end in a unique column.

    With a constant ``k`` Spark keeps at most k rows per key before the
    shuffle, so a hot key moves k rows per input partition.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def page_per_query(
    df: DataFrame, keys: list[str], order: list[Column], offset: int, limit: int
) -> DataFrame:
    """OFFSET / LIMIT for every key at once."""
    ranked = top_k_per_query(df, keys, order, offset + limit)
    return ranked.filter(F.col("rank") > offset)


def with_totals(page: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``total``, the number of matches per key before paging."""
    return page.join(matches.groupBy(*keys).agg(F.count("*").alias("total")), keys)


def spread_join(
    rows: DataFrame, lookup: DataFrame, on: list[str], spread: str, how: str = "inner",
    salts: int = 8,
) -> DataFrame:
    """Equi-join whose ``rows`` side may hold one key very often.

    Each key is cut into ``salts`` pieces by the unique column ``spread``; the
    lookup side, one or few rows per key, is repeated for every piece.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)))
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    repeated = lookup.withColumn("_salt", pieces)
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by ``keys`` to a fixed number of tasks, which are not put together however few
    bytes they read."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)
