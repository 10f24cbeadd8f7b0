"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

#: Rows that a task of a text search reads at most, or about: what it sorts grows with them.
TASK_ROWS = 500_000


class Tables:
    """The derived tables of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in views.RAW:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return views.view(self.spark, self.sf_dir, name)

    def spread(self, df: DataFrame, key: str = "id") -> DataFrame:
        """Rows over all cores, and over more tasks where a task would hold too many: a data
        folder holds each table as a single file, too few tasks for text matching. Real
        address tables have many files."""
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
        return df.repartition(tasks, key)


def query(name: str, sql: str | None = None, reads: tuple[str, ...] = ()):
    """Register ``f(tables) -> DataFrame``; ``sql`` may use the views in ``reads``."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            head = views.ctes(*reads) if reads else ""
            body = sql.strip()
            if head and body.lower().startswith("with "):
                CHECKS[name] = f"{head},\n{body[5:]}"
            else:
                CHECKS[name] = f"{head}\n{body}"
        return f

    return register
