"""Streams: usage rollup, request verdicts, running limits, landing-folder loads.

All state lives in the query's checkpoint and in tables under given paths.
Batch results are written per batch number and replaced when a batch runs
again, so a restart neither loses nor doubles rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.accounts import authorize_requests
from ..operators.usage import daily_rollup, rate_limits_of_rollup
from ..sources.files import address_rows, feature_pieces, features_of, parse_pieces
from ..sources.tables import insert_new, with_full_address


def _instant(c: str) -> Column:
    """Zone-less time, meant as UTC -> instant, whatever the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(c)).cast("timestamp")


def _utc_date(c: str) -> Column:
    local = F.col(c).cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local).cast("date")


def _per_batch(df: DataFrame, path: str, checkpoint: str, mode: str, write) -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def _replace(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def usage_rollup_stream(
    usage: DataFrame, path: str, checkpoint: str, late: str = "1 hour"
) -> StreamingQuery:
    """Rows per user, endpoint and day; rows later than ``late`` after their day are dropped.

    Update mode: each batch writes the groups it changed, see ``usage_rollup``.
    """
    groups = (
        usage.withColumn("at", _instant("created_at"))
        .withWatermark("at", late)
        .groupBy(F.window("at", "1 day"), "user_id", "endpoint")
        .agg(
            F.count("*").alias("total_calls"),
            F.count(F.when(F.col("billable"), 1)).alias("billable_calls"),
            F.avg("response_time_ms").alias("avg_response_time"),
        )
    )
    days = groups.select(
        _utc_date("window.start").alias("date"), "user_id", "endpoint", "total_calls",
        "billable_calls", "avg_response_time",
    )
    return _per_batch(days, path, checkpoint, "update", lambda b, no: _replace(b, path, no))


def usage_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Latest state of every group written by ``usage_rollup_stream``."""
    rows = spark.read.parquet(path)
    keys = ["user_id", "endpoint", "date"]
    values = F.struct("total_calls", "billable_calls", "avg_response_time")
    latest = rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("v"))
    return latest.select(*keys, "v.*")


def authorize_stream(
    requests: DataFrame, keys: DataFrame, users: DataFrame, limits: DataFrame | None,
    path: str, checkpoint: str,
) -> StreamingQuery:
    """Verdict per request, appended to the table at ``path``."""
    verdicts = authorize_requests(requests, keys, users, limits)
    return (
        verdicts.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def counters_stream(usage: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running counters: every batch adds its rollup, one row per user, endpoint and day."""
    return _per_batch(
        usage, path, checkpoint, "append", lambda b, no: _replace(daily_rollup(b), path, no)
    )


def running_limits(
    spark: SparkSession, path: str, users: DataFrame, subscriptions: DataFrame, as_of: str
) -> DataFrame:
    """Rate-limit status from the counters collected so far."""
    return rate_limits_of_rollup(users, subscriptions, spark.read.parquet(path), as_of)


def ingest_stream(
    spark: SparkSession, landing: str, path: str, checkpoint: str, state: str,
    flavour: str = "dataset", county: str | None = None, files_per_batch: int = 64,
) -> StreamingQuery:
    """Load new address files of a landing folder; addresses already stored are left out."""

    def rows_of(pieces: DataFrame) -> DataFrame:
        return address_rows(parse_pieces(pieces), flavour, county, state)

    empty = spark.createDataFrame([], "value string, _file string, _start bigint")
    # An empty first part gives the table its schema before any file arrives.
    stored = with_full_address(rows_of(empty)).drop("source_order")
    stored.write.mode("ignore").parquet(f"{path}/batch=-1")

    def load(pieces: DataFrame, batch: int) -> None:
        table = pieces.sparkSession.read.parquet(path).filter(F.col("batch") < batch)
        found = address_rows(features_of(pieces)[0], flavour, county, state)
        new = insert_new(table, found, ["hash"], F.col("source_order"))
        _replace(with_full_address(new).drop("source_order"), path, batch)

    pieces = feature_pieces(
        spark.readStream.option("maxFilesPerTrigger", files_per_batch), landing
    )
    return _per_batch(pieces, path, checkpoint, "append", load)
