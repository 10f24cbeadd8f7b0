"""Merging new rows into tables, bulk loads and the load registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import county_from_path, full_address
from ..operators.stage import stage
from .files import address_rows, dataset_name, read_feature_files


def _one_per_key(df: DataFrame, keys: list[str], order: Column, last: bool) -> DataFrame:
    """Aggregated on the map side: a key with many copies moves one row per partition."""
    others = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*others), order).alias("_row")).select(
        *keys, "_row.*"
    )


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: list[str], order: Column
) -> DataFrame:
    """Last row per key wins; incoming rows replace existing ones."""
    latest = _one_per_key(incoming, keys, order, last=True).select(*existing.columns)
    kept = existing.join(latest.select(*keys), keys, "left_anti")
    return kept.select(*existing.columns).unionByName(latest)


def insert_new(
    existing: DataFrame, incoming: DataFrame, keys: list[str], order: Column
) -> DataFrame:
    """Rows to add: the first incoming row of every key that does not exist yet.

    The table is first cut down to the keys that come in, so a small load does
    not move a large table.
    """
    first = _one_per_key(incoming, keys, order, last=False)
    present = existing.select(*keys).join(first.select(*keys), keys, "left_semi")
    return first.join(present, keys, "left_anti")


def insert_counts(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """What ``insert_new`` does with the incoming rows, in one row: incoming, added, duplicates.

    Duplicates are rows whose key exists and further rows of a key that is new.
    """
    per_key = incoming.groupBy(*keys).agg(F.count("*").alias("n"))
    present = existing.select(*keys).join(per_key.select(*keys), keys, "left_semi").distinct()
    marked = per_key.join(present.withColumn("known", F.lit(True)), keys, "left")
    return marked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("incoming"),
        F.count_if(F.col("known").isNull()).alias("added"),
    ).withColumn("duplicates", F.col("incoming") - F.col("added"))


def pending_datasets(manifest: DataFrame, registry: DataFrame) -> DataFrame:
    """Manifest rows (state, county) with the latest load of the same place, if any.

    ``pending`` is true where nothing was loaded before.
    """
    place = [F.upper("state").alias("_s"), F.upper("county").alias("_c")]
    known = registry.select(*place, "id", "status", "uploaded_at").groupBy("_s", "_c").agg(
        F.max_by(F.struct("id", "status"), F.struct("uploaded_at", "id")).alias("latest")
    )
    return (
        manifest.select("*", *place)
        .join(known, ["_s", "_c"], "left")
        .drop("_s", "_c")
        .select("*", F.col("latest.id").alias("dataset_id"),
                F.col("latest.status").alias("dataset_status"),
                F.col("latest").isNull().alias("pending"))
        .drop("latest")
    )


def missing_counties(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of counties that the table does not hold yet."""
    loaded = existing.select(F.lower("county").alias("_k")).distinct()
    return incoming.withColumn("_k", F.lower("county")).join(loaded, "_k", "left_anti").drop("_k")


def with_full_address(rows: DataFrame) -> DataFrame:
    line = full_address("house_number", "street", "unit", "city", "region", "postcode")
    return rows.withColumn("full_address", line)


def bulk_ingest(
    spark: SparkSession,
    paths: str | list[str],
    state: str,
    existing: DataFrame | None = None,
    flavour: str = "dataset",
) -> tuple[DataFrame, DataFrame]:
    """Load many county files in one job -> (rows to add, report per file).

    The report names every file: admitted, added and duplicate rows, rejected parts, and status
    ``failed`` with a reason for a file in which nothing but rejects was found.
    """
    features, rejects = read_feature_files(spark, paths)
    # Parsed once, then read by the merge and by the report.
    read = stage(address_rows(features, flavour, state=state), "bulk-read")
    keys, order = ["hash"], F.col("source_order")
    if existing is None:
        existing = spark.createDataFrame([], "hash string")
    added = insert_new(existing, read, keys, order)
    # only the names are read
    files = spark.read.format("binaryFile").load(paths).select(
        dataset_name(F.col("path")).alias("file_name")
    ).distinct()
    admitted = read.groupBy("file_name").agg(
        F.count("*").alias("admitted"), F.min("county").alias("county")
    )
    inserted = added.groupBy("file_name").agg(F.count("*").alias("record_count"))
    refused = rejects.groupBy(dataset_name(F.col("_file")).alias("file_name")).agg(
        F.count("*").alias("rejected"), F.min("reason").alias("reason")
    )
    joined = files.join(admitted, "file_name", "left").join(inserted, "file_name", "left")
    joined = joined.join(refused, "file_name", "left").fillna(0, ["admitted", "record_count", "rejected"])
    failed = (F.col("admitted") == 0) & (F.col("rejected") > 0)
    report = joined.select(
        "file_name",
        F.coalesce("county", county_from_path(F.col("file_name"))).alias("county"),
        F.lit(state).alias("state"), "admitted", "record_count",
        (F.col("admitted") - F.col("record_count")).alias("duplicates"), "rejected",
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(failed, F.col("reason")).alias("error_message"),
    )
    return with_full_address(added), report


def load_events(report: DataFrame, at: Column) -> DataFrame:
    """A load report (see ``bulk_ingest``) as status events of its files, for ``dataset_registry``."""
    return report.select(
        F.col("file_name").alias("id"), "status", "record_count", "error_message", at.alias("at")
    )


def dataset_registry(events: DataFrame) -> DataFrame:
    """Status events (id, status, record_count, error_message, at) -> latest state per id.

    ``processed_at`` is set once a load has completed or failed.
    """
    done = F.col("status").isin("completed", "failed")
    latest = F.max_by(F.struct("status", "record_count", "error_message", "at"), "at")
    rows = events.groupBy("id").agg(F.min("at").alias("uploaded_at"), latest.alias("l"))
    return rows.select("id", "uploaded_at", "l.*").withColumn(
        "processed_at", F.when(done, F.col("at"))
    ).drop("at")


def append_usage(usage: DataFrame, path: str, rows_a_file: int = 2_000_000) -> None:
    """Append metering rows to the log, one folder per day, so reports read few days.

    A day is written by as many tasks as its rows need; rows without a time go to a folder of
    their own."""
    dated = usage.withColumn("date", F.to_date("created_at"))
    # one row for each day of the load
    volume = dated.groupBy(F.col("date").alias("_day")).agg(
        F.ceil(F.count("*") / rows_a_file).alias("_parts")
    )
    sized = dated.join(F.broadcast(volume), F.col("date").eqNullSafe(F.col("_day")))
    spread = sized.withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    columns = [*usage.columns, "date"]
    spread.repartition("date", "_part").select(*columns).write.mode("append").partitionBy(
        "date"
    ).parquet(path)


def write_addresses(rows: DataFrame, path: str, salts: int = 16) -> None:
    """Store addresses by county, sorted by ZIP within files; a large county fills many files."""
    spread = F.pmod(F.xxhash64("hash"), F.lit(salts))
    (
        rows.repartition(F.col("county"), spread)
        .sortWithinPartitions("county", "postcode")
        .write.mode("append")
        .partitionBy("county")
        .parquet(path)
    )


def to_geojson(df: DataFrame, properties: list[str], geometry: Column) -> DataFrame:
    """One GeoJSON feature text per row, ``type`` first."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*properties).alias("properties"),
        geometry.alias("geometry"),
    )
    return df.withColumn("feature", F.to_json(feature, {"ignoreNullFields": "false"}))


def geometry_struct(kind: str, coordinates: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
