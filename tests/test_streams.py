"""Streams over several files and batches; restarts neither lose nor double rows."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from waystone.functions.text import key_hash
from waystone.operators import accounts as ac
from waystone.operators import usage as us
from waystone.streaming import flows

SCHEMA = (
    "id long, user_id long, endpoint string, status_code int, response_time_ms int, "
    "billable boolean, created_at timestamp_ntz"
)


def log(spark, first, n):
    start = datetime(2024, 1, 1)
    rows = [
        (i, 1 if i % 3 else i % 7, f"e{i % 2}", 200, i % 50, i % 4 > 0,
         start + timedelta(minutes=17 * i))
        for i in range(first, first + n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_rollup_and_counters_over_batches(spark, tmp_path):
    landing, out, counters = (str(tmp_path / n) for n in ("in", "out", "counters"))
    log(spark, 0, 300).coalesce(1).write.mode("append").parquet(landing)
    for first in (None, 300):
        if first:
            log(spark, first, 300).coalesce(1).write.mode("append").parquet(landing)
        flows.usage_rollup_stream(
            source(spark, landing), out, str(tmp_path / "check")
        ).awaitTermination()
        flows.counters_stream(
            source(spark, landing), counters, str(tmp_path / "check2")
        ).awaitTermination()
    got = {tuple(r) for r in flows.usage_rollup(spark, out).select(
        "user_id", "endpoint", "date", "total_calls", "billable_calls").collect()}
    batch = us.daily_rollup(log(spark, 0, 600)).select(
        "user_id", "endpoint", "date", "calls", "billable")
    assert got == {tuple(r) for r in batch.collect()}

    users = spark.createDataFrame(
        [(i, f"u{i}@x", "free", False) for i in range(7)],
        "id long, email string, plan_type string, is_admin boolean",
    )
    subs = spark.createDataFrame([(1, 100, True)], "user_id long, monthly_limit int, is_active boolean")
    live = flows.running_limits(spark, counters, users, subs, "2024-01-07")
    want = us.rate_limit_status(users, subs, log(spark, 0, 600), "2024-01-07")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, want.collect()))
    state = {r["user_id"]: r["within_limit"] for r in want.collect()}
    assert state[1] is False and state[2] is True


def test_ingest_stream_keeps_first_copies(spark, tmp_path):
    def feature(n, street):
        props = {"HOUSENUM": n, "ST_NAME": street, "USPS_CITY": "DAYTON", "ZIPCODE": "45410"}
        return {"type": "Feature", "properties": props,
                "geometry": {"type": "Point", "coordinates": [-84.0, 39.0]}}

    landing, path, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    landing.mkdir()
    for batch in range(3):
        features = [feature(n, "MAIN ST") for n in range(batch * 5, batch * 5 + 10)]
        doc = {"type": "FeatureCollection", "features": features + features[:2]}
        (landing / f"adams-{batch}.geojson").write_text(json.dumps(doc))
        flows.ingest_stream(
            spark, str(landing), path, check, "OH", files_per_batch=1
        ).awaitTermination()
    rows = spark.read.parquet(path)
    assert rows.count() == 20 and rows.select("hash").distinct().count() == 20
    assert {r["n"] for r in rows.groupBy("batch").agg(F.count("*").alias("n")).collect()} == {5, 10}
    assert rows.filter("full_address = '7 MAIN Street, DAYTON, OH, 45410'").count() == 1


def test_verdicts_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1), f"key{i % 5}", p) for i, p in enumerate(
        ["/geocode/1", "/addresses/2", "/admin/x", "/nothing", "/cities"] * 20)]
    requests = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, raw_key string, path string")
    keys = spark.createDataFrame(
        [(1, "key0", 1, ["*"], True), (2, "key1", 1, ["geocode"], True), (3, "key2", 2, ["*"], True),
         (4, "key3", 1, ["*"], False)],
        "id long, raw string, user_id long, permissions array<string>, is_active boolean",
    ).withColumn("key_hash", key_hash(F.col("raw")))
    users = spark.createDataFrame([(1, "free", True), (2, "pro", True)],
                                  "id long, plan_type string, is_active boolean")
    limits = spark.createDataFrame([(1, True), (2, False)], "user_id long, within_limit boolean")
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    requests.repartition(3).write.parquet(landing)
    stream = spark.readStream.schema(requests.schema).parquet(landing)
    flows.authorize_stream(stream, keys, users, limits, out, str(tmp_path / "c")).awaitTermination()
    got = {r["id"]: r["verdict"] for r in spark.read.parquet(out).collect()}
    want = ac.authorize_requests(requests, keys, users, limits)
    assert got == {r["id"]: r["verdict"] for r in want.collect()}
    assert set(got.values()) == {"ok", "forbidden", "over_limit", "invalid_key"}
