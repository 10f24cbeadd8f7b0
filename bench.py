"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: data folder, BENCH_CPUS: local cores, BENCH_QUERIES: comma list.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from waystone.plans.catalogue import QUERIES
from waystone.session import configure

HEADLINE = [
    "p08_full_address",
    "p11_parse_addresses",
    "f12_geocode",
    "f09_search_addresses",
    "f14_search_with_fallback",
    "g02_zip_distance",
    "g04_zips_within",
    "g05_addresses_within",
    "g06_nearest_addresses",
    "g08_points_to_states",
    "a07_user_metrics",
    "a08_system_analytics",
    "a10_rate_limit_status",
    "j01_authorize_requests",
    "s05_read_address_collection",
    "s10_upsert",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    builder = configure(builder).config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", cpus)
    spark = builder.config("spark.driver.memory", "16g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["a01_county_address_counts"](spark, sf_dir).collect()  # start the session
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
