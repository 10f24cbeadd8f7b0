"""The plans of the joins: equi-joins only, filters and columns pushed to the scan."""

import re

import pytest

from pyspark.sql import functions as F

from waystone.operators.geocode import ranked_lists
from waystone.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = [
    "f01_lookup", "f02_search_zips", "f04_city_zips", "f06_resolve_states",
    "f09_search_addresses", "f12_geocode", "f13_component_tiers", "f14_search_with_fallback",
    "f17_zip_fallback", "g02_zip_distance", "g04_zips_within", "g05_addresses_within",
    "g06_nearest_addresses", "g07_cities_within", "g08_points_to_states",
    "g09_counties_in_boxes", "j01_authorize_requests", "j06_user_activity",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_pairwise_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in text
    assert "CartesianProduct" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(QUERIES["t01_top_k_per_query"](spark, SF))
    assert re.search(r"WindowGroupLimit .*Partial", text)


def test_usage_report_reads_few_columns_and_days(spark):
    text = plan(QUERIES["a06_endpoint_usage"](spark, SF))
    assert "GreaterThanOrEqual(ts," in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "props" not in schema


def test_report_is_one_scan(spark):
    for name in ("a07_user_metrics", "a08_system_analytics", "a13_usage_cards"):
        assert plan(QUERIES[name](spark, SF)).count("FileScan") == 1


def test_address_lists_are_cut_before_the_shuffle(spark, tmp_path):
    # 90 of 100 addresses lie in one ZIP; ids and lines are in opposite order.
    rows = [(i, f"{999 - i} MAIN ST", "70112" if i % 10 else f"{i:05d}") for i in range(100)]
    spark.createDataFrame(rows, "id int, full_address string, postcode string").repartition(
        4
    ).write.parquet(str(tmp_path / "a"))
    addresses = spark.read.parquet(str(tmp_path / "a"))
    asked = spark.createDataFrame([("70112",), ("00010",), ("none",), ("70112",)], "list_key string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lists = ranked_lists(addresses, F.array("postcode"), asked, 3)
        text = plan(lists)
        found = {r["list_key"]: sorted(x["id"] for x in r["records"]) for r in lists.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {"70112": [97, 98, 99], "00010": [10]}
    lines = text.splitlines()
    partial = next(i for i, x in enumerate(lines) if "WindowGroupLimit" in x and "Partial" in x)
    scan = next(i for i, x in enumerate(lines) if i > partial and "FileScan" in x)
    assert not any("Exchange" in x for x in lines[partial:scan])
