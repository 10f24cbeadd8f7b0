"""Registered queries beside their SQL on the smallest data.

A quick choice by default; WAYSTONE_ALL=1 runs every query.
"""

import os

import pytest
from compare import compare, connect

from waystone.operators.search import search_states
from waystone.operators.usage import daily_usage, system_analytics, user_metrics
from waystone.plans.catalogue import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"
QUICK = [
    "a01_county_address_counts", "a03_dataset_stats", "a04_usage_summary", "a07_user_metrics",
    "a08_system_analytics", "a10_rate_limit_status", "a13_usage_cards", "f01_lookup",
    "f04_city_zips", "f06_resolve_states", "f20_sync_admins", "g02_zip_distance",
    "g08_points_to_states", "g09_counties_in_boxes", "j01_authorize_requests",
    "j06_user_activity", "p07_expand_street", "p08_full_address", "p10_strip_unit",
    "p13_query_variants", "s10_upsert", "s16_wkt", "t02_page_with_total",
]
NAMES = list(QUERIES) if os.environ.get("WAYSTONE_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SF) == ""


@pytest.mark.parametrize("name", ["f22_geocode_summary_of_all", "f23_search_zips_of_all"])
def test_queries_name_what_has_no_answer(spark, con, name):
    assert compare(spark, con, name, SF) == ""


def test_searches_without_a_match_have_total_0(spark):
    asked = spark.createDataFrame([(1, "oak"), (2, "nowhere"), (3, "nowhere")], "qid int, name string")
    states = spark.createDataFrame([(1, "Oakland", "OK", "1", "2")],
                                   "id int, state_name string, state_abbr string, region string, division string")
    found = search_states(asked, states, unmatched=True).collect()
    assert {(r["qid"], r["total"], r["id"]) for r in found} == {(1, 1, 1), (2, 0, None), (3, 0, None)}


def test_days_of_reports_have_a_limit(spark):
    usage = spark.range(501).selectExpr(
        "1 as user_id", "'x' as endpoint", "true as billable", "5 as response_time_ms", "200 as status_code",
        "cast(date_sub(date'2024-06-30', cast(id as int)) as timestamp_ntz) as created_at")

    def days(report):
        return [report(usage, "2024-06-30", d).filter("date is not null").count()
                for d in (7, 365, 366, 0, None)]

    assert days(user_metrics) == days(system_analytics) == [8, 366, 31, 31, 31]
    assert days(daily_usage) == [8, 366, 367, 31, 31]  # a user's own report has no upper limit


def test_every_query_has_a_check():
    assert set(CHECKS) == set(QUERIES)
