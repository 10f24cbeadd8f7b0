"""Streams run to the end of the available data, compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as us
from ..session import scratch_path
from ..streaming import flows
from .registry import query
from .source_queries import _DATASET_ROWS, _feature_lines
from .usage_queries import _GRANTS, _LIMITS, TODAY, keys
from .views import VIEWS


def _stream(t, view: str):
    """A derived view over the events file, read as a stream."""
    schema = t.events.schema
    events = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    events.parquet(t.sf_dir).createOrReplaceTempView("events")
    return t.spark.sql(VIEWS[view][0])


@query(
    "r01_usage_rollup_stream",
    """
select user_id, endpoint, cast(created_at as date) as date, count(*) as total_calls,
       count(*) filter (where billable) as billable_calls,
       round(avg(response_time_ms), 3) as avg_response_time
from usage_records group by user_id, endpoint, cast(created_at as date)""",
    ("usage_records",),
)
def usage_rollup_stream(t):
    path, check = scratch_path(t.spark, "rollup"), scratch_path(t.spark, "rollup-check")
    flows.usage_rollup_stream(_stream(t, "usage_records"), path, check).awaitTermination()
    return flows.usage_rollup(t.spark, path).withColumn(
        "avg_response_time", F.round("avg_response_time", 3)
    )


@query(
    "r02_authorize_stream",
    f"""
with {_LIMITS.strip()[5:]},
{_GRANTS.strip()}
select a.id, endpoint, case when not coalesce(live, false) then 'invalid_key'
         when not l.within_limit then 'over_limit' when not granted then 'forbidden'
         else 'ok' end as verdict
from allowed a left join limits l on a.user_id = l.user_id""",
    ("requests", "api_keys", "users", "subscriptions", "usage_records"),
)
def authorize_stream(t):
    path, check = scratch_path(t.spark, "verdicts"), scratch_path(t.spark, "verdicts-check")
    limits = us.rate_limit_status(t.users, t.subscriptions, t.usage_records, TODAY)
    known, owners = keys(t), t.users
    flows.authorize_stream(
        _stream(t, "requests"), known, owners, limits, path, check
    ).awaitTermination()
    return t.spark.read.parquet(path).select("id", "endpoint", "verdict")


@query(
    "r03_running_limits",
    f"{_LIMITS} select user_id, current_usage, daily_usage, within_limit, remaining from limits",
    ("users", "subscriptions", "usage_records"),
)
def running_limits(t):
    path, check = scratch_path(t.spark, "counters"), scratch_path(t.spark, "counters-check")
    users, subscriptions = t.users, t.subscriptions
    flows.counters_stream(_stream(t, "usage_records"), path, check).awaitTermination()
    return flows.running_limits(t.spark, path, users, subscriptions, TODAY).select(
        "user_id", "current_usage", "daily_usage", "within_limit", "remaining"
    )


@query(
    "r04_ingest_stream",
    f"""
with {_DATASET_ROWS.strip()}
select concat(house_number, '|', street, '|', unit, '|', city, '|', postcode) as hash,
       'Hamilton' as county, count(distinct city) as n
from rows_ group by 1""",
    ("addresses",),
)
def ingest_stream(t):
    landing, path = scratch_path(t.spark, "landing"), scratch_path(t.spark, "landed")
    check = scratch_path(t.spark, "landing-check")
    _feature_lines(t).select("value").repartition(4).write.text(landing)
    flows.ingest_stream(
        t.spark, landing, path, check, "OH", county="Hamilton", files_per_batch=2
    ).awaitTermination()
    return t.spark.read.parquet(path).groupBy("hash", "county").agg(F.count("*").alias("n"))
