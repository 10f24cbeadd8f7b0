"""Reports on the metering log.

All reports read one rollup: counts and sums per (user, endpoint, day), built in
a single pass with map-side aggregation. A user or endpoint that holds a large
share of the log shrinks to one row per day before anything is shuffled; what
follows works on the rollup only. Dates are explicit: no report reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import row_limit

_SUMS = ("calls", "billable", "time_ms", "timed", "ok_200", "ok_300", "errors")


def daily_rollup(usage: DataFrame) -> DataFrame:
    """(user_id, endpoint, date) -> additive counts and sums."""

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    status = F.col("status_code")
    return usage.groupBy("user_id", "endpoint", F.to_date("created_at").alias("date")).agg(
        F.count("*").alias("calls"),
        count(F.col("billable")).alias("billable"),
        F.sum(F.col("response_time_ms").cast("long")).alias("time_ms"),
        F.count("response_time_ms").alias("timed"),
        count((status >= 200) & (status < 300)).alias("ok_200"),
        count((status >= 300) & (status < 400)).alias("ok_300"),
        count(status >= 400).alias("errors"),
    )


def _sum(name: str, where: Column | None = None) -> Column:
    value = F.col(name) if where is None else F.when(where, F.col(name))
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def _mean_ms() -> Column:
    return F.coalesce(F.try_divide(F.sum("time_ms"), F.sum("timed")), F.lit(0.0)).cast("double")


def since(usage: DataFrame, as_of: str, days: int | None, limit: str | None = None) -> DataFrame:
    """Rows from ``days`` days before the date on, 30 if none are given; reaches the parquet
    scan. ``limit`` names the row limit (see ``row_limit``) that holds for the administrators'
    reports; what users see of their own has no upper limit."""
    asked = F.lit(days).cast("int")
    asked = row_limit(asked, limit) if limit else F.when(asked > 0, asked).otherwise(30)
    start = F.date_sub(F.lit(as_of).cast("date"), asked).cast("timestamp_ntz")
    return usage.filter(F.col("created_at") >= start)


def daily_usage(usage: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per user and day: calls, billable calls, distinct endpoints."""
    return (
        daily_rollup(since(usage, as_of, days))
        .groupBy("user_id", "date")
        .agg(
            _sum("calls").alias("total_calls"),
            _sum("billable").alias("billable_calls"),
            F.count("*").alias("unique_endpoints"),
        )
    )


def endpoint_usage(usage: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per user and endpoint; success is 200-299."""
    return (
        daily_rollup(since(usage, as_of, days))
        .groupBy("user_id", "endpoint")
        .agg(
            _sum("calls").alias("total_calls"),
            _sum("billable").alias("billable_calls"),
            _mean_ms().alias("avg_response_time"),
            _sum("ok_200").alias("success_count"),
            _sum("errors").alias("error_count"),
        )
    )


def _report() -> list[Column]:
    """Success is 200-399 in the wide reports."""
    return [
        _sum("calls").alias("total"),
        _sum("billable").alias("billable"),
        _mean_ms().alias("avg_time"),
        (_sum("ok_200") + _sum("ok_300")).alias("success_count"),
        _sum("errors").alias("error_count"),
    ]


def user_metrics(usage: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per user: totals, by endpoint and by day, told apart by ``level``."""
    u, e, d = F.col("user_id"), F.col("endpoint"), F.col("date")
    return (
        daily_rollup(since(usage, as_of, days, "days"))
        .groupingSets([[u], [u, e], [u, d]], u, e, d)
        .agg(F.grouping_id().alias("_set"), *_report())
        .withColumn("level", _level({3: "total", 1: "endpoint", 2: "date"}))
        .drop("_set")
    )


def system_analytics(usage: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """The same over all users."""
    e, d = F.col("endpoint"), F.col("date")
    rolled = daily_rollup(since(usage, as_of, days, "days")).groupBy("endpoint", "date")
    rolled = rolled.agg(*(F.sum(c).alias(c) for c in _SUMS))
    return (
        rolled.groupingSets([[], [e], [d]], e, d)
        .agg(F.grouping_id().alias("_set"), *_report())
        .withColumn("level", _level({3: "total", 1: "endpoint", 2: "date"}))
        .drop("_set")
    )


def _level(names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for number, name in names.items():
        out = F.when(F.col("_set") == number, name).otherwise(out)
    return out


def usage_summary(usage: DataFrame, subscriptions: DataFrame, month: str) -> DataFrame:
    """One month ('yyyy-MM') per user: calls, cost, endpoint -> calls."""
    start = F.to_date(F.lit(f"{month}-01")).cast("timestamp_ntz")
    stop = F.add_months(F.to_date(F.lit(f"{month}-01")), 1).cast("timestamp_ntz")
    in_month = usage.filter((F.col("created_at") >= start) & (F.col("created_at") < stop))
    per_endpoint = (
        daily_rollup(in_month)
        .groupBy("user_id", "endpoint")
        .agg(_sum("calls").alias("calls"), _sum("billable").alias("billable"))
    )
    totals = per_endpoint.groupBy("user_id").agg(
        _sum("calls").alias("total_calls"),
        _sum("billable").alias("billable_calls"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("endpoint", "calls")))).alias(
            "endpoint_breakdown"
        ),
    )
    price = subscriptions.select("user_id", "price_per_call")
    return totals.join(price, "user_id", "left").select(
        "user_id",
        F.lit(month).alias("month"),
        "total_calls",
        "billable_calls",
        call_cost(F.col("billable_calls"), F.col("price_per_call")).alias("total_cost"),
        "endpoint_breakdown",
    )


def call_cost(billable: Column, cents_per_call: Column) -> Column:
    """Billable calls -> cost, price in hundredths; no price means no cost."""
    return (billable * F.coalesce(cents_per_call, F.lit(0)) / 100).cast("double")


def _limit(plan: Column, place: int) -> Column:
    out = F.lit(lx.DEFAULT_PLAN_LIMITS[place])
    for name, limits in lx.PLAN_LIMITS.items():
        out = F.when(plan == name, limits[place]).otherwise(out)
    return out


def _counters(rollup: DataFrame, as_of: str) -> DataFrame:
    """Per user: billable this month, billable today, calls today, calls ever."""
    day = F.lit(as_of).cast("date")
    this_month = F.col("date") >= F.trunc(day, "month")
    today = F.col("date") >= day
    return rollup.groupBy("user_id").agg(
        _sum("billable", this_month).alias("month_billable"),
        _sum("billable", today).alias("day_billable"),
        _sum("calls", today).alias("day_calls"),
        _sum("calls").alias("all_calls"),
    )


def rate_limit_status(
    users: DataFrame,
    subscriptions: DataFrame,
    usage: DataFrame,
    as_of: str,
    admin_emails: list[str] | None = None,
) -> DataFrame:
    """Per user: usage against the plan; -1 is unlimited, admins always are.

    An active subscription replaces the monthly figure only.
    """
    month_start = F.trunc(F.lit(as_of).cast("date"), "month").cast("timestamp_ntz")
    rollup = daily_rollup(usage.filter(F.col("created_at") >= month_start))
    return rate_limits_of_rollup(users, subscriptions, rollup, as_of, admin_emails)


def rate_limits_of_rollup(
    users: DataFrame,
    subscriptions: DataFrame,
    rollup: DataFrame,
    as_of: str,
    admin_emails: list[str] | None = None,
) -> DataFrame:
    """The same from a rollup (any sum of ``daily_rollup`` parts)."""
    counts = _counters(rollup, as_of)
    active = subscriptions.filter("is_active").select("user_id", "monthly_limit")
    rows = (
        users.withColumnRenamed("id", "user_id")
        .join(active, "user_id", "left")
        .join(counts, "user_id", "left")
    )
    admin = F.col("is_admin")
    if admin_emails:
        admin = admin | F.col("email").isin([e.strip() for e in admin_emails])
    used = F.coalesce("month_billable", F.lit(0))
    used_today = F.coalesce("day_billable", F.lit(0))
    monthly = F.coalesce(F.col("monthly_limit"), _limit(F.col("plan_type"), 0))
    daily = _limit(F.col("plan_type"), 1)
    unlimited = (monthly == -1) | (daily == -1)
    return rows.select(
        "user_id",
        F.when(admin, 0).otherwise(used).cast("long").alias("current_usage"),
        F.when(admin, 0).otherwise(used_today).cast("long").alias("daily_usage"),
        F.when(admin, -1).otherwise(monthly).alias("monthly_limit"),
        F.when(admin, -1).otherwise(daily).alias("daily_limit"),
        (admin | unlimited | ((used < monthly) & (used_today < daily))).alias("within_limit"),
        F.when(admin | (monthly == -1), -1).otherwise(monthly - used).cast("long")
        .alias("remaining"),
    )


def user_activity(users: DataFrame, usage: DataFrame, keys: DataFrame, as_of: str) -> DataFrame:
    """User list with month, day and overall usage and the number of active keys."""
    counts = _counters(daily_rollup(usage), as_of)
    active = keys.filter("is_active").groupBy("user_id").agg(F.count("*").alias("active_keys"))
    rows = users.withColumnRenamed("id", "user_id").join(counts, "user_id", "left")
    rows = rows.join(active, "user_id", "left")

    def number(name: str, alias: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("long").alias(alias)

    return rows.select(
        F.col("user_id").alias("id"),
        *(c for c in users.columns if c != "id"),
        number("month_billable", "monthly_usage"),
        number("day_calls", "today_usage"),
        number("all_calls", "total_usage"),
        number("active_keys", "active_keys"),
    )


def admin_counters(
    users: DataFrame, keys: DataFrame, usage: DataFrame, zips: DataFrame, as_of: str
) -> DataFrame:
    """Four counters in one row: users, active keys, calls on the day, ZIPs."""
    start = F.lit(as_of).cast("date").cast("timestamp_ntz")
    stop = F.date_add(F.lit(as_of).cast("date"), 1).cast("timestamp_ntz")
    today = usage.filter((F.col("created_at") >= start) & (F.col("created_at") < stop))
    parts = {
        "total_users": users,
        "active_keys": keys.filter("is_active"),
        "calls_today": today,
        "zip_codes": zips,
    }
    counts = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts.agg(
        *(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in parts)
    )


def usage_cards(usage: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Dashboard figures per user.

    Calls per day count days with data only; the mean response time is the
    plain mean of the endpoints' means. Both are rounded to whole numbers,
    halves up.
    """
    known = since(usage, as_of, days).filter(F.col("user_id").isNotNull())
    rolled = daily_rollup(known)
    # One pass gives a row for each day and one for each endpoint of a user.
    sets = [[F.col("user_id"), F.col("date")], [F.col("user_id"), F.col("endpoint")]]
    both = rolled.groupingSets(sets, "user_id", "date", "endpoint").agg(
        (F.grouping("date") == 0).alias("is_day"), _sum("calls").alias("calls"),
        _sum("billable").alias("billable"), _mean_ms().alias("mean_ms"),
    )

    is_day = F.col("is_day")
    calls, billable = _sum("calls", is_day), _sum("billable", is_day)
    return both.groupBy("user_id").agg(
        calls.alias("total_calls"),
        billable.alias("billable_calls"),
        F.floor(calls / F.count_if(is_day) + 0.5).alias("avg_calls_per_day"),
        F.floor(billable / calls * 100 + 0.5).alias("billable_percent"),
        F.floor(F.avg(F.when(~is_day, F.col("mean_ms"))) + 0.5).alias("avg_response_time"),
    )


# ------------------------------------------------------------ datasets, counties


def county_address_counts(addresses: DataFrame) -> DataFrame:
    return addresses.groupBy("county").agg(F.count("*").alias("count"))


def county_summary(counties: DataFrame) -> DataFrame:
    n = F.col("address_count")
    return counties.agg(
        F.count("*").alias("total_counties"),
        F.sum(n).alias("total_addresses"),
        F.avg(n).alias("avg_addresses_per_county"),
        F.max(n).alias("max_addresses_per_county"),
        F.min(n).alias("min_addresses_per_county"),
    )


def dataset_stats(datasets: DataFrame) -> DataFrame:
    """Totals, by state and by status, told apart by ``level``."""
    state, status = F.col("state"), F.col("status")
    base = datasets.groupBy("state", "status").agg(
        F.count("*").alias("n"),
        F.sum(F.col("record_count").cast("long")).alias("records"),
        F.sum("file_size").alias("size"),
    )
    return (
        base.groupingSets([[], [state], [status]], state, status)
        .agg(
            F.grouping_id().alias("_set"),
            _sum("n").alias("datasets"),
            _sum("records").alias("records"),
            _sum("size").alias("storage"),
        )
        .withColumn("level", _level({3: "total", 1: "state", 2: "status"}))
        .drop("_set")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, loaded): the state of every table in one result."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("loaded", F.col("rows") > 0)
