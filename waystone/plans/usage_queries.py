"""Usage reports, accounts and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import has_permission, key_hash, key_preview, row_limit
from ..operators import accounts as ac
from ..operators import topk
from ..operators import usage as us
from .registry import query

USAGE = ("usage_records",)
AS_OF, TODAY, MONTH = "2024-01-31", "2024-01-30", "2024-01"
_SINCE = "created_at >= date '2024-01-31' - interval 20 day"
_REPORT = """count(*) as total, count(*) filter (where billable) as billable,
       round(avg(response_time_ms), 3) as avg_time,
       count(*) filter (where status_code >= 200 and status_code < 400) as success_count,
       count(*) filter (where status_code >= 400) as error_count"""


@query(
    "a01_county_address_counts",
    "select county, count(*) as count from addresses group by county",
    ("addresses",),
)
def county_address_counts(t):
    return us.county_address_counts(t.addresses)


@query(
    "a02_county_summary",
    """
select count(*) as total_counties, cast(sum(address_count) as bigint) as total_addresses,
       avg(address_count) as avg_addresses_per_county, max(address_count)
         as max_addresses_per_county, min(address_count) as min_addresses_per_county
from counties""",
    ("counties",),
)
def county_summary(t):
    return us.county_summary(t.counties)


@query(
    "a03_dataset_stats",
    """
select 'total' as level, null as state, null as status, count(*) as datasets,
       cast(coalesce(sum(record_count), 0) as bigint) as records,
       cast(coalesce(sum(file_size), 0) as bigint) as storage from datasets
union all
select 'state', state, null, count(*), cast(sum(record_count) as bigint),
       cast(sum(file_size) as bigint) from datasets group by state
union all
select 'status', null, status, count(*), cast(sum(record_count) as bigint),
       cast(sum(file_size) as bigint) from datasets group by status""",
    ("datasets",),
)
def dataset_stats(t):
    return us.dataset_stats(t.datasets)


@query(
    "a04_usage_summary",
    """
with e as (select user_id, endpoint, count(*) as n, count(*) filter (where billable) as b
           from usage_records where strftime(created_at, '%Y-%m') = '2024-01'
           group by user_id, endpoint),
s as (select user_id, sum(n) as n, sum(b) as b,
             string_agg(concat(endpoint, '=', n), ',' order by endpoint) as breakdown
      from e group by user_id)
select s.user_id, '2024-01' as month, cast(n as bigint) as total_calls,
       cast(b as bigint) as billable_calls,
       round(cast(b as double) * coalesce(cast(price_per_call as double), 0) / 100, 4)
         as total_cost, breakdown
from s left join subscriptions p on s.user_id = p.user_id""",
    ("usage_records", "subscriptions"),
)
def usage_summary(t):
    rows = us.usage_summary(t.usage_records, t.subscriptions, MONTH)
    pairs = F.transform(
        F.map_entries("endpoint_breakdown"), lambda e: F.concat_ws("=", e["key"], e["value"])
    )
    return rows.select(
        "user_id", "month", "total_calls", "billable_calls",
        F.round("total_cost", 4).alias("total_cost"), F.array_join(pairs, ",").alias("breakdown"),
    )


@query(
    "a05_daily_usage",
    f"""
select user_id, cast(created_at as date) as date, count(*) as total_calls,
       count(*) filter (where billable) as billable_calls,
       count(distinct endpoint) as unique_endpoints
from usage_records where {_SINCE} group by user_id, cast(created_at as date)""",
    USAGE,
)
def daily_usage(t):
    return us.daily_usage(t.usage_records, AS_OF, 20)


@query(
    "a06_endpoint_usage",
    f"""
select user_id, endpoint, count(*) as total_calls,
       count(*) filter (where billable) as billable_calls,
       round(avg(response_time_ms), 3) as avg_response_time,
       count(*) filter (where status_code >= 200 and status_code < 300) as success_count,
       count(*) filter (where status_code >= 400) as error_count
from usage_records where {_SINCE} group by user_id, endpoint""",
    USAGE,
)
def endpoint_usage(t):
    return us.endpoint_usage(t.usage_records, AS_OF, 20).withColumn(
        "avg_response_time", F.round("avg_response_time", 3)
    )


@query(
    "a07_user_metrics",
    f"""
with u as (select *, cast(created_at as date) as date from usage_records where {_SINCE})
select user_id, null as endpoint, null as date, 'total' as level, {_REPORT} from u group by user_id
union all
select user_id, endpoint, null, 'endpoint', {_REPORT} from u group by user_id, endpoint
union all
select user_id, null, date, 'date', {_REPORT} from u group by user_id, date""",
    USAGE,
)
def user_metrics(t):
    return us.user_metrics(t.usage_records, AS_OF, 20).withColumn("avg_time", F.round("avg_time", 3))


@query(
    "a08_system_analytics",
    f"""
with u as (select *, cast(created_at as date) as date from usage_records where {_SINCE})
select null as endpoint, null as date, 'total' as level, {_REPORT} from u
union all
select endpoint, null, 'endpoint', {_REPORT} from u group by endpoint
union all
select null, date, 'date', {_REPORT} from u group by date""",
    USAGE,
)
def system_analytics(t):
    return us.system_analytics(t.usage_records, AS_OF, 20).withColumn(
        "avg_time", F.round("avg_time", 3)
    )


@query(
    "a09_admin_counters",
    f"""
select (select count(*) from users) as total_users,
       (select count(*) from api_keys where is_active) as active_keys,
       (select count(*) from usage_records where cast(created_at as date) = date '{TODAY}')
         as calls_today,
       (select count(*) from zips) as zip_codes""",
    ("users", "api_keys", "usage_records", "zips"),
)
def admin_counters(t):
    return us.admin_counters(t.users, t.api_keys, t.usage_records, t.zips, TODAY)


_LIMITS = f"""
with c as (
  select user_id, count(*) filter (where billable) as m,
         count(*) filter (where billable and created_at >= date '{TODAY}') as d
  from usage_records where created_at >= date '2024-01-01' group by user_id),
r as (
  select u.id as user_id, u.is_admin, coalesce(m, 0) as m, coalesce(d, 0) as d,
         coalesce(s.monthly_limit, case plan_type when 'starter' then 30000 when 'pro' then 500000
           when 'enterprise' then -1 else 3000 end) as ml,
         case plan_type when 'starter' then 5000 when 'pro' then 100000
           when 'enterprise' then -1 else 500 end as dl
  from users u left join (select user_id, monthly_limit from subscriptions where is_active) s
      on u.id = s.user_id left join c on u.id = c.user_id),
limits as (
  select user_id, case when is_admin then 0 else m end as current_usage,
         case when is_admin then 0 else d end as daily_usage,
         case when is_admin then -1 else ml end as monthly_limit,
         case when is_admin then -1 else dl end as daily_limit,
         is_admin or ml = -1 or dl = -1 or (m < ml and d < dl) as within_limit,
         case when is_admin or ml = -1 then -1 else ml - m end as remaining from r)
"""


@query(
    "a10_rate_limit_status",
    f"{_LIMITS} select * from limits",
    ("users", "subscriptions", "usage_records"),
)
def rate_limit_status(t):
    return us.rate_limit_status(t.users, t.subscriptions, t.usage_records, TODAY)


@query("a11_distinct_counties", "select distinct county from addresses", ("addresses",))
def distinct_counties(t):
    return us.distinct_values(t.addresses, "county")


@query(
    "a12_table_counts",
    """
select 'zips' as "table", count(*) as rows, count(*) > 0 as loaded from zips
union all select 'addresses', count(*), count(*) > 0 from addresses
union all select 'cities', count(*), count(*) > 0 from cities
union all select 'states', count(*), count(*) > 0 from states""",
    ("zips", "addresses", "cities", "states"),
)
def table_counts(t):
    return us.table_counts({n: getattr(t, n) for n in ("zips", "addresses", "cities", "states")})


@query(
    "a13_usage_cards",
    f"""
with u as (select *, cast(created_at as date) as date from usage_records where {_SINCE}),
d as (select user_id, date, count(*) as n, count(*) filter (where billable) as b
      from u group by user_id, date),
e as (select user_id, endpoint, avg(response_time_ms) as ms from u group by user_id, endpoint),
x as (select user_id, sum(n) as n, sum(b) as b, count(*) as days from d group by user_id),
y as (select user_id, avg(ms) as ms from e group by user_id)
select x.user_id, cast(n as bigint) as total_calls, cast(b as bigint) as billable_calls,
       cast(floor(n / days + 0.5) as bigint) as avg_calls_per_day,
       cast(floor(cast(b as double) / n * 100 + 0.5) as bigint) as billable_percent,
       cast(floor(ms + 0.5) as bigint) as avg_response_time
from x join y on x.user_id = y.user_id""",
    USAGE,
)
def usage_cards(t):
    return us.usage_cards(t.usage_records, AS_OF, 20)


@query(
    "a14_bootstrap_admin",
    """
select id, email, true as is_admin from users
where id = (select min(id) from users)
  and not exists (select 1 from users where is_admin and id % 50 <> 7)""",
    ("users",),
)
def bootstrap_admin(t):
    users = t.users.withColumn("is_admin", F.col("is_admin") & (F.col("id") % 50 != 7))
    return ac.bootstrap_admin(users).select("id", "email", "is_admin")


def keys(t):
    """Keys with hash and permissions; each key opens some of the endpoints."""
    granted = F.when(F.col("id") % 5 == 0, F.array(F.lit("*"))).when(
        F.col("id") % 5 == 1, F.array(F.lit("geocode"), F.lit("search"), F.lit("distance"))
    ).otherwise(F.array(F.lit("addresses"), F.lit("counties"), F.lit("cities"), F.lit("states")))
    return t.api_keys.select(
        "id", "user_id", "name", "is_active", "created_at",
        key_hash(F.col("raw_key")).alias("key_hash"),
        key_preview(F.col("raw_key")).alias("key_preview"),
        granted.alias("permissions"),
    )


_GRANTS = """
needs(no, endpoint, permission) as (values
  (0, 'geocode', 'geocode'), (1, 'search', 'search'), (2, 'distance', 'distance'),
  (3, 'nearby', 'distance'), (4, 'proximity', 'distance'), (5, 'addresses', 'addresses'),
  (6, 'search', 'search'), (7, 'search', 'search'), (8, 'cities', 'cities'),
  (9, 'states', 'states'), (10, 'admin', 'admin'), (11, 'unknown', null)),
grants(kind, permission) as (values
  (1, 'geocode'), (1, 'search'), (1, 'distance'), (2, 'addresses'), (2, 'counties'),
  (2, 'cities'), (2, 'states')),
allowed as (
  select r.id, n.endpoint, k.id as api_key_id, k.user_id, k.is_active and u.is_active as live,
         n.permission is not null and (k.id % 5 = 0 or exists (
           select 1 from grants g where g.kind = case when k.id % 5 = 1 then 1 else 2 end
             and g.permission = n.permission)) as granted
  from requests r join needs n on r.id % 12 = n.no
  left join api_keys k on r.raw_key = k.raw_key left join users u on k.user_id = u.id)
"""


@query(
    "j01_authorize_requests",
    f"""
with {_LIMITS.strip()[5:]},
{_GRANTS.strip()}
select a.id, case when live then a.user_id end as user_id,
       case when live then a.api_key_id end as api_key_id, endpoint,
       case when not coalesce(live, false) then 'invalid_key' when not l.within_limit
            then 'over_limit' when not granted then 'forbidden' else 'ok' end as verdict
from allowed a left join limits l on a.user_id = l.user_id""",
    ("requests", "api_keys", "users", "subscriptions", "usage_records"),
)
def authorize_requests(t):
    limits = us.rate_limit_status(t.users, t.subscriptions, t.usage_records, TODAY)
    return ac.authorize_requests(t.requests, keys(t), t.users, limits).drop("created_at")


@query(
    "f22_permissions",
    f"""
with {_GRANTS.strip()}
select id, endpoint, granted from allowed where api_key_id is not null""",
    ("requests", "api_keys", "users"),
)
def permissions(t):
    from ..functions.text import endpoint_of

    owned = keys(t).select(F.col("key_hash"), "permissions")
    rows = t.requests.withColumn("key_hash", key_hash(F.col("raw_key"))).join(owned, "key_hash")
    endpoint = endpoint_of(F.col("path"))
    return rows.select(
        "id", endpoint.alias("endpoint"),
        has_permission(F.col("permissions"), endpoint).alias("granted"),
    )


@query(
    "j02_key_inventory",
    """
select k.id, email as user_email, k.name,
       concat(substr(raw_key, 1, 11), '...', right(raw_key, 4)) as key_preview, k.is_active
from api_keys k join users u on k.user_id = u.id""",
    ("api_keys", "users"),
)
def key_inventory(t):
    return ac.key_inventory(keys(t), t.users).select(
        "id", "user_email", "name", "key_preview", "is_active"
    )


@query(
    "j06_user_activity",
    f"""
select u.id, email, plan_type,
  (select count(*) from usage_records r where r.user_id = u.id and billable
     and created_at >= date '2024-01-01') as monthly_usage,
  (select count(*) from usage_records r where r.user_id = u.id
     and created_at >= date '{TODAY}') as today_usage,
  (select count(*) from usage_records r where r.user_id = u.id) as total_usage,
  (select count(*) from api_keys k where k.user_id = u.id and k.is_active) as active_keys
from users u""",
    ("users", "usage_records", "api_keys"),
)
def user_activity(t):
    rows = us.user_activity(t.users, t.usage_records, t.api_keys, TODAY)
    return rows.select(
        "id", "email", "plan_type", "monthly_usage", "today_usage", "total_usage", "active_keys"
    )


@query(
    "j03_plan_limits",
    """
select u.id as user_id, coalesce(s.monthly_limit, case plan_type when 'starter' then 30000
         when 'pro' then 500000 when 'enterprise' then -1 else 3000 end) as monthly_limit
from users u left join (select user_id, monthly_limit from subscriptions where is_active) s
  on u.id = s.user_id where not u.is_admin""",
    ("users", "subscriptions"),
)
def plan_limits(t):
    none = t.usage_records.filter("false")
    rows = us.rate_limit_status(t.users.filter("not is_admin"), t.subscriptions, none, TODAY)
    return rows.select("user_id", "monthly_limit")


@query(
    "j05_existence",
    """
select id, exists (select 1 from api_keys k where k.user_id = u.id and k.is_active) as has_key
from users u""",
    ("users", "api_keys"),
)
def existence(t):
    active = t.api_keys.filter("is_active").select(F.col("user_id").alias("id"))
    users = t.users.select("id")
    yes = users.join(active, "id", "left_semi").withColumn("has_key", F.lit(True))
    no = users.join(active, "id", "left_anti").withColumn("has_key", F.lit(False))
    return yes.unionByName(no)


@query(
    "p18_call_cost",
    """
select r.id, round(case when billable then coalesce(cast(price_per_call as double), 0) else 0 end
         / 100, 6) as cost
from usage_records r left join subscriptions s on r.user_id = s.user_id""",
    ("usage_records", "subscriptions"),
)
def call_cost(t):
    price = t.subscriptions.select("user_id", "price_per_call")
    rows = topk.spread_join(t.usage_records, price, ["user_id"], "id", "left")
    cost = us.call_cost(F.col("billable").cast("int"), F.col("price_per_call"))
    return rows.select("id", F.round(cost, 6).alias("cost"))


@query(
    "f19_user_keys",
    """
select user_id, id, name from api_keys
where is_active and user_id in (select user_id from subscriptions)""",
    ("api_keys", "subscriptions"),
)
def user_keys(t):
    return ac.keys_of_users(t.subscriptions, t.api_keys).select("user_id", "id", "name")


@query(
    "f20_sync_admins",
    """
select id, email, 'enterprise' as plan_type, true as is_admin from users
where id % 4 = 0 and (not is_admin or plan_type <> 'enterprise')""",
    ("users",),
)
def sync_admins(t):
    emails = t.users.filter("id % 4 = 0").select(F.concat(F.lit(" "), "email").alias("email"))
    return ac.sync_admins(t.users, emails).select("id", "email", "plan_type", "is_admin")


@query(
    "t08_row_limits",
    """
select id, case when n <= 0 then 50 when n > 500 then 500 else n end as addresses,
       case when n <= 0 or n > 100 then 50 else n end as zips,
       case when n <= 0 then 10 when n > 100 then 100 else n end as cities,
       case when n <= 0 then 50 else n end as states
from (select id, record_count / 10 - 50 as f, cast(floor(record_count / 10.0) as int) - 50 as n
      from datasets) d""",
    ("datasets",),
)
def row_limits(t):
    asked = (F.floor(F.col("record_count") / 10).cast("int") - 50).alias("n")
    rows = t.datasets.select("id", asked)
    return rows.select(
        "id", *(row_limit(F.col("n"), kind).alias(kind)
                for kind in ("addresses", "zips", "cities", "states"))
    )
