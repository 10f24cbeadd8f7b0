"""Location tables derived from the driver's parquet tables.

Each text runs unchanged in Spark SQL and in DuckDB, so a query and its SQL
check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# name -> (SQL, names of views it reads)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "zips": (
        """
select lpad(cast(10000 + c_custkey as varchar(10)), 5, '0') as zip_code, c_custkey as k,
       concat('City ', cast(c_nationkey as varchar(10))) as city_name,
       case c_nationkey % 5 when 0 then 'OH' when 1 then 'CA' when 2 then 'NY'
            when 3 then 'TX' else 'WA' end as state_code,
       38  + (c_custkey * 37 % 400) / cast(100 as double) as lat,
       -85 + (c_custkey * 91 % 500) / cast(100 as double) as lng,
       c_acctbal as population
from customer""",
        (),
    ),
    "addresses": (
        """
select o_orderkey as id, cast(o_orderkey % 900 + 1 as varchar(10)) as house_number,
       concat(case o_custkey % 5 when 0 then 'MAIN' when 1 then 'OAKLEY' when 2 then 'HIGH'
                   when 3 then 'PARK' else 'ELM' end, ' ',
              case o_orderkey % 4 when 0 then 'DR' when 1 then 'RD' when 2 then 'AVE'
                   else 'ST' end) as street,
       case when o_orderkey % 7 = 0 then concat('UNIT ', cast(o_orderkey % 3 as varchar(10)))
            else '' end as unit,
       concat('CITY ', cast(o_custkey % 25 as varchar(10))) as city,
       case when o_orderkey % 11 = 0 then '' else 'OH' end as region,
       lpad(cast(10000 + o_custkey % 150 as varchar(10)), 5, '0') as postcode,
       concat('County ', cast(o_custkey % 8 as varchar(10))) as county,
       38  + (o_custkey * 37 % 400) / cast(100 as double) as latitude,
       -85 + (o_custkey * 91 % 500) / cast(100 as double) as longitude
from orders""",
        (),
    ),
    # Stored line of an address, spelled out for the four suffixes in use.
    "address_lines": (
        """
select *, concat(house_number, ' ', substr(street, 1, length(street) - length(suffix)),
                 case suffix when 'DR' then 'Drive' when 'RD' then 'Road'
                      when 'AVE' then 'Avenue' else 'Street' end,
                 case when unit = '' then '' else concat(' ', unit) end,
                 ', ', city, ', OH, ', postcode) as full_address
from (select *, case id % 4 when 0 then 'DR' when 1 then 'RD' when 2 then 'AVE'
                else 'ST' end as suffix from addresses) s""",
        ("addresses",),
    ),
    # What a user asks for: the parts, and how they are written down.
    "question_parts": (
        """
select qid, form, house, name, kind, short_kind, city_no, zip_code,
       case when form = 6 then '' when form in (3, 7, 9) then '' else house end as x_house,
       case when form = 6 then concat('City ', city_no) when form = 8 then concat(name, ' Drive')
            when form = 9 then concat(substr(name, 2, 9), ' Drive')
            when form = 10 then '' when form = 7 then concat(name, ' ', kind)
            else concat(name, ' ', kind) end as x_street,
       case when form in (0, 1, 2, 3, 4) then concat('City ', city_no)
            when form in (8, 9) then 'City' else '' end as x_city,
       case when form in (5, 7, 8, 9, 10) then '' else 'OH' end as x_state,
       case when form in (0, 1, 2, 6, 10) then zip_code else '' end as x_zip
from (
  select c_custkey as qid, c_custkey % 11 as form,
         cast(c_custkey * 7 % 900 + 1 as varchar(10)) as house,
         case floor(c_custkey / 11.0) % 6 when 0 then 'Main' when 1 then 'Oakley' when 2 then 'High'
              when 3 then 'Park' when 4 then 'Elm' else 'Birch' end as name,
         case floor(c_custkey / 66.0) % 6 when 0 then 'DR' when 1 then 'Road' when 2 then 'ave.'
              when 3 then 'st' when 4 then 'Drive' else 'RD' end as kind,
         case floor(c_custkey / 66.0) % 6 when 0 then 'dr' when 1 then 'rd' when 2 then 'ave'
              when 3 then 'st' when 4 then 'dr' else 'rd' end as short_kind,
         cast(case when c_custkey % 9 = 0 then c_custkey % 160 % 25 + 1
                   when c_custkey % 13 = 0 then 99
                   else c_custkey % 160 % 25 end as varchar(10)) as city_no,
         lpad(cast(10000 + c_custkey % 160 as varchar(10)), 5, '0') as zip_code
  from customer) c""",
        (),
    ),
    "questions": (
        """
select qid, x_house, x_street, x_city, x_state, x_zip, form, short_kind,
       case form
         when 0 then concat(house, ' ', x_street, ', ', x_city, ', OH ', zip_code)
         when 1 then concat(house, ' ', x_street, ', ', x_city, ' OH ', zip_code)
         when 2 then concat(house, ' ', x_street, ' ', x_city, ' OH ', zip_code)
         when 3 then concat(x_street, ', ', x_city, ', OH')
         when 4 then concat(house, ' ', x_street, ' #B2, ', x_city, ', OH')
         when 5 then concat('  ', house, ' ', x_street, ' ')
         when 6 then concat(x_street, ', OH ', zip_code)
         when 7 then x_street
         when 8 then concat(house, ' ', x_street, ', City')
         when 9 then concat(x_street, ', City')
         else zip_code end as q,
       case form
         when 0 then concat(house, ' ', x_street, ', ', x_city, ', OH ', zip_code)
         when 1 then concat(house, ' ', x_street, ', ', x_city, ' OH ', zip_code)
         when 2 then concat(house, ' ', x_street, ' ', x_city, ' OH ', zip_code)
         when 3 then concat(x_street, ', ', x_city, ', OH')
         when 4 then concat(house, ' ', x_street, ', ', x_city, ', OH')
         when 5 then concat(house, ' ', x_street)
         when 6 then concat(x_street, ', OH ', zip_code)
         when 7 then x_street
         when 8 then concat(house, ' ', x_street, ', City')
         when 9 then concat(x_street, ', City')
         else zip_code end as clean_q
from (select qid, form, house, zip_code, short_kind,
             case when form = 10 then '' when form in (3, 7, 9) then ''
                  when form = 6 then '' else x_house end as x_house,
             x_street, x_city, x_state, x_zip from question_parts) p""",
        ("question_parts",),
    ),
    "cities": (
        """
select s_suppkey as id, concat('City ', cast(s_suppkey % 25 as varchar(10)), ' ', s_name) as city,
       concat('City ', cast(s_suppkey % 25 as varchar(10)), ' ', s_name) as city_ascii,
       case s_nationkey % 5 when 0 then 'OH' when 1 then 'CA' when 2 then 'NY'
            when 3 then 'TX' else 'WA' end as state_id,
       case s_nationkey % 5 when 0 then 'Ohio' when 1 then 'California' when 2 then 'New York'
            when 3 then 'Texas' else 'Washington' end as state_name,
       concat('County ', cast(s_suppkey % 8 as varchar(10))) as county_name,
       38  + (s_suppkey * 37 % 400) / cast(100 as double) as lat,
       -85 + (s_suppkey * 91 % 500) / cast(100 as double) as lng,
       case when s_suppkey % 10 = 0 then null else cast(floor(s_acctbal) as int) end as population,
       cast(s_suppkey % 5 as int) as ranking,
       concat(lpad(cast(10000 + s_suppkey % 150 as varchar(10)), 5, '0'), ' ',
              lpad(cast(10000 + (s_suppkey + 25) % 150 as varchar(10)), 5, '0'), ' ',
              lpad(cast(10000 + (s_suppkey + 50) % 150 as varchar(10)), 5, '0')) as zips
from supplier""",
        (),
    ),
    "states": (
        """
select cast(n_nationkey as bigint) as id,
       lpad(cast(n_nationkey + 1 as varchar(10)), 2, '0') as state_fips,
       concat(substr('ABCDE', n_nationkey % 5 + 1, 1),
              substr('VWXYZ', cast(floor(n_nationkey / 5.0) as int) + 1, 1)) as state_abbr,
       concat('State ', n_name) as state_name,
       cast(n_regionkey as varchar(10)) as region,
       cast(n_nationkey % 3 as varchar(10)) as division
from nation""",
        (),
    ),
    # 25 L-shaped polygons, as edges.
    "state_edges": (
        """
select id, seq, bx + dx1 as x1, by_ + dy1 as y1, bx + dx2 as x2, by_ + dy2 as y2
from (select cast(n_nationkey as bigint) as id, n_nationkey % 5 - cast(85 as double) as bx,
             38 + floor(n_nationkey / cast(5 as double)) as by_, 1 as seq, 0 as dx1, 0 as dy1,
             1 as dx2, 0 as dy2 from nation
      union all select n_nationkey, n_nationkey % 5 - cast(85 as double),
             38 + floor(n_nationkey / cast(5 as double)), 2, 1, 0, 1, 0.5 from nation
      union all select n_nationkey, n_nationkey % 5 - cast(85 as double),
             38 + floor(n_nationkey / cast(5 as double)), 3, 1, 0.5, 0.5, 0.5 from nation
      union all select n_nationkey, n_nationkey % 5 - cast(85 as double),
             38 + floor(n_nationkey / cast(5 as double)), 4, 0.5, 0.5, 0.5, 1 from nation
      union all select n_nationkey, n_nationkey % 5 - cast(85 as double),
             38 + floor(n_nationkey / cast(5 as double)), 5, 0.5, 1, 0, 1 from nation
      union all select n_nationkey, n_nationkey % 5 - cast(85 as double),
             38 + floor(n_nationkey / cast(5 as double)), 6, 0, 1, 0, 0 from nation) e""",
        (),
    ),
    # One county per supplier: a rectangle with a notch, and an address count.
    "counties": (
        """
select s_suppkey as id, concat('County ', s_name) as county_name,
       cast(floor(s_acctbal) as int) as address_count,
       -85 + (s_suppkey * 91 % 500) / cast(100 as double) as x0,
       38  + (s_suppkey * 37 % 400) / cast(100 as double) as y0,
       0.1 + cast(s_suppkey % 5 as double) / 10 as w, 0.1 + cast(s_suppkey % 3 as double) / 10 as h
from supplier""",
        (),
    ),
    "usage_records": (
        """
select event_id as id, user_id, user_id * 2 + event_id % 2 as api_key_id, event_type as endpoint,
       case when event_type = 'error' then 500 when event_id % 10 = 0 then 404
            when event_id % 10 = 1 then 301 else 200 end as status_code,
       cast(floor(value) as int) as response_time_ms, event_type <> 'error' as billable,
       ts as created_at
from events""",
        (),
    ),
    "users": (
        """
select user_id as id, concat('user', cast(user_id as varchar(10)), '@example.org') as email,
       concat('User ', cast(user_id as varchar(10))) as name,
       case user_id % 5 when 0 then 'enterprise' when 1 then 'pro' when 2 then 'starter'
            when 3 then 'free' else 'trial' end as plan_type,
       user_id % 17 <> 0 as is_active, user_id % 50 = 7 as is_admin,
       min(ts) as created_at
from events group by user_id""",
        (),
    ),
    "subscriptions": (
        """
select id as user_id, plan_type, cast(id % 7 + 1 as int) as monthly_limit,
       cast(id % 4 * 0.25 as decimal(10, 6)) as price_per_call, id % 3 <> 0 as is_active
from users where id % 2 = 0""",
        ("users",),
    ),
    "api_keys": (
        """
select id * 2 + n as id, id as user_id, concat('Key ', cast(n as varchar(10))) as name,
       concat('sk_live_', cast(id * 2 + n as varchar(10)), '_secret') as raw_key,
       (id + n) % 6 <> 0 as is_active, created_at, n
from (select id, created_at, 0 as n from users
      union all select id, created_at, 1 as n from users) u""",
        ("users",),
    ),
    "requests": (
        """
select event_id as id, ts as created_at,
       case when event_id % 23 = 0 then 'sk_live_unknown'
            else concat('sk_live_', cast(user_id * 2 + event_id % 2 as varchar(10)), '_secret')
            end as raw_key,
       case event_id % 12 when 0 then '/api/v1/geocode/45050' when 1 then '/api/v1/search'
            when 2 then '/api/v1/distance/1/2' when 3 then '/api/v1/nearby/45050'
            when 4 then '/api/v1/proximity/1/2' when 5 then '/api/v1/addresses/7'
            when 6 then '/api/v1/addresses/search' when 7 then '/api/v1/counties/bounds/search'
            when 8 then '/api/v1/cities' when 9 then '/api/v1/states/lookup'
            when 10 then '/api/v1/admin/stats' else '/api/v1/health' end as path
from events""",
        (),
    ),
    "datasets": (
        """
select p_partkey as id, concat('dataset ', p_name) as name,
       case p_size % 4 when 0 then 'OH' when 1 then 'CA' when 2 then 'ny' else 'TX' end as state,
       concat('County ', cast(p_partkey % 88 as varchar(10))) as county,
       cast(floor(p_retailprice * 1000) as bigint) as file_size,
       cast(p_size * 100 as int) as record_count,
       case p_partkey % 7 when 0 then 'failed' when 1 then 'pending' when 2 then 'processing'
            else 'completed' end as status,
       p_partkey * 7919 % 100003 as uploaded_at
from part""",
        (),
    ),
}


def needed(*names: str) -> list[str]:
    """The named views and all they read, in building order."""
    order: list[str] = []
    for name in names:
        for dep in (*needed(*VIEWS[name][1]), name):
            if dep not in order:
                order.append(dep)
    return order


def ctes(*names: str) -> str:
    """``with`` list defining the named views, for an SQL check."""
    return "with " + ",\n".join(f"{name} as ({VIEWS[name][0]})" for name in needed(*names))


RAW = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame; Catalyst sees through to the parquet scan."""
    text = f"{ctes(name)}\nselect * from {name}"
    for raw in RAW:
        if raw in text:
            spark.read.parquet(f"{sf_dir}/{raw}.parquet").createOrReplaceTempView(raw)
    return spark.sql(text)
