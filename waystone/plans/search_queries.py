"""Lookups, filtered searches, listings and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import search as se
from ..operators import topk
from .registry import query
from .spatial_queries import _h


@query(
    "f01_lookup",
    """
select r.o_orderkey as key_id, z.zip_code is not null as found, z.city_name
from orders r left join zips z on lpad(cast(10000 + o_custkey * 2 as varchar(10)), 5, '0')
  = z.zip_code""",
    ("zips",),
)
def lookup(t):
    key = F.lpad((F.col("o_custkey") * 2 + 10000).cast("string"), 5, "0")
    keys = t.orders.select(F.col("o_orderkey").alias("key_id"), key.alias("zip_code"))
    return se.lookup(keys, t.zips, "zip_code", "key_id").select("key_id", "found", "city_name")


_ZIP_QUERIES = """
select cast(s_suppkey as bigint) as qid, concat('CITY ', cast(s_suppkey % 30 as varchar(10))) as city,
       case s_suppkey % 4 when 0 then 'OH' when 1 then 'TX' when 2 then '' else null end as state
from supplier"""


def _asked(t, text, *tables):
    for name in tables:
        getattr(t, name).createOrReplaceTempView(name)
    return t.spark.sql(text)


@query(
    "f02_search_zips",
    f"""
with q as ({_ZIP_QUERIES}),
r as (select q.qid, z.zip_code, z.city_name,
             count(*) over (partition by q.qid) as total,
             row_number() over (partition by q.qid order by z.city_name, z.zip_code) as rank
      from q join zips z on contains(lower(z.city_name), lower(q.city))
        and (coalesce(q.state, '') = '' or q.state = z.state_code))
select qid, total, cast(rank as int) as rank, zip_code, city_name from r where rank <= 20""",
    ("zips",),
)
def search_zips(t):
    return se.search_zips(_asked(t, _ZIP_QUERIES, "supplier"), t.zips, 20).select(
        "qid", "total", "rank", "zip_code", "city_name"
    )


@query(
    "f23_search_zips_of_all",
    f"""
with q as ({_ZIP_QUERIES}),
r as (select q.qid, z.zip_code, z.city_name, count(z.zip_code) over (partition by q.qid) as total,
             row_number() over (partition by q.qid order by z.city_name, z.zip_code) as rank
      from q left join zips z on contains(lower(z.city_name), lower(q.city))
        and (coalesce(q.state, '') = '' or q.state = z.state_code))
select qid, total, cast(case when total > 0 then rank end as int) as rank, zip_code, city_name
from r where rank <= 20""",
    ("zips",),
)
def search_zips_of_all(t):
    asked = _asked(t, _ZIP_QUERIES, "supplier")
    return se.search_zips(asked, t.zips, 20, unmatched=True).select(
        "qid", "total", "rank", "zip_code", "city_name"
    )


_CITY_QUERIES = """
select c_custkey as qid,
       case when c_custkey % 3 = 0 then concat('city ', cast(c_custkey % 25 as varchar(10)), ' ')
            end as q,
       case when c_custkey % 4 = 1 then 'SUPPLIER' end as city,
       case c_custkey % 5 when 0 then 'oh' when 1 then 'new york' when 2 then 'Texas' end as state,
       case when c_custkey % 6 = 0 then 'county 3' end as county,
       cast(case when c_custkey % 7 = 0 then 3000 end as int) as min_pop
from customer"""


@query(
    "f03_search_cities",
    f"""
with q as ({_CITY_QUERIES}),
r as (select q.qid, c.id, count(*) over (partition by q.qid) as total,
        row_number() over (partition by q.qid order by
          case when ranking > 0 then ranking else 999999 end, population desc nulls last, id)
          as rank
      from q join cities c
        on (q.q is null or contains(lower(c.city), lower(q.q)))
       and (q.city is null or contains(lower(c.city_ascii), lower(q.city)))
       and (q.state is null or c.state_id = upper(q.state)
            or (length(q.state) <> 2 and lower(c.state_name) = lower(q.state)))
       and (q.county is null or contains(lower(c.county_name), lower(q.county)))
       and (q.min_pop is null or c.population >= q.min_pop))
select qid, total, cast(rank as int) as rank, id from r where rank <= 10""",
    ("cities",),
)
def search_cities(t):
    return se.search_cities(_asked(t, _CITY_QUERIES, "customer"), t.cities).select(
        "qid", "total", "rank", "id"
    )


_CITY_PAIRS = """
select c_custkey as qid, lower(concat('City ', cast(c_custkey % 100 % 25 as varchar(10)),
         ' Supplier#', lpad(cast(c_custkey % 100 as varchar(10)), 9, '0'))) as city,
       case when c_custkey % 2 = 0 then 'oh' else 'TEXAS' end as state
from customer"""


@query(
    "f04_city_zips",
    f"""
with p as ({_CITY_PAIRS}),
m as (select p.qid, min(c.id) as id from p join cities c on lower(c.city_ascii) = p.city
        and (c.state_id = upper(p.state)
             or (length(p.state) <> 2 and lower(c.state_name) = lower(p.state)))
      group by p.qid)
select m.qid, unnest(string_split(c.zips, ' ')) as zip_code from m join cities c on m.id = c.id""",
    ("cities",),
)
def city_zips(t):
    return se.city_zips(_asked(t, _CITY_PAIRS, "customer"), t.cities)


@query(
    "f05_search_states",
    """
with q as (
  select c_custkey as qid,
         case when c_custkey % 2 = 0 then concat('nation_', cast(c_custkey % 10 as varchar(10)))
           end as name,
         case when c_custkey % 3 = 0 then cast(c_custkey % 5 as varchar(10)) end as region,
         case when c_custkey % 7 = 0 then '1' end as division from customer),
r as (select q.qid, s.id, s.state_name, count(*) over (partition by q.qid) as total,
             row_number() over (partition by q.qid order by s.state_name, s.id) as rank
      from q join states s on (q.name is null or contains(lower(s.state_name), q.name))
        and (q.region is null or s.region = q.region)
        and (q.division is null or s.division = q.division))
select qid, total, cast(rank as int) as rank, id, state_name from r where rank <= 50""",
    ("states",),
)
def search_states(t):
    number = F.col("c_custkey")
    queries = t.customer.select(
        number.alias("qid"),
        F.when(number % 2 == 0, F.concat(F.lit("nation_"), (number % 10).cast("string")))
        .alias("name"),
        F.when(number % 3 == 0, (number % 5).cast("string")).alias("region"),
        F.when(number % 7 == 0, "1").alias("division"),
    )
    return se.search_states(queries, t.states).select("qid", "total", "rank", "id", "state_name")


@query(
    "f06_resolve_states",
    """
with q as (
  select c_custkey as qid, case c_custkey % 4
           when 0 then lpad(cast(c_custkey % 30 as varchar(10)), 2, '0')
           when 1 then lower(concat(substr('ABCDE', cast(c_custkey % 5 as int) + 1, 1),
                                    substr('VWXYZ', cast(c_custkey % 7 as int) + 1, 1)))
           when 2 then upper(concat('State NATION_', cast(c_custkey % 30 as varchar(10))))
           else 'nowhere' end as identifier from customer)
select q.qid, s.id, s.state_abbr, s.state_name
from q join states s on s.state_fips = q.identifier or upper(s.state_abbr) = upper(q.identifier)
  or lower(s.state_name) = lower(q.identifier)""",
    ("states",),
)
def resolve_states(t):
    n = F.col("c_custkey")
    text = (
        F.when(n % 4 == 0, F.lpad((n % 30).cast("string"), 2, "0"))
        .when(
            n % 4 == 1,
            F.lower(
                F.concat(
                    F.substr(F.lit("ABCDE"), (n % 5).cast("int") + 1, F.lit(1)),
                    F.substr(F.lit("VWXYZ"), (n % 7).cast("int") + 1, F.lit(1)),
                )
            ),
        )
        .when(n % 4 == 2, F.upper(F.concat(F.lit("State NATION_"), (n % 30).cast("string"))))
        .otherwise("nowhere")
    )
    ids = t.customer.select(n.alias("qid"), text.alias("identifier"))
    return se.resolve_states(ids, t.states).select("qid", "id", "state_abbr", "state_name")


@query(
    "f07_search_counties",
    """
with q as (
  select c_custkey as qid,
         case when c_custkey % 2 = 0 then concat('#00000000', cast(c_custkey % 10 as varchar(10)))
           end as name,
         cast(case when c_custkey % 3 = 0 then 2000 end as int) as lo,
         cast(case when c_custkey % 5 = 0 then 7000 end as int) as hi from customer),
r as (select q.qid, c.id, count(*) over (partition by q.qid) as total,
             row_number() over (partition by q.qid
               order by address_count desc nulls first, county_name, id) as rank
      from q join counties c on (q.name is null or contains(lower(c.county_name), q.name))
        and (q.lo is null or address_count >= q.lo) and (q.hi is null or address_count <= q.hi))
select qid, total, cast(rank as int) as rank, id from r where rank <= 100""",
    ("counties",),
)
def search_counties(t):
    n = F.col("c_custkey")
    queries = t.customer.select(
        n.alias("qid"),
        F.when(n % 2 == 0, F.concat(F.lit("#00000000"), (n % 10).cast("string"))).alias("name"),
        F.when(n % 3 == 0, 2000).alias("min_addresses"),
        F.when(n % 5 == 0, 7000).alias("max_addresses"),
    )
    rows = se.search_counties(queries, t.counties.select("id", "county_name", "address_count"))
    return rows.select("qid", "total", "rank", "id")


@query(
    "f08_county_by_name",
    """
select c_custkey as qid, c.id, c.address_count from customer
join counties c on lower(c.county_name)
  = concat('county supplier#', lpad(cast(c_custkey % 130 as varchar(10)), 9, '0'))""",
    ("counties",),
)
def county_by_name(t):
    number = F.lpad((F.col("c_custkey") % 130).cast("string"), 9, "0")
    names = t.customer.select(
        F.col("c_custkey").alias("qid"), F.concat(F.lit("COUNTY Supplier#"), number).alias("name")
    )
    return se.county_by_name(names, t.counties).select("qid", "id", "address_count")


_WORD_QUERIES = """
select qid, case qid % 4 when 0 then concat(house, '  ', lower(name))
                 when 1 then concat(name, ' ', zip_code)
                 when 2 then concat('city ', city_no, ' ', name)
                 else concat(upper(substr(name, 2, 9)), ' road county ', house, ' Apt 2B') end as q
from question_parts"""


@query(
    "f09_search_addresses",
    """
with w as (
  select qid, case qid % 4 when 0 then house when 1 then lower(name) when 2 then 'city'
                   else lower(substr(name, 2, 9)) end as w1,
         case qid % 4 when 0 then lower(name) when 1 then zip_code when 2 then city_no
              else 'road' end as w2,
         case qid % 4 when 2 then lower(name) when 3 then 'county' end as w3,
         case qid % 4 when 3 then house end as w4
  from question_parts),
u as (select qid, unnest([w1, w2, w3, w4]) as word from w),
d as (select distinct word from u where word is not null),
a as (select *, lower(full_address) as f, lower(street) as s, lower(city) as c,
             lower(county) as n from address_lines),
hits as (
  select d.word, a.id, case when contains(f, word) then 150 when contains(s, word) then 100
         when contains(concat(house_number, ' ', s), word) then 90
         when contains(house_number, word) then 80 when contains(c, word) then 60
         when contains(postcode, word) then 50 when contains(n, word) then 30 end as score
  from d join a on contains(f, word) or contains(house_number, word) or contains(s, word)
    or contains(c, word) or contains(n, word) or contains(postcode, word)),
x as (select u.qid, h.id, sum(score) as score, count(*) as n from u join hits h on u.word = h.word
      group by u.qid, h.id),
r as (
  select x.qid, x.id, x.score, count(*) over (partition by x.qid) as total,
         row_number() over (partition by x.qid order by score desc, county, city, street,
                            house_number, x.id) as rank
  from x join address_lines a on x.id = a.id
  where x.n = (case x.qid % 4 when 2 then 3 when 3 then 4 else 2 end))
select qid, total, cast(rank as int) as rank, id, cast(score as int) as relevance_score
from r where rank <= 25""",
    ("question_parts", "address_lines"),
)
def search_addresses(t):
    t.question_parts.createOrReplaceTempView("question_parts")
    queries = t.spark.sql(_WORD_QUERIES)
    rows = t.spread(t.address_lines.drop("suffix", "unit", "region"))
    return se.search_addresses(queries, rows, 25).select(
        "qid", "total", "rank", "id", "relevance_score"
    )


@query(
    "f11_field_filters",
    """
with q as (
  select qid, case when qid % 2 = 0 then lower(name) end as street,
         case when qid % 3 = 0 then concat('city ', city_no) end as city,
         case when qid % 5 = 0 then 'county 3' end as county,
         case when qid % 3 = 1 then zip_code end as postcode
  from question_parts),
r as (
  select q.qid, a.id, count(*) over (partition by q.qid) as total,
         row_number() over (partition by q.qid order by a.county, a.city, a.street,
                            a.house_number, a.id) as rank
  from q join address_lines a
    on (q.street is null or contains(lower(a.street), q.street))
   and (q.city is null or contains(lower(a.city), q.city))
   and (q.county is null or contains(lower(a.county), q.county))
   and (q.postcode is null or a.postcode = q.postcode))
select qid, total, cast(rank as int) as rank, id from r where rank <= 10""",
    ("question_parts", "address_lines"),
)
def field_filters(t):
    n = F.col("qid")
    queries = t.question_parts.select(
        "qid",
        F.when(n % 2 == 0, F.upper("name")).alias("street"),
        F.when(n % 3 == 0, F.concat(F.lit("CITY "), "city_no")).alias("city"),
        F.when(n % 5 == 0, "County 3").alias("county"),
        F.when(n % 3 == 1, F.col("zip_code")).alias("postcode"),
    )
    rows = t.spread(t.address_lines.drop("suffix", "unit", "region"))
    return se.search_addresses(queries, rows, 10).select("qid", "total", "rank", "id")


# Places with a radius of their own, with none, and with words or filters beside them.
_PLACE_QUERIES = """
select s_suppkey as qid, 38 + (s_suppkey * 37 % 400) / cast(100 as double) + 0.0011 as lat,
       -85 + (s_suppkey * 91 % 500) / cast(100 as double) + 0.0007 as lng,
       cast(case s_suppkey % 6 when 0 then 0.3 when 1 then 4 when 2 then 17.5 when 3 then 60 when 4 then 0
            end as double) as radius_km,
       case when s_suppkey % 7 = 0 then 'dr' when s_suppkey % 9 = 0 then 'oakley' end as q,
       case when s_suppkey % 8 = 0 then concat('1', lpad(cast(s_suppkey % 150 as varchar(10)), 4, '0')) end as postcode,
       cast(case s_suppkey % 4 when 0 then 5 when 1 then 700 when 2 then 0 end as int) as limit_,
       cast(case when s_suppkey % 3 = 0 then 2 end as int) as offset_
from supplier"""


@query(
    "f24_search_addresses_by_place",
    f"""
with q as ({_PLACE_QUERIES}),
n as (select *, coalesce(offset_, 0) as first, case when limit_ > 500 then 500 when limit_ > 0 then limit_
             else 50 end as rows_ from q),
d as (select q.*, a.id, a.county, a.city, a.street, a.house_number, {_h("q", "a", lat2="latitude", lng2="longitude")} as h
      from n q join address_lines a
        on (q.q is null or contains(lower(concat_ws(' ', a.full_address, a.house_number, a.street, a.city, a.county, a.postcode)), q.q))
       and (q.postcode is null or q.postcode = a.postcode)),
k as (select *, 6371.0088 * 2 * atan2(sqrt(h), sqrt(greatest(1 - h, 0))) as km from d),
r as (select *, count(*) over (partition by qid) as total,
             row_number() over (partition by qid order by round(km, 6), county, city, street, house_number, id) as rank
      from k where coalesce(radius_km, 0) <= 0 or km <= radius_km)
select qid, total, cast(rank as int) as rank, id, round(round(km, 6), 4) as distance_km
from r where rank > first and rank <= first + rows_""",
    ("address_lines",),
)
def search_addresses_by_place(t):
    asked = _asked(t, _PLACE_QUERIES, "supplier").withColumnsRenamed({"limit_": "limit", "offset_": "offset"})
    rows = t.spread(t.address_lines.drop("suffix", "unit", "region"))
    found = se.search_addresses(asked, rows).filter("id is not null")
    return found.select("qid", "total", "rank", "id", F.round("distance_km", 4).alias("distance_km"))


# One condition each: a state, a floor of the population, a circle, a short word.
_LONE_QUERIES = """
select k as qid, case when k % 5 = 0 then 'a' when k % 5 = 4 then '7' end as q,
       case when k % 5 = 1 then case when k % 2 = 0 then 'oh' else 'texas' end end as state,
       cast(case when k % 5 = 2 then k % 9 * 700 + 1 end as int) as min_pop,
       case when k % 5 = 3 then lat end as lat, case when k % 5 = 3 then lng end as lng,
       cast(case when k % 5 = 3 then k % 4 * 30 end as double) as radius_km,
       cast(k % 13 * 10 as int) as limit_
from zips"""


@query(
    "f25_search_cities_by_one_condition",
    f"""
with q as ({_LONE_QUERIES}),
r as (select q.qid, q.limit_, c.id, count(*) over (partition by q.qid) as total,
        row_number() over (partition by q.qid order by
          case when ranking > 0 then ranking else 999999 end, population desc nulls last, c.id) as rank
      from q join cities c
        on (q.q is null or contains(lower(c.city), q.q) or contains(lower(c.city_ascii), q.q))
       and (q.state is null or c.state_id = upper(q.state)
            or (length(q.state) <> 2 and lower(c.state_name) = lower(q.state)))
       and (q.min_pop is null or c.population >= q.min_pop)
       and (q.lat is null or q.radius_km <= 0 or
            6371 * acos(least(1, greatest(-1, cos(radians(q.lat)) * cos(radians(c.lat))
              * cos(radians(c.lng) - radians(q.lng)) + sin(radians(q.lat)) * sin(radians(c.lat))))) <= q.radius_km))
select qid, total, cast(rank as int) as rank, id from r
where rank <= case when limit_ > 100 then 100 when limit_ > 0 then limit_ else 10 end""",
    ("zips", "cities"),
)
def search_cities_by_one_condition(t):
    asked = _asked(t, _LONE_QUERIES, "zips").withColumnRenamed("limit_", "limit")
    found = se.search_cities(asked, t.cities).filter("id is not null")
    return found.select("qid", "total", "rank", "id")


@query(
    "f17_zip_fallback",
    """
with q as (
  select c_custkey as qid, case c_custkey % 6 when 0 then 'MAIN' when 1 then 'oakley'
           when 2 then 'High' when 3 then 'park' when 4 then 'elm' else 'birch' end as street,
         c_custkey % 100 as city_id,
         lpad(cast(10000 + c_custkey % 300 as varchar(10)), 5, '0') as zip from customer),
lost as (select * from q where zip not in (select postcode from addresses)),
z as (select l.qid, lower(l.street) as street, unnest(string_split(c.zips, ' ')) as zip_code
      from lost l join cities c on c.id = l.city_id),
r as (select z.qid, z.zip_code, a.id, row_number() over (partition by z.qid, z.zip_code
               order by a.county, a.city, a.street, a.house_number, a.id) as rank
      from z join addresses a on a.postcode = z.zip_code and contains(lower(a.street), z.street))
select qid, zip_code, cast(rank as int) as rank, id from r where rank <= 50""",
    ("addresses", "cities"),
)
def zip_fallback(t):
    n = F.col("c_custkey")
    streets = F.array(*(F.lit(s) for s in ("MAIN", "oakley", "High", "park", "elm", "birch")))
    asked = t.customer.select(
        n.alias("qid"),
        F.element_at(streets, (n % 6).cast("int") + 1).alias("street"),
        (n % 100).alias("id"),
        F.lpad((n % 300 + 10000).cast("string"), 5, "0").alias("zip"),
    )
    named = t.cities.select("id", F.col("city_ascii").alias("city"), F.col("state_id").alias("state"))
    queries = asked.join(named, "id").drop("id")
    columns = ["id", "house_number", "street", "city", "postcode", "county"]
    rows = t.spread(t.address_lines.select(*columns))
    return se.zip_fallback(queries, t.cities, rows).select("qid", "zip_code", "rank", "id")


@query(
    "f18_list_datasets",
    """
select id, name, state, status from datasets where state = 'OH' and status = 'completed'
order by uploaded_at desc, id limit 50 offset 10""",
    ("datasets",),
)
def list_datasets(t):
    return se.list_datasets(t.datasets, "OH", "completed", 50, 10).select(
        "id", "name", "state", "status"
    )


@query(
    "f21_validate",
    """
select id, case when length(zip) not between 5 and 10 then 'Invalid ZIP code format'
                when not (radius > 0 and radius <= 100) then 'Invalid radius parameter'
                else 'ok' end as status
from (select event_id as id, substr('1234567890123', 1, cast(event_id % 13 as int) + 1) as zip,
             value - 20 as radius from events) e""",
)
def validate(t):
    zip_text = F.substr(F.lit("1234567890123"), F.lit(1), (F.col("event_id") % 13).cast("int") + 1)
    rows = t.events.select(
        F.col("event_id").alias("id"), zip_text.alias("zip"), (F.col("value") - 20).alias("radius")
    )
    rules = {
        "Invalid ZIP code format": se.valid_zip(F.col("zip")),
        "Invalid radius parameter": se.valid_radius(F.col("radius")),
    }
    return se.validate(rows, rules).select("id", "status")


_RAW_PLACES = """
select event_id as id,
       case event_id % 7 when 0 then '' when 1 then null when 2 then '39.1x' when 3 then ' 39.1'
            else cast(38 + event_id % 900 / cast(1000 as double) as varchar(20)) end as lat,
       case event_id % 5 when 0 then '-84.' when 1 then 'west' when 2 then '.5e1' else '-84.25' end as lng,
       case event_id % 4 when 0 then '12a' when 1 then '99999999999999999999' when 2 then ''
            else cast(event_id as varchar(20)) end as address_id
from events"""


@query(
    "f21_validate_places",
    f"""
with p as ({_RAW_PLACES}),
j as (select *, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$' as number from p)
select id, case when coalesce(lat, '') = '' or coalesce(lng, '') = ''
                then 'Both lat and lng parameters are required'
                when not regexp_matches(lat, number) then 'Invalid latitude value'
                when not regexp_matches(lng, number) then 'Invalid longitude value'
                when not regexp_matches(address_id, '^[0-9]{{1,18}}$') then 'Invalid address ID'
                else 'ok' end as status
from j""",
)
def validate_places(t):
    rows = _asked(t, _RAW_PLACES, "events")
    rules = se.place_rules("lat", "lng") | {"Invalid address ID": se.valid_id(F.col("address_id"))}
    return se.validate(rows, rules).select("id", "status")


@query(
    "t01_top_k_per_query",
    """
with r as (select postcode, id, row_number() over (partition by postcode
             order by street, house_number, id) as rank from addresses)
select postcode, cast(rank as int) as rank, id from r where rank <= 5""",
    ("addresses",),
)
def top_k(t):
    rows = t.addresses.select("postcode", "street", "house_number", "id")
    order = [F.col("street"), F.col("house_number"), F.col("id")]
    return topk.top_k_per_query(rows, ["postcode"], order, 5).select("postcode", "rank", "id")


@query(
    "t02_page_with_total",
    """
with r as (select county, id, count(*) over (partition by county) as total,
             row_number() over (partition by county order by id desc) as rank from addresses)
select county, cast(rank as int) as rank, id, total from r where rank between 11 and 20""",
    ("addresses",),
)
def page_with_total(t):
    rows = t.addresses.select("county", "id")
    page = topk.page_per_query(rows, ["county"], [F.col("id").desc()], 10, 10)
    return topk.with_totals(page, rows, ["county"])


@query(
    "t04_sort_keys",
    """
select id, cast(row_number() over (order by case when ranking > 0 then ranking else 999999 end,
         population desc nulls last, id) as int) as place from cities
order by place limit 40""",
    ("cities",),
)
def sort_keys(t):
    ranked = F.when(F.col("ranking") > 0, F.col("ranking")).otherwise(999999)
    order = [ranked, F.col("population").desc_nulls_last(), F.col("id")]
    first = t.cities.orderBy(*order).limit(40)  # each task keeps 40; the places are theirs alone
    return first.select("id", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query(
    "t05_nulls_last",
    """
with r as (select state_id, id, row_number() over (partition by state_id
             order by population asc nulls last, id) as up,
           row_number() over (partition by state_id order by population desc nulls first, id)
             as down from cities)
select 'up' as side, state_id, id, cast(up as int) as rank from r where up <= 5
union all
select 'down', state_id, id, cast(down as int) from r where down <= 5""",
    ("cities",),
)
def nulls_last(t):
    rows = t.cities.select("state_id", "id", "population")
    number = F.col("population")
    orders = {"up": number.asc_nulls_last(), "down": number.desc_nulls_first()}
    parts = [
        topk.top_k_per_query(rows, ["state_id"], [order, F.col("id")], 5)
        .select(F.lit(side).alias("side"), "state_id", "id", "rank")
        for side, order in orders.items()
    ]
    return parts[0].unionByName(parts[1])
