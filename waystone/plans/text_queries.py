"""Normalisation columns over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import sql
from ..functions import text as tx
from ..functions.parse import parse_addresses
from ..operators import geocode as gc
from .registry import query


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


_SUFFIX_ROWS = _values(lx.suffix_words().items())
_SUFFIX_LIST = list(lx.suffix_words())
_FORMS = {**lx.word_forms(lx.STREET_TYPES), **lx.word_forms(lx.DIRECTIONS)}
_FORM_ROWS = _values((w, s) for w, spellings in _FORMS.items() for s in spellings)
_WORDS = list(_FORMS)
_DIRECTION_ROWS = _values(
    (w, s) for w, spellings in lx.word_forms(lx.DIRECTIONS).items() for s in spellings
)

# Street names from part names, cycling through all suffixes, both letter cases.
_STREETS = f"""
select p_partkey as id, concat(p_name, case when p_partkey % 3 = 0 then '  ' else ' ' end,
         case when p_partkey % 2 = 0 then w.word else lower(w.word) end) as street
from part join (values {", ".join(f"({i}, '{w}')" for i, w in enumerate([*_SUFFIX_LIST, "Lane", "PK", "DR."]))})
  w(no, word) on p_partkey % {len(_SUFFIX_LIST) + 3} = w.no"""

# Four-word phrases: number, direction or other word, name, street word.
_PHRASES = f"""
select p_partkey as id, cast(p_partkey % 97 + 1 as varchar(10)) as w1, d.word as w2,
       concat('x', cast(p_partkey % 13 as varchar(10))) as w3, t.word as w4,
       concat(cast(p_partkey % 97 + 1 as varchar(10)), ' ', upper(d.word), ' X',
              cast(p_partkey % 13 as varchar(10)), ' ', t.word) as q
from part
join (values {", ".join(f"({i}, '{w}')" for i, w in enumerate([*lx.word_forms(lx.DIRECTIONS), "old"]))})
  d(no, word) on p_partkey % {len(lx.word_forms(lx.DIRECTIONS)) + 1} = d.no
join (values {", ".join(f"({i}, '{w}')" for i, w in enumerate([*_WORDS, "ring", "dr.."]))})
  t(no, word) on p_partkey % {len(_WORDS) + 2} = t.no"""


def _sql_rows(tables, text: str):
    tables.part.createOrReplaceTempView("part")
    return tables.spark.sql(text)


@query(
    "p07_expand_street",
    f"""
with s as ({_STREETS}),
     x(abbr, word) as (values {_SUFFIX_ROWS})
select id, coalesce(regexp_extract(street, '^(.*?)\\s+(\\S+)$', 1) || ' ' || x.word, street)
         as expanded
from s left join x on upper(regexp_extract(street, '^(.*?)\\s+(\\S+)$', 2)) = x.abbr""",
)
def expand_street(t):
    return _sql_rows(t, _STREETS).select("id", tx.expand_street(F.col("street")).alias("expanded"))


@query(
    "p08_full_address",
    "select id, full_address from address_lines",
    ("address_lines",),
)
def full_address(t):
    line = tx.full_address("house_number", "street", "unit", "city", "region", "postcode")
    return t.addresses.select("id", line.alias("full_address"))


@query(
    "p08_sql_functions",
    """
select id, full_address, concat(house_number, ' ', street) as stripped, 'addresses' as endpoint
from address_lines""",
    ("address_lines",),
)
def sql_functions(t):
    sql.register(t.spark)
    t.addresses.createOrReplaceTempView("addresses")
    return t.spark.sql("""
        select id, full_address(house_number, street, unit, city, region, postcode) as full_address,
               strip_unit(concat(house_number, ' ', street, ', Apt 2B')) as stripped,
               endpoint_of(concat('/api/v1/addresses/', id)) as endpoint
        from addresses""")


@query(
    "p09_full_address_plain",
    """
select id, concat_ws(', ', concat_ws(' ', house_number, street,
             case when unit <> '' then concat('Unit ', unit) end), city,
           concat_ws(' ', nullif(region, ''), postcode)) as full_address
from addresses""",
    ("addresses",),
)
def full_address_plain(t):
    line = tx.full_address(
        "house_number", "street", "unit", "city", "region", "postcode", style="plain"
    )
    return t.addresses.select("id", line.alias("full_address"))


@query("p10_strip_unit", "select qid, clean_q as stripped from questions", ("questions",))
def strip_unit(t):
    return t.questions.select("qid", tx.strip_unit(F.col("q")).alias("stripped"))


@query(
    "p11_parse_addresses",
    """
select qid, x_house as house_number, x_street as street, x_city as city, x_state as state,
       x_zip as zip from questions""",
    ("questions",),
)
def parse(t):
    return parse_addresses(t.questions.select("qid", "clean_q"), "clean_q").select(
        "qid", "parsed.*"
    )


@query(
    "p12_is_street_type",
    f"""
with s as ({_STREETS}),
     x(word) as (values {_values((w,) for w in _WORDS)})
select id, regexp_extract(street, '(\\S+)$', 1) as word,
       lower(regexp_extract(street, '(\\S+?)\\.?$', 1)) in (select word from x) as is_type
from s""",
)
def is_street_type(t):
    word = F.regexp_extract("street", r"(\S+)\z", 1)
    return _sql_rows(t, _STREETS).select(
        "id", word.alias("word"), tx.is_street_type(word).alias("is_type")
    )


@query(
    "p13_query_variants",
    f"""
with p as ({_PHRASES}),
     x(word, spelling) as (values {_FORM_ROWS}),
     d(word, spelling) as (values {_DIRECTION_ROWS}),
     v as (
       select id, lower(q) as variant from p
       union select id, concat(w1, ' ', w2, ' ', w3, ' ', spelling) from p
         join x on regexp_replace(w4, '[.]{{1,2}}$', '') = x.word
       union select id, concat(w1, ' ', spelling, ' ', w3, ' ', w4) from p
         join d on regexp_replace(w2, '[.]{{1,2}}$', '') = d.word)
select id, variant from v""",
)
def query_variants(t):
    return tx.query_variants(_sql_rows(t, _PHRASES).select("id", "q"), "q").select("id", "variant")


_FULL_ROWS = _values((w, s[0]) for w, s in _FORMS.items())


@query(
    "p14_expand_query",
    f"""
with p as ({_PHRASES}), x(word, full_word) as (values {_FULL_ROWS})
select id, case when x.full_word is null then q
                else concat(w1, ' ', w2, ' ', w3, ' ', x.full_word) end as expanded
from p left join x on regexp_replace(w4, '[.]$', '') = x.word""",
)
def expand_query(t):
    return _sql_rows(t, _PHRASES).select("id", tx.expand_query(F.col("q")).alias("expanded"))


@query(
    "p15_street_only",
    """
select qid, case when form in (0, 1, 2, 4, 5, 8)
                 then substr(clean_q, length(split_part(clean_q, ' ', 1)) + 2)
                 else clean_q end as street_query
from questions""",
    ("questions",),
)
def street_only(t):
    return t.questions.select("qid", tx.street_only(F.col("clean_q")).alias("street_query"))


@query(
    "p16_endpoint_of",
    """
select id, case id % 12 when 0 then 'geocode' when 1 then 'search' when 2 then 'distance'
             when 3 then 'nearby' when 4 then 'proximity' when 5 then 'addresses'
             when 6 then 'search' when 7 then 'search' when 8 then 'cities' when 9 then 'states'
             when 10 then 'admin' else 'unknown' end as endpoint
from requests""",
    ("requests",),
)
def endpoint_of(t):
    return t.requests.select("id", tx.endpoint_of(F.col("path")).alias("endpoint"))


@query(
    "p17_key_hash",
    """
select id, sha256(raw_key) as key_hash,
       concat(substr(raw_key, 1, 11), '...', right(raw_key, 4)) as key_preview from api_keys""",
    ("api_keys",),
)
def key_hash(t):
    key = F.col("raw_key")
    return t.api_keys.select(
        "id", tx.key_hash(key).alias("key_hash"), tx.key_preview(key).alias("key_preview")
    )


def address_rows(t):
    rows = t.address_lines.select(
        "id", "full_address", "house_number", "street", "city", "postcode"
    )
    return t.spread(rows)


# The naive form of the tiers: every question against every address.
_TIERS = """
spell as (
  select qid, lower(x_street) as s, lower(x_house) as h, lower(x_city) as c, x_zip as z,
         case when form <> 6 and x_street <> '' then lower(split_part(x_street, ' ', 1)) || ' ' end
           as n,
         case short_kind when 'dr' then 'dr' when 'rd' then 'rd' when 'ave' then 'av'
              else 'st' end as k1,
         case short_kind when 'dr' then 'drive' when 'rd' then 'road' when 'ave' then 'avenue'
              else 'street' end as k2
  from questions),
pairs as (
  select q.qid, a.id, a.full_address,
         q.s <> '' and (contains(lower(a.street), q.s)
           or coalesce(contains(lower(a.street), q.n || q.k1)
                    or contains(lower(a.street), q.n || q.k2), false)) as st,
         q.h <> '' and a.house_number = q.h as ho, q.c <> '' and lower(a.city) = q.c as ci,
         q.z <> '' and a.postcode = q.z as zi, q.s, q.h, q.c, q.z
  from spell q join address_lines a
    on lower(a.city) = q.c or a.postcode = q.z or (q.c = '' and q.z = '')),
tiered as (
  select *, case when c <> '' and z <> '' then ci and zi when z <> '' then zi when c <> '' then ci
                 else true end as loc,
         case when s <> '' and h <> '' then 1 else 0 end as e,
         case when s <> '' then 1 else 0 end as n
  from pairs),
hits as (
  select qid, id, full_address,
         case when e = 1 and st and ho and loc then 1
              when n = 1 and st and loc then e + 1
              when zi then e + n + 1
              when ci then e + n + 1 + case when z <> '' then 1 else 0 end end as tier, e
  from tiered),
ranked as (
  select *, row_number() over (partition by qid order by tier, full_address, id) as rank
  from hits where tier is not null)
"""


@query(
    "f13_component_tiers",
    f"""
with {_TIERS.strip()}
select qid, tier, e = 1 and tier = 1 as is_exact, cast(rank as int) as rank, id, full_address
from ranked where rank <= 50""",
    ("questions", "address_lines"),
)
def component_tiers(t):
    part = F.struct(
        F.col("x_house").alias("house_number"),
        F.col("x_street").alias("street"),
        F.col("x_city").alias("city"),
        F.col("x_zip").alias("zip"),
    )
    queries = t.questions.select("qid", part.alias("parsed"))
    return gc.component_tiers(queries, address_rows(t), 50).select(
        "qid", "tier", "is_exact", "rank", "id", "full_address"
    )


_TEXT_HITS = """
texts as (
  select qid, case when form = 9 then clean_q else clean_q end as whole,
         case when form = 8 then substr(clean_q, length(split_part(clean_q, ' ', 1)) + 2) end as part
  from questions where form in (8, 9)),
text_hits as (
  select t.qid, a.id, a.full_address, case when contains(lower(a.full_address), lower(whole)) then 1
           else 2 end as tier
  from texts t join address_lines a
    on contains(lower(a.full_address), lower(t.whole))
    or contains(lower(a.full_address), lower(t.part))),
text_ranked as (
  select *, row_number() over (partition by qid order by tier, full_address, id) as rank
  from text_hits)
"""

_GEOCODED = f"""
with {_TIERS.strip()},
{_TEXT_HITS.strip()},
geocoded as (
  select qid, 'component' as search_method, tier, e = 1 and tier = 1 as is_exact,
         cast(rank as int) as rank, id, full_address from ranked where rank <= 50
  union all
  select qid, 'fulltext', tier, tier = 1, cast(rank as int), id, full_address
  from text_ranked where rank <= 50)
"""


@query(
    "f12_geocode",
    f"{_GEOCODED} select * from geocoded",
    ("questions", "address_lines"),
)
def geocode(t):
    return gc.geocode(t.questions.select("qid", "q"), address_rows(t), 50).select(
        "qid", "search_method", "tier", "is_exact", "rank", "id", "full_address"
    )


@query(
    "f16_geocode_summary",
    f"""{_GEOCODED}
select g.qid, search_method, count(*) filter (where is_exact) as exact_count,
       count(*) filter (where not is_exact) as fallback_count, min(tier) as best_tier,
       case when count(*) filter (where not is_exact) > 0 then
         case search_method when 'component' then 'nearby addresses (street/city match)'
              else min(t.part) end end as fallback_query
from geocoded g left join texts t on g.qid = t.qid
group by g.qid, search_method""",
    ("questions", "address_lines"),
)
def geocode_summary(t):
    return gc.geocode_summary(gc.geocode(t.questions.select("qid", "q"), address_rows(t), 50))


@query(
    "f22_geocode_summary_of_all",
    f"""{_GEOCODED},
named as (select distinct qid from questions)
select n.qid, search_method, count(*) filter (where is_exact) as exact_count,
       count(*) filter (where not is_exact) as fallback_count, min(tier) as best_tier,
       case when count(*) filter (where not is_exact) > 0 then
         case search_method when 'component' then 'nearby addresses (street/city match)'
              else min(t.part) end end as fallback_query
from named n left join geocoded g on n.qid = g.qid left join texts t on g.qid = t.qid
group by n.qid, search_method""",
    ("questions", "address_lines"),
)
def geocode_summary_of_all(t):
    answers = gc.geocode(t.questions.select("qid", "q"), address_rows(t), 50)
    return gc.geocode_summary(answers, t.questions)


@query(
    "f14_search_with_fallback",
    """
with texts as (
  select qid, lower(name) as n, house, lower(short_kind) as k,
         case lower(short_kind) when 'dr' then 'drive' when 'rd' then 'road'
              when 'ave' then 'avenue' else 'street' end as long_kind
  from question_parts),
hits as (
  select t.qid, a.id, a.full_address,
         case when contains(lower(a.full_address), concat(house, ' ', n, ' ', k))
                or contains(lower(a.full_address), concat(house, ' ', n, ' ', long_kind))
              then 1 else 2 end as priority
  from texts t join address_lines a
    on contains(lower(a.full_address), concat(n, ' ', k))
    or contains(lower(a.full_address), concat(n, ' ', long_kind))),
ranked as (
  select *, cast(row_number() over (partition by qid order by priority, full_address, id) as int)
    as rank from hits)
select qid, priority, rank, id, full_address from ranked where rank <= 50""",
    ("question_parts", "address_lines"),
)
def search_with_fallback(t):
    queries = t.question_parts.select("qid", F.concat_ws(" ", "house", "name", "kind").alias("q"))
    return gc.search_with_fallback(queries, address_rows(t), 50).select(
        "qid", "priority", "rank", "id", "full_address"
    )


@query(
    "f15_search_variants",
    """
with texts as (
  select qid, lower(name) as n, lower(kind) as typed, lower(short_kind) as k,
         case lower(short_kind) when 'dr' then 'drive' when 'rd' then 'road'
              when 'ave' then 'avenue' else 'street' end as long_kind
  from question_parts),
hits as (
  select t.qid, a.id, a.full_address,
         case when contains(lower(a.full_address), concat(n, ' ', typed)) then 1 else 2 end
           as priority
  from texts t join address_lines a
    on contains(lower(a.full_address), concat(n, ' ', k))
    or contains(lower(a.full_address), concat(n, ' ', long_kind))),
ranked as (
  select *, cast(row_number() over (partition by qid order by priority, full_address, id) as int)
    as rank from hits)
select qid, priority, rank, id, full_address from ranked where rank <= 50""",
    ("question_parts", "address_lines"),
)
def search_variants(t):
    queries = t.question_parts.select("qid", F.concat_ws(" ", "name", "kind").alias("q"))
    return gc.search_variants(queries, address_rows(t), 50).select(
        "qid", "priority", "rank", "id", "full_address"
    )
