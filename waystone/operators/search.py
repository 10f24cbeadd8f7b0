"""Lookups and filtered, ranked searches for whole tables of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import contains_text, county_key, row_limit, strip_unit, words
from . import cells
from .geocode import SEP, ranked_lists
from .matching import Path, containment_candidates, tagged
from .stage import stage
from .topk import spread_join, top_k_per_query

# ------------------------------------------------------------ lookups by key


def lookup(keys: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """Enrich every row of ``keys``; ``found`` tells whether the key exists."""
    marked = table.withColumn("found", F.lit(True))
    rows = spread_join(keys, marked, [key], spread, "left")
    return rows.withColumn("found", F.coalesce("found", F.lit(False)))


def county_by_name(names: DataFrame, counties: DataFrame, spread: str = "qid") -> DataFrame:
    """names (qid, name) -> the county of that name in any letter case."""
    asked = names.withColumn("_k", F.lower("name"))
    named = counties.withColumn("_k", F.lower("county_name"))
    return spread_join(asked, named, ["_k"], spread).drop("_k")


def _state_keys(state: Column) -> Column:
    """Keys a state text may mean: an id, or (unless two letters) also a name."""
    by_id = F.concat(F.lit("id:"), F.upper(state))
    by_name = F.concat(F.lit("name:"), F.lower(state))
    return F.when(F.length(state) == 2, F.array(by_id)).otherwise(F.array(by_id, by_name))


def _state_of_city() -> Column:
    return F.array(
        F.concat(F.lit("id:"), F.col("state_id")),
        F.concat(F.lit("name:"), F.lower("state_name")),
    )


def city_zips(pairs: DataFrame, cities: DataFrame) -> DataFrame:
    """pairs (qid, city, state) -> one row per ZIP of that city."""
    asked = pairs.select("qid", F.lower("city").alias("_c"), F.explode(_state_keys(F.col("state")))
                         .alias("_s"))
    known = (
        cities.select(
            F.lower("city_ascii").alias("_c"), F.explode(_state_of_city()).alias("_s"), "id", "zips"
        )
        .groupBy("_c", "_s")
        .agg(F.min(F.struct("id", "zips")).alias("city"))
    )
    best = spread_join(asked, known, ["_c", "_s"], "qid").groupBy("qid").agg(
        F.min("city").alias("city")
    )
    return best.select("qid", F.explode(words(F.col("city.zips"))).alias("zip_code"))


def resolve_states(ids: DataFrame, states: DataFrame) -> DataFrame:
    """ids (qid, identifier) -> the state of that FIPS code, abbreviation or name."""

    def tagged(fips: Column, abbr: Column, name: Column) -> Column:
        return F.array(
            F.concat(F.lit("fips:"), fips),
            F.concat(F.lit("abbr:"), F.upper(abbr)),
            F.concat(F.lit("name:"), F.lower(name)),
        )

    alias = (
        states.select(
            F.explode(tagged(*(F.col(f"state_{c}") for c in ("fips", "abbr", "name")))).alias("_k"),
            F.struct("id", *(c for c in states.columns if c != "id")).alias("state"),
        )
        .groupBy("_k")
        .agg(F.min("state").alias("state"))
    )
    text = F.col("identifier")
    asked = ids.withColumn("_k", F.explode(tagged(text, text, text)))
    return (
        spread_join(asked, alias, ["_k"], "qid")
        .groupBy("qid")
        .agg(F.min("state").alias("state"))
        .select("qid", "state.*")
    )


# ------------------------------------------------------------ filtered search


def filtered_search(
    queries: DataFrame,
    rows: DataFrame,
    haystack: Column,
    needles: Column,
    condition: Column,
    order: list[Column],
    k: int,
    offset: int = 0,
    extra: dict[str, Column] | None = None,
    totals: bool = True,
    helpers: dict[str, Column] | None = None,
    unmatched: bool = False,
    paths: list[Path] | None = None,
    nearest: Callable[[DataFrame], list[Path]] | None = None,
) -> DataFrame:
    """Rows meeting each query's conditions: one page per query and the total.

    ``needles``: lower-cased strings every match must hold in ``haystack``; they and the
    ``paths`` (see ``containment_candidates``) find the candidates. ``condition`` is the full
    test over the columns of both sides. ``helpers`` are row columns computed once for the
    tests, ``extra`` columns of a match. Equal queries are answered once. A query's own
    ``q_limit`` and ``q_offset``, where given, take the place of ``k`` and ``offset``.
    ``unmatched`` also names the queries without any match, in a row with total 0 and no answer.
    ``nearest`` is given where ``distance_km`` of ``extra`` comes first in ``order``: matches are then
    counted by classes of distance, and only those in the classes that hold a query's page are
    ranked. It gives the paths of queries whose ``_reach`` is cut to these classes.
    """
    fields = [c for c in queries.columns if c != "qid"]
    asked = queries.withColumn("question", F.to_json(F.struct(*fields)))
    distinct = asked.drop("qid").dropDuplicates(["question"]).withColumn("_needles", needles)
    start, last = F.lit(offset), F.lit(offset + k)
    longest = offset + k
    if "q_limit" in fields:
        start = F.coalesce("q_offset", F.lit(offset))
        last = start + F.coalesce("q_limit", F.lit(k))
        # a constant bound cuts lists before the shuffle
        longest = distinct.agg(F.max(last)).first()[0] or longest
    texts = rows.withColumns(helpers or {}).withColumn("_hay", haystack)

    def matches(some: DataFrame, ways: list[Path] | None) -> DataFrame:
        hits = containment_candidates(some, texts, "_hay", F.col("_needles"), paths=ways)
        return hits.filter(condition).withColumns(extra or {})

    hits = ranked = matches(distinct, paths)
    if nearest is not None:
        counted = hits.groupBy("question", cells.step_of(F.col("distance_km")).alias("_step"))
        steps = stage(counted.agg(F.count("*").alias("n")), "steps")
        so_far = F.sum("n").over(Window.partitionBy("question").orderBy("_step")) - F.col("n")
        first_ones = distinct.select("question", last.alias("_last")).join(
            steps.withColumn("_before", so_far), "question"
        ).filter("_before < _last").groupBy("question").agg(F.max("_step").alias("_last_step"))
        shorter = F.least("_reach", cells.step_reach(F.col("_last_step")))
        closer = distinct.join(first_ones, "question").withColumn(
            "_reach", F.when(F.col("_reach").isNotNull(), shorter)
        )
        closer = stage(closer, "closer")
        ranked = matches(closer, nearest(closer)).filter(
            cells.step_of(F.col("distance_km")) <= F.col("_last_step")
        )
    page = top_k_per_query(ranked, ["question"], order, longest)
    page = page.filter((F.col("rank") > start) & (F.col("rank") <= last))
    columns = [*rows.columns, *(extra or {})]
    page = page.groupBy("question").agg(
        F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("answers")
    )
    if totals:
        counts = hits.groupBy("question").agg(F.count("*").alias("total"))
        if nearest is not None:
            counts = steps.groupBy("question").agg(F.sum("n").alias("total"))
        page = counts.join(page, "question", "left")
    else:
        page = page.withColumn("total", F.lit(None).cast("long"))
    if unmatched:
        page = distinct.select("question").join(page, "question", "left")
        if totals:
            page = page.fillna(0, ["total"])
    found = spread_join(asked.select("qid", "question"), page, ["question"], "qid")
    # a page past the end still tells the total, in a row without an answer
    return found.select("qid", "total", F.explode_outer("answers").alias("a")).select(
        "qid", "total", "a.*"
    )


# ------------------------------------------------------------ ways to candidates


def _equal_path(tag: str, asked: Column, held: Column) -> Path:
    given = asked.isNotNull() & (asked != "")
    return F.when(given, F.array(tagged(tag, asked))), F.array(tagged(tag, held))


def _bucket_of(number: Column) -> Column:
    """Numbers by powers of two; all below 1 in one bucket."""
    return F.floor(F.log2(F.greatest(number.cast("double"), F.lit(0.5)))).cast("int")


def _range_path(tag: str, low: Column, high: Column, held: Column) -> Path:
    """``low`` and ``high`` (0: not asked) bound a number."""
    first = F.when(low > 0, _bucket_of(low)).otherwise(-1)
    last = F.when(high > 0, _bucket_of(high)).otherwise(64)
    keys = F.transform(F.sequence(first, F.greatest(first, last)), lambda b: tagged(tag, b))
    return F.when((low > 0) | (high > 0), keys), F.array(tagged(tag, _bucket_of(held)))


def _circle_path(
    queries: DataFrame, lat: str, lng: str, radius: str, row_lat: str, row_lng: str
) -> Path:
    """Cells of a circle (``q_`` columns), on the levels that the queries use."""
    q_lat, q_lng, r = F.col(lat), F.col(lng), F.col(radius)
    given = q_lat.isNotNull() & q_lng.isNotNull() & (r > 0)
    used = queries.select(F.when(given, cells.level_of(r)).alias("_level"))
    levels = cells.levels_asked(used, "_level")
    asked = F.when(given, cells.cover(q_lat, q_lng, r))
    held = cells.keys_at(F.col(row_lat), F.col(row_lng), levels)
    return (
        F.transform(asked, lambda c: tagged("cell", c)), F.transform(held, lambda c: tagged("cell", c))
    )


def _given(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def _holds(field: str, asked: str, wildcards: bool = False) -> Column:
    """Contains test that passes when nothing is asked."""
    return ~_given(asked) | contains_text(F.col(field), F.col(asked), wildcards)


def _circled() -> Column:
    """A place and a radius above 0 are asked for."""
    place = F.col("q_lat").isNotNull() & F.col("q_lng").isNotNull()
    return place & (F.coalesce("q_radius_km", F.lit(0.0)) > 0)


def _equals(field: Column, asked: Column) -> Column:
    return asked.isNull() | (asked == "") | (field == asked)


def _with(queries: DataFrame, columns: dict[str, str], kind: str) -> DataFrame:
    """The known query fields, renamed with ``q_`` so they cannot clash with rows; a query's own
    limit and offset follow the rule of ``kind``."""
    present = set(queries.columns)
    if "limit" in present:
        columns = columns | {"limit": "int", "offset": "int"}
    known = queries.select(
        "qid",
        *(
            (F.col(c) if c in present else F.lit(None)).cast(t).alias(f"q_{c}")
            for c, t in columns.items()
        ),
    )
    if "limit" not in present:
        return known
    return known.withColumn("q_limit", row_limit(F.col("q_limit"), kind)).withColumn(
        "q_offset", F.greatest(F.coalesce("q_offset", F.lit(0)), F.lit(0))
    )


def _list(*names: str) -> Column:
    """The given ones of the named query fields, lower-cased."""
    return F.array_compact(F.array(*(F.when(_given(n), F.lower(n)) for n in names)))


def _literal(needles: Column, wildcards: bool) -> Column:
    """What a match must hold: with wildcards, the texts between % and _."""
    if not wildcards:
        return needles
    return F.flatten(F.transform(needles, lambda n: F.split(n, "[%_]")))


def _haystack(*names: str) -> Column:
    return F.concat_ws("\n", *(F.lower(n) for n in names))


def search_zips(
    queries: DataFrame, zips: DataFrame, k: int = 50, offset: int = 0, wildcards: bool = False,
    unmatched: bool = False,
) -> DataFrame:
    """queries (qid, city, state): city name contains, state equal; by city, ZIP."""
    q = _with(queries, {"city": "string", "state": "string"}, "zips")
    test = _holds("city_name", "q_city", wildcards) & _equals(F.col("state_code"), F.col("q_state"))
    order = [F.col("city_name").asc_nulls_last(), F.col("zip_code")]
    return filtered_search(
        q, zips, _haystack("city_name"), _literal(_list("q_city"), wildcards), test, order, k, offset,
        unmatched=unmatched, paths=[_equal_path("state", F.col("q_state"), F.col("state_code"))],
    )


def search_cities(
    queries: DataFrame, cities: DataFrame, k: int = 10, offset: int = 0, wildcards: bool = False,
    unmatched: bool = False,
) -> DataFrame:
    """queries (qid, q, city, state, county, min_pop, lat, lng, radius_km).

    Ranked cities first, then by population; a two-letter state is an id.
    """
    q = _with(
        queries,
        {"q": "string", "city": "string", "state": "string", "county": "string",
         "min_pop": "int", "lat": "double", "lng": "double", "radius_km": "double"},
        "cities",
    )
    state = F.col("q_state")
    by_id = F.col("state_id") == F.upper(state)
    by_name = F.lower("state_name") == F.lower(state)
    no_floor = F.coalesce("q_min_pop", F.lit(0)) <= 0
    km = geo.cosines_km(F.col("q_lat"), F.col("q_lng"), F.col("lat"), F.col("lng"))
    test = (
        (_holds("city_ascii", "q_q", wildcards) | _holds("city", "q_q", wildcards))
        & _holds("city_ascii", "q_city", wildcards)
        & (~_given("q_state") | by_id | ((F.length(state) != 2) & by_name))
        & _holds("county_name", "q_county", wildcards)
        & (no_floor | (F.col("population") >= F.col("q_min_pop")))
        & (~_circled() | (km <= F.col("q_radius_km")))
    )
    ranked = F.when(F.col("ranking") > 0, F.col("ranking")).otherwise(999999)
    order = [ranked, F.col("population").desc_nulls_last(), F.col("id")]
    hay = _haystack("city_ascii", "city", "county_name")
    needles = _literal(_list("q_q", "q_city", "q_county"), wildcards)
    # a state's name that is also its id is one key
    by_name_key = F.when(F.upper("state_name") != F.col("state_id"), tagged("name", F.lower("state_name")))
    by_id_key = tagged("id", F.upper(state))
    states = F.when(F.length(state) == 2, F.array(by_id_key)).otherwise(
        F.array(by_id_key, tagged("name", F.lower(state)))
    )
    held = F.array_compact(F.array(tagged("id", F.col("state_id")), by_name_key))
    floor = F.coalesce("q_min_pop", F.lit(0))
    paths = [
        (F.when(_given("q_state"), states), held),
        _range_path("pop", floor, F.lit(0), F.col("population")),
        _circle_path(q, "q_lat", "q_lng", "q_radius_km", "lat", "lng"),
    ]
    return filtered_search(
        q, cities, hay, needles, test, order, k, offset, unmatched=unmatched, paths=paths
    )


def search_states(
    queries: DataFrame, states: DataFrame, k: int = 50, offset: int = 0, wildcards: bool = False,
    unmatched: bool = False,
) -> DataFrame:
    """queries (qid, name, abbr, region, division); by name."""
    q = _with(
        queries, {"name": "string", "abbr": "string", "region": "string", "division": "string"},
        "states",
    )
    test = (
        _holds("state_name", "q_name", wildcards)
        & _equals(F.upper("state_abbr"), F.upper("q_abbr"))
        & _equals(F.col("region"), F.col("q_region"))
        & _equals(F.col("division"), F.col("q_division"))
    )
    order = [F.col("state_name").asc_nulls_last(), F.col("id")]
    return filtered_search(
        q, states, _haystack("state_name"), _literal(_list("q_name"), wildcards), test, order, k,
        offset, unmatched=unmatched,
        paths=[
            _equal_path("abbr", F.upper("q_abbr"), F.upper("state_abbr")),
            _equal_path("region", F.col("q_region"), F.col("region")),
            _equal_path("division", F.col("q_division"), F.col("division")),
        ],
    )


def search_counties(
    queries: DataFrame, counties: DataFrame, k: int = 100, offset: int = 0, wildcards: bool = False,
    unmatched: bool = False,
) -> DataFrame:
    """queries (qid, name, min_addresses, max_addresses); largest first."""
    q = _with(
        queries, {"name": "string", "min_addresses": "int", "max_addresses": "int"}, "counties"
    )
    low, high = F.coalesce("q_min_addresses", F.lit(0)), F.coalesce("q_max_addresses", F.lit(0))
    count = F.col("address_count")
    named = _holds("county_name", "q_name", wildcards)
    test = named & ((low <= 0) | (count >= low)) & ((high <= 0) | (count <= high))
    order = [count.desc_nulls_first(), F.col("county_name"), F.col("id")]
    return filtered_search(
        q, counties, _haystack("county_name"), _literal(_list("q_name"), wildcards), test, order,
        k, offset, unmatched=unmatched, paths=[_range_path("count", low, high, count)],
    )


_FIELDS = ("full_address", "street", "house_number", "city", "postcode", "county")


def relevance(tokens: Column, wildcards: bool = False) -> Column:
    """Sum over the words of the weight of the best field that holds the word.

    Works on the lower-cased helper columns ``_full_address``, ``_street`` ...
    """

    def weight(word: Column) -> Column:
        def holds(field: Column) -> Column:
            return contains_text(field, word, True) if wildcards else F.contains(field, word)

        house_line = F.concat("_house_number", F.lit(" "), "_street")
        return (
            F.when(holds(F.col("_full_address")), 150)
            .when(holds(F.col("_street")), 100)
            .when(holds(house_line), 90)
            .when(holds(F.col("_house_number")), 80)
            .when(holds(F.col("_city")), 60)
            .when(holds(F.col("_postcode")), 50)
            .when(holds(F.col("_county")), 30)
            .otherwise(0)
        )

    return F.aggregate(tokens, F.lit(0), lambda total, w: total + weight(w))


def search_addresses(
    queries: DataFrame, addresses: DataFrame, k: int = 50, offset: int = 0, totals: bool = True,
    wildcards: bool = False,
    unmatched: bool = False,
) -> DataFrame:
    """queries (qid, q, county, city, postcode, street, lat, lng, radius_km, limit, offset).

    Every word of ``q`` must occur in some field; the filters must hold as
    well. Nearest first where a place is given, else most relevant first. A query that gives
    a place and nothing else looks as far as its last answer lies; its total is the whole table.
    """
    q = _with(
        queries,
        {"q": "string", "county": "string", "city": "string", "postcode": "string",
         "street": "string", "lat": "double", "lng": "double", "radius_km": "double"},
        "addresses",
    )
    q = q.withColumn(
        "q_words", words(F.lower(strip_unit(F.coalesce("q_q", F.lit("")))))
    ).drop("q_q")
    km = geo.haversine_km(*(F.col(c) for c in ("q_lat", "q_lng", "latitude", "longitude")))

    def in_some_field(word: Column) -> Column:
        if not wildcards:  # no word holds the line break between the fields
            return F.contains(F.col("_hay"), word)
        return reduce(or_, (contains_text(F.col(f"_{c}"), word, True) for c in _FIELDS))

    test = (
        F.forall("q_words", in_some_field)
        & _holds("_county", "q_county", wildcards)
        & _holds("_city", "q_city", wildcards)
        & _holds("_street", "q_street", wildcards)
        & _equals(F.col("postcode"), F.col("q_postcode"))
        & (~_circled() | (km <= F.col("q_radius_km")))
    )
    placed = F.col("q_lat").isNotNull() & F.col("q_lng").isNotNull()
    near = F.when(placed, F.round(km, 6))
    score = F.when(placed, 0).otherwise(F.col("relevance_score"))
    order = [
        F.col("distance_km").asc_nulls_last(),
        score.desc(),
        *(F.col(c).asc_nulls_last() for c in ("county", "city", "street", "house_number")),
        F.col("id"),
    ]
    needles = F.concat(F.col("q_words"), _list("q_county", "q_city", "q_postcode", "q_street"))
    needles = _literal(needles, wildcards)
    given = [_given(f"q_{c}") for c in ("county", "city", "postcode", "street")]
    alone = placed & ~_circled() & (F.size("q_words") == 0) & ~reduce(or_, given)
    reached, whole = _reached(q, alone, addresses, k, offset)

    def paths(some: DataFrame) -> list[Path]:
        return [
            _equal_path("postcode", F.col("q_postcode"), F.col("postcode")),
            _circle_path(some, "q_lat", "q_lng", "_reach", "latitude", "longitude"),
        ]

    any_place = {"lat", "lng"} <= set(queries.columns) and not q.filter(placed).isEmpty()
    test = test & (F.col("_reach").isNull() | ~F.col("_alone") | (km <= F.col("_reach")))
    found = filtered_search(
        reached, addresses, F.concat_ws("\n", *(f"_{c}" for c in _FIELDS)), needles, test, order, k,
        offset, {"relevance_score": relevance(F.col("q_words"), wildcards), "distance_km": near},
        totals,
        {f"_{c}": F.lower(c) for c in _FIELDS}, unmatched, paths(reached),
        paths if any_place else None,
    )
    if whole is None or not totals:
        return found
    # what was not looked at counts too
    all_of = reached.filter("_alone").select("qid").distinct().withColumn("_all", F.lit(whole))
    return found.join(all_of, "qid", "left").withColumn("total", F.coalesce("_all", "total")).drop("_all")


def _reached(
    q: DataFrame, alone: Column, addresses: DataFrame, k: int, offset: int
) -> tuple[DataFrame, int | None]:
    """Queries with ``_reach``, the radius that holds their answers, and ``_alone`` where it is not
    asked for but found; the number of addresses if there are such queries."""
    q = q.withColumn("_alone", alone)
    asked = F.when(_circled(), F.col("q_radius_km"))
    if q.filter("_alone").isEmpty():
        return q.withColumn("_reach", asked), None
    need = offset + k
    if "q_limit" in q.columns:
        need = q.filter("_alone").agg(F.max(F.col("q_limit") + F.col("q_offset"))).first()[0]
    place = F.struct("q_lat", "q_lng").alias("place")
    spots = q.filter("_alone").select(
        place.alias("pid"), F.col("q_lat").alias("lat"), F.col("q_lng").alias("lng")
    ).distinct()
    # with fewer places than asked for, rows without a place follow: all are looked at
    reach = cells.reach_of(spots, addresses.select("latitude", "longitude"), need)
    q = q.withColumn("pid", F.when(F.col("_alone"), place)).join(reach, "pid", "left")
    q = q.withColumn("_reach", F.coalesce(asked, "reach")).drop("pid", "reach")
    # read by every step of the search, so found once
    q = stage(q, "reached")
    return q, addresses.count()


def zip_fallback(
    queries: DataFrame, cities: DataFrame, addresses: DataFrame, k: int = 50
) -> DataFrame:
    """queries (qid, street, city, state, zip) whose ZIP holds no address at all:
    the first ``k`` addresses with that street in each ZIP of the city."""
    known = addresses.select(F.col("postcode").alias("zip")).distinct()
    lost = queries.join(known, "zip", "left_anti")
    asked = (
        city_zips(lost.select("qid", "city", "state"), cities)
        .join(lost.select("qid", F.lower("street").alias("needle")), "qid")
        .withColumnRenamed("zip_code", "postcode")
    )
    streets = addresses.select("postcode", F.lower("street").alias("name")).distinct()
    matched = (
        containment_candidates(
            asked.select("postcode", "needle").distinct(), streets, "name",
            F.array("needle"), on=("postcode",), short_words=False,
        )
        .filter(F.contains("name", F.col("needle")))
        .withColumn("list_key", F.concat("postcode", F.lit(SEP), "name"))
    )
    order = ("county", "city", "street", "house_number", "id")
    key = F.array(F.concat("postcode", F.lit(SEP), F.lower("street")))
    lists = ranked_lists(addresses, key, matched, k, order)
    found = asked.join(matched, ["postcode", "needle"]).select("qid", "postcode", "list_key")
    rows = spread_join(found, lists, ["list_key"], "qid").select(
        "qid", F.col("postcode").alias("zip_code"), F.explode("records").alias("rec")
    )
    best = top_k_per_query(
        rows, ["qid", "zip_code"], [F.col(f"rec.{c}").asc_nulls_last() for c in order], k
    )
    return best.select("qid", "zip_code", "rank", "rec.*")


# ------------------------------------------------------------ listings, checks


def list_datasets(
    datasets: DataFrame,
    state: str | None = None,
    status: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """Latest uploads first; one page."""
    if state:
        datasets = datasets.filter(F.col("state") == state)
    if status:
        datasets = datasets.filter(F.col("status") == status)
    return datasets.orderBy(F.col("uploaded_at").desc(), F.col("id")).offset(offset).limit(limit)


def valid_zip(c: Column) -> Column:
    return F.length(c).between(5, 10)


def valid_radius(c: Column) -> Column:
    return (c > 0) & (c <= 100)


def required(*columns: str) -> Column:
    """All of the texts are given."""
    return reduce(lambda a, b: a & b, (_given(c) for c in columns))


def valid_number(text: Column) -> Column:
    """A decimal number and nothing else; blanks around it are not taken."""
    return text.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")


def valid_id(text: Column) -> Column:
    """A whole number of 64 bits."""
    return text.rlike(r"\A[+-]?[0-9]+\z") & text.try_cast("bigint").isNotNull()


def place_rules(lat: str, lng: str) -> dict[str, Column]:
    """Rules for a place given as texts; use them with ``validate``."""
    return {
        "Both lat and lng parameters are required": required(lat, lng),
        "Invalid latitude value": valid_number(F.col(lat)),
        "Invalid longitude value": valid_number(F.col(lng)),
    }


def validate(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``status``: the first rule (message -> condition) a row breaks, else 'ok'."""
    status = F.lit("ok")
    for message, condition in reversed(list(rules.items())):
        status = F.when(~F.coalesce(condition, F.lit(False)), message).otherwise(status)
    return rows.withColumn("status", status)


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checked rows -> (good, rejects)."""
    return rows.filter("status = 'ok'").drop("status"), rows.filter("status <> 'ok'")


def county_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """Join two tables whose county names may be spelled differently."""
    return left.withColumn("_k", county_key(F.col(left_col))).join(
        right.withColumn("_k", county_key(F.col(right_col))), "_k"
    ).drop("_k")

