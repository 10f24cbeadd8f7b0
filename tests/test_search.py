"""Searches against brute force on small tables, with crowded keys and odd texts."""

import random

import pytest
from pyspark.sql import functions as F

from waystone.functions import text as tx
from waystone.functions.parse import parse_addresses
from waystone.operators import geocode as gc
from waystone.operators import matching
from waystone.operators import search as se

STREETS = ["MAIN ST", "N MAIN ST", "OAK AVE", "OAKLEY DR", "ELM", "GERMAIN DR", "50% OFF_RD", "A\\B LN"]
CITIES = ["DAYTON", "Dayton View", "MONROE", "OXFORD"]


def table(seed=4, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        crowded = i % 3 == 0  # a third of all rows: one house on one street
        street = "MAIN ST" if crowded else rng.choice(STREETS)
        city = "DAYTON" if crowded else rng.choice(CITIES)
        zip_code = "45410" if crowded else rng.choice(["45410", "45409", "45050"])
        house = "12" if crowded else str(rng.randint(1, 30))
        rows.append((i, house, street, "", city, "OH", zip_code, rng.choice(["Butler", "Adams"]),
                     39 + rng.random(), -84 + rng.random()))
    return rows


@pytest.fixture(scope="module")
def addresses(spark):
    df = spark.createDataFrame(
        table(),
        "id long, house_number string, street string, unit string, city string, region string, "
        "postcode string, county string, latitude double, longitude double",
    )
    line = tx.full_address("house_number", "street", "unit", "city", "region", "postcode")
    return df.withColumn("full_address", line).repartition(4)


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    monkeypatch.setattr(matching, "CHUNK", 20)


TEXTS = [
    "12 Main St, Dayton, OH 45410", "12 Main Street Dayton OH 45410", "main dr, dayton", "Dayton",
    "12 main", "45050", "7 Oakley Drive", "oakley dr 45409", "5 Elm, Oxford, OH", "xyz nowhere",
    "ain St, DAYT", "12 MAIN Street, DAY", "50% OFF_RD", "a\\b ln", "20 Main St #F, Monroe", "", "  ",
    "12 ain Drive, MON", "Dayton, OH 45410", "st",
]


def brute_geocode(rows, parsed, spellings, clean, street_text, street_spellings, k):
    house, street, city, _, zip_code = parsed
    low = [{key: (v or "").lower() for key, v in r.items() if isinstance(v, str)} for r in rows]
    order = []
    for r, l in zip(rows, low):
        st = bool(street) and any(s in l["street"] for s in spellings)
        ho, ci = r["house_number"] == house, l["city"] == city.lower()
        zi = r["postcode"] == zip_code
        if city and zip_code:
            place = ci and zi
        elif zip_code:
            place = zi
        else:
            place = ci if city else True
        tiers, n = [], 0
        if street:
            if house:
                n += 1
                tiers.append((n, st and ho and place))
            n += 1
            tiers.append((n, st and place))
        if zip_code:
            n += 1
            tiers.append((n, zi))
        if city:
            n += 1
            tiers.append((n, ci))
        hit = [t for t, ok in tiers if ok]
        if hit:
            order.append((min(hit), r["full_address"], r["id"]))
    if order:
        return "component", sorted(order)[:k]
    fallback = street_text != "" and street_text != clean
    for r, l in zip(rows, low):
        if fallback:
            tier = 1 if any(s in l["full_address"] for s in spellings_of(clean)) else (
                2 if any(s in l["full_address"] for s in street_spellings) else None)
        else:
            tier = 1 if clean.lower() in l["full_address"] else (
                2 if any(s in l["full_address"] for s in spellings_of(clean)) else None)
        if tier:
            order.append((tier, r["full_address"], r["id"]))
    return "fulltext", sorted(order)[:k]


SPELLINGS = {}


def spellings_of(text):
    return SPELLINGS[text]


@pytest.mark.parametrize("k", [3, 50])
def test_geocode(spark, addresses, k):
    queries = spark.createDataFrame(list(enumerate(TEXTS * 2)), "qid long, q string")
    rows = [r.asDict() for r in addresses.collect()]
    prepared = queries.select("qid", tx.strip_unit(tx.trim_ws(F.col("q"))).alias("clean"))
    prepared = parse_addresses(prepared, "clean").select(
        "*", tx.street_only(F.col("clean")).alias("street_text"))
    plain = prepared.collect()
    asked = {r["clean"] for r in plain} | {r["street_text"] for r in plain}
    asked |= {r["parsed"]["street"] for r in plain}
    words = spark.createDataFrame([(a,) for a in asked], "q string")
    for r in tx.query_variants(words, "q").collect():
        SPELLINGS.setdefault(r["q"], set()).add(r["variant"])
    got = {}
    answers = gc.geocode(queries, addresses.select(
        "id", "full_address", "house_number", "street", "city", "postcode"), k).collect()
    for r in sorted(answers, key=lambda r: r["rank"]):
        got.setdefault(r["qid"], []).append(
            (r["search_method"], r["tier"], r["full_address"], r["id"]))
    for r in plain:
        if r["clean"] == "":
            assert r["qid"] not in got
            continue
        method, want = brute_geocode(
            rows, tuple(r["parsed"]), SPELLINGS[r["parsed"]["street"]], r["clean"],
            r["street_text"], SPELLINGS[r["street_text"]], k)
        assert got.get(r["qid"], []) == [(method, *w) for w in want], r["clean"]


WORDS = ["12 main", "oak 45410", "st", "1 n", "butler oxford", "zzz", "", "50% off", "Dayton #5",
         "a\\b", "main main", "oh"]


def test_search_addresses(spark, addresses):
    rows = [r.asDict() for r in addresses.collect()]
    asked = [(i, w, None, None, None, None) for i, w in enumerate(WORDS)]
    asked += [(100, None, "butl", None, None, None), (101, "main", None, "day", "45410", None),
              (102, None, None, None, "45050", "oak"), (103, "", "Adams", "", "", "main")]
    queries = spark.createDataFrame(
        asked, "qid long, q string, county string, city string, postcode string, street string")
    weights = [("full_address", 150), ("street", 100), (None, 90), ("house_number", 80),
               ("city", 60), ("postcode", 50), ("county", 30)]
    got = {}
    for r in se.search_addresses(queries, addresses, 15, 2).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], r["relevance_score"], r["total"]))
    for qid, text, county, city, postcode, street in asked:
        tokens = (text or "").split("#")[0].lower().split()
        hits = []
        for r in rows:
            low = {k: str(v).lower() for k, v in r.items()}
            fields = ("full_address", "house_number", "street", "city", "county", "postcode")
            if not all(any(t in low[f] for f in fields) for t in tokens):
                continue
            if not ((county or "").lower() in low["county"] and (city or "").lower() in low["city"]
                    and (street or "").lower() in low["street"]
                    and postcode in (None, "", r["postcode"])):
                continue
            score = 0
            for t in tokens:
                for f, w in weights:
                    if t in (low[f] if f else low["house_number"] + " " + low["street"]):
                        score += w
                        break
            hits.append((-score, r["county"], r["city"], r["street"], r["house_number"], r["id"]))
        want = [(n + 1, h[5], -h[0], len(hits)) for n, h in enumerate(sorted(hits))][2:17]
        assert sorted(got.get(qid, [])) == want, (qid, text)


def test_nearest_first_when_a_place_is_given(spark, addresses):
    queries = spark.createDataFrame(
        [(1, "main", 39.5, -83.5, 40.0)], "qid long, q string, lat double, lng double, radius_km double")
    rows = sorted(se.search_addresses(queries, addresses, 500).collect(), key=lambda r: r["rank"])
    assert rows and all("MAIN" in r["street"] for r in rows)
    distances = [r["distance_km"] for r in rows]
    assert distances == sorted(distances) and distances[-1] <= 40


def test_wrong_zip(spark):
    cities = spark.createDataFrame(
        [(1, "Dayton", "Dayton", "OH", "Ohio", "45401 45410")],
        "id long, city string, city_ascii string, state_id string, state_name string, zips string")
    rows = [(1, "1424", "WYOMING ST", "DAYTON", "45410", "Montgomery"),
            (2, "9", "HIGH ST", "DAYTON", "45410", "Montgomery")]
    addresses = spark.createDataFrame(
        rows, "id long, house_number string, street string, city string, postcode string, county string")
    text = "1424 WYOMING STREET, DAYTON, OH, 45401"
    parsed = parse_addresses(spark.createDataFrame([(1, text)], "qid long, q string"), "q")
    queries = parsed.select("qid", F.lit("Wyoming").alias("street"), "parsed.city", "parsed.state",
                            "parsed.zip")
    found = se.zip_fallback(queries, cities, addresses).collect()
    assert [(r["zip_code"], r["id"]) for r in found] == [("45410", 1)]


def test_wildcards_are_literal_unless_asked(spark):
    df = spark.createDataFrame([("MAIN ST", "m_in"), ("50% OFF", "0% o"), ("a\\b", "\\b")], "f string, n string")
    literal = [r[0] for r in df.select(tx.contains_text(F.col("f"), F.col("n"))).collect()]
    live = [r[0] for r in df.select(tx.contains_text(F.col("f"), F.col("n"), True)).collect()]
    assert literal == [False, True, True] and live == [True, True, True]


def test_wildcard_search(spark, addresses):
    queries = spark.createDataFrame(
        [(1, "m_in"), (2, "o%ley"), (3, "50% off"), (4, "%"), (5, "a\\b")], "qid long, q string")
    rows = [r.asDict() for r in addresses.collect()]
    found = se.search_addresses(queries, addresses, 500, wildcards=True).collect()
    counts = {q: sum(r["qid"] == q for r in found) for q in range(1, 6)}

    def holding(*parts):
        return sum(any(p in r["street"].lower() for p in parts) for r in rows)

    assert counts == {1: holding("main"), 2: holding("oakley"), 3: holding("50% off"),
                      4: len(rows), 5: holding("a\\b")}


def test_validation(spark):
    df = spark.createDataFrame([("45050", 5.0), ("4505", 5.0), ("45050", 0.0), (None, 5.0)],
                               "zip string, radius double")
    checked = se.validate(df, {"zip": se.valid_zip(F.col("zip")),
                               "radius": se.valid_radius(F.col("radius"))})
    good, rejects = se.split_valid(checked)
    assert good.count() == 1
    assert sorted(r["status"] for r in rejects.collect()) == ["radius", "zip", "zip"]


def test_large_tables_have_more_tasks(spark, monkeypatch):
    """A task of a text search holds a bounded number of rows (F18)."""
    from waystone.plans import registry

    monkeypatch.setattr(registry, "TASK_ROWS", 10)
    cores = spark.sparkContext.defaultParallelism
    tables = registry.Tables(spark, "nowhere")
    assert tables.spread(spark.range(1000)).rdd.getNumPartitions() == 100
    assert tables.spread(spark.range(7)).rdd.getNumPartitions() == cores
