"""How searches find their candidates: circles of any size, and one way per query."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waystone.operators import cells, matching, spatial
from waystone.operators import search as se


def km(lat1, lng1, lat2, lng2, earth=6371.0088):
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2
    h += math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * earth * math.asin(min(1, math.sqrt(h)))


def around(rng, lat, lng, radius):
    """A place near the edge of a circle, anywhere on the globe."""
    arc, course = radius * rng.uniform(0.2, 1.05) / 6371.0088, rng.uniform(0, 2 * math.pi)
    a = math.radians(lat)
    s = math.sin(a) * math.cos(arc) + math.cos(a) * math.sin(arc) * math.cos(course)
    there = math.asin(max(-1, min(1, s)))
    turn = math.atan2(math.sin(course) * math.sin(arc) * math.cos(a), math.cos(arc) - math.sin(a) * s)
    return math.degrees(there), (lng + math.degrees(turn) + 540) % 360 - 180


def circles(rng, n):
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(n)]
    spots += [(90.0, 0.0), (-90.0, 7.0), (0.0, 180.0), (0.0, -180.0), (89.999, 50.0), (38.0, 179.9999), (0.0, 0.0)]
    radii = [0.05, 0.3, 2.0, 11.0, 90.0, 800.0, 7000.0, 19000.0]
    return [(i, lat, lng, rng.choice(radii) * rng.uniform(0.5, 2)) for i, (lat, lng) in enumerate(spots)]


def test_circles_of_any_size(spark):
    rng = random.Random(5)
    points = circles(rng, 150)
    targets = [(i, *around(rng, lat, lng, r)) for i, (_, lat, lng, r) in enumerate(points * 3)]
    targets += [(len(targets) + i, lat, lng) for i, (_, lat, lng, _) in enumerate(points)] + [(9999, None, None)]
    asked = [*points, (500, None, 1.0, 5.0), (501, 1.0, 1.0, None), (502, 1.0, 1.0, 0.0), (503, 1.0, 1.0, -4.0)]
    p = spark.createDataFrame(asked, "pid int, lat double, lng double, r double")
    t = spark.createDataFrame(targets, "id int, latitude double, longitude double")
    found = {(x["pid"], x["id"]) for x in spatial.radius_column_join(p, t, "r").collect()}
    near = [(a, b, km(lat, lng, la, ln), r) for a, lat, lng, r in points for b, la, ln in targets if la is not None]
    assert found >= {(a, b) for a, b, d, r in near if d <= r * (1 - 1e-9)}
    assert found <= {(a, b) for a, b, d, r in near if d <= r * (1 + 1e-9)}
    capped = spatial.radius_column_join(p, t, "r", cap_km=100.0)
    assert {x["pid"] for x in capped.select("pid").distinct().collect()} <= {a for a, _, _, r in points if r <= 100}
    assert spatial.radius_column_join(p.limit(0), t, "r").count() == 0


def test_pairs_grow_with_matches(spark):
    """Candidates of circles of very different sizes stay near the number of answers."""
    rng = random.Random(8)
    t = spark.createDataFrame(
        [(i, rng.uniform(38, 42), rng.uniform(-85, -80)) for i in range(20_000)], "id int, latitude double, longitude double"
    )
    p = spark.createDataFrame(
        [(i, 40.0, -82.0, r) for i, r in enumerate([0.4, 1.0, 3.0, 8.0, 20.0, 55.0, 150.0])], "pid int, lat double, lng double, r double"
    )
    level = cells.levels_asked(p.select(cells.level_of(F.col("r")).alias("l")), "l")
    held = t.withColumn("c", F.explode(cells.keys_at(F.col("latitude"), F.col("longitude"), level)))
    covers = p.withColumn("c", F.explode(cells.cover(F.col("lat"), F.col("lng"), F.col("r"))))
    assert covers.groupBy("pid").count().agg(F.max("count")).first()[0] <= 60
    candidates = covers.join(held, "c").count()
    answers = spatial.radius_column_join(p, t, "r").count()
    assert answers > 1000 and candidates < 14 * answers


@pytest.mark.parametrize("need", [7, 400])
def test_reach_holds_what_is_needed(spark, need):
    rng = random.Random(2)
    points = [(i, lat, lng) for i, lat, lng, _ in circles(rng, 5)]
    places = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)] + [(40 + i / 1e4, -80.0) for i in range(200)]
    p = spark.createDataFrame(points, "pid int, lat double, lng double")
    found = cells.reach_of(p, spark.createDataFrame([*places, (None, None)], "latitude double, longitude double"), need)
    reach = {r["pid"]: r["reach"] for r in found.collect()}
    assert set(reach) == {i for i, _, _ in points}
    for i, lat, lng in points:
        assert sum(km(lat, lng, *x) <= reach[i] * (1 + 1e-9) for x in places) >= need
    few = cells.reach_of(p, spark.createDataFrame(places[:3], "latitude double, longitude double"), 4)
    assert few.count() == 0


ROWS = 6000


@pytest.fixture(scope="module")
def addresses(spark):
    rng = random.Random(3)
    rows = []
    for i in range(ROWS):
        street = rng.choice(["MAIN ST", "OAK AVE", "ELM DR", "A ST", "B7 RD"])
        house, city, zip_code = str(i % 400), f"CITY {i % 20}", f"4{i % 100:04d}"
        rows.append((i, house, street, city, zip_code, "COUNTY", f"{house} {street}, {city}, OH, {zip_code}",
                     39 + rng.random(), -84 + rng.random()))
    rows += [(ROWS, "1", "LOST LN", "CITY 1", "40001", "COUNTY", "1 LOST LN", None, None)]
    return spark.createDataFrame(
        rows, "id int, house_number string, street string, city string, postcode string, county string, "
        "full_address string, latitude double, longitude double"
    )


QUERY = "qid int, q string, postcode string, lat double, lng double, radius_km double, limit int, offset int"


def candidates(monkeypatch, search):
    """Pairs that are looked at, by query."""
    seen = {}
    find = matching.containment_candidates

    def counted(*args, **kwargs):
        found = find(*args, **kwargs)
        seen["n"] = found.count()
        return found

    monkeypatch.setattr(se, "containment_candidates", counted)
    rows = search().collect()
    return seen["n"], rows


def test_ways_bound_the_candidates(spark, addresses, monkeypatch):
    asked = [
        ((1, None, None, 39.5, -83.5, 3.0, None, None), 14),  # a circle alone
        ((2, None, "40007", None, None, None, None, None), 1),  # an equality alone
        ((3, "a", None, None, None, None, 5, 2), 1),  # a short word alone
        ((4, "b7", None, None, None, None, None, None), 1),
        ((5, "7 city", "40007", None, None, None, None, None), 3),  # the rarer of several
        ((6, "oak", "40007", 39.5, -83.5, 30.0, None, None), 6),
    ]
    queries = spark.createDataFrame([q for q, _ in asked], QUERY)
    n, rows = candidates(monkeypatch, lambda: se.search_addresses(queries, addresses, unmatched=True))
    total = {r["qid"]: r["total"] for r in rows}
    assert min(total.values()) > 0
    assert n <= sum(total[q[0]] * bound + 40 for q, bound in asked) < len(asked) * ROWS


def test_place_alone_looks_no_farther_than_its_answers(spark, addresses, monkeypatch):
    asked = [(1, None, None, 39.5, -83.5, None, 3, None), (2, "", "", 39.1, -83.9, 0.0, 5, 4), (3, None, None, 60.0, 10.0, None, 1, 0)]
    n, rows = candidates(monkeypatch, lambda: se.search_addresses(spark.createDataFrame(asked, QUERY), addresses))
    assert n < ROWS + 600  # the third place is far from all of them
    table = addresses.collect()
    for qid, _, _, lat, lng, _, limit, offset in asked:
        got = [(r["rank"], r["id"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["qid"] == qid]
        order = sorted((r for r in table if r["latitude"] is not None), key=lambda r: km(lat, lng, r["latitude"], r["longitude"]))
        first = offset or 0
        assert got == [(first + k + 1, r["id"]) for k, r in enumerate(order[first : first + limit])]
    assert {r["total"] for r in rows} == {ROWS + 1}


def test_more_rows_than_places(spark, addresses):
    few = addresses.filter(f"id % 900 = 0 or id = {ROWS}")
    asked = spark.createDataFrame([(1, None, None, 39.5, -83.5, None, 50, None), (1, None, None, 39.6, -83.5, None, 50, None)], QUERY)
    rows = se.search_addresses(asked, few).collect()
    number = few.count()
    assert len(rows) == 2 * number and {r["total"] for r in rows} == {number}
    assert {r["id"] for r in rows if r["rank"] == number} == {ROWS}  # the one without a place


def test_limits_and_offsets_of_queries(spark, addresses):
    asked = [(i, "oak", None, None, None, None, limit, offset) for i, (limit, offset) in
             enumerate([(3, 0), (3, 2), (None, None), (0, 1), (900, 0), (4, 100_000), (2, -5)])]
    rows = se.search_addresses(spark.createDataFrame(asked, QUERY), addresses, k=50).collect()
    got = {}
    for r in rows:
        got.setdefault(r["qid"], []).append(r["rank"])
    total = addresses.filter("lower(full_address) like '%oak%'").count()
    want = {0: (0, 3), 1: (2, 5), 2: (0, 50), 3: (1, 51), 4: (0, 500), 6: (0, 2)}
    for qid, (first, last) in want.items():
        assert sorted(got[qid]) == list(range(first + 1, last + 1))
    assert got[5] == [None] and {r["total"] for r in rows} == {total}


def test_keys_of_paths_never_meet_pieces(spark):
    texts = spark.createDataFrame([(1, "abc", "x"), (2, "abd", "abc")], "id int, t string, k string")
    needles = spark.createDataFrame([(1, "zzz", "abc"), (2, None, "x"), (3, "abd", None)], "qid int, n string, key string")
    path = (F.when(F.col("key").isNotNull(), F.array(matching.tagged("k", F.col("key")))), F.array(matching.tagged("k", F.col("k"))))
    found = matching.containment_candidates(
        needles, texts, "t", F.array_compact(F.array("n")), paths=[path]
    )
    assert {(r["qid"], r["id"]) for r in found.collect()} == {(2, 1), (3, 2)}


def test_only_the_nearest_are_ranked(spark, monkeypatch):
    """a circle holds thousands of addresses; those that are sorted follow the page."""
    rng = random.Random(3)
    rows = [(i, f"{i} Elm Drive", str(i), "Elm DR", "X", "1", "C", 40 + rng.uniform(-1, 1), -82 + rng.uniform(-1, 1))
            for i in range(4000)]
    rows += [(4000 + i, "Elm Drive", "1", "Elm DR", "X", "1", "C", *p)
             for i, p in enumerate([(40.0, -82.0), (None, None), (float("nan"), 1.0)])]
    a = spark.createDataFrame(
        rows, "id int, full_address string, house_number string, street string, city string, postcode string,"
        " county string, latitude double, longitude double"
    ).repartition(3)
    q = spark.createDataFrame(
        [(1, 40.0, -82.0, 60.0, None, 5, 0), (2, 40.1, -82.1, 90.0, "elm", 3, 4), (3, 40.0, -82.0, None, "elm", 2, 4001),
         (4, 40.0, -82.0, 0.0001, None, 5, 0), (5, None, None, None, "17 elm", 5, 0)],
        "qid int, lat double, lng double, radius_km double, q string, limit int, offset int",
    )
    ranked, plain = [], se.top_k_per_query

    def counted(df, *rest):
        ranked.append(df.count())
        return plain(df, *rest)

    monkeypatch.setattr(se, "top_k_per_query", counted)
    found = {}
    for r in se.search_addresses(q, a).orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], (r["total"], []))[1].append(r["id"])

    def near(lat, lng, most):
        by = sorted((round(km(lat, lng, x[7], x[8]), 6), x[0]) for x in rows[:4001] if km(lat, lng, x[7], x[8]) <= most)
        return [i for _, i in by]

    first, second = near(40.0, -82.0, 60), near(40.1, -82.1, 90)
    assert found[1] == (len(first), first[:5]) and found[2] == (len(second), second[4:7])
    assert found[3] == (4003, [4002, 4001])
    worded = sum("17" in str(i) for i in range(4000))
    assert found[4] == (1, [4000]) and found[5][0] == worded
    assert len(first) > 500 and sum(ranked) < 4003 + worded + 200
