"""Readers on small files: good rows, rejects, and odd layouts."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from waystone.plans import source_queries as sq
from waystone.plans.registry import Tables
from waystone.sources import files as fi
from waystone.sources import tables as tb

HEADER = ";".join(fi.ZIP_COLUMNS)


def test_zip_csv(spark, tmp_path):
    def line(zip_code, population="10.555", weights="", point="41.5, -81.25", tail=""):
        return (f"{zip_code};Akron;OH;Ohio;TRUE;;{population};;39153;Summit;{weights};"
                f"Summit,Stark;39153;FALSE;false;America/New_York;{point}{tail}")

    lines = [
        HEADER,
        line("44301", weights='"{""39153"": ""99.5"", ""39151"": 0.5}"'),
        line("44302", population=""),
        line("44303", population="many"),
        line("44304", point="41.5"),
        line("44305", tail=";more"),
        line("44306", weights="{broken"),
        line("44307", point="x, y"),
        "44308;short",
        line("44301", population="7"),
    ]
    path = tmp_path / "zips.csv"
    path.write_text("\n".join(lines) + "\n")
    for multi_line in (True, False):
        good, rejects = fi.read_zip_csv(spark, str(path), multi_line)
        rows = good.collect()
        assert [r["zip_code"] for r in rows] == ["44301", "44302", "44301"]
        first = rows[0]
        assert str(first["population"]) == "10.56" or str(first["population"]) == "10.55"
        assert first["county_weights"] == {"39153": "99.5", "39151": "0.5"}
        assert first["county_names"] == ["Summit", "Stark"] and first["zcta"] is True
        assert first["zcta_parent"] is None and rows[1]["population"] is None
        assert float(first["latitude"]) == 41.5 and float(first["longitude"]) == -81.25
        reasons = {r["zip_code"]: r["reason"] for r in rejects.collect()}
        assert reasons == {
            "44303": "invalid population value", "44304": "invalid geo point",
            "44305": "expected 17 fields", "44306": "invalid county weights",
            "44307": "invalid geo point", "44308": "expected 17 fields",
        }
        merged = tb.upsert(good.limit(0), good, ["zip_code"], F.col("source_order"))
        latest = {r["zip_code"]: r["population"] for r in merged.collect()}
        assert float(latest["44301"]) == 7.0 and len(latest) == 2


def test_city_csv(spark, tmp_path):
    header = ",".join(fi.CITY_COLUMNS)
    row = "{},{},OH,Ohio,39049,Franklin,{},-83.0,{},1500.5,shape,FALSE,TRUE,America/New_York,{},\"{}\",{}"
    lines = [
        header,
        row.format("Columbus", "Columbus", "39.98", "905748", "1", "43201 43202", "1840003760"),
        row.format("Dublín", "Dublin", "bad", "n/a", "0", "", "1840003761"),
        row.format("Columbus", "Columbus", "0", "5", "3", "1", "1840003762"),
        "too,short",
        row.format("Extra", "Extra", "1", "2", "3", "4", "5") + ",more",
    ]
    path = tmp_path / "cities.csv.gz"
    path.write_bytes(gzip.compress(("\n".join(lines) + "\n").encode()))
    rows = fi.read_city_csv(spark, str(path))
    found = {r["external_id"]: r for r in rows.collect()}
    assert set(found) == {"1840003760", "1840003761", "1840003762", "5"}
    assert found["1840003761"]["population"] == 0 and float(found["1840003761"]["lat"]) == 0
    new = tb.insert_new(rows.limit(0), rows, ["city_ascii", "state_id"], F.col("source_order"))
    kept = {r["city_ascii"]: r["external_id"] for r in new.collect()}
    assert kept == {"Columbus": "1840003760", "Dublin": "1840003761", "Extra": "5"}


def feature(props, point=(-84.5, 39.1), kind="Point", **more):
    geometry = {"type": kind, "coordinates": list(point)}
    return {"type": "Feature", "properties": props, "geometry": geometry, **more}


FEATURES = [
    feature({"HOUSENUM": 12, "ST_NAME": "MAIN ST", "USPS_CITY": "DAYTON", "ZIPCODE": "45410"}),
    feature({"HOUSENUM": 45.5, "STREET": " OAK AVE ", "CITY": "", "MUNI": "X", "ZIP": 45410}),
    feature({"HOUSE_NUMB": "7", "ST_NAME": "", "LSN": "7 STATE RTE 247", "COUNTY": "ADA"}),
    feature({"HOUSENUM": None, "HOUSE_NUMB": "9", "ST_NAME": None, "street": "Elm", "UNIT": True}),
    feature({"HOUSENUM": "1"}),
    feature({"ST_NAME": "LONE RD"}),
    feature({"HOUSENUM": "3", "ST_NAME": "BENT LN"}, [[1, 2], [3, 4]], "LineString"),
    feature({"HOUSENUM": "12", "ST_NAME": "MAIN ST", "USPS_CITY": "DAYTON", "ZIPCODE": "45410"}),
]
DATASET = {
    "12|MAIN ST||DAYTON|45410", "45.5|OAK AVE|||45410", "7|STATE RTE 247|||", "9|Elm|true||",
}


@pytest.mark.parametrize("layout", ["one line", "pretty", "lines", "gzip"])
def test_address_files(spark, tmp_path, layout):
    doc = {"type": "FeatureCollection", "name": 'a "Feature" list', "features": FEATURES}
    text = {
        "one line": json.dumps(doc, separators=(",", ":")),
        "pretty": json.dumps(doc, indent=2),
        "lines": "\n".join(map(json.dumps, FEATURES)) + '\n{"type": "Feature", "prop',
        "gzip": json.dumps(doc),
    }[layout]
    name = "adams-addresses-county.geojson"
    if layout == "gzip":
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(text.encode()))
    else:
        (tmp_path / name).write_text(text)
    rows = fi.read_address_geojson(spark, str(tmp_path), "dataset", state="OH")
    got = rows.collect()
    assert {r["hash"] for r in got} == DATASET and len(got) == 5
    assert {r["county"] for r in got} == {"Adams"} and {r["region"] for r in got} == {"OH"}
    added, report = tb.bulk_ingest(spark, str(tmp_path), "OH")
    assert {r["full_address"] for r in added.collect()} >= {"12 MAIN Street, DAYTON, OH, 45410"}
    line = report.first()
    assert (line["admitted"], line["record_count"], line["duplicates"]) == (5, 4, 1)


def test_whole_files_take_any_member_order(spark, tmp_path):
    turned = [{"geometry": f["geometry"], "properties": f["properties"], "type": f["type"]}
              for f in FEATURES]
    path = tmp_path / "adams.geojson"
    path.write_text(json.dumps({"features": turned, "type": "FeatureCollection"}))
    rows = fi.read_address_geojson(spark, str(path), "dataset", state="OH", whole_files=True)
    assert {r["hash"] for r in rows.collect()} == DATASET


def test_no_feature_is_lost(spark, tmp_path):
    turned = [{"geometry": f["geometry"], "properties": f["properties"], "type": f["type"]}
              for f in FEATURES[:3]]
    marked = [feature({"HOUSENUM": "5", "ST_NAME": "FIR ST", "kind": "Feature"}), *FEATURES[:2]]
    texts = {
        "last": json.dumps({"type": "FeatureCollection", "features": turned}),
        "lines": "\n".join(map(json.dumps, turned)),
        "marked": json.dumps({"type": "FeatureCollection", "features": marked}, indent=1),
        "broken": "this is not JSON",
        "cut": json.dumps({"type": "FeatureCollection", "features": FEATURES[:3]})[:-60],
        "none": json.dumps({"type": "FeatureCollection", "features": []}),
    }
    for name, text in texts.items():
        (tmp_path / f"{name} a-addresses-county.geojson").write_text(text)
    features, rejects = fi.read_feature_files(spark, str(tmp_path))

    def per_file(df):
        return {r["_file"].rsplit("/", 1)[-1].split("%20")[0]: r["count"]
                for r in df.groupBy("_file").count().collect()}

    assert per_file(features) == {"last": 3, "lines": 3, "marked": 3, "cut": 2}
    assert per_file(rejects) == {"broken": 1, "cut": 1}
    _, report = tb.bulk_ingest(spark, str(tmp_path), "OH")
    lines = {r["file_name"].split(" ")[0]: r for r in report.collect()}
    assert set(lines) == set(texts)
    assert {n: r["status"] for n, r in lines.items() if r["status"] == "failed"} == {"broken": "failed"}
    assert lines["marked"]["admitted"] == 3 and lines["none"]["admitted"] == 0
    assert lines["broken"]["error_message"] and lines["cut"]["rejected"] == 1


def test_odd_files_are_never_one_row(spark, tmp_path, monkeypatch):
    """Read with splits far smaller than the files, and without reading any file whole."""
    def whole(*_):
        raise AssertionError("a file was read as one row")

    monkeypatch.setattr(fi, "_documents", whole)
    many = [feature({"HOUSENUM": str(k), "ST_NAME": 'A "Feature" {ST', "l": [{"a": 1}, {"b": "}"}]})
            for k in range(60)]
    turned = [{"geometry": f["geometry"], "properties": f["properties"], "type": f["type"]} for f in many]
    kinds = [{**f, "properties": {**f["properties"], "kind": "Feature"}} for f in many]
    nulls = [*many[:30], {"type": "Feature", "properties": {"HOUSENUM": "1"}, "geometry": None},
             {"type": "Feature", "properties": None, "geometry": many[0]["geometry"]}, *many[30:]]
    texts = {
        "last": json.dumps({"type": "FeatureCollection", "features": turned, "crs": {"a": [1]}}),
        "lines": "\n".join(map(json.dumps, turned)),
        "kinds": json.dumps({"features": kinds, "type": "FeatureCollection"}, indent=1),
        "nulls": json.dumps({"type": "FeatureCollection", "features": nulls}),
        "bent": "\n".join([*map(json.dumps, turned[:20]), json.dumps(turned[20])[:-9],
                           *map(json.dumps, turned[21:])]),
    }
    for name, text in texts.items():
        (tmp_path / f"{name}-addresses-county.geojson").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        features, rejects = fi.read_feature_files(spark, str(tmp_path))
        rows = features.select("_file", F.to_json("feature.properties").alias("p"), "source_order").collect()
        refused = [r["_file"] for r in rejects.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    found = {name: [] for name in texts}
    for r in sorted(rows, key=lambda r: r["source_order"]):
        found[r["_file"].rsplit("/", 1)[-1].split("-")[0]].append((json.loads(r["p"] or "null") or {}).get("HOUSENUM"))
    want = [str(k) for k in range(60)]
    assert found["last"] == found["lines"] == found["kinds"] == want
    assert found["nulls"] == [*want[:30], "1", None, *want[30:]]
    assert found["bent"] == [*want[:20], *want[21:]]
    assert len(refused) == 1 and "bent" in refused[0]
    assert fi.read_address_geojson(spark, str(tmp_path), state="OH").count() == 60 * 5 - 1


def test_county_flavour(spark, tmp_path):
    features = [
        feature({"number": 44.5, "street": "MAIN ST", "region": "OHIO", "flag": True}),
        feature({"HOUSENUM": True, "house_number": "8", "LSN": "8 ELM"}),
        feature({"street": "ONLY ST", "hash": "given"}),
        feature({"unit": "5"}),
    ]
    path = tmp_path / "van_wert-addresses-county.geojson"
    path.write_text("\n".join(map(json.dumps, features)))
    rows = fi.read_address_geojson(spark, str(path), "county", county="van_wert").collect()
    got = {(r["hash"], r["house_number"], r["street"], r["region"], r["county"]) for r in rows}
    assert got == {
        ("van_wert_44_MAIN ST_39.100000_-84.500000", "44", "MAIN ST", "OH", "Van_wert"),
        ("van_wert_8_8 ELM_39.100000_-84.500000", "8", "8 ELM", "", "Van_wert"),
        ("given", "", "ONLY ST", "", "Van_wert"),
    }


def test_states(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]

    def state(fips, kind, coordinates):
        props = {"STATEFP": fips, "STUSPS": "S" + fips, "NAME": "State " + fips, "ALAND": 5,
                 "INTPTLAT": "+37.15", "INTPTLON": "-119.27", "REGION": "4"}
        return feature(props, coordinates, kind)

    doc = {"type": "FeatureCollection", "features": [
        state("06", "MultiPolygon", [[ring, hole], [[[9, 9], [10, 9], [10, 10], [9, 9]]]]),
        state("36", "Polygon", [ring]),
        state("36", "Polygon", [hole]),
        state("99", "Point", [1, 2]),
    ]}
    path = tmp_path / "states.geojson.gz"
    path.write_bytes(gzip.compress(json.dumps(doc).encode()))
    rows = {r["state_fips"]: r for r in fi.read_state_geojson(spark, str(path)).collect()}
    assert set(rows) == {"06", "36"}
    assert [len(part) for part in rows["06"]["geometry"]] == [2, 1]
    assert rows["36"]["geometry"] == [[[list(map(float, p)) for p in ring]]]
    assert float(rows["06"]["internal_lat"]) == 37.15


def test_county_meta(spark, tmp_path):
    ring = [[-84, 39], [-83, 39], [-83, 40], [-84, 39]]
    docs = {
        "van_wert": {"bounds": {"type": "Polygon", "coordinates": [ring]}, "count": 7,
                     "source_name": "s", "layer": "l", "stats": {"a": 1}},
        "adams": {"bounds": {"type": "Point", "coordinates": []}, "count": 1},
        "allen": {"bounds": {"type": "Polygon", "coordinates": [ring[:3]]}, "count": 1},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}-addresses-county.geojson.meta").write_text(json.dumps(doc))
    row, = fi.read_county_meta(spark, f"{tmp_path}/*-addresses-county.geojson.meta").collect()
    assert (row["county_name"], row["address_count"], row["stats"]) == ("Van Wert", 7, '{"a":1}')
    assert len(row["ring"]) == 4


def test_write_addresses_by_county(spark, tmp_path):
    rows = spark.createDataFrame(
        [(f"h{i}", f"4541{i % 3}", "Adams" if i % 4 else "Allen") for i in range(200)],
        "hash string, postcode string, county string",
    )
    path = str(tmp_path / "addresses")
    tb.write_addresses(rows, path)
    back = spark.read.parquet(path)
    assert back.count() == 200
    assert back.filter("county = 'Allen'").count() == 50


def test_usage_files_follow_the_volume(spark, tmp_path):
    """A busy day fills several files, a quiet one a single file, and no row is lost."""
    rows = [(i, "2024-01-01 10:00:00") for i in range(4000)] + [(i, "2024-01-02 10:00:00") for i in range(30)]
    rows += [(9, None)]
    usage = spark.createDataFrame(rows, "id long, created_at string").withColumn(
        "created_at", F.to_timestamp("created_at")
    )
    path = str(tmp_path / "usage")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny parts stay apart
    try:
        tb.append_usage(usage.repartition(6), path, rows_a_file=1000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = spark.read.parquet(path)
    each = stored.select("date", "_metadata.file_path").distinct().groupBy("date").count().collect()
    files = {str(r["date"]): r["count"] for r in each}
    assert files["2024-01-02"] == 1 and files["None"] == 1 and 2 <= files["2024-01-01"] <= 4
    assert stored.count() == 4031


def test_insert_counts(spark):
    old = spark.createDataFrame([("a",), ("a",), ("z",)], "k string")
    new = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 1)], "k string, v int")
    assert tuple(tb.insert_counts(old, new, ["k"]).first()) == (4, 2, 2)
    assert tuple(tb.insert_counts(old, new.limit(0), ["k"]).first()) == (0, 0, 0)
    assert tb.insert_new(old, new, ["k"], F.col("v")).count() == 2


def test_many_county_files_are_written_by_many_tasks(spark, tmp_path):
    """Documents of a few bytes: their size alone would send all files to one task."""
    spark.range(300).selectExpr("id as s_suppkey", "concat('S', id) as s_name", "id / 2D as s_acctbal").write.parquet(
        str(tmp_path / "supplier.parquet")
    )
    tables = Tables(spark, str(tmp_path))
    path = sq._write_county_meta(tables)
    files = spark.read.text(f"{path}/*", wholetext=True).selectExpr("_metadata.file_name as f").collect()
    tasks = {r["f"].split("-")[1] for r in files}
    assert len(files) == 300 and len(tasks) == spark.sparkContext.defaultParallelism
    made = sq.read_county_meta(tables)
    assert made.count() == sum(k % 9 > 0 and k % 10 > 0 for k in range(300))
