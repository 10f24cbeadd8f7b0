"""Golden rows for the text columns."""

import pytest
from pyspark.sql import functions as F

from waystone.functions import lexicon as lx
from waystone.functions import text as tx
from waystone.functions.parse import parse_addresses
from waystone.sources.files import dataset_name


def apply(spark, function, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string")
    out = df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in out]


def test_strip_unit(spark):
    cases = {
        "20 Overbrook Ct #F, Monroe, OH 45050": "20 Overbrook Ct, Monroe, OH 45050",
        "123 Main St Apt 2B, Columbus, OH 43215": "123 Main St, Columbus, OH 43215",
        "123 Main St, Suite 100, Columbus": "123 Main St, Columbus",
        "Ste. Genevieve": "Ste. Genevieve",
        "5 Elm St unit #7": "5 Elm St",
        "  1 A St  ": "1 A St",
    }
    assert apply(spark, tx.strip_unit, cases) == list(cases.values())


def test_expand_street(spark):
    cases = {
        "MAIN DR": "MAIN Drive",
        "main   st": "main Street",
        "OAK\tave": "OAK Avenue",
        "DR": "DR",
        " DR": " Drive",
        "ST JOHN": "ST JOHN",
        "High Street": "High Street",
        "Ridge PK": "Ridge PK",
        "5th N": "5th North",
        "MAIN DR ": "MAIN DR ",
    }
    assert apply(spark, tx.expand_street, cases) == list(cases.values())


def test_full_address(spark):
    rows = [
        ("12", "MAIN DR", "2B", "DAYTON", "OH", "45410"),
        ("12", "MAIN DR", "", "", "", ""),
        ("", "", "", "DAYTON", "KY", ""),
        (None, None, None, None, None, None),
    ]
    names = ["house", "street", "unit", "city", "region", "postcode"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    new = [r[0] for r in df.select(tx.full_address(*names)).collect()]
    assert new == ["12 MAIN Drive 2B, DAYTON, OH, 45410", "12 MAIN Drive, OH", "DAYTON, KY", "OH"]
    old = [r[0] for r in df.select(tx.full_address(*names, style="plain")).collect()]
    assert old == ["12 MAIN DR Unit 2B, DAYTON, OH 45410", "12 MAIN DR, ", "DAYTON, KY", ""]


@pytest.mark.parametrize(
    "text, parts",
    [
        ("20 Overbrook Ct, Monroe, OH 45050", ("20", "Overbrook Ct", "Monroe", "OH", "45050")),
        ("20 Overbrook Ct, Monroe OH 45050", ("20", "Overbrook Ct", "Monroe", "OH", "45050")),
        ("20 Main St, Monroe", ("20", "Main St", "Monroe", "", "")),
        ("20 Overbrook Ct Monroe OH 45050", ("20", "Overbrook Ct", "Monroe", "OH", "45050")),
        ("20 Main St, Monroe, OH, 45050", ("20", "Main St", "Monroe", "OH", "45050")),
        ("20 Main St, North, Monroe, OH 45050", ("20", "Main St", "North, Monroe", "OH", "45050")),
        ("20 Main St, OH, 45050", ("20", "Main St", "", "OH", "45050")),
        ("20 Main St, Monroe, Extra", ("20", "Main St", "Monroe", "", "")),
        ("20 Main St, Monroe 45050", ("20", "Main St", "", "", "45050")),
        ("100-102 Elm Ct", ("100-102", "Elm Ct", "", "", "")),
        ("5 Elm Ct 45050-1234", ("5", "Elm", "", "CT", "45050")),
        ("Elm Ct", ("", "Elm Ct", "", "", "")),
        ("Oakley", ("", "", "Oakley", "", "")),
        ("2525 Oakley", ("2525", "Oakley", "", "", "")),
        ("Cincinnati OH", ("", "", "Cincinnati", "OH", "")),
        ("45209", ("", "", "", "", "45209")),
        ("20", ("", "", "20", "", "")),
        ("", ("", "", "", "", "")),
        (" , ,", ("", "", "", "", "")),
        ("12b N. High St. Columbus", ("12b", "N. High St.", "Columbus", "", "")),
    ],
)
def test_parse(spark, text, parts):
    df = spark.createDataFrame([(text,)], "q string")
    assert tuple(parse_addresses(df, "q").select("parsed.*").collect()[0]) == parts


def variants(spark, text):
    df = spark.createDataFrame([(text,)], "q string")
    return {r["variant"] for r in tx.query_variants(df, "q").collect()}


def test_variants(spark):
    assert variants(spark, "123 main dr") == {"123 main dr", "123 main dr.", "123 main drive"}
    assert variants(spark, "N Main AVENUE 5") == {
        "n main avenue 5", "n main ave 5", "n main ave. 5", "n main av 5",
        "n. main avenue 5", "north main avenue 5",
    }
    assert variants(spark, "Oakley") == {"oakley"}
    assert variants(spark, "  Main  St ") == {"  main  st ", "main st", "main st.", "main street"}
    assert variants(spark, "") == {""}


def test_expand_query(spark):
    cases = {
        "7 westerfield dr": "7 westerfield drive",
        "7 Westerfield dr 5": "7 westerfield drive 5",
        "Oakley Plaza": "Oakley Plaza",
        "": "",
    }
    assert apply(spark, tx.expand_query, cases) == list(cases.values())


def test_street_only(spark):
    cases = {
        "8 Prestige Plaza, Miamisburg OH": "Prestige Plaza, Miamisburg OH",
        "123 Main St": "Main St",
        "123": "123",
        "1st Street": "Street",
        "1abcde Street": "1abcde Street",
        "Main St": "Main St",
    }
    assert apply(spark, tx.street_only, cases) == list(cases.values())


def test_endpoint(spark):
    cases = {
        "/api/v1/geocode/45050": "geocode",
        "/api/v1/addresses/search": "search",
        "/api/v1/addresses/7": "addresses",
        "/health": "unknown",
    }
    assert apply(spark, tx.endpoint_of, cases) == list(cases.values())


def test_county_names(spark):
    cases = {
        "/data/adams-addresses-county.geojson.gz": "Adams",
        "adams_county.json": "Adams",
        "van_wert-addresses.geojson": "Van",
        "HAMILTON.geojson": "Hamilton",
    }
    assert apply(spark, tx.county_from_path, cases) == list(cases.values())
    assert apply(spark, tx.title_words, ["van wert", "st.mary-o'neil", "van_wert"]) == [
        "Van Wert", "St.Mary-O'Neil", "Van_wert",
    ]
    assert apply(spark, tx.county_key, ["Van_wert", "VAN WERT"]) == ["van wert", "van wert"]


def test_permissions(spark):
    rows = [(["geocode"], "geocode"), (["distance"], "nearby"), (["*"], "unknown"), (["*"], "admin"),
            (["search"], "cities"), (None, "cities")]
    df = spark.createDataFrame(rows, "p array<string>, e string")
    got = [r[0] for r in df.select(tx.has_permission(F.col("p"), F.col("e"))).collect()]
    assert got == [True, True, False, True, False, False]


def test_row_limits(spark):
    df = spark.createDataFrame([(None,), (0,), (7,), (150,), (9999,)], "n int")

    def run(kind):
        return [r[0] for r in df.select(tx.row_limit(F.col("n"), kind)).collect()]

    assert run("addresses") == [50, 50, 7, 150, 500]
    assert run("zips") == [50, 50, 7, 50, 50]
    assert run("states") == [50, 50, 7, 150, 9999]


def test_trimming_and_file_names_need_no_regular_expression(spark):
    """Same texts as by the patterns, which were run for each value of each row."""
    ends = ["", *lx.WS_CHARS, " \t ", "x", "​"]
    texts = spark.createDataFrame([(a + "b c" + b,) for a in ends for b in ends] + [(" 　",), ("",), (None,)], "c string")
    trimmed = texts.select("c", tx.trim_ws(F.col("c")).alias("t"), F.regexp_replace("c", rf"^{lx.WS}+|{lx.WS}+\z", "").alias("r"))
    assert trimmed.filter("not t <=> r").isEmpty()
    assert "regexp" not in texts.select(tx.trim_ws(F.col("c")).alias("t"))._jdf.queryExecution().toString()
    names = {
        "file:/d/file=a-addresses-county.geojson/part-0-x.txt": "a-addresses-county.geojson", "/d/b%20c.json": "b c.json",
        "//part-1": "part-1", "part-2": "part-2", "/d/": "", "x/part-3/": "", "d/k_=v": "v", None: None,
    }
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", dataset_name(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in rows} == names
