"""The SQL names give the same values as the columns."""

from pyspark.sql import functions as F

from waystone.functions import geo, sql
from waystone.functions import text as tx


def test_sql_functions(spark):
    names = sql.register(spark)
    assert set(names) == {"expand_street", "full_address", "strip_unit", "endpoint_of",
                          "haversine_miles", "haversine_km"}
    streets = ["MAIN DR", "main \t st", "DR", " DR", "ST JOHN", "5th n", None, "Elm PK"]
    df = spark.createDataFrame([(s, f"\t1 {s} Apt 2B, X\n") for s in streets], "street string, q string")
    df = df.withColumn("path", F.concat(F.lit("/api/addresses/"), "street"))
    df.createOrReplaceTempView("rows_")
    got = spark.sql("""
        select expand_street(street) as a, strip_unit(q) as b, endpoint_of(path) as c,
               full_address('1', street, '', 'X', null, '45410') as d,
               round(haversine_km(39.1, -84.5, 40, -83), 6) as e from rows_""").collect()
    want = df.select(
        tx.expand_street(F.col("street")), tx.strip_unit(F.col("q")), tx.endpoint_of(F.col("path")),
        tx.full_address(F.lit("1"), "street", F.lit(""), F.lit("X"), F.lit(None), F.lit("45410")),
        F.round(geo.haversine_km(F.lit(39.1), F.lit(-84.5), F.lit(40), F.lit(-83)), 6),
    ).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
