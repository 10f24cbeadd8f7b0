"""Readers: ZIP and city CSV, state, address and county GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.props import members, pick_prop, prop_text
from ..functions.text import address_hash, county_from_path, title_words, trim_ws
from ..operators.stage import stage
from .csvlines import read_records
from .scanning import scanned

# Fixed values. Column order of the input files.
ZIP_COLUMNS = (
    "zip_code city_name state_code state_name zcta zcta_parent population density "
    "primary_county_code primary_county_name county_weights county_names county_codes "
    "imprecise military timezone geo_point"
).split()
CITY_COLUMNS = (
    "city city_ascii state_id state_name county_fips county_name lat lng population density "
    "source military incorporated timezone ranking zips external_id"
).split()

# Fixed values. Property names by output field, in order of preference.
DATASET_PROPS = {
    "house_number": ("HOUSENUM", "HOUSE_NUMB", "house_number", "LHN"),
    "street": ("ST_NAME", "STREET", "street"),
    "line": ("LSN",),
    "city": ("USPS_CITY", "CITY", "city", "MUNI", "COMM"),
    "postcode": ("ZIPCODE", "ZIP", "postcode", "postal_code"),
    "unit": ("UNITNUM", "UNIT", "unit", "UNITEXTRA"),
    "district": ("COUNTY", "district"),
}
COUNTY_PROPS = {
    "house_number": ("number", "HOUSENUM", "HouseNum", "house_number", "housenumber"),
    "street": ("street", "ST_NAME", "StreetName", "street_name", "STREETNAME", "LSN"),
    "unit": ("unit", "UNITNUM", "Unit", "UNIT"),
    "city": ("city", "USPS_CITY", "City", "CITY", "MUNI"),
    "region": ("region", "STATE", "State", "state", "REGION"),
    "postcode": ("postcode", "ZIPCODE", "ZipCode", "zip_code", "POSTCODE"),
    "hash": ("hash",),
}
STATE_PROPS = (
    "STATEFP string, STATENS string, GEOID string, STUSPS string, NAME string, LSAD string, "
    "MTFCC string, FUNCSTAT string, ALAND bigint, AWATER bigint, INTPTLAT string, "
    "INTPTLON string, REGION string, DIVISION string"
)


def _source_order() -> Column:
    """Reading position: file, split, row in the split. Stable under retries."""
    return F.struct(
        F.col("_file").alias("file"),
        F.col("_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    ).alias("source_order")


def _csv(spark, path, columns, sep, multi_line) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in columns) + ", _corrupt string"
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
               "columnNameOfCorruptRecord": "_corrupt"}
    if multi_line is None:
        records = read_records(spark, path, sep)
        read = F.explode(F.array(F.from_csv("text", schema, options)))
        at = F.struct(F.col("_file").alias("file"), F.col("_start").alias("start"), "row")
        rows = records.select(read.alias("r"), at.alias("source_order")).select("r.*", "source_order")
    else:
        rows = (
            spark.read.schema(schema)
            .options(**options, header=True, multiLine=multi_line, enforceSchema=True)
            .csv(path)
            .select(
                *columns,
                "_corrupt",
                F.col("_metadata.file_path").alias("_file"),
                F.col("_metadata.file_block_start").alias("_start"),
            )
            .withColumn("source_order", _source_order())
        )
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns), "_corrupt", "source_order")


def _is_true(c: str) -> Column:
    return F.upper(c) == "TRUE"


def _number(c: str, kind: str = "double") -> Column:
    return F.expr(f"try_cast(nullif({c}, '') as {kind})")


def _comma_list(c: str) -> Column:
    return F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))


def read_zip_csv(
    spark: SparkSession, path: str, multi_line: bool | None = None
) -> tuple[DataFrame, DataFrame]:
    """';'-separated ZIP points -> (good rows, rejected rows with a reason).

    Rows need all 17 fields, readable numbers and weights, and a "lat, lng"
    point. Quoted fields may hold line breaks, and big files are split nevertheless;
    ``multi_line=True`` reads each file in one task instead, ``False`` takes each line as a row.
    """
    raw = _csv(spark, path, ZIP_COLUMNS, ";", multi_line)
    spot = F.split(trim_ws(F.col("geo_point")), ",")
    raw = raw.withColumns(
        {
            "_population": _number("population"),
            "_density": _number("density"),
            "_weights": F.from_json(
                F.replace(F.trim(F.col("county_weights"), F.lit('"')), F.lit('""'), F.lit('"')),
                "map<string,string>",
            ),
            "_lat": trim_ws(spot[0]).try_cast("double"),
            "_lng": F.try_element_at(spot, F.lit(2)),
            "_parts": F.size(spot),
        }
    ).withColumn("_lng", trim_ws(F.col("_lng")).try_cast("double"))
    reason = (
        F.when(F.col("_corrupt").isNotNull(), "expected 17 fields")
        .when((F.col("population") != "") & F.col("_population").isNull(),
              "invalid population value")
        .when((F.col("density") != "") & F.col("_density").isNull(), "invalid density value")
        .when((F.col("county_weights") != "") & F.col("_weights").isNull(),
              "invalid county weights")
        .when((F.col("_parts") != 2) | F.col("_lat").isNull() | F.col("_lng").isNull(),
              "invalid geo point")
    )
    raw = raw.withColumn("reason", reason)
    good = raw.filter(F.col("reason").isNull()).select(
        "zip_code", "city_name", "state_code", "state_name",
        _is_true("zcta").alias("zcta"),
        F.nullif("zcta_parent", F.lit("")).alias("zcta_parent"),
        F.col("_population").cast("decimal(12,2)").alias("population"),
        F.col("_density").cast("decimal(10,2)").alias("density"),
        "primary_county_code", "primary_county_name",
        F.col("_weights").alias("county_weights"),
        _comma_list("county_names").alias("county_names"),
        _comma_list("county_codes").alias("county_codes"),
        _is_true("imprecise").alias("imprecise"),
        _is_true("military").alias("military"),
        "timezone",
        F.col("_lat").cast("decimal(10,7)").alias("latitude"),
        F.col("_lng").cast("decimal(10,7)").alias("longitude"),
        "source_order",
    )
    rejects = raw.filter(F.col("reason").isNotNull()).select(*ZIP_COLUMNS, "reason", "source_order")
    return good, rejects


def read_city_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """City CSV, plain or gzip. Unreadable numbers become 0; short rows are left out.
    ``multi_line`` as in ``read_zip_csv``."""
    raw = _csv(spark, path, CITY_COLUMNS, ",", multi_line)
    # Extra fields are allowed, so only rows with too few fields are dropped.
    fields = F.size(F.split("_corrupt", r',(?=(?:[^"]*"[^"]*")*[^"]*\z)', -1))
    raw = raw.filter(F.col("_corrupt").isNull() | (fields > len(CITY_COLUMNS)))

    def number(c: str, kind: str) -> Column:
        return F.coalesce(_number(c, kind), F.lit(0).cast(kind))

    return raw.select(
        "city", "city_ascii", "state_id", "state_name", "county_fips", "county_name",
        number("lat", "double").cast("decimal(10,7)").alias("lat"),
        number("lng", "double").cast("decimal(11,7)").alias("lng"),
        number("population", "int").alias("population"),
        number("density", "double").cast("decimal(10,2)").alias("density"),
        "source",
        _is_true("military").alias("military"),
        _is_true("incorporated").alias("incorporated"),
        "timezone",
        number("ranking", "int").alias("ranking"),
        "zips", "external_id", "source_order",
    )


# ------------------------------------------------------------ GeoJSON


def _schema(properties: str, coordinates: str) -> str:
    return (
        f"type string, properties {properties}, "
        f"geometry struct<type: string, coordinates: {coordinates}>"
    )


#: Names of odd files that are sent to every task, at most.
LISTED = 50_000

# Free-form members stay variants; they are read by name later.
FREE = ("variant", "variant")


def read_features(
    spark: SparkSession, path: str | list[str], types: tuple[str, str] = FREE,
    whole_files: bool = False,
) -> DataFrame:
    """Features of FeatureCollection or newline-delimited files; see ``read_feature_files``."""
    return read_feature_files(spark, path, types, whole_files)[0]


def read_feature_files(
    spark: SparkSession, path: str | list[str], types: tuple[str, str] = FREE,
    whole_files: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Features of files, plain or gzip, with members in any order -> (features, rejects).

    Files are cut behind each ``"Feature"`` type mark, so a large file is read piece by piece
    (and split if it is not compressed). A file in which any piece is not the rest of a
    whole feature (``type`` comes later, the mark is also a value, something is broken)
    or which has none is read by ``scanned``, chunk by chunk and chunks side by side.
    A member that is null is there. Rejects (file, reason, text) hold every part of a file that
    is no feature. ``types``: column types of properties and coordinates; ``whole_files`` reads
    all files as documents, each in one row.
    """
    if whole_files:
        return parse_documents(_documents(spark.read, path), types)
    return features_of(feature_pieces(spark.read, path), types)


def features_of(pieces: DataFrame, types: tuple[str, str] = FREE) -> tuple[DataFrame, DataFrame]:
    """Raw pieces (see ``feature_pieces``) -> (features, rejects)."""
    # only names of members are read here; null if the text is no object
    names = F.json_object_keys(F.concat(F.lit('{"type":"Feature"'), F.col("value")))
    good = F.array_contains(names, "properties") & F.array_contains(names, "geometry")
    judged = pieces.filter(~_opens()).select("_file", F.coalesce(good, F.lit(False)).alias("good"))
    files = pieces.select("_file").distinct().join(
        judged.groupBy("_file").agg(
            F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
        ), "_file", "left",
    )
    odd = stage(files.filter("bad > 0 or coalesce(good, 0) = 0").select("_file"), "odd-files")
    number = odd.count()
    if not number:
        nothing = pieces.sparkSession.createDataFrame([], "_file string, reason string, text string")
        return parse_pieces(pieces, types), nothing
    if number > LISTED:  # too many to send to every task: all are scanned, with the same rows
        return parse_scanned(scanned(pieces), types)
    odd = F.broadcast(odd)
    plain = parse_pieces(pieces.join(odd, "_file", "left_anti"), types)
    rest, rejects = parse_scanned(scanned(pieces.join(odd, "_file", "left_semi")), types)
    return plain.unionByName(rest), rejects


def parse_scanned(texts: DataFrame, types: tuple[str, str] = FREE) -> tuple[DataFrame, DataFrame]:
    """Objects of files (see ``scanned``) -> (features, rejects)."""
    feature = F.explode(F.array(F.struct(F.from_json("text", _schema(*types)).alias("f"))))
    rows = texts.select("_file", "chunk", "row", "text", feature.alias("p"))
    found = F.col("p.f")
    good = F.coalesce(found["type"] == "Feature", F.lit(False)) & (
        found["properties"].isNotNull() | found["geometry"].isNotNull()
    )
    order = F.struct(F.col("_file").alias("file"), F.col("chunk").alias("start"), "row")
    features = rows.filter(good).select(found.alias("feature"), "_file", order.alias("source_order"))
    rejects = rows.filter(~good).select(
        "_file",
        F.when(F.col("text").isNull(), "no feature in this file").otherwise("not a feature")
        .alias("reason"),
        "text",
    )
    return features, rejects


def _documents(reader, path: str | list[str]) -> DataFrame:
    return reader.text(path, wholetext=True).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def parse_documents(docs: DataFrame, types: tuple[str, str] = FREE) -> tuple[DataFrame, DataFrame]:
    """Whole files -> (features, rejects): as a collection, else as lines that hold features,
    else as the pieces behind the marks."""
    schema = _schema(*types)

    def parsed(text: Column) -> Column:
        return F.struct(text.alias("text"), F.from_json(text, schema).alias("feature"))

    lines = F.transform(
        F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: parsed(x)
    )
    marked = F.split("value", '"Feature"')
    pieces = F.transform(
        F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(0))),
        lambda x: parsed(F.concat(F.lit('{"type":"Feature"'), x)),
    )
    members_ = F.transform(
        F.col("doc.features"), lambda x: F.struct(F.lit(None).cast("string").alias("text"), x.alias("feature"))
    )
    found = docs.select(
        "_file", "_start", "value",
        F.from_json("value", f"features array<struct<{schema}>>").alias("doc"),
        lines.alias("lines"),
    )
    is_feature = F.exists("lines", lambda x: x["feature"]["type"] == "Feature")
    collection = F.col("doc.features").isNotNull()
    parts = F.when(collection, members_).when(is_feature, F.col("lines")).otherwise(pieces)
    rows = found.select(
        "_file", "_start", collection.alias("collection"), F.explode_outer(parts).alias("part")
    )
    feature = F.col("part.feature")
    good = F.coalesce(feature["type"] == "Feature", F.lit(False)) & (
        feature["properties"].isNotNull() | feature["geometry"].isNotNull()
    )
    features = rows.filter(good).select(feature.alias("feature"), "_file", _source_order())
    empty = F.col("collection") & F.col("part").isNull()  # a collection without features
    rejects = rows.filter(~good & ~empty).select(
        "_file",
        F.when(F.col("part").isNull(), "no feature in this file").otherwise("not a feature")
        .alias("reason"),
        F.col("part.text").alias("text"),
    )
    return features, rejects


def feature_pieces(reader, path: str | list[str]) -> DataFrame:
    """Raw pieces of feature files; ``reader`` is ``spark.read`` or ``spark.readStream``."""
    return reader.option("lineSep", '"Feature"').text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def _opens() -> Column:
    """The piece before the first mark opens the file and holds no feature."""
    return F.ltrim("value").startswith("{")


def parse_pieces(pieces: DataFrame, types: tuple[str, str] = FREE) -> DataFrame:
    ordered = pieces.select("value", "_file", _source_order())
    rest = ordered.filter(~_opens())
    text = F.concat(F.lit('{"type":"Feature"'), F.col("value"))
    # Through a generator, so that a piece is parsed once for all later uses.
    parsed = F.explode(F.array(F.from_json(text, _schema(*types))))
    return rest.select(parsed.alias("feature"), "_file", "source_order")


def read_state_geojson(
    spark: SparkSession, path: str, whole_files: bool = False
) -> DataFrame:
    """State features -> one row per state, first wins; polygons become multipolygons."""
    rows = read_features(spark, path, (f"struct<{STATE_PROPS}>", "string"), whole_files)
    p, g = "feature.properties", "feature.geometry"

    def degrees(c: str, kind: str) -> Column:
        return F.coalesce(F.col(f"{p}.{c}").try_cast("double"), F.lit(0.0)).cast(kind)

    found = rows.select(
        F.col(f"{p}.STATEFP").alias("state_fips"),
        F.col(f"{p}.STUSPS").alias("state_abbr"),
        F.col(f"{p}.NAME").alias("state_name"),
        F.col(f"{p}.STATENS").alias("state_ns"),
        F.col(f"{p}.GEOID").alias("geoid"),
        F.col(f"{p}.REGION").alias("region"),
        F.col(f"{p}.DIVISION").alias("division"),
        F.col(f"{p}.LSAD").alias("lsad"),
        F.col(f"{p}.MTFCC").alias("mtfcc"),
        F.col(f"{p}.FUNCSTAT").alias("funcstat"),
        F.col(f"{p}.ALAND").alias("area_land"),
        F.col(f"{p}.AWATER").alias("area_water"),
        degrees("INTPTLAT", "decimal(10,7)").alias("internal_lat"),
        degrees("INTPTLON", "decimal(11,7)").alias("internal_lng"),
        geo.as_multipolygon(F.col(f"{g}.type"), F.col(f"{g}.coordinates")).alias("geometry"),
        "source_order",
    ).filter(F.col("geometry").isNotNull() & F.col("state_fips").isNotNull())
    columns = [c for c in found.columns if c not in ("source_order", "state_fips")]
    first = found.groupBy("state_fips").agg(
        F.min_by(F.struct(*columns), "source_order").alias("s")
    )
    return first.select("state_fips", "s.*")


def read_address_geojson(
    spark: SparkSession,
    path: str | list[str],
    flavour: str = "dataset",
    county: str | None = None,
    state: str | None = None,
    whole_files: bool = False,
) -> DataFrame:
    """Address point features -> address rows with their duplicate key.

    flavour "dataset": needs house number and street; county and state come
    from the arguments (county from the file name if absent). flavour "county":
    needs one of the two; region from the properties. Other features than
    points are left out.
    """
    features = read_features(spark, path, whole_files=whole_files)
    return address_rows(features, flavour, county, state)


def address_rows(
    features: DataFrame, flavour: str, county: str | None = None, state: str | None = None
) -> DataFrame:
    """Features (see ``read_features``) -> address rows."""
    at = F.when(F.col("feature.geometry.type") == "Point", F.col("feature.geometry.coordinates"))
    read = F.struct(
        members(F.col("feature.properties")).alias("p"),
        F.try_variant_get(at, "$[0]", "double").alias("longitude"),
        F.try_variant_get(at, "$[1]", "double").alias("latitude"),
    )
    rows = features.select(F.explode(F.array(read)).alias("r"), "_file", "source_order")
    rows = rows.select("r.*", "_file", "source_order").filter(
        "longitude is not null and latitude is not null"
    )
    table = DATASET_PROPS if flavour == "dataset" else COUNTY_PROPS
    # Pick, then format, each in its own projection: a picked value is read once.
    picked = {name: pick_prop(F.col("p"), names, flavour) for name, names in table.items()}
    rows = rows.select(
        *(c.alias(n) for n, c in picked.items()), "latitude", "longitude", "_file", "source_order"
    ).select(
        *(prop_text(F.col(n), flavour).alias(n) for n in picked),
        "latitude", "longitude", "_file", "source_order",
    )
    # A generator keeps the admission filter from repeating the property reads.
    rows = rows.select(
        F.explode(F.array(F.struct(*picked))).alias("f"), "latitude", "longitude", "_file",
        "source_order",
    ).select("f.*", "latitude", "longitude", "_file", "source_order")
    # The dataset layout of Spark's own writer puts the name on the folder.
    file_name = dataset_name(F.col("_file"))
    place = F.lit(county) if county is not None else county_from_path(file_name)
    house, street = F.col("house_number"), F.col("street")
    if flavour == "dataset":
        bare = F.when(
            F.col("line").startswith(house), F.substr("line", F.length(house) + 1)
        ).otherwise(F.col("line"))
        from_line = F.when((house != "") & (F.col("line") != ""), trim_ws(bare)).otherwise("")
        rows = rows.withColumn("street", F.when(street == "", from_line).otherwise(street))
        rows = rows.filter((F.col("house_number") != "") & (F.col("street") != ""))
        rows = rows.withColumn("region", F.lit(state or ""))
        key = address_hash(
            "dataset", *(F.col(c) for c in ("house_number", "street", "unit", "city", "postcode"))
        )
        shown = place
    else:
        rows = rows.filter((house != "") | (street != ""))
        rows = rows.withColumn("district", F.lit("")).withColumn(
            "region", F.substring("region", 1, 2)
        )
        key = address_hash(
            "county", F.lower(place),
            *(F.col(c) for c in ("house_number", "street", "latitude", "longitude")),
            given=F.col("hash"),
        )
        shown = title_words(place)
    return rows.select(
        key.alias("hash"), "house_number", "street", "unit", "city", "district", "region",
        "postcode", shown.alias("county"), "latitude", "longitude",
        file_name.alias("file_name"), "source_order",
    )


def dataset_name(path: Column) -> Column:
    """File name, or the folder's name for part files written by Spark."""
    own, last = F.substring_index(path, "/", -1), F.substring_index(path, "/", -2)
    folder = F.when(last.contains("/"), F.substring_index(last, "/", 1)).otherwise("")
    name = F.when(own.startswith("part-") & (folder != ""), folder).otherwise(own)
    return F.regexp_replace(F.url_decode(name), "^[a-z_]+=", "")


def read_county_meta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """County boundary files (one JSON document each) -> one row per county, last file wins.

    The county's name comes from the file name; only polygons whose first ring
    has at least 4 positions are taken.
    """
    schema = (
        "source_name string, layer string, count int, stats string, "
        "bounds struct<type: string, coordinates: array<array<array<double>>>>"
    )
    docs = spark.read.text(path, wholetext=True).select(
        F.from_json("value", schema).alias("m"), F.col("_metadata.file_path").alias("_file")
    )
    name = F.regexp_replace(dataset_name(F.col("_file")), r"-addresses-county\.geojson\.meta\z", "")
    name = title_words(trim_ws(F.regexp_replace(name, "[_-]", " ")))
    ring = F.filter(F.element_at("m.bounds.coordinates", 1), lambda p: F.size(p) >= 2)
    rows = docs.filter("m.bounds.type = 'Polygon' and size(m.bounds.coordinates) > 0").select(
        name.alias("county_name"), "m.source_name", "m.layer",
        F.col("m.count").alias("address_count"), F.col("m.stats").alias("stats"),
        F.explode(F.array(ring)).alias("ring"), "_file",
    ).filter(F.size("ring") >= 4)
    columns = [c for c in rows.columns if c not in ("county_name", "_file")]
    last = rows.groupBy("county_name").agg(F.max_by(F.struct(*columns), "_file").alias("c"))
    return last.select("county_name", "c.*")
