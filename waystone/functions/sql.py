"""The main column functions under SQL names, for use in spark.sql texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import lexicon as lx


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _suffix_map() -> str:
    pairs = (f"'{k}', '{v}'" for k, v in lx.suffix_words().items())
    return f"map({', '.join(pairs)})"


def _endpoint_case() -> str:
    cases = (f"when contains(path, '{part}') then '{name}'" for part, name in lx.ENDPOINTS)
    return f"case {' '.join(cases)} else 'unknown' end"


def _haversine(radius: float) -> str:
    h = (
        "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) "
        "* pow(sin(radians(lng2 - lng1) / 2), 2)"
    )
    return f"{radius}D * 2 * asin(sqrt(least(1D, {h})))"


def definitions() -> dict[str, str]:
    """Signature and return type -> SQL body."""
    blanks = r"' \t\n\r\f\u000b'"
    last = r"substring_index(translate(street, '\t\n\r\f\u000b', '     '), ' ', -1)"
    outer = rf"^{lx.WS}+|{lx.WS}+\z"
    full = f"try_element_at({_suffix_map()}, upper({last}))"
    place = "lat1 double, lng1 double, lat2 double, lng2 double"
    parts = ", ".join(f"{c} string" for c in ("house", "street", "unit", "city", "region", "zip"))
    return {
        "expand_street(street string) returns string": (
            f"if({full} is null or length({last}) = length(street), street, "
            f"concat(trim(trailing {blanks} from left(street, length(street) - length({last}))), "
            f"' ', {full}))"
        ),
        f"full_address({parts}) returns string": (
            "concat_ws(', ', nullif(concat_ws(' ', nullif(house, ''), "
            "nullif(expand_street(street), ''), nullif(unit, '')), ''), nullif(city, ''), "
            "coalesce(nullif(region, ''), 'OH'), nullif(zip, ''))"
        ),
        "strip_unit(query string) returns string": (
            f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(query, "
            f"{_text(lx.UNIT_PATTERN)}, ''), {_text(lx.DOUBLE_COMMA)}, ', '), "
            f"{_text(lx.SPACE_RUN)}, ' '), {_text(outer)}, '')"
        ),
        "endpoint_of(path string) returns string": _endpoint_case(),
        f"haversine_miles({place}) returns double": _haversine(lx.EARTH_MILES),
        f"haversine_km({place}) returns double": _haversine(lx.MEAN_EARTH_KM),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    names = []
    for signature, body in definitions().items():
        spark.sql(f"create or replace temporary function {signature} return {body}")
        names.append(signature.split("(")[0])
    return names
