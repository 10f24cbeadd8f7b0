"""Distance and geometry columns.

Points are two double columns. A polygon is an array of rings, a ring an array
of [lng, lat]; a multipolygon is an array of polygons.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx

POLYGON = "array<array<array<double>>>"
MULTIPOLYGON = "array<array<array<array<double>>>>"


def haversine(lat1, lng1, lat2, lng2, radius: float) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    d_lat, d_lng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    h = F.pow(F.sin(d_lat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(d_lng / 2), 2
    )
    return radius * 2 * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0))))


def haversine_miles(lat1, lng1, lat2, lng2) -> Column:
    return haversine(lat1, lng1, lat2, lng2, lx.EARTH_MILES)


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    return haversine(lat1, lng1, lat2, lng2, lx.MEAN_EARTH_KM)


def ellipsoid_km(lat1, lng1, lat2, lng2) -> Column:
    """Distance on the WGS84 ellipsoid, Andoyer-Lambert first-order correction."""
    a, f = 6378.137, 1 / 298.257223563
    b1 = F.atan((1 - f) * F.tan(F.radians(lat1)))
    b2 = F.atan((1 - f) * F.tan(F.radians(lat2)))
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(
        F.sin(F.radians(lng2 - lng1) / 2), 2
    )
    angle = 2 * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0))))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (angle - F.sin(angle)) * F.try_divide(
        F.pow(F.sin(p) * F.cos(q), 2), F.pow(F.cos(angle / 2), 2)
    )
    y = (angle + F.sin(angle)) * F.try_divide(
        F.pow(F.cos(p) * F.sin(q), 2), F.pow(F.sin(angle / 2), 2)
    )
    return a * (angle - f / 2 * (F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))


def cosines_km(lat1, lng1, lat2, lng2) -> Column:
    """Spherical law of cosines; the cosine is clamped so that equal points give 0."""
    cosine = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(
        F.radians(lng2) - F.radians(lng1)
    ) + F.sin(F.radians(lat1)) * F.sin(F.radians(lat2))
    return lx.EARTH_KM * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def _positions(ring: Column) -> Column:
    return F.array_join(
        F.transform(ring, lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))),
        ", ",
    )


def _polygon_body(rings: Column) -> Column:
    parts = F.transform(rings, lambda r: F.concat(F.lit("("), _positions(r), F.lit(")")))
    return F.concat(F.lit("("), F.array_join(parts, ","), F.lit(")"))


def to_wkt(polygon: Column, kind: str = "POLYGON") -> Column:
    """Array polygon (or multipolygon) -> well-known text."""
    if kind == "MULTIPOLYGON":
        body = F.array_join(F.transform(polygon, _polygon_body), ",")
        return F.concat(F.lit("MULTIPOLYGON("), body, F.lit(")"))
    return F.concat(F.lit("POLYGON"), _polygon_body(polygon))


def point_wkt(lng: Column, lat: Column) -> Column:
    return F.concat(
        F.lit("POINT("), lng.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")
    )


def from_wkt(c: Column) -> Column:
    """POLYGON text -> array polygon, NULL for anything else.

    Well-known text turns into a JSON array by exchanging brackets and blanks.
    """
    body = F.regexp_extract(c, r"(?i)^\s*POLYGON\s*(\(.*\))\s*\z", 1)
    pairs = F.regexp_replace(body, r"([-+0-9.eE]+)\s+([-+0-9.eE]+)", "[$1,$2]")
    return F.from_json(F.nullif(F.translate(pairs, "()", "[]"), F.lit("")), POLYGON)


def as_multipolygon(kind: Column, coordinates: Column) -> Column:
    """GeoJSON coordinates text -> multipolygon; a plain polygon becomes one part."""
    return F.when(kind == "MultiPolygon", F.from_json(coordinates, MULTIPOLYGON)).when(
        kind == "Polygon", F.array(F.from_json(coordinates, POLYGON))
    )


def ring_edges(ring: Column) -> Column:
    """Ring -> array of edges (x1, y1, x2, y2)."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))),
        lambda i: F.struct(
            F.element_at(F.element_at(ring, i), 1).alias("x1"),
            F.element_at(F.element_at(ring, i), 2).alias("y1"),
            F.element_at(F.try_element_at(ring, i + 1), 1).alias("x2"),
            F.element_at(F.try_element_at(ring, i + 1), 2).alias("y2"),
        ),
    )


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.struct(
        F.array_min(xs).alias("min_lng"),
        F.array_min(ys).alias("min_lat"),
        F.array_max(xs).alias("max_lng"),
        F.array_max(ys).alias("max_lat"),
    )
