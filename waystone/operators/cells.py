"""Grid cells for circles of any size: a level for each class of radius.

Level l has 9 * 4^l rows of cells from pole to pole and twice as many columns. A circle uses the
finest level whose cells are at least half its radius high, so it touches few cells and they
cover little more than the circle. A key is one whole number that holds level, row and column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx

LEVELS = 8
_BITS = 20


def _reach(radius_km: Column) -> Column:
    """Degrees of latitude, with slack for rounding."""
    degrees = radius_km / lx.EARTH_KM * 1.001 * 57.29577951308232
    return F.least(F.greatest(degrees, F.lit(1e-9)), F.lit(180.0))


def level_of(radius_km: Column) -> Column:
    finest = F.floor(F.log(4.0, 40.0 / _reach(radius_km)))
    return F.least(F.greatest(finest, F.lit(0)), F.lit(LEVELS - 1)).cast("int")


def levels_asked(radii: DataFrame, level: str) -> list[int]:
    """Levels in use; at most ``LEVELS`` rows reach the driver."""
    found = radii.filter(F.col(level).isNotNull()).select(level).distinct().collect()
    return sorted(r[0] for r in found)


def _key(level: Column, row: Column, column: Column) -> Column:
    high = F.shiftleft(level.cast("bigint"), 2 * _BITS)
    return high + F.shiftleft(row.cast("bigint"), _BITS) + column.cast("bigint")


def _rows(level: Column) -> Column:
    return F.expr("9L") * F.pow(F.lit(4.0), level).cast("bigint")


def key_at(lat: Column, lng: Column, level: int) -> Column:
    """The cell of a place; null without a place."""
    rows = 9 * 4**level
    row = F.floor((lat + 90) * (rows / 180))
    column = F.pmod(F.floor((lng + 180) * (rows / 180)), F.lit(2 * rows))
    return _key(F.lit(level), row, column)


def keys_at(lat: Column, lng: Column, levels: list[int]) -> Column:
    """The cells of a place on several levels; no element without a place."""
    if not levels:
        return F.array().cast("array<bigint>")
    return F.array_compact(F.array(*(key_at(lat, lng, level) for level in levels)))


def cover(lat: Column, lng: Column, radius_km: Column, level: Column | None = None) -> Column:
    """Array of the cells a circle can touch, of its own level unless another is given;
    longitudes wrap at 180 degrees."""
    reach = _reach(radius_km)
    level = level_of(radius_km) if level is None else level
    rows = _rows(level)
    scale, columns = rows / 180.0, rows * 2
    sine = F.try_divide(F.sin(F.radians(F.least(reach, F.lit(89.99)))), F.cos(F.radians(lat)))
    polar = (F.abs(lat) + reach >= 90) | (F.abs(sine) >= 1) | sine.isNull()
    side = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(sine, F.lit(1.0)))) + 1e-9)

    def row(at: Column) -> Column:
        return F.least(F.greatest(F.floor((at + 90) * scale), F.lit(0)), rows)

    def column(at: Column) -> Column:
        return F.floor((at + 180) * scale)

    first = column(lng - side)
    last = F.least(column(lng + side), first + columns - 1)
    of_row = lambda r: F.transform(
        F.sequence(first, last), lambda c: _key(level, r, F.pmod(c, columns))
    )
    return F.flatten(F.transform(F.sequence(row(lat - reach), row(lat + reach)), of_row))


def _farthest_km(lat: Column, lng: Column, key: Column) -> Column:
    """No place of the cell is farther away than this."""
    level = F.shiftright(key, 2 * _BITS)
    row = F.shiftright(key, _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))
    column = key.bitwiseAND(F.lit((1 << _BITS) - 1))
    side = F.lit(20.0) / F.pow(F.lit(4.0), level)
    south, west = row * side - 90, column * side - 180
    d_lat = F.greatest(F.abs(lat - south), F.abs(lat - south - side))
    apart = F.pmod(F.abs(lng - west - side / 2), F.lit(360.0))
    d_lng = F.least(F.least(apart, 360 - apart) + side / 2, F.lit(180.0))
    level_lat = F.least(F.abs(south), F.abs(south + side))
    widest = F.when((south <= 0) & (south + side >= 0), 1.0).otherwise(F.cos(F.radians(level_lat)))
    h = F.pow(F.sin(F.radians(d_lat) / 2), 2) + F.cos(F.radians(lat)) * widest * F.pow(
        F.sin(F.radians(d_lng) / 2), 2
    )
    return 2 * lx.EARTH_KM * 1.0001 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def reach_of(points: DataFrame, places: DataFrame, need: int) -> DataFrame:
    """points (pid, lat, lng), places (latitude, longitude) -> (pid, reach): a radius in km that
    holds at least ``need`` places for certain, one of a few sizes; none if there are fewer.

    Only counts of cells are compared, so the work does not grow with crowded places. Points with
    a column ``most`` are tried with no larger radius."""
    radii = [0.3 * 4.0**i for i in range(8)] + [20_100.0]  # the last one reaches round the globe
    held = F.explode(keys_at(F.col("latitude"), F.col("longitude"), list(range(LEVELS))))
    counts = places.select(held.alias("_cell")).groupBy("_cell").agg(F.count("*").alias("n"))
    sizes = F.array(*map(F.lit, radii))
    if "most" in points.columns:
        sizes = F.filter(sizes, lambda r: r <= F.col("most"))
    tried = points.select("pid", "lat", "lng", F.explode(sizes).alias("reach"))
    lat, lng = F.col("lat"), F.col("lng")
    finer = level_of(F.col("reach") / 4)  # of which many lie wholly inside
    spots = tried.withColumn("_cell", F.explode(cover(lat, lng, F.col("reach"), finer)))
    inside = spots.join(counts, "_cell").filter(
        (_farthest_km(lat, lng, F.col("_cell")) <= F.col("reach")) | (F.col("reach") == radii[-1])
    )
    sums = inside.groupBy("pid", "reach").agg(F.sum("n").alias("n")).filter(F.col("n") >= need)
    return sums.groupBy("pid").agg(F.min("reach").alias("reach"))


#: Classes of distance for each doubling, and the distance below which all are one class.
STEPS, NEAREST_KM = 4, 0.01
#: Classes of places whose distance is no number, or null; they come last, in this order.
NO_NUMBER, UNKNOWN = 1_000_000, 1_000_001


def step_of(km: Column) -> Column:
    """The class of a distance: a greater distance is never in a lower class."""
    step = F.floor(F.log2(F.greatest(km, F.lit(NEAREST_KM))) * STEPS).cast("int")
    return F.when(km.isNull(), UNKNOWN).when(F.isnan(km), NO_NUMBER).otherwise(step)


def step_reach(step: Column) -> Column:
    """A radius that holds a class and all lower ones; null if that is no circle."""
    return F.when(step < NO_NUMBER, F.pow(F.lit(2.0), (step + 1) / STEPS) * 1.0001 + 1e-3)
