"""Reading named values out of free-form GeoJSON properties."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_ws


def members(props: Column) -> Column:
    """Variant object -> map of its members, read once for many lookups."""
    return F.try_variant_get(props, "$", "map<string,variant>")


def _plain(number: Column) -> Column:
    """A fraction without trailing zeros; very large or small values as Spark writes them."""
    digits = F.regexp_replace(number.cast("decimal(38,15)").cast("string"), r"\.?0+\z", "")
    small = (F.abs(number) < 1e15) & (F.abs(number) >= 1e-4)
    return F.when(small, digits).otherwise(number.cast("string"))


def _is_number(kind: Column) -> Column:
    return reduce(or_, (kind.startswith(name) for name in ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")))


def pick_prop(found: Column, names: tuple[str, ...], mode: str = "dataset") -> Column:
    """First usable value among ``names`` as a variant, NULL if none.

    found: the map made by ``members``. JSON null counts as absent; mode
    "county" also skips booleans and nested values.
    """

    def usable(v: Column) -> Column:
        present = v.isNotNull() & ~F.is_variant_null(v)
        if mode == "county":
            kind = F.schema_of_variant(v)
            return present & (_is_number(kind) | (kind == "STRING"))
        return present

    listed = F.array(*(F.try_element_at(found, F.lit(name)) for name in names))
    return F.try_element_at(F.filter(listed, usable), F.lit(1))


def prop_text(value: Column, mode: str = "dataset") -> Column:
    """Picked value -> text, '' for none.

    mode "dataset": whole numbers without a fraction, other numbers and
    booleans as written. mode "county": numbers rounded to whole ones.
    """
    text = F.try_variant_get(value, "$", "string")
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    if mode == "county":
        shown = F.bround(number, 0).cast("decimal(38,0)").cast("string")
    else:
        whole = number == F.floor(number)
        shown = F.when(whole, number.cast("decimal(38,0)").cast("string")).otherwise(_plain(number))
    return F.coalesce(
        F.when(kind == "STRING", trim_ws(text)).when(_is_number(kind), shown).otherwise(text),
        F.lit(""),
    )


def first_prop(found: Column, names: tuple[str, ...], mode: str = "dataset") -> Column:
    """First value present among ``names``, as text; a present empty text wins."""
    return prop_text(pick_prop(found, names, mode), mode)
