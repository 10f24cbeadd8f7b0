"""Free-form addresses -> house number, street, city, state and ZIP columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as lx
from .text import is_state_code, is_street_type, trim_ws, words

def _house(c: Column) -> Column:
    return F.regexp_extract(c, lx.HOUSE_AT_START, 1)


def _after_house(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, lx.HOUSE_AT_START, ""))


def _zip(c: Column) -> Column:
    return F.regexp_extract(c, lx.ZIP_AT_END, 1)


def _before_zip(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, lx.ZIP_AT_END, ""))


def _last(tokens: Column) -> Column:
    return F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit(""))


def _join_first(tokens: Column, count: Column) -> Column:
    return F.array_join(F.slice(tokens, F.lit(1), F.greatest(count, F.lit(0))), " ")


def parse_addresses(df: DataFrame, col: str, into: str = "parsed") -> DataFrame:
    """Add a struct column (house_number, street, city, state, zip).

    Texts with a comma are read part by part from the end; others are cut at
    their right-most street word.  Each step is its own projection so that a
    shared piece is computed once per row.
    """
    keep = df.columns
    blank = F.lit("")
    step = df.withColumn("_q", trim_ws(F.coalesce(F.col(col), blank)))
    step = step.withColumn("_has_comma", F.contains("_q", F.lit(",")))
    step = step.withColumn(
        "_parts",
        F.when(
            F.col("_has_comma"),
            F.filter(F.transform(F.split("_q", ","), trim_ws), lambda p: p != ""),
        ).otherwise(F.array("_q")),
    )
    # The tail holds ZIP and state in both forms: last part, or the whole text.
    step = step.withColumn("_n", F.size("_parts")).withColumn(
        "_tail",
        F.when(F.col("_has_comma") & (F.col("_n") < 2), blank).otherwise(_last(F.col("_parts"))),
    )
    step = step.withColumn("_zip", _zip(F.col("_tail")))
    step = step.withColumn("_rest", _before_zip(F.col("_tail")))
    step = step.withColumn("_rest_words", words(F.col("_rest")))
    step = step.withColumn("_last", _last(F.col("_rest_words")))
    step = step.withColumn("_code", is_state_code(F.col("_last")))
    step = step.withColumn("_found_zip", F.col("_zip") != "")

    # Space form: a code that is also a street word needs a ZIP beside it.
    state_ok = (
        F.col("_code")
        & (F.size("_rest_words") >= 2)
        & (~is_street_type(F.col("_last")) | F.col("_found_zip"))
    )
    step = step.withColumn(
        "_state",
        F.when(F.when(F.col("_has_comma"), F.col("_code")).otherwise(state_ok), F.upper("_last"))
        .otherwise(blank),
    )
    step = step.withColumn(
        "_leftover",
        F.when(F.col("_state") != "", _join_first(F.col("_rest_words"), F.size("_rest_words") - 1))
        .otherwise(F.col("_rest")),
    )
    # The head starts with the house number: first part, or what the tail left.
    step = step.withColumn(
        "_head",
        F.when(F.col("_has_comma"), F.coalesce(F.try_element_at("_parts", F.lit(1)), blank))
        .otherwise(F.col("_leftover")),
    )
    step = step.withColumn("_house", _house(F.col("_head")))
    step = step.withColumn("_line", _after_house(F.col("_head")))

    # Comma form, middle parts.
    second_last = F.coalesce(
        F.when(F.col("_n") >= 3, F.try_element_at("_parts", F.lit(-2))), blank
    )
    step = step.withColumn(
        "_late_state",
        (F.col("_n") >= 3) & F.col("_found_zip") & (F.col("_state") == "")
        & is_state_code(second_last),
    )
    middle = F.array_join(
        F.slice(F.col("_parts"), F.lit(2), F.greatest(F.col("_n") - 2, F.lit(0))), ", "
    )
    found = F.col("_found_zip") | (F.col("_state") != "")
    comma_city = (
        F.when(F.col("_n") < 2, blank)
        .when(~found, F.when(F.col("_n") == 2, F.col("_tail")).otherwise(second_last))
        .when(F.col("_n") == 2, F.when(F.col("_state") != "", F.col("_leftover")).otherwise(blank))
        .when(
            F.col("_late_state"),
            F.when(F.col("_n") >= 4, F.try_element_at("_parts", F.lit(2))).otherwise(blank),
        )
        .otherwise(middle)
    )
    # Space form: the right-most street word ends the street.
    step = step.withColumn("_line_words", words(F.col("_line")))
    step = step.withColumn(
        "_cut",
        F.coalesce(
            F.array_max(
                F.transform(
                    "_line_words", lambda w, i: F.when(is_street_type(w), i + 1).otherwise(0)
                )
            ),
            F.lit(0),
        ),
    )
    size = F.size("_line_words")
    cut_inside = (F.col("_cut") > 0) & (F.col("_cut") < size)
    all_street = (F.col("_cut") > 0) | (F.col("_house") != "")
    space_street = (
        F.when(cut_inside, _join_first(F.col("_line_words"), F.col("_cut")))
        .when(all_street, F.col("_line"))
        .otherwise(blank)
    )
    space_city = (
        F.when(
            cut_inside,
            F.array_join(F.slice(F.col("_line_words"), F.col("_cut") + 1, size), " "),
        )
        .when(all_street, blank)
        .otherwise(F.col("_line"))
    )
    comma = F.col("_has_comma")
    # Delivered through a generator: a later filter on a part then tests the
    # finished column instead of repeating all steps inside the filter.
    return step.select(
        *keep,
        F.explode(F.array(F.struct(
            F.col("_house").alias("house_number"),
            F.when(comma, F.col("_line")).otherwise(space_street).alias("street"),
            trim_ws(F.when(comma, comma_city).otherwise(space_city)).alias("city"),
            F.when(F.col("_late_state") & comma, F.upper(second_last))
            .otherwise(F.col("_state"))
            .alias("state"),
            F.col("_zip").alias("zip"),
        ))).alias(into),
    )
