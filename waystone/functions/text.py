"""Text columns: trimming, street words, unit designators, full addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as lx

_TYPES = lx.word_forms(lx.STREET_TYPES)
_DIRECTIONS = lx.word_forms(lx.DIRECTIONS)
_ALL_WORDS = {**_TYPES, **_DIRECTIONS}


def _quoted(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "\\'") + "'"
    return f"array({', '.join(map(_quoted, value))})"


def _map_sql(entries: dict) -> str:
    return f"map({', '.join(f'{_quoted(k)}, {_quoted(v)}' for k, v in entries.items())})"


def _table(entries: dict) -> Column:
    """A constant map column, written as one SQL literal."""
    return F.expr(_map_sql(entries))


def _set(values) -> Column:
    return F.expr(_quoted(list(values)))


def trim_ws(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(lx.WS_CHARS))


def words(c: Column) -> Column:
    """White-space separated words, as an array without empty entries."""
    return F.filter(F.split(c, f"{lx.WS}+"), lambda w: w != "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def contains_text(field: Column, needle: Column, wildcards: bool = False) -> Column:
    """Case-blind substring test; ``wildcards`` lets % and _ act as in LIKE."""
    if wildcards:
        pattern = F.replace(needle, F.lit("\\"), F.lit("\\\\"))
        return F.ilike(field, F.concat(F.lit("%"), pattern, F.lit("%")))
    return F.contains(F.lower(field), F.lower(needle))


def title_words(c: Column) -> Column:
    """Capitalise every word of a lower-cased text; any mark such as '-' or '.' ends a word."""
    spaced = F.initcap(F.regexp_replace(F.lower(c), r"([^\p{L}\p{N}_]+)", "\u0001$1 "))
    return F.regexp_replace(spaced, "\u0001([^\\p{L}\\p{N}_]+) ", "$1")


def expand_street(c: Column) -> Column:
    """Spell out an abbreviated last word; the blanks before it become one."""
    blanks = F.lit(" \t\n\r\f\u000b")
    last = F.substring_index(F.translate(c, "\t\n\r\f\u000b", "     "), " ", -1)
    full = F.try_element_at(_table(lx.suffix_words()), F.upper(last))
    before = F.rtrim(F.left(c, F.length(c) - F.length(last)), blanks)
    abbreviated = full.isNotNull() & (F.length(last) < F.length(c))
    return F.when(abbreviated, F.concat(before, F.lit(" "), full)).otherwise(c)


def full_address(house, street, unit, city, region, postcode, style: str = "expanded") -> Column:
    """One-line address. ``style="plain"`` is the earlier layout, without expansion."""
    house, street, unit, city, region, postcode = (
        F.col(c) if isinstance(c, str) else c
        for c in (house, street, unit, city, region, postcode)
    )
    if style == "plain":
        label = F.when(unit != "", F.concat(F.lit("Unit "), unit))
        line = F.concat_ws(" ", blank_to_null(house), blank_to_null(street), label)
        tail = F.concat_ws(" ", blank_to_null(region), blank_to_null(postcode))
        return F.concat_ws(", ", blank_to_null(line), blank_to_null(city), tail)
    line = F.concat_ws(
        " ", blank_to_null(house), blank_to_null(expand_street(street)), blank_to_null(unit)
    )
    return F.concat_ws(
        ", ",
        blank_to_null(line),
        blank_to_null(city),
        F.coalesce(blank_to_null(region), F.lit("OH")),
        blank_to_null(postcode),
    )


def strip_unit(c: Column) -> Column:
    """Drop unit designators (#F, Apt 2B, Suite 100), then tidy commas and blanks."""
    bare = F.regexp_replace(c, lx.UNIT_PATTERN, "")
    bare = F.regexp_replace(bare, lx.DOUBLE_COMMA, ", ")
    return trim_ws(F.regexp_replace(bare, lx.SPACE_RUN, " "))


def is_state_code(c: Column) -> Column:
    return F.array_contains(_set(lx.STATE_CODES), F.upper(trim_ws(c)))


def is_street_type(c: Column) -> Column:
    """Street words and directions, in any spelling, count as street types."""
    bare = F.lower(F.regexp_replace(c, r"\.\z", ""))
    return F.array_contains(_set(_ALL_WORDS), bare)


def query_variants(df: DataFrame, col: str, into: str = "variant") -> DataFrame:
    """One row per spelling of a query, lower-cased, one changed word at a time.

    The last two words may be street words or directions; within the first
    three words only directions are varied.
    """
    keep = [c for c in df.columns if c != into]

    def respelled(place: str, table: dict) -> str:
        word = f"regexp_replace(try_element_at(_tokens, {place} + 1), '[.]{{1,2}}$', '')"
        spellings = f"coalesce(try_element_at({_map_sql(table)}, {word}), array())"
        return (
            f"transform({spellings}, s -> "
            f"array_join(transform(_tokens, (t, i) -> if(i = {place}, s, t)), ' '))"
        )

    parts = ["array(_low)", respelled("(_n - 1)", _ALL_WORDS)]
    parts.append(f"if(_n >= 2, {respelled('(_n - 2)', _ALL_WORDS)}, array())")
    parts += [respelled(str(i), _DIRECTIONS) for i in range(3)]
    return (
        df.withColumn("_low", F.lower(col))
        .withColumn("_tokens", words(F.col("_low")))
        .withColumn("_n", F.size("_tokens"))
        .select(
            *keep,
            F.expr(
                f"explode_outer(if(_n = 0, array(_low), array_distinct(concat({', '.join(parts)}))))"
            ).alias(into),
        )
    )


def expand_query(c: Column) -> Column:
    """Spell out the last word of a query, or else the one before it."""
    tokens = words(F.lower(c))
    count = F.size(tokens)
    full_forms = _table({word: spellings[0] for word, spellings in _ALL_WORDS.items()})

    def full(back: int) -> Column:
        word = F.regexp_replace(F.try_element_at(tokens, F.lit(-back)), r"\.\z", "")
        return F.try_element_at(full_forms, word)

    def with_word(back: int, word: Column) -> Column:
        return F.array_join(
            F.transform(tokens, lambda t, i: F.when(i == count - back, word).otherwise(t)), " "
        )

    return (
        F.when(full(1).isNotNull(), with_word(1, full(1)))
        .when(full(2).isNotNull(), with_word(2, full(2)))
        .otherwise(c)
    )


def street_only(c: Column) -> Column:
    """The query without a leading house number."""
    text = trim_ws(c)
    tokens = words(text)
    first = F.try_element_at(tokens, F.lit(1))
    digits = F.length(F.regexp_replace(first, "[^0-9]", ""))
    numbered = first.rlike("^[0-9]") & (digits >= F.floor(F.octet_length(first) / 2))
    return F.when(
        (F.size(tokens) >= 2) & numbered,
        F.array_join(F.slice(tokens, F.lit(2), F.size(tokens)), " "),
    ).otherwise(text)


def endpoint_of(path: Column) -> Column:
    """Request path -> endpoint category."""
    (fragment, name), *rest = lx.ENDPOINTS
    chosen = F.when(path.contains(fragment), name)
    for fragment, name in rest:
        chosen = chosen.when(path.contains(fragment), name)
    return chosen.otherwise("unknown")


def permission_of(endpoint: Column) -> Column:
    """Endpoint category -> permission name, NULL for an unknown endpoint."""
    return F.try_element_at(_table(lx.PERMISSIONS), endpoint)


def has_permission(granted: Column, endpoint: Column) -> Column:
    needed = permission_of(endpoint)
    allowed = F.array_contains(granted, needed) | F.array_contains(granted, F.lit("*"))
    return needed.isNotNull() & F.coalesce(allowed, F.lit(False))


def key_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def key_preview(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 11), F.lit("..."), F.right(c, F.lit(4)))


def county_from_path(path: Column) -> Column:
    """County name from a file name such as ``adams-addresses-county.geojson.gz``."""
    name = F.substring_index(path, "/", -1)
    for ending in (".gz", ".geojson", ".json"):
        name = F.when(name.endswith(ending), F.substr(name, F.lit(1), F.length(name) - len(ending))).otherwise(name)
    return title_words(F.regexp_extract(name, r"^[-_]*([^-_]+)", 1))


def county_key(c: Column) -> Column:
    """Spelling-blind county key: 'Van_wert', 'van-wert' and 'Van Wert' agree."""
    return F.lower(F.regexp_replace(trim_ws(c), "[_-]", " "))


def address_hash(flavour: str, *cols: Column, given: Column | None = None) -> Column:
    """Duplicate key of an address row.

    "dataset": house|street|unit|city|postcode.
    "county": the given hash if any, else county_house_street_lat_lng.
    """
    if flavour == "dataset":
        return F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in cols))
    county, house, street, lat, lng = cols
    built = F.format_string("%s_%s_%s_%.6f_%.6f", county, house, street, lat, lng)
    return F.coalesce(blank_to_null(given), built) if given is not None else built


def row_limit(requested: Column, kind: str) -> Column:
    """Requested row count -> the one that applies."""
    default, cap, rule = lx.ROW_LIMITS[kind]
    low = requested.isNull() | (requested <= 0)
    if cap is None:
        return F.when(low, default).otherwise(requested)
    beyond = F.lit(cap if rule == "clamp" else default)
    return F.when(low, default).when(requested > cap, beyond).otherwise(requested)
