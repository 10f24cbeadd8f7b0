"""Free-form address questions -> ranked known addresses.

A question never meets all addresses of its ZIP or city.  Streets are matched
as distinct names, and every key a question may ask for (a street in a place, a
house on a street, a whole ZIP, a whole city) owns one ranked list, cut to the
first ``k`` addresses before any shuffle.  Cutting keeps the answer exact: a
question takes at most k rows, and a row of a list can only be displaced by a
row of an earlier tier, which takes one of the k places itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import parse_addresses
from ..functions.text import query_variants, street_only, strip_unit, trim_ws
from .matching import containment_candidates
from .stage import stage
from .topk import spread_join, top_k_per_query

SEP = "\u0001"
BY_LINE = ("full_address", "id")


def _key(*parts: Column | str) -> Column:
    """One string key out of several; NULL if any part is NULL."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    spaced = [cols[0]]
    for c in cols[1:]:
        spaced += [F.lit(SEP), c]
    return F.concat(*spaced)


def _record(columns: list[str], order: tuple[str, ...] = BY_LINE) -> Column:
    """The whole address row, its sort columns first."""
    return F.struct(*order, *(c for c in columns if c not in order))


def ranked_lists(
    addresses: DataFrame,
    keys: Column,
    asked: DataFrame,
    k: int,
    order: tuple[str, ...] = BY_LINE,
) -> DataFrame:
    """(list_key, records): the first ``k`` addresses of every asked key.

    ``keys`` is an array column: all list keys an address belongs to; ``order``
    ends in ``id``, which names one address.  Only the key and the order columns
    are cut and shuffled: a key with most of the rows sends k of them from each
    input partition.  Whole records are fetched for the rows that remain.
    """
    rows = addresses.select(F.explode(F.array_compact(keys)).alias("list_key"), *order)
    best = top_k_per_query(rows, ["list_key"], [F.col(c).asc_nulls_last() for c in order], k)
    # An inner join stays above the cut; a semi join would be moved below it, and with it
    # the shuffle of all rows of a key to one task.
    wanted = best.select("list_key", "id").join(asked.select("list_key").distinct(), "list_key")
    records = addresses.select("id", _record(addresses.columns, order).alias("rec"))
    found = wanted.join(records, "id")
    return found.groupBy("list_key").agg(F.collect_list("rec").alias("records"))


def _rec_order(order: tuple[str, ...]) -> list[Column]:
    return [F.col(f"rec.{name}").asc_nulls_last() for name in order]


def _places(postcode: Column, city: Column) -> tuple[Column, Column, Column, Column]:
    """Place keys: both ZIP and city, ZIP, city, anywhere."""
    return (
        _key("zip+city", postcode, city),
        _key("zip", postcode),
        _key("city", city),
        F.lit("anywhere"),
    )


def _answer(
    asked: DataFrame, lists: DataFrame, k: int, order: tuple[str, ...] = BY_LINE
) -> DataFrame:
    """asked (question, tier, list_key) + lists -> first k records per question."""
    found = spread_join(asked, lists, ["list_key"], spread="question")
    rows = found.select("question", "tier", F.explode("records").alias("rec"))
    best = rows.groupBy("question", "rec").agg(F.min("tier").alias("tier"))
    return top_k_per_query(best, ["question"], [F.col("tier"), *_rec_order(order)], k)


def _component_answers(questions: DataFrame, addresses: DataFrame, k: int) -> DataFrame:
    """Tiered answers of distinct parsed questions.

    questions: question, house, street, city, zip (street and city lower-cased,
    '' where absent).
    """
    has_house, has_street = F.col("house") != "", F.col("street") != ""
    has_city, has_zip = F.col("city") != "", F.col("zip") != ""
    both, by_zip, by_city, anywhere = _places(F.col("zip"), F.col("city"))
    place = (
        F.when(has_city & has_zip, both).when(has_zip, by_zip).when(has_city, by_city)
        .otherwise(anywhere)
    )
    first = F.when(has_street & has_house, 1).otherwise(0)
    street_tiers = F.when(has_street, first + 1).otherwise(0)
    asked = questions.select(
        "*",
        place.alias("place"),
        street_tiers.alias("street_tier"),
        (street_tiers + 1).alias("zip_tier"),
        (street_tiers + has_zip.cast("int") + 1).alias("city_tier"),
    )
    # Read by the matching (twice) and by the way back to the questions.
    spelled = stage(query_variants(asked.filter(has_street), "street", "spelling"), "spellings")

    # Distinct street names per asked place, matched with the asked spellings.
    named = addresses.select(
        F.lower("street").alias("name"), F.lower("city").alias("lcity"), "postcode"
    ).filter(F.col("name").isNotNull())
    streets = (
        named.distinct()
        .select(
            "name",
            F.explode(F.array_compact(F.array(*_places(F.col("postcode"), F.col("lcity")))))
            .alias("place"),
        )
        .distinct()
        .join(spelled.select("place").distinct(), "place", "left_semi")
    )
    matched = stage(
        containment_candidates(
            spelled.select("place", "spelling").distinct(),
            streets,
            "name",
            F.array("spelling"),
            on=("place",),
            short_words=False,
        )
        .filter(F.contains("name", F.col("spelling")))
        .join(spelled, ["place", "spelling"])
        .select("question", "place", "house", "street_tier", "name")
        .distinct(),
        "matched-streets",
    )

    street_lists_asked = matched.select(
        "question", F.col("street_tier").alias("tier"), _key("place", F.col("place"), F.col("name"))
        .alias("list_key"),
    )
    zip_asked = asked.filter(has_zip).select(
        "question", F.col("zip_tier").alias("tier"), by_zip.alias("list_key")
    )
    city_asked = asked.filter(has_city).select(
        "question", F.col("city_tier").alias("tier"), by_city.alias("list_key")
    )
    wide_asked = street_lists_asked.unionByName(zip_asked).unionByName(city_asked)
    house_asked = matched.filter(F.col("house") != "").select(
        "question",
        F.lit(1).alias("tier"),
        "house",
        "name",
        _key("house", F.col("place"), F.col("name"), F.col("house")).alias("list_key"),
    )

    name, lcity = F.lower("street"), F.lower("city")
    places = _places(F.col("postcode"), lcity)
    wide_keys = F.array(
        *(_key("place", p, name) for p in places), places[1], places[2]
    )
    wide = ranked_lists(addresses, wide_keys, wide_asked, k)
    # Houses are met on (street, number) first, so only rows in question fan out.
    wanted = house_asked.select(F.col("name").alias("_n"), F.col("house").alias("_h")).distinct()
    at_house = addresses.join(
        wanted, (name == F.col("_n")) & (F.col("house_number") == F.col("_h")), "left_semi"
    )
    house_keys = F.array(*(_key("house", p, name, F.col("house_number")) for p in places))
    exact = ranked_lists(at_house, house_keys, house_asked, k)
    return _answer(
        wide_asked.unionByName(house_asked.drop("house", "name")),
        wide.unionByName(exact),
        k,
    )


def _flat(answers: DataFrame) -> DataFrame:
    """One row per question with its ranked answers as an array (at most k)."""
    return answers.groupBy("question").agg(
        F.array_sort(F.collect_list(F.struct("rank", "tier", "rec"))).alias("answers")
    )


def _by_parts(queries: DataFrame, addresses: DataFrame, k: int, parsed: str) -> DataFrame:
    """qid -> array of tiered answers; ``numbered`` tells whether tier 1 is exact."""
    q = queries.select(
        "qid",
        F.col(f"{parsed}.house_number").alias("house"),
        F.lower(f"{parsed}.street").alias("street"),
        F.lower(f"{parsed}.city").alias("city"),
        F.col(f"{parsed}.zip").alias("zip"),
    ).withColumn("question", _key(*(F.col(c) for c in ("house", "street", "city", "zip"))))
    distinct = stage(q.drop("qid").distinct(), "questions")
    answers = _flat(_component_answers(distinct, addresses, k))
    numbered = (F.col("house") != "") & (F.col("street") != "")
    return spread_join(q, answers, ["question"], spread="qid").select(
        "qid", numbered.alias("numbered"), "answers"
    )


def component_tiers(
    queries: DataFrame, addresses: DataFrame, k: int = 50, parsed: str = "parsed"
) -> DataFrame:
    """Tiered search by address parts for every query.

    queries: qid and a struct column ``parsed`` (see ``parse_addresses``).
    Returns qid, tier, is_exact, rank and the address.
    """
    rows = _by_parts(queries, addresses, k, parsed).select(
        "qid", "numbered", F.explode("answers").alias("a")
    )
    return rows.select(
        "qid",
        F.col("a.tier").alias("tier"),
        (F.col("numbered") & (F.col("a.tier") == 1)).alias("is_exact"),
        F.col("a.rank").alias("rank"),
        "a.rec.*",
    )


def _text_answers(needles: DataFrame, addresses: DataFrame, k: int) -> DataFrame:
    """needles (question, tier, needle) -> first k addresses holding a needle."""
    needles = stage(needles, "needles")  # read by the search and by the ranking
    texts = addresses.select(
        F.lower("full_address").alias("line"), _record(addresses.columns).alias("rec")
    )
    hits = containment_candidates(
        needles.select("needle").distinct(), texts, "line", F.array("needle"), short_words=False
    ).filter(F.contains("line", F.col("needle")))
    lists = (
        top_k_per_query(hits, ["needle"], _rec_order(BY_LINE), k)
        .groupBy(F.col("needle").alias("list_key"))
        .agg(F.collect_list("rec").alias("records"))
    )
    asked = needles.withColumnRenamed("needle", "list_key")
    return _answer(asked, lists, k)


def _needles(texts: DataFrame) -> DataFrame:
    """Distinct cleaned texts (question) -> needles with their priority.

    With a street-only form: 1 any spelling of the whole text, 2 any spelling
    of the street-only form.  Without: 1 the text itself, 2 another spelling.
    """
    t = texts.select("question", street_only(F.col("question")).alias("street_text")).withColumn(
        "has_fallback", (F.col("street_text") != "") & (F.col("street_text") != F.col("question"))
    )
    whole = query_variants(t, "question", "needle")
    itself = F.col("needle") == F.lower("question")
    whole = whole.select(
        "question", F.when(F.col("has_fallback") | itself, 1).otherwise(2).alias("tier"), "needle"
    )
    partial = query_variants(t.filter("has_fallback"), "street_text", "needle").select(
        "question", F.lit(2).alias("tier"), "needle"
    )
    return whole.unionByName(partial)


def _clean(queries: DataFrame, col: str) -> DataFrame:
    text = trim_ws(F.col(col))
    return queries.select("qid", strip_unit(text).alias("question")).filter(
        F.col("question") != ""
    )


def _deliver(q: DataFrame, answers: DataFrame) -> DataFrame:
    rows = spread_join(q, answers, ["question"], spread="qid").select(
        "qid", F.explode("answers").alias("a")
    )
    return rows.select(
        "qid", F.col("a.tier").alias("priority"), F.col("a.rank").alias("rank"), "a.rec.*"
    )


def search_with_fallback(
    queries: DataFrame, addresses: DataFrame, k: int = 50, col: str = "q"
) -> DataFrame:
    """Whole-text matches, then street-only matches, by (priority, full_address)."""
    q = queries.select("qid", trim_ws(F.col(col)).alias("question")).filter(
        F.col("question") != ""
    )
    answers = _text_answers(_needles(q.select("question").distinct()), addresses, k)
    return _deliver(q, _flat(answers))


def search_variants(
    queries: DataFrame, addresses: DataFrame, k: int = 50, col: str = "q"
) -> DataFrame:
    """Addresses holding any spelling of the text, the text as typed first."""
    q = queries.select("qid", F.col(col).alias("question")).filter(F.col("question") != "")
    needles = query_variants(q.select("question").distinct(), "question", "needle")
    needles = needles.withColumn(
        "tier", F.when(F.col("needle") == F.lower("question"), 1).otherwise(2)
    )
    return _deliver(q, _flat(_text_answers(needles, addresses, k)))


def geocode(queries: DataFrame, addresses: DataFrame, k: int = 50, col: str = "q") -> DataFrame:
    """Address questions -> answers: by parts first, by text where parts find nothing.

    queries: qid and a text column.  Equal texts are answered once.
    """
    q = _clean(queries, col)
    texts = q.select("question").distinct()
    # Parsed once; also keeps filters on the parts out of the parsing columns.
    parsed = stage(parse_addresses(texts, "question"), "parsed")
    by_parts = _by_parts(parsed.withColumnRenamed("question", "qid"), addresses, k, "parsed")
    # Read by two branches below: the answers and the texts left without any.
    by_parts = stage(
        by_parts.select(
            F.col("qid").alias("question"),
            F.lit("component").alias("method"),
            F.when(F.col("numbered"), 1).otherwise(0).alias("exact_to"),
            "answers",
        ),
        "geocode-parts",
    )
    left = parsed.select("question").join(by_parts.select("question"), "question", "left_anti")
    street_text = street_only(F.col("question"))
    has_fallback = (street_text != "") & (street_text != F.col("question"))
    by_text = _flat(_text_answers(_needles(left), addresses, k)).select(
        "question",
        F.lit("fulltext").alias("method"),
        # Without a street-only form every answer counts as exact.
        F.when(has_fallback, 1).otherwise(2).alias("exact_to"),
        "answers",
    )
    rows = spread_join(q, by_parts.unionByName(by_text), ["question"], spread="qid").select(
        "qid", "question", "method", "exact_to", F.explode("answers").alias("a")
    )
    return rows.select(
        "qid",
        "question",
        F.col("method").alias("search_method"),
        F.col("a.tier").alias("tier"),
        (F.col("a.tier") <= F.col("exact_to")).alias("is_exact"),
        F.col("a.rank").alias("rank"),
        "a.rec.*",
    )


def geocode_summary(answers: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """Per query: exact and fallback counts, best tier and the fallback's label.

    ``questions`` (qid): those without an answer are named with counts of 0.
    """
    exact = F.count(F.when(F.col("is_exact"), 1))
    others = F.count(F.when(~F.col("is_exact"), 1))
    totals = answers.groupBy("qid", "question", "search_method").agg(
        exact.alias("exact_count"), others.alias("fallback_count"), F.min("tier").alias("best_tier")
    )
    label = F.when(
        F.col("search_method") == "component", F.lit("nearby addresses (street/city match)")
    ).otherwise(street_only(F.col("question")))
    found = totals.select(
        "qid",
        "search_method",
        "exact_count",
        "fallback_count",
        "best_tier",
        F.when(F.col("fallback_count") > 0, label).alias("fallback_query"),
    )
    if questions is None:
        return found
    named = questions.select("qid").distinct().join(found, "qid", "left")
    return named.fillna(0, ["exact_count", "fallback_count"])
