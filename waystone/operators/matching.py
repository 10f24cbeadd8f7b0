"""Search for many needles at once, as an equi-join on three-letter pieces and other keys.

A text can only contain a needle if it contains every three-letter piece of it; it can only
match an equality, a range or a circle if it has one of the keys that cover it. Each needle is
looked up the way that the fewest texts are behind; every hit is checked again by
the caller. Counts are kept per hash bucket of the pieces, so the table of
counts has a proven size limit and may be broadcast, and pieces held by many
texts are cut into chunks, so that no task receives all texts of a common piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 65536  # a broadcast table has at most this many rows, and one more
CHUNK = 200_000  # texts per (piece, chunk) group


Path = tuple[Column, Column]  # (keys a query asks for, keys a text has)


def _bucket(piece: str) -> Column:
    return F.expr(f"if({piece} = '*', -1, cast(pmod(xxhash64({piece}), {BUCKETS}) as int))")


def tagged(tag: str, value: Column) -> Column:
    """A key of a path; longer than any piece, so that it never equals one."""
    return F.concat(F.lit(f"\u0001{tag}=="), value.cast("string"))


def _with_keys(texts: DataFrame, text: str, paths: list[Path], sizes: tuple[int, ...]) -> DataFrame:
    """One row per distinct key of the text: its pieces, its keys of the paths, and ``*``.

    A piece is taken at its first position only, which keeps it unique without
    grouping.
    """
    first, piece = "0", f"if(_i = 0, '*', substring({text}, _i, 3))"
    if paths:
        texts = texts.withColumn("_held", F.array_compact(F.flatten(F.array(*(h for _, h in paths)))))
        first, piece = "-size(_held)", f"if(_i < 0, _held[-_i - 1], {piece})"
    found = (
        texts.withColumn("_i", F.expr(f"explode(sequence({first}, greatest(length({text}) - 2, 0)))"))
        .withColumn("_piece", F.expr(piece))
        .filter(f"_i <= 0 or instr({text}, _piece) = _i")
        .drop("_i", "_held")
    )
    for size in sizes:
        last = f"length({text}) - {size - 1}"
        places = f"explode(if({last} < 1, array(), sequence(1, {last})))"
        short = texts.withColumn("_i", F.expr(places))
        short = short.withColumn("_piece", F.expr(f"substring({text}, _i, {size})"))
        found = found.union(short.filter(f"instr({text}, _piece) = _i").drop("_i", "_held"))
    return found


def containment_candidates(
    needles: DataFrame,
    texts: DataFrame,
    text: str,
    required: Column,
    on: tuple[str, ...] = (),
    paths: list[Path] | None = None,
    short_words: bool = True,
) -> DataFrame:
    """Rows of ``needles`` joined with the ``texts`` rows that may match them.

    ``required`` is an array column of lower-cased strings that must all occur
    in ``text``; the caller still has to check them. ``on`` are equal columns
    of both sides.

    Each needle goes its cheapest way, measured by the number of texts behind it: one of its
    three-letter pieces, or one of the ``paths``. A path names keys that every match must have
    one of (null if the needle asks nothing there) and the keys a text has; a text has at most
    one of the keys that a needle asks for. A needle without any of these is looked up under a
    word of one or two letters (unless ``short_words`` is off); only one that asks nothing at
    all meets every text, as its answer does.
    """
    paths = paths or []
    pieces = F.expr(
        "array_distinct(flatten(transform(filter(_required, s -> length(s) >= 3), "
        "s -> transform(sequence(1, length(s) - 2), i -> substring(s, i, 3)))))"
    )
    short = F.expr("array_distinct(filter(_required, s -> length(s) between 1 and 2))")
    if not short_words:
        short = F.array().cast("array<string>")
    asked = needles.withColumn("_id", F.struct(*needles.columns)).withColumn("_required", required)
    of_paths = F.array(*(F.array_distinct(a) for a, _ in paths)) if paths else F.array().cast("array<array<string>>")
    ways = F.concat(
        F.transform("_pieces", lambda p: F.array(p)),
        F.filter(of_paths, lambda keys: keys.isNotNull() & (F.size(keys) > 0)),
    )
    asked = asked.withColumn("_pieces", pieces).withColumn("_short", short).withColumn("_ways", ways)
    few = F.size("_ways") == 0
    sizes: tuple[int, ...] = ()
    if short_words or paths:  # one row: which keys are asked for at all
        of_size = [few & F.expr(f"exists(_short, s -> length(s) = {n})") for n in (1, 2)]
        used = asked.agg(*(F.max(F.size(a) > 0) for a, _ in paths), *map(F.max, of_size)).first()
        sizes = tuple(n for n in (1, 2) if used[len(paths) + n - 1])
        paths = [p for p, any_query in zip(paths, used, strict=False) if any_query]
    asked = asked.select("_id", "_short", "_ways")
    fallback = F.when(F.size("_short") > 0, F.transform("_short", lambda s: F.array(s))).otherwise(
        F.array(F.array(F.lit("*")))
    )
    ways = F.posexplode(F.when(few, fallback).otherwise(F.col("_ways")))
    keys = (
        asked.select("_id", ways.alias("_way", "_keys"))
        .select("_id", "_way", F.explode("_keys").alias("_piece"))
        .withColumn("_b", _bucket("_piece"))
    )
    counts = (
        _with_keys(texts, text, paths, sizes)
        .groupBy(_bucket("_piece").alias("_b"))
        .agg(F.count("*").alias("_df"))
    )
    counted = keys.join(F.broadcast(counts), "_b", "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    key = F.struct("_df", "_piece", "_b")
    # A way that no text is behind (count 0) proves that the needle has no match.
    if paths:
        cheapest = (
            counted.groupBy("_id", "_way")
            .agg(F.sum("_df").alias("_cost"), F.sort_array(F.collect_list(key)).alias("_keys"))
            .groupBy("_id")
            .agg(F.min(F.struct("_cost", "_keys")).alias("_a"))
            .select("_id", F.explode("_a._keys").alias("_a"))
        )
    else:  # every way is one key
        cheapest = counted.groupBy("_id").agg(F.min(key).alias("_a"))
    anchors = cheapest.filter("_a._df > 0").select(
        "_id.*", "_a._piece", "_a._b", F.ceil(F.col("_a._df") / CHUNK).alias("_chunks")
    )
    wanted = anchors.select("_b", "_chunks").distinct()
    columns = [c for c in texts.columns if c not in on]
    posted = (
        _with_keys(texts, text, paths, sizes)
        .withColumn("_b", _bucket("_piece"))
        .join(F.broadcast(wanted), "_b")
        .withColumn("_chunk", F.pmod(F.xxhash64(*texts.columns), F.col("_chunks")))
        .select(*on, "_piece", "_chunk", *columns)
    )
    spread = anchors.withColumn("_chunk", F.expr("explode(sequence(0L, _chunks - 1))")).drop(
        "_chunks", "_b"
    )
    return spread.join(posted, [*on, "_piece", "_chunk"]).drop("_piece", "_chunk")
