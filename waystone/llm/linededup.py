"""Lines that earlier documents already have, as keep bitmaps; built-in functions only.

Every line of every document becomes a narrow row (two 64-bit hashes of its key, document,
position). The rows are range-partitioned by hash and sorted by document and position within
a hash, so one pass over a range meets the first document of every hash before all others.
What comes back to a document is a bitmap of its lines, never text.

A hash that would outgrow its range (found by a frequent-items sketch of fixed size) is cut
into parts by document, which fall into many ranges; the parts' first documents meet in an
aggregate that combines before its shuffle. The sketch only decides how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stage import stage

#: Characters stripped at both ends of a line: blank and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a range (about 50 bytes each before sorting).
RANGE_ROWS = 1_000_000
#: Hashes the sketch tracks, and at most this many of them are cut into parts.
TRACKED, HOT = 10_000, 1_000
#: Lines that share a word of the bitmap.
BITS = 64


def line_key(line: Column) -> Column:
    """Stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("fp"))


def line_hashes(docs: DataFrame, least: int = 10) -> DataFrame:
    """A row (doc_id, fp, pos, h1, h2) per line whose key has at least ``least`` code points;
    fp is a hash of the whole text, (h1, h2) 128 bits of the key."""
    lines = _rows(docs).select("doc_id", "fp", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "fp", "pos", line_key(F.col("line")).alias("key"))
    # the second hash starts from another seed: a constant is hashed before the key
    return keyed.filter(F.char_length("key") >= least).select(
        "doc_id", "fp", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def keep_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """Documents that lose lines -> (doc_id, fp, keep: array<struct<word int, bits bigint>>).

    Bit p of the entry for word w is 0 where line 64 * w + p goes; words of lines that all
    stay are left out. ``docs`` needs doc_id and text; other columns are ignored. Rows with
    equal ids count as one document, as do all rows without an id, which come last.
    """
    lines = stage(line_hashes(docs, least), "lines")
    spark = lines.sparkSession
    sketch = lines.agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(h1, {HOT}, {TRACKED})").alias("top")
    ).first()
    least_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least_ranges, -(-sketch["n"] // RANGE_ROWS))
    often = [r["item"] for r in sketch["top"] or [] if r["count"] * 2 * ranges > sketch["n"]]
    hot, keys = F.col("h1").isin(often), ["h1", "h2"]
    if often:
        part = F.when(hot, F.pmod(F.xxhash64("doc_id"), F.lit(ranges))).otherwise(F.lit(0))
        lines, keys = lines.withColumn("part", part.cast("int")), [*keys, "part"]
    # equal keys share a range, so the window needs no exchange of its own
    dealt = lines.repartitionByRange(ranges, *keys)
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("doc_id"), "pos")
    stream = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.withColumn("first", F.first("doc_id").over(stream))
    if often:  # at most HOT rows, but for equal 64-bit hashes
        firsts = lines.filter(hot).groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
        firsts = firsts.withColumn("is_hot", F.lit(True))
        seen = seen.join(F.broadcast(firsts), ["h1", "h2"], "left").withColumn(
            "first", F.when(F.col("is_hot"), F.col("least")).otherwise(F.col("first"))
        )
    gone = seen.filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "fp", "pos")
    # both groupings are by document first, so one exchange serves them and the join with texts
    word = F.floor(F.col("pos") / BITS).cast("int")
    bit = F.expr(f"shiftleft(1L, pos % {BITS})")
    words = gone.repartition("doc_id", "fp").groupBy("doc_id", "fp", word.alias("word")).agg(
        F.bitwise_not(F.bit_or(bit)).alias("bits")
    )
    return words.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("word", "bits")).alias("keep"))


def dropped_positions(keep: Column) -> Column:
    """Positions of the lines that a bitmap drops."""
    def of(entry: Column) -> Column:
        first = entry["word"] * BITS
        return F.filter(
            F.sequence(first, first + (BITS - 1)), lambda p: F.getbit(entry["bits"], p - first) == 0
        )

    return F.flatten(F.transform(keep, of))


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Texts and their bitmaps -> (doc_id, kept_text, n_lines, n_dropped), a row per row."""
    rows = _rows(docs).alias("d").join(
        bitmaps.hint("shuffle_hash").alias("b"),
        F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.fp") == F.col("b.fp")),
        "left",
    )
    # through a generator, so that a text is split once for all uses
    cut = F.struct(
        F.when(F.col("keep").isNotNull(), F.split("text", "\n")).alias("lines"),
        F.when(F.col("keep").isNotNull(), dropped_positions(F.col("keep"))).alias("gone"),
    )
    n_lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    rows = rows.select("d.doc_id", "text", n_lines.alias("n_lines"), F.explode(F.array(cut)).alias("c"))
    places = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("c.gone"))
    kept = F.array_join(F.transform(places, lambda p: F.get(F.col("c.lines"), p)), "\n")
    return rows.select(
        "doc_id",
        F.when(F.col("c.gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("c.gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def remove_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """Drop every line whose key a document with a smaller id holds.

    A key is the line stripped at both ends with A-Z lower-cased; only keys of at least
    ``least`` code points count. Returns doc_id, kept_text, n_lines (before), n_dropped, a row
    per row of ``docs``. A null or empty text is one empty line. Rows that repeat an id count
    as one document and each gets its answer; rows without an id count as one document that
    comes after all others. Other columns of ``docs`` are ignored; an empty table gives an
    empty result.
    """
    return drop_lines(docs, keep_bitmaps(docs, least))
