"""CSV files with line breaks in quoted fields, read split by split.

A line is a function on one bit, whether it begins inside a quoted field; a split of a file
composes its lines. A first pass keeps the two ends of every split, which chained in order
give the bit each split starts with. A second pass cuts splits into records; what a split leaves
open is put together with the splits that finish it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.stage import stage

#: Splits that start inside a field and are sent to every task, at most.
LISTED = 50_000

RECORD = "_file string, _start bigint, row bigint, kind string, text string"


def line_reader(sep: str) -> Callable:
    """``ends_inside(line, inside)``: whether the line ends inside a quoted field.

    A quote opens a field only as its first character; within, two quotes are one. After
    the closing quote the field goes on to the separator, whatever comes. All in one
    closure, so that Python workers need not import this package.
    """
    import re

    s = re.escape(sep)
    quoted = r'[^"]*+(?:""[^"]*+)*+'  # up to the closing quote
    opened = re.compile(rf'(?:(?:"{quoted}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+"{quoted}', re.DOTALL)
    closed = re.compile(rf'{quoted}"[^{s}]*+', re.DOTALL)

    def ends_inside(line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        if inside:
            end = closed.match(line)
            if end is None:
                return True
            if end.end() == len(line):
                return False
            line = line[end.end() + 1 :]
        return opened.fullmatch(line) is not None

    return ends_inside


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.rtrim(F.col("value"), F.lit("\r")).alias("value"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def split_starts(lines: DataFrame, sep: str) -> DataFrame:
    """Splits (_file, _start) that start inside a quoted field."""
    ends_inside = line_reader(sep)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        at, outer, inner = None, False, True

        def row():
            return pa.RecordBatch.from_pylist(
                [{"_file": at[0], "_start": at[1], "outer": outer, "inner": inner}]
            )

        for batch in batches:
            first = batch.slice(0, 1).to_pylist()[0] if batch.num_rows else None
            if first is None:
                continue
            same = pc.and_(
                pc.equal(batch.column("_file"), first["_file"]),
                pc.equal(batch.column("_start"), first["_start"]),
            )
            # lines without quotes change nothing; a batch of one split skips them at once
            if pc.all(same).as_py():
                quotes = pc.match_substring(batch.column("value"), '"')
                keep = pc.or_(quotes, pa.array([True] + [False] * (batch.num_rows - 1)))
                batch = batch.filter(keep)
            columns = [batch.column(c).to_pylist() for c in ("_file", "_start", "value")]
            for file, start, line in zip(*columns, strict=True):
                if at != (file, start):
                    if at is not None:
                        yield row()
                    at, outer, inner = (file, start), False, True
                if outer == inner:
                    outer = inner = ends_inside(line, outer)
                else:
                    outer, inner = ends_inside(line, outer), ends_inside(line, inner)
        if at is not None:
            yield row()

    narrow = lines.select("_file", "_start", "value")
    ends = narrow.mapInArrow(run, "_file string, _start bigint, outer boolean, inner boolean")
    order = Window.partitionBy("_file").orderBy("_start")  # one row for each split
    # Composed in order: the last split that fixes the bit, and how often it turned since then.
    turns = F.sum(F.when(F.col("outer") & ~F.col("inner"), 1).otherwise(0)).over(order) % 2 == 1
    fixed = F.when(F.col("outer") == F.col("inner"), F.col("outer") != F.col("turned"))
    known = ends.withColumn("turned", turns)
    since = F.coalesce(F.last(fixed, ignorenulls=True).over(order), F.lit(False))
    after = known.withColumn("after", since != F.col("turned"))
    starts = after.withColumn("inside", F.lag("after", 1, False).over(order))
    return stage(starts.filter("inside").select("_file", "_start", "inside"), "inside")


def read_records(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """Records after the first (the header) of every file -> (_file, _start, row, text)."""
    lines = lines_of(spark, path)
    inside = split_starts(lines, sep)
    ends_inside = line_reader(sep)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["_file", "_start", "row", "kind", "text"]
        at, number, held, state, tail, out = None, 0, [], False, False, []

        def batch_of():
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names
            )

        def close(kind):
            out.append((*at, number, kind, "\n".join(held)))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_file", "_start", "inside", "value")]
            for file, start, starts_inside, line in zip(*columns, strict=True):
                if at != (file, start):
                    if held:
                        close("middle" if tail else "head")
                    at, number, held = (file, start), 0, []
                    state = tail = bool(starts_inside)
                if not state and not line and not held:
                    continue  # an empty line is no record
                held.append(line)
                state = ends_inside(line, state)
                if not state:
                    close("tail" if tail else "row")
                    held, tail, number = [], False, number + 1
            if len(out) >= 1000:
                yield batch_of()
                out = []
        if held:
            close("middle" if tail else "head")
        if out:
            yield batch_of()

    split = ["_file", "_start"]
    if inside.count() > LISTED:  # too many to send to every task: lines go to their splits' bits
        numbered = lines.withColumn("_row", F.monotonically_increasing_id())
        known = numbered.join(inside, split, "left").repartition(*split)
        known = known.sortWithinPartitions(*split, "_row")
    else:
        known = lines.join(F.broadcast(inside), split, "left")
    cut = known.select("_file", "_start", "inside", "value").mapInArrow(run, RECORD)
    whole = cut.filter("kind = 'row'").drop("kind")
    # at most two parts for each split, which may belong to one record
    order = Window.partitionBy("_file").orderBy("_start", "row")
    parts = cut.filter("kind != 'row'").withColumn("n", F.count_if(F.col("kind") == "head").over(order))
    built = parts.groupBy("_file", "n").agg(
        F.min(F.struct("_start", "row")).alias("at"),
        F.sort_array(F.collect_list(F.struct("_start", "row", "text"))).alias("p"),
    )
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    built = built.select("_file", "at.*", text.alias("text"))
    # the first record of a file is its header
    return whole.union(built).filter("_start > 0 or row > 0")
