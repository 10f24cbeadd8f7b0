"""CSV with line breaks in quoted fields: splits of a few bytes against the whole-file reader."""

import random

import pytest
from pyspark.sql import functions as F

from waystone.sources import csvlines as cl
from waystone.sources import files as fi

COLUMNS = ["a", "b", "c"]


def cell(rng):
    plain = "".join(rng.choices("xyz 1é", k=rng.randint(0, 6)))
    quoted = "".join(rng.choices(["x", "y", ";", "\n", '""', " ", "z", "\n\n"], k=rng.randint(0, 8)))
    return rng.choice([plain, plain, f'"{quoted}"', f'"{quoted}"', f'{plain}in"ch', '""'])


def table(rng, n):
    rows = [";".join(cell(rng) for _ in range(rng.choice([3, 3, 3, 3, 2, 4]))) for _ in range(n)]
    return "\n".join(["a;b;c", *rows]) + rng.choice(["", "\n"])


def rows_of(df):
    found = df.select(*COLUMNS, F.col("_corrupt").isNotNull().alias("bad"), "source_order", "_file").collect()
    out = {}
    for r in sorted(found, key=lambda r: r["source_order"]):
        out.setdefault(r["_file"].rsplit("/", 1)[-1], []).append(tuple(r[:4]))
    return out


def read(spark, path, multi_line):
    df = fi._csv(spark, path, COLUMNS, ";", multi_line)
    return rows_of(df.withColumn("_file", F.col("source_order.file")))


@pytest.mark.parametrize("listed", [0, 50_000])
def test_same_rows_as_the_whole_file_reader(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(cl, "LISTED", listed)
    rng = random.Random(1)
    for k in range(30):
        (tmp_path / f"f{k}.csv").write_text(table(rng, rng.randint(0, 40)))
    (tmp_path / "crlf.csv").write_bytes(b'a;b;c\r\n1;"two\r\nlines";3\r\n4;"";6\r\n')
    (tmp_path / "long.csv").write_text('a;b;c\n1;"' + "many\nlines;\n" * 400 + '";3\n4;5;6\n')
    (tmp_path / "plain.csv").write_text("a;b;c\n" + "1;2;3\n" * 500)
    want = read(spark, str(tmp_path), True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        lines = cl.lines_of(spark, str(tmp_path))
        assert lines.select("_file", "_start").distinct().count() > 100
        assert cl.split_starts(lines, ";").count() > 20
        got = read(spark, str(tmp_path), None)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(got) == set(want)
    for name, rows in want.items():
        assert got[name] == rows, name


def test_line_states():
    ends_inside = cl.line_reader(";")
    cases = [
        ('a;b', False, False), ('a;"b', False, True), ('a;"b""', False, True), ('a;"b"', False, False),
        ('a;b"c', False, False), ('"x"y;"z', False, True), ('b', True, True), ('b";c', True, False),
        ('b""', True, True), ('b"";"', True, False), ('b";"c', True, True), ('";""', True, False),
        ('"', False, True), ('""', False, False), ('"""', False, True), ('', True, True), (';;"', False, True),
    ]
    for line, inside, want in cases:
        assert ends_inside(line, inside) == want, (line, inside)
    assert not ends_inside('"' + "ab" * 500_000 + '"', False)
    assert ends_inside("x;" * 200_000 + '"open', False)


def test_splits_are_read_side_by_side(spark, tmp_path):
    """A file with line breaks in quotes uses a task per split, and no record is lost."""
    path = tmp_path / "big.csv"
    path.write_text("a;b;c\n" + "".join(f'{k};"line\nof {k}";x\n' for k in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = fi._csv(spark, str(path), COLUMNS, ";", None)
        assert rows.select(F.spark_partition_id()).distinct().count() > 15
        got = [tuple(r) for r in rows.orderBy("source_order").select(*COLUMNS).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(str(k), f"line\nof {k}", "x") for k in range(20_000)]
