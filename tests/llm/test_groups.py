"""Spelling variants, centroids and line removal on odd rows, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from waystone.llm import centroids, checks, linededup, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, pos string, word string, n string, h1 string, keep string, fp int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", 1) for r in rows], DOCS).repartition(4)


# ------------------------------------------------------------------ lines


def line_rows():
    rng = random.Random(3)
    shared = [f"  Shared line number {i} é\t" for i in range(30)]
    rows = []
    for i in range(120):
        lines = [f"own line of document {i} / {k}" for k in range(rng.randint(0, 4))]
        lines += rng.choices(shared, k=rng.randint(0, 6)) + ["short", "", "The one line that all have"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "THE ONE LINE THAT ALL HAVE\r"), (204, "x" * 50_000)]
    rows += [(205, "\n".join(f"long document line {k % 400}" for k in range(3000))), (206, rows[5][1])]
    rows += [(207, "\n".join(f"long document line {k % 500}" for k in range(700)))]
    rows += [(208, "123456789\n1234567890\n line with a hard blank"), (209, "123456789\n 1234567890 \n LINE with a hard blank")]
    rows += [rows[3], (7, "another text of seven\nown line of document 50 / 0\nThe one line that all have")]
    rows += [(None, "no id has this line\nThe one line that all have"), (None, "no id has this line\nshort")]
    rows += [(None, None), (-5, "Kelvin K is no letter k"), (-4, "kelvin k is no letter k")]
    return rows


def kept_lines(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    def rank(doc_id):
        return (doc_id is None, doc_id or 0)

    first = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= 10 and (k not in first or rank(doc_id) < first[k]):
                first[k] = rank(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key(x), rank(doc_id)) == rank(doc_id)]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def by_text(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("hot", [0, 5])
def test_lines(spark, monkeypatch, hot):
    if hot:  # every hash that the sketch finds is cut into parts
        monkeypatch.setattr(linededup, "RANGE_ROWS", 20)
        monkeypatch.setattr(linededup, "HOT", hot)
    rows = line_rows()
    found = linededup.remove_lines(docs_of(spark, rows))
    assert found.columns == ["doc_id", "kept_text", "n_lines", "n_dropped"]
    assert by_text(found.collect()) == by_text(kept_lines(rows))


def test_lines_without_rows(spark):
    assert linededup.remove_lines(docs_of(spark, line_rows()).limit(0)).count() == 0
    alone = [(1, "only one document\nonly one document"), (1, None)]
    assert by_text(linededup.remove_lines(docs_of(spark, alone)).collect()) == by_text(kept_lines(alone))


@pytest.mark.parametrize("rows_a_range", [20, 1_000_000])
def test_lines_use_built_in_functions_and_one_exchange(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(linededup, "RANGE_ROWS", rows_a_range)
    found = linededup.remove_lines(docs_of(spark, line_rows()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    # the window reads the ranges as they are dealt, and documents' groupings need one exchange
    # (the aggregate of the hot hashes' first documents has its own)
    assert plan.count("rangepartitioning(h1") == 1
    assert plan.count("hashpartitioning(h1") == (rows_a_range == 20)
    assert plan.count("hashpartitioning(doc_id") <= 2


def test_bitmaps(spark):
    rows = [(1, "\n".join(f"line number {k}" for k in range(200))), (2, "line number 3\nmine alone\nLine number 130")]
    rows += [(3, "\n".join(f"line number {199 - k}" for k in range(200)) + "\nline of the third")]
    got = {r["doc_id"]: r["keep"] for r in linededup.keep_bitmaps(docs_of(spark, rows)).collect()}
    assert set(got) == {2, 3}
    assert [(e["word"], e["bits"] & 0xFFFF) for e in got[2]] == [(0, 0xFFFF & ~0b101)]
    bits = {e["word"]: e["bits"] & (2**64 - 1) for e in got[3]}
    assert [bits[w] for w in range(4)] == [0, 0, 0, (2**64 - 1) & ~0xFF]


# -------------------------------------------------------------- centroids


def lloyd(rows, k, rounds, width=64, scale=256, seed="2"):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(scale * x) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else sha(f"{seed}:{r[0]}"), r[1]))
    centres = [v for _, v in order[:k]]

    def assigned():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        groups = defaultdict(list)
        for (c, _), (_, v) in zip(assigned(), kept, strict=True):
            groups[c].append(v)
        for c, vs in groups.items():
            centres[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    final = assigned()
    inertia = Counter()
    for c, d in final:
        inertia[c] += d
    return [
        (vec_id, c, d, inertia[c], sum(inertia.values()), sha(",".join(map(str, centres[c]))))
        for (vec_id, _), (c, d) in zip(kept, final, strict=True)
    ]


def vector_rows():
    rng = random.Random(9)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.7) for x in rng.choice(middles)]) for i in range(260)]
    rows += [(400 + i, rows[i][1]) for i in range(30)]  # ties
    rows += [rows[2], (3, rows[9][1]), (None, rows[4][1]), (None, [0.0] * 64)]
    rows += [(500, None), (501, [1.0] * 63), (502, [1.0] * 65), (503, []), (504, [None] + [1.0] * 63)]
    rows += [(505, [float("nan")] + [1.0] * 63), (506, [1.0] * 63 + [float("-inf")]), (507, [-1000.0] * 64)]
    return rows


def vectors_of(spark, rows):
    schema = "vec_id long, embedding array<double>, v string, dots int, cluster string, distance string"
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], schema).repartition(3)


def rank(row):
    return (row[0] is None, row[0] or 0, row[1:])


@pytest.mark.parametrize(("n", "k", "rounds"), [(None, 40, 5), (None, 5, 9), (12, 40, 2), (1, 3, 1), (40, 4, 0)])
def test_centroids(spark, n, k, rounds):
    rows = vector_rows()[:n]
    found = centroids.cluster(vectors_of(spark, rows), k=k, rounds=rounds)
    assert sorted(map(tuple, found.collect()), key=rank) == sorted(lloyd(rows, k, rounds), key=rank)


def test_centroids_without_rows(spark):
    table = vectors_of(spark, vector_rows())
    assert centroids.cluster(table.limit(0)).count() == 0
    assert centroids.cluster(table.filter("vec_id in (500, 505)")).columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    ]


def test_large_components(spark):
    rows = [(i, [(-1) ** i * 200_000.5 + i] * 64) for i in range(7)]  # products beyond 2^53
    found = centroids.cluster(vectors_of(spark, rows), k=3, rounds=2)
    assert sorted(map(tuple, found.collect())) == sorted(lloyd(rows, 3, 2))
    with pytest.raises(Exception, match="not below"):
        centroids.cluster(vectors_of(spark, [(1, [1e9] * 64)]))


# --------------------------------------------------------------- spelling


def spell(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, n_near = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        n_near[w] = len(others)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], n_near[w], n.get(form[w], 0)) for w in n)


def spelling_rows():
    rng = random.Random(11)
    letters = "abcdeéöABÀ×"
    base = ["".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(60)]
    base += ["aaaaa", "aaaaaa", "aaaaaaa", "abcde", "abcdf", "bacde", "edcba", "ééééé", "x" * 300, "x" * 299, "x" * 298 + "y"]
    base += ["pneumonoultramicroscopic", "pneumonoultramicroscopik", "pneumonultramicroscopic", "abcdefghijklmnop", "abcdefghijklmno"]
    words = []
    for w in base:
        words += [w] * rng.randint(1, 30)
        for _ in range(6):
            i = rng.randrange(len(w))
            other = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:]])
            words += [other] * rng.randint(1, 9)
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::150]) + "-it's 9") for i in range(150)]
    return rows + [(900, None), (901, ""), (902, "1234 ?"), rows[0], (None, rows[1][1]), (None, None), (903, "ÄÖ" * 30_000)]


def test_spelling(spark):
    rows = spelling_rows()
    found = spelling.spelling_variants(docs_of(spark, rows))
    got = sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in found.collect())
    want = spell(rows)
    assert got == want
    assert any(r[1] and r[1] != r[2] for r in want)  # chains
    assert spelling.spelling_variants(docs_of(spark, rows).limit(0)).count() == 0
    assert spelling.spelling_variants(docs_of(spark, [(1, "one word")])).count() == 0


def test_signatures_meet_for_every_edit():
    import numpy as np

    rng = random.Random(2)
    ranks = np.arange(0x200) % 31
    for _ in range(400):
        w = "".join(rng.choices("abcdefgh", k=rng.randint(4, 24)))
        i = rng.randrange(len(w))
        pairs = [(w, w[:i] + rng.choice("xyab") + w[i + 1 :], 2), (w, w[:i] + w[i + 1 :], 1)]
        for a, b, left_out in pairs:
            longer = np.array([len(w), len(w)])
            t = (spelling.LONG_PARTS if len(w) >= spelling.LONG else spelling.SHORT_PARTS)[left_out == 1]
            letters = spelling.Letters([a, b], ranks)
            sig = spelling.signatures(letters.parts(t), longer, left_out)
            first, second = letters.halves(longer)
            assert (sig[0] == sig[1]).any() and (first[0] == first[1] or second[0] == second[1])


# ------------------------------------------------------------------- SQL


def test_sql_of_the_rows(spark, tmp_path):
    """The DuckDB checks and plain Python agree on odd rows too."""
    con = duckdb.connect()
    docs_of(spark, line_rows()[:-5] + spelling_rows()).coalesce(1).write.parquet(f"{tmp_path}/d")
    vectors_of(spark, vector_rows()).coalesce(1).write.parquet(f"{tmp_path}/e")
    for name, path in (("documents", "d"), ("embeddings", "e")):
        file = next((tmp_path / path).glob("part-*.parquet"))
        con.execute(f"create view {name} as select * from '{file}'")
    rows = line_rows()[:-5] + spelling_rows()
    want = [(a, n, d, sha(t)) for a, t, n, d in kept_lines([r for r in rows if r[0] is not None])]
    got = con.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({checks.LINES}) where doc_id is not null").fetchall()
    assert sorted(got) == sorted(want)
    got = con.execute(f"select word, coalesce(form, ''), root, n, n_near, coalesce(form_n, 0) from ({checks.SPELLING})").fetchall()
    assert sorted(got) == spell(rows)
    columns = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    got = con.execute(f"select {columns} from ({checks.centroid_sql()})").fetchall()
    assert sorted(got, key=rank) == sorted(lloyd(vector_rows(), 40, 5), key=rank)


def test_hot_sketch_is_only_a_plan(spark):
    """Any share of a line gives the same rows."""
    rows = [(i, "the same long line everywhere\n" * (i % 3) + f"line of document {i % 40}") for i in range(600)]
    found = linededup.remove_lines(docs_of(spark, rows)).withColumn("x", F.lit(1)).drop("x")
    assert by_text(found.collect()) == by_text(kept_lines(rows))
