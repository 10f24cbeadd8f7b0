"""Archives, top-k search, the suffix sorter, the attention model and the pipeline."""

import base64
import hashlib
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waystone.llm import attention, induced, topk, warc

PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two é</p>" * 400), (3, None, "<p>one</p>"),
    (4, "http://a/4", None), (5, "u", ""), (6, "u", "\x1f\x8b\x08 WARC/1.1 not a record"),
    (6, "u", "\x1f\x8b\x08 WARC/1.1 not a record"), (None, "u", "<p>one</p>"), (None, "u", "alone"),
]


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_archives(spark, split):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, sha1 string")
    files = warc.write_archives(pages.repartition(3), file_bytes=400)
    found = warc.read_archives(files, split_bytes=split).collect()
    want = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        equal = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(equal, default=None)
        revisit = first is not None and page_id != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page_id or 0, len(data), digest, "revisit" if revisit else "response", (first or 0) if revisit else 0))
    got = [(r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in found]
    assert sorted(got) == sorted(want)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_ranges_are_read_by_many_tasks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "u", rng.bytes(300).hex()) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    files = warc.write_archives(pages)
    n = files.selectExpr("sum(greatest(ceil(n_bytes / 4096), 1)) as n").first()[0]
    found = warc.read_archives(files, split_bytes=4096)
    tasks = found.rdd.getNumPartitions()
    assert n > 16 and tasks >= min(n, spark.sparkContext.defaultParallelism)
    busy = found.groupBy(F.spark_partition_id()).count().count()
    assert busy >= min(n, tasks) // 2 and found.count() == 400


def test_cut_record_is_an_error():
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), "x") for i in range(300)]
    rows += [(300 + i, rows[i][1], "x") for i in range(20)]  # ties
    rows += [(900, None, "x"), (901, [1.0, None] + [0.0] * 14, "x"), (902, [float("nan")] * 16, "x"), (None, rows[0][1], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    found = [tuple(r) for r in topk.top_k(table.repartition(4)).collect()]
    good = [(i, np.floor(np.array(v, np.float64) * 256).astype(np.int64)) for i, v, _ in rows[:320]]
    want = []
    for q, v in good:
        if q % 50 == 0:
            best = sorted(((-int(v @ x), i) for i, x in good if i != q))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(found) == sorted(want)
    assert topk.top_k(table.limit(0)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(two).collect()] == [(0, 1, 1, 128 * 256 + 128 * 512)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    levels = topk.segment_levels(64)
    x = topk.Block(np.arange(50), np.floor(rng.normal(size=(50, 64)) * 256), levels)
    q, r = np.divmod(np.arange(2500), 50)
    exact = (x.vectors @ x.vectors.T).ravel()
    for level in range(len(levels)):
        assert (topk.upper_bounds(x, x, level, q, r) >= exact - 1e-3).all()


@pytest.mark.parametrize("held", [200, induced.HELD])
def test_suffixes(held, monkeypatch):
    monkeypatch.setattr(induced, "CHUNK", 64)
    rng = np.random.default_rng(3)
    for n in [1, 2, 5, *range(100, 1500, 250)]:
        base = rng.integers(1, 5, 40)
        text = np.concatenate([np.append(base[rng.integers(0, 30):], 0) if rng.random() < 0.6 else rng.integers(0, 9, 9) for _ in range(n // 20 + 1)]).astype(np.uint8)
        with tempfile.TemporaryDirectory() as folder:
            found = np.concatenate([r.copy() for r in induced.suffixes(text, folder, 50, held=held)])
        assert sorted(found["at"].tolist()) == list(range(len(text)))
        rows = [tuple(text[k : k + 50].tolist()) for k in found["at"].tolist()]
        assert rows == sorted(rows, reverse=True)
        for k in range(1, len(rows)):
            common = next((i for i, (a, b) in enumerate(zip(rows[k - 1], rows[k], strict=False)) if a != b),
                          min(len(rows[k]), len(rows[k - 1])))
            assert found["lcp"][k] == common


def test_attention_gradient():
    rng = np.random.default_rng(0)
    model = attention.Model.fresh()
    model.w = {n: x.astype(np.float64) for n, x in model.w.items()}
    units, bounds = rng.integers(0, attention.UNITS, 60), np.array([0, 20, 60])
    first, text, inputs = attention.input_windows(bounds)
    at, inside = attention.places(first, inputs[text], 60)
    target = units[np.minimum(at[:, attention.LOOK :] + 1, 59)]
    _, gradient = model.gradient(units[at], inside, target)
    for name, w in model.w.items():
        place = np.unravel_index(np.abs(gradient[name]).argmax(), w.shape)
        losses = []
        for step in (1e-4, -1e-4):
            w[place] += step
            losses.append(model.gradient(units[at], inside, target)[0])
            w[place] -= step
        assert abs((losses[0] - losses[1]) / 2e-4 - gradient[name][place]) < 1e-4, name


def test_every_unit_is_scored_once_and_causally():
    rng = np.random.default_rng(0)
    units, bounds = rng.integers(1, attention.UNITS, 150), np.array([0, 2, 3 + 40, 150])
    units[bounds[:-1]] = units[bounds[1:] - 1] = 0
    model = attention.Model.fresh()
    whole = model.log_probabilities(units, bounds)
    assert (whole[bounds[:-1]] == 0).all() and (np.delete(whole, bounds[:-1]) < 0).all()
    changed = units.copy()
    changed[100:149] = 5
    assert np.allclose(model.log_probabilities(changed, bounds)[:100], whole[:100], atol=1e-5)
    learned = attention.train(np.tile([0, 1, 2, 3, 0], 50), np.arange(0, 251, 5), 150)
    assert learned.log_probabilities(np.array([0, 1, 2, 3, 0]), np.array([0, 5])).sum() > -1


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, before, sf).cache()
        assert after.columns == docs.columns, name
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert kept <= {r["doc_id"] for r in before.select("doc_id").collect()}
        before = after
    placed = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert {r["doc_id"] for r in placed.select("doc_id").collect()} == kept
    assert 0 < len(kept) < docs.count()
    empty = docs.limit(0)
    for _, step in corpus_pipeline.STAGES[:2]:
        assert step(spark, empty, sf).count() == 0
