"""Every operator on a small table of ordinary and odd rows, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from waystone.llm import (
    languages, neardup, packing, quality, scoring, subwords, suffixdedup, token_counts,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, kept string, score string, n_bytes string"


def rows():
    rng = random.Random(5)
    bits = {"en": ["the", "and", "ing", "tion", "ou"], "de": ["der", "ung", "sch", "ein", "ü"]}

    def words(lang, n):
        return ["".join(rng.choices(bits[lang], k=rng.randint(1, 3))) for _ in range(n)]

    out, shared = [], " ".join(words("en", 30))
    for i in range(0, 80, 2):
        lang = "en" if rng.random() < 0.6 else "de"
        text = words(lang, rng.randint(3, 150))
        if i % 5 == 0:
            text += [shared]
        out.append((i, " ".join(text) + (".\n" if i % 3 else "  "), lang))
    base = words("en", 120)
    for i in range(101, 113):  # near copies, of which some are linked through others only
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = "Changed"
        out.append((i, " ".join(copy), "en"))
    out += [(7, out[3][1], "en"), (9, out[3][1].upper(), "en"), (11, "", "en"), (13, None, "de")]
    out += [(15, " \n\t ", None), (17, "one two", "en"), (19, "ONE two", "en"), (21, "x" * 300, "en")]
    out += [(23, "a b c d e " * 3000, "en"), (25, "1234 ## 99", "en"), (27, "日本語 éà <|endoftext|>", None)]
    out += [out[2], (None, "no id here " * 20, "en"), (None, None, None)]
    return [(*r, "x", "y", "z") for r in out]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def by_id(found):
    out = defaultdict(list)
    for r in found.collect():
        out[r["doc_id"]].append(r)
    return out


def expected(f):
    out = defaultdict(list)
    for row in ROWS:
        out[row[0]].append(f(row[0], row[1]))
    return out


def same(found, want, columns):
    got = by_id(found)
    assert set(got) == set(want)
    for key, values in want.items():
        assert sorted(tuple(r[c] for c in columns) for r in got[key]) == sorted(values), key


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    def count(text):
        return len(library.encode(text or "", add_special_tokens=False).ids)

    def one(_, text):
        n, text = count(text), text or ""
        fit = max(k for k in range(len(text) + 1) if count(text[:k]) <= 40) if len(text) < 900 else None
        return len(text.encode()), n, n > 40, fit

    found = token_counts.token_counts(docs, budget=40)
    got, want = by_id(found), expected(one)
    for key, values in want.items():
        for value in values:
            assert any(
                (r["n_bytes"], r["n_tokens"], r["over_limit"]) == value[:3]
                and value[3] in (None, r["fit_chars"])
                for r in got[key]
            ), key
    assert sum(map(len, got.values())) == len(ROWS)
    assert token_counts.token_counts(empty).count() == 0
    for text in ["it's 'really 'll !!s", "ΣΑΣ İx é", "a b　c", "<|startoftext|>a", "éx 한"]:
        want = [count(text[:k]) for k in range(len(text) + 1)]
        assert token_counts.prefix_table(text).tolist() == want


def test_a_word_is_looked_up_once(monkeypatch):
    """Numbers stay the words' own, also when the memory starts afresh."""

    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            Counted.asked += 1
            return super().__contains__(key)

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    own, library = packing.WordIds(path), Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "MEMORY_BYTES", 1500)
    for words in (["tree", "a-b", "Été"], ["a-b", "new"], ["x", "tree", "y"], [f"w{k}" for k in range(9)], ["w3", "tree"]):
        own.place, Counted.asked = Counted(own.place), 0
        numbers = own.find(words)
        assert Counted.asked == len(words)
        ids = [own.ids[own.bounds[n] : own.bounds[n + 1]].tolist() for n in numbers]
        assert ids == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_packing(docs, empty):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = packing.best_fit_pack(docs, capacity=256).collect()

    def ids(text):
        return library.encode(text or "", add_special_tokens=False).ids + [1]

    want = Counter()
    for row in ROWS:
        whole = ids(row[1])
        for k in range(0, len(whole), 256):
            part = np.array(whole[k : k + 256], "<u4")
            want[row[0], k // 256, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)
    places = defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 256
    total = sum(n for p in places.values() for _, n in p)
    assert len(places) <= math.ceil(total / 256) * 1.05 + 1
    assert packing.best_fit_pack(empty).count() == 0


@pytest.mark.parametrize("capacity", [10, 97])
def test_plan_is_best_fit(capacity):
    import bisect

    rng = random.Random(capacity)
    for _ in range(20):
        items = [min(capacity, max(1, int(rng.expovariate(3 / capacity)))) for _ in range(500)]
        bins, opened = [], 0
        for x in sorted(items, reverse=True):
            k = bisect.bisect_left(bins, x)
            opened += k == len(bins)
            room = capacity if k == len(bins) else bins.pop(k)
            if room > x:
                bisect.insort(bins, room - x)
        counts = Counter(items)
        plan = packing.plan_slots(dict(counts), capacity)
        used = set()
        for n, c in counts.items():
            mine = [p for p in plan if p[0] == n]
            ends = [p[1] for p in mine[1:]] + [c]
            for p, end in zip(mine, ends, strict=True):
                used |= {p[2] + k // p[3] for k in range(end - p[1])}
        assert len(used) == opened


def link_classes():
    sets = {}
    for i, text, *_ in ROWS:
        w = tokens(text)
        if i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sets, {i: find(i) for i in ids}


def test_near_duplicates(docs, empty, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)  # so that buckets fall into several blocks
    sets, root = link_classes()
    got = by_id(neardup.near_duplicates(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    for i, found in got.items():
        for r in found:
            if i is not None:
                assert (r["n_shingles"], r["component_id"]) == (len(sets[i]), root[i])
            assert r["kept"] == (i is None or root[i] == i)
    assert any(root[i] != i for i in range(101, 113))
    assert neardup.near_duplicates(empty).count() == 0


def test_near_copies_meet_few(spark):
    """Classes of one large group of near copies are paired with one other each, not one a band."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(120):
        words = list(base)
        words[int(rng.integers(400))] = f"x{int(rng.integers(10**6))}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    drawn = neardup.sketches(rows).select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band"))
    shared = drawn.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("n"))
    members = drawn.join(shared.filter("n > 1"), "band")
    assert neardup.first_stars(members).count() < 120
    assert members.filter("leader <> rep").select("leader", "rep").distinct().count() > 200
    parts = spark.createDataFrame([(k, 0 if k < 118 else k) for k in range(120)], "rep long, component long")
    open_ones = neardup.open_stars(members, parts).collect()
    assert open_ones and {r["b"] for r in open_ones} | {r["a"] for r in open_ones} >= {118, 119}
    assert all(r["b"] >= 118 or r["a"] >= 118 for r in open_ones)
    assert {r["component_id"] for r in neardup.near_duplicates(rows).collect()} == {0}


def test_refused_pairs_go_nowhere(spark, monkeypatch):
    """Near copies that are plausible but not similar enough leave their bucket as links only,
    not as pairs whose number grows with the square of the group."""
    rng = np.random.default_rng(8)
    base, texts = [f"w{k}" for k in range(400)], []
    for k in range(150):
        words = list(base)
        for at in (np.arange(8) * 50 + rng.integers(0, 45, 8)).tolist():
            words[at] = f"x{k}y{at}"
        texts.append(words)
    texts += [[*t[:399], "end"] for t in texts[:20]]  # each similar to one other at least
    sets = [{tuple(w[k : k + 5]) for k in range(396)} for w in texts]
    alike = [
        (a, b) for a in range(170) for b in range(a)
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    root = list(range(170))
    for _ in range(170):
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    pairs, confirmed = [], neardup.confirmed

    def counted(some, packed):
        pairs.append(some.count())
        return confirmed(some, packed)

    monkeypatch.setattr(neardup, "confirmed", counted)
    monkeypatch.setattr(neardup, "BLOCK", 40)  # so that buckets fall into several blocks
    monkeypatch.setattr(neardup, "SET_BYTES", 20_000)
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(rows).collect()}
    assert got == dict(enumerate(root)) and 20 < len(set(root)) < 165
    assert sum(pairs) < 2000


def test_workers_give_memory_back(spark):
    """A task of one operator drops what another one remembers, and its own stays."""
    from waystone.llm import batches

    dropped = []

    def run(rows):
        yield from rows

    task = batches.frugal(run)
    saved = dict(batches.REMEMBERED)
    batches.REMEMBERED |= {"another": lambda: dropped.append(1), run.__module__: lambda: dropped.append(2)}
    try:
        assert list(task(iter([1, 2]))) == [1, 2] and dropped == [1]
    finally:
        batches.REMEMBERED.clear()
        batches.REMEMBERED.update(saved)
    assert packing.__name__ in batches.REMEMBERED


def test_forgotten_memory_is_back_before_the_task(monkeypatch):
    """What others remembered goes back to the system before a task takes memory of its own."""
    from waystone.llm import batches

    done = []
    monkeypatch.setattr(batches, "free_memory", lambda: done.append("free"))
    monkeypatch.setattr(batches, "REMEMBERED", {"another": lambda: done.append("forget")})

    def run(rows):
        done.append("begin")
        yield from rows

    assert list(batches.frugal(run)(iter([1]))) == [1]
    assert done == ["forget", "free", "begin", "free"]


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (100, 95), (60, 61)]
    found = neardup.components(spark.createDataFrame(edges, "a long, b long"))
    want = {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90, 60: 60, 61: 60}
    assert {r["node"]: r["component"] for r in found.collect()} == want


def test_posterior_limits():
    least = neardup.least_matches(1e-4)
    assert all(0 <= m < 16 * (k + 1) for k, m in enumerate(least)) and least == sorted(least)
    assert 0.6 < least[-1] / neardup.HASHES < 0.75


@pytest.mark.parametrize("hot", [1000, 2])
def test_remove_repeats(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    raw = [(r[0], (r[1] or "").encode()) for r in ROWS]
    first = {}
    for i, data in raw:
        for k in range(len(data) - 49):
            s = data[k : k + 50]
            first[s] = min(first.get(s, math.inf), math.inf if i is None else i)

    def one(i, text):
        data = (text or "").encode()
        own = math.inf if i is None else i
        gone = np.zeros(len(data) + 1, int)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < own:
                gone[k] += 1
                gone[k + 50] -= 1
        gone = np.cumsum(gone)[:-1] > 0 if len(data) else np.zeros(0, bool)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(data) else 0
        return len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()

    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    found = suffixdedup.remove_repeats(docs, with_text=True, carry=("lang",))
    same(found, expected(one), columns)
    assert found.filter(F.col("lang") == "de").count() == sum(r[2] == "de" for r in ROWS)
    assert suffixdedup.remove_repeats(empty).count() == 0


def test_only_windows_that_come_again_are_sorted(tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    lone = [bytes(rng.integers(97, 123, 3000, dtype=np.uint8)) for _ in range(20)]
    shared = lone[0][500:700]
    raw = [*lone, lone[1][:100] + shared, shared[:60], lone[2][:49], b"ab" * 100]
    sizes, ids = np.array([len(r) for r in raw]), np.arange(len(raw))[::-1].copy()
    data = np.frombuffer(b"".join(raw), np.uint8)
    lengths = []
    suffixes = suffixdedup.suffixes

    def counted(text, *rest):
        lengths.append(len(text))
        return suffixes(text, *rest)

    monkeypatch.setattr(suffixdedup, "suffixes", counted)
    (tmp_path / "all").mkdir()
    want = suffixdedup.least_ids(sizes, ids, data, str(tmp_path / "all"))
    first = {}
    for r, i in zip(raw, ids.tolist(), strict=True):
        for k in range(len(r) - 49):
            first[r[k : k + 50]] = min(first.get(r[k : k + 50], i), i)
    assert want.tolist() == [first[r[k : k + 50]] for r in raw for k in range(len(r) - 49)]
    assert suffixdedup.least_shared(sizes, ids, data, str(tmp_path)).tolist() == want.tolist()
    assert lengths[0] > 60_000 and lengths[1] < 2_000
    pieces = pa.table({
        "shard": [0], "block": [0], "ids": [suffixdedup.squeeze(ids)], "data": [suffixdedup.squeeze(data)],
        "sizes": [suffixdedup.squeeze(sizes.astype(np.int32))],
    })
    suffixdedup._answer_shard(pieces)
    assert lengths[2] == lengths[1]  # the whole shard step sorts no more


def test_score(docs, empty):
    ids = [r[0] for r in ROWS]
    fold = scoring.fold_of(ids)
    counts = Counter()
    for row, f in zip(ROWS, fold, strict=True):
        if f >= 0 and f != 2:
            counts.update([*tokens(row[1]), None])
    n, v = sum(counts.values()), len(counts)

    def one(i, text):
        w = [*tokens(text), None]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        held_out = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        return held_out, len(w), sum(counts[x] > 0 for x in w), n, round(base, 6)

    found = scoring.score_texts(docs, train_texts=40, steps=60)
    rounded = found.withColumn("base", F.round("base_score", 6)).cache()
    same(rounded, expected(one), ["held_out", "n_tokens", "n_known", "train_tokens", "base"])
    scores = [r["score"] for r in rounded.collect()]
    assert all(math.isfinite(s) and s < 0 for s in scores)
    assert scoring.score_texts(empty).count() == 0


def test_every_training_text_reaches_the_attention_weights(spark):
    """Texts far down the order of hashed ids alone hold words in a fixed order."""
    rng, names = random.Random(2), [f"{c}x" for c in "abcdefgh"]
    order = spark.range(4000).orderBy(F.xxhash64("id")).collect()
    fold = scoring.fold_of([r["id"] for r in order])
    learned = [r["id"] for r, f in zip(order, fold, strict=True) if f != 2]
    tests = [r["id"] for r, f in zip(order, fold, strict=True) if f == 2][:40]
    rows = [(i, " ".join(rng.choices(names, k=48))) for i in learned[:1200]]
    rows += [(i, " ".join(names * 6)) for i in learned[1200:]]
    for k, i in enumerate(tests):
        rows.append((i, " ".join(names * 6 if k % 2 else rng.sample(names * 6, 48))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = {r["doc_id"]: r["score"] for r in scoring.score_texts(docs, steps=100).collect()}
    mixed, ordered = ([found[i] for i in tests[k::2]] for k in (0, 1))
    assert min(ordered) > max(mixed) + 10


def test_rounds_learn_from_every_window_once(spark, monkeypatch):
    texts = [np.tile([1, 2, 3], 40 + k) for k in range(60)]
    rows, total = [], 0
    for k, t in enumerate(texts):
        seq = np.concatenate([[0], t, [0]])
        number = len(scoring.input_windows(np.array([0, len(seq)]))[0])
        total += number
        rows.append((k / 60, number, bytearray(scoring.squeeze(seq.astype(np.uint8))),
                     bytearray(scoring.squeeze(np.array([len(seq)])))))
    learned = spark.createDataFrame(rows, scoring.LEARNED).repartition(4).cache()
    assert scoring.fit(learned, 800)[1] == total
    assert scoring.fit(learned, 1)[1] == total  # several rounds
    assert scoring.fit(learned.limit(0), 1)[1] == 0


def test_word_shares_and_spelling_leave_no_mass_over():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 350, 300)  # the first id of each distinct word
    n = rng.integers(1, 9, 300)
    starts, once = np.bincount(words, n, 400), np.bincount(words, n == 1, 400)
    seen = starts + rng.integers(0, 5, 400)
    units = scoring.Units.of(seen, starts, once, np.arange(400) % 2 == 0)
    listed = np.exp(units.listed(n, words))
    for u in np.unique(units.unit[words]):
        mine = units.unit[words] == u
        assert abs(listed[mine].sum() + np.exp(units.spelled[u]) - 1) < 1e-12
        assert abs(np.exp(units.share[units.unit == u]).sum() - 1) < 1e-12
    assert np.isneginf(units.listed(np.zeros(1), words[:1])).all()


def test_texts_are_scored_alone_as_among_others():
    model = scoring.Model.fresh()
    at = np.array([0, 3, 5, 8, 10, 10, 41])
    ids = np.arange(at[-1]) * 7 % 300
    starts = np.bincount(ids, minlength=300)
    units = scoring.Units.of(starts, starts, starts * 0, starts < 0)
    seq, limits = scoring.unit_texts(ids, at, units)
    whole = model.log_probabilities(seq, limits)
    for k in range(len(at) - 1):
        alone, own = scoring.unit_texts(ids[at[k] : at[k + 1]], at[k : k + 2] - at[k], units)
        assert list(alone) == list(seq[limits[k] : limits[k + 1]])
        assert alone[0] == alone[-1] == 0
        found = model.log_probabilities(alone, own)
        assert np.allclose(found, whole[limits[k] : limits[k + 1]], atol=1e-5)
        assert list(scoring.id_places(at[k : k + 2] - at[k])) == list(range(1, len(alone) - 1))


def test_subwords(docs, empty):
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoded = subwords.encode_subwords(docs).cache()
    want = expected(lambda _, text: tuple(library.encode(text or "")))
    got = by_id(encoded)
    for key, values in want.items():
        assert sorted(tuple(r["ids"]) for r in got[key]) == sorted(values), key
    same(subwords.decode_subwords(encoded), expected(lambda _, t: (library.decode(library.encode(t or "")),)), ["text"])
    digest = subwords.subword_digest(docs)
    assert digest.filter("round_trip").count() == len(ROWS)
    assert subwords.subword_digest(empty).count() == subwords.encode_subwords(empty).count() == 0
    odd = ["  a   b ", "字字 é\n\n", "▁x", " ", "<s> <0x41>"]
    model = subwords.model(public_tokenizers.path("piece_bpe_32k.model"))
    import pyarrow as pa

    ids, bounds = model.encode(pa.array(odd))
    for k, text in enumerate(odd):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(text), text


def test_quality_counts(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 80, 2)] + [(None, 1), (2, None)],
                                   "doc_id long, quality int")

    def one(_, text):
        text = text or ""
        w = WORD.findall(text)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
                len(lines) - len(set(lines)), len(covered), failed)

    found = quality.quality_rules(docs, labels).cache()
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same(found, expected(one), columns)
    assert found.filter("base_failed and kept").count() == 0
    kept = quality.quality_rules(docs, labels.limit(0)).filter("kept").count()
    assert kept == found.filter("not base_failed").count()
    assert quality.quality_rules(empty, labels).count() == 0


def test_trees_keep_their_constraints():
    rng = np.random.default_rng(1)
    x = rng.random((2000, len(quality.FEATURES)))
    y = ((x[:, 2] < 0.5) ^ (rng.random(2000) < 0.1)).astype(float)
    forest = quality.train(x, y, [s for _, s in quality.FEATURES], trees=20)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.85
    for feature, (_, sign) in enumerate(quality.FEATURES):
        if sign:
            probe = x[:200].copy()
            before = forest.score(probe)
            probe[:, feature] += 0.3
            assert ((forest.score(probe) - before) * sign >= -1e-12).all()


def test_languages(docs, empty):
    found = languages.identify(docs).cache()
    known = {r[0]: r[2] for r in ROWS if r[2] and r[0] is not None and r[0] < 80 and r[0] % 2 == 0}
    got = by_id(found)
    assert np.mean([got[i][0]["lang_pred"] == lang for i, lang in known.items()]) > 0.9
    for i in (11, 13, 15, 25):
        assert got[i][0]["lang_pred"] == "und" and got[i][0]["score"] == 0
    for r in found.collect():
        held_out = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == held_out and 0 <= r["score"] <= 1
    assert found.count() == len(ROWS) and languages.identify(empty).count() == 0


def test_viterbi_is_best():
    from itertools import product

    rng = np.random.default_rng(2)
    sizes = [0, 1, 5, 3]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(9, 3)).astype(np.float32) * 3
    label = languages.viterbi(scores, bounds, 1.5)

    def value(path, part):
        return sum(part[k, c] for k, c in enumerate(path)) - 1.5 * sum(
            a != b for a, b in zip(path, path[1:], strict=False)
        )

    for a, b in zip(bounds, bounds[1:], strict=False):
        part = scores[a:b]
        if b > a:
            best = max(product(range(3), repeat=b - a), key=lambda p: value(p, part))  # noqa: B023
            assert abs(value(best, part) - value(label[a:b].tolist(), part)) < 1e-4


def test_spans_of_mixed_text(spark):
    train = [("der ung sch ein " * 20, "de"), ("the and ing tion " * 20, "en")] * 3
    model = languages.fit(spark.createDataFrame(train, "text string, lang string"))
    mixed = spark.createDataFrame([(1, "the and tion " * 8 + "der sch ein " * 8)], "doc_id long, text string")
    found = [tuple(r) for r in languages.spans(mixed, model).orderBy("first_word").collect()]
    assert found == [(1, 0, 24, "en"), (1, 24, 24, "de")]
