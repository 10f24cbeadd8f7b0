"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact sets.

1. Every text gets 384 minimum hashes of its 5-word shingles: 32 bands of 4 of them propose
   pairs (a pair of similarity 0.75 shares no band with probability 5e-6), one byte of each
   hash is kept to compare pairs.
2. Texts with equal words are one class from then on; only classes are compared.
3. Pairs are compared 16 hashes at a time and dropped as soon as the posterior
   probability of the wanted similarity falls below ``MISS``; the rest is verified on
   full shingle sets.
4. A bucket never emits all its pairs: first every class meets one other, the smallest id of all
   its buckets; then the smallest ids of those buckets where it is still apart from them; at last
   what is still in different components and plausible, each pair in one bucket only. These
   are verified where the bucket meets, and only links leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stage import stage
from .batches import (
    MIX_A,
    MIX_B,
    coded_words,
    frugal,
    group_spans,
    hash_strings,
    mix,
    slices,
    sums,
    texts_of,
    whole_groups,
)

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
#: Minimum hashes of a text: the first fill the bands, a byte of each is compared.
HASHES = 384
STEP = 16
#: Chance that the posterior test drops a pair that is similar enough.
MISS = 1e-4
#: Members of a bucket that are compared with each other in one group.
BLOCK = 1024
#: Bytes of packed texts in such a block, and of shingle sets that a task keeps while it compares.
BLOCK_BYTES, SET_BYTES = 16 << 20, 64 << 20
#: What rows that are compared with each other have in common.
GROUP = ["band", "_i", "_j"]
CHAIN = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def hash_family() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(HASHES, dtype=np.uint64)
    return mix(k * MIX_A + np.uint64(1)) | np.uint64(1), mix(k * MIX_B + np.uint64(2))


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles (64 bits, repeats included) with bounds by text, and two
    64-bit hashes of each text's word sequence."""
    bounds, codes, distinct = coded_words(pc.ascii_lower(texts))
    h = hash_strings(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(bounds)
    place = np.arange(len(h)) - np.repeat(bounds[:-1], n)
    key = np.stack(
        [sums(mix(h * k + place.astype(np.uint64) * MIX_B), bounds) for k in (CHAIN, MIX_A)], 1
    )
    key = mix(key + n.astype(np.uint64)[:, None])
    sizes = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(ends[-1]), np.uint64)
    if len(h) >= WORDS:
        s = h[: len(h) - WORDS + 1].copy()
        for k in range(1, WORDS):
            s = s * CHAIN + h[k : len(h) - WORDS + 1 + k]
        text = np.repeat(np.arange(len(n)), n)
        whole = text[: len(s)] == text[WORDS - 1 :]
        full = np.repeat(n >= WORDS, sizes)
        out[full] = mix(s[whole])
    for k in np.flatnonzero((n > 0) & (n < WORDS)).tolist():
        out[ends[k]] = mix(key[k : k + 1, 0] + CHAIN)[0]  # the whole sequence is the only one
    return out, ends, key


def shingle_sets(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the texts' keys."""
    hashes, bounds, key = shingle_hashes(texts)
    ends = bounds.tolist()
    return [np.unique(hashes[a:b]) for a, b in zip(ends, ends[1:], strict=False)], key


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum hashes, a row for each text; texts without a shingle get zeros."""
    a, b = hash_family()
    out = np.zeros((len(bounds) - 1, len(a)), np.uint32)
    live = np.flatnonzero(np.diff(bounds))
    start = 0
    while start < len(live):  # as many texts at a time as stay in the processor's cache
        stop = int(np.searchsorted(bounds[live + 1], bounds[live[start]] + 30_000, "right"))
        part = live[start : max(stop, start + 1)]
        x = hashes[bounds[part[0]] : bounds[part[-1] + 1]]
        at = bounds[part] - bounds[part[0]]
        for k in range(len(a)):
            out[part, k] = np.minimum.reduceat((x * a[k] + b[k]) >> np.uint64(32), at)
        start += len(part)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]) + np.uint64(7)
    for k in range(ROWS):
        key = mix(key * CHAIN + rows[:, :, k])
    return key.view(np.int64)


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a byte matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    bounds = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(rows), [None, pa.py_buffer(bounds), pa.py_buffer(rows.tobytes())]
    )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (equal for equal word sequences), n_shingles, low bytes of the hashes, bands."""

    @frugal
    def run(batches):
        for batch in slices(batches):
            hashes, bounds, key = shingle_hashes(texts_of(batch.column("text")))
            ends = bounds.tolist()
            n = [len(np.unique(hashes[a:b])) for a, b in zip(ends, ends[1:], strict=False)]
            sig = signatures(hashes, bounds)
            at = pa.array(np.arange(0, (len(sig) + 1) * BANDS, BANDS), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), fixed_binary(key),
                    pa.array(n, pa.int64()), fixed_binary((sig & np.uint32(255)).astype(np.uint8)),
                    pa.ListArray.from_arrays(at, pa.array(band_keys(sig).ravel())),
                ],
                names=["doc_id", "key", "n_shingles", "low", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, key binary, n_shingles long, low binary, bands array<long>"
    )


@lru_cache(maxsize=8)
def least_matches(miss: float) -> list[int]:
    """For 16, 32, ... compared bytes: fewest matches that keep a pair.

    Under a uniform prior, P(similarity >= wanted | m of n match) = P(Binomial(n + 1, c) <= m),
    with c the chance that two bytes match at the wanted similarity.
    """
    wanted = PERCENT / 100
    c = wanted + (1 - wanted) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * c**m * (1 - c) ** (n + 1 - m)
        out.append(m)
    return out


def plausible(a: np.ndarray, b: np.ndarray, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of byte matrices that may be similar enough, and their matches; batch by batch."""
    live = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(miss)):
        part = slice(k * STEP, (k + 1) * STEP)
        matches[live] += (a[live, part] == b[live, part]).sum(1)
        live = live[matches[live] >= least]
    return live, matches


def byte_rows(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(-1, HASHES)


def likely_pairs(pairs: DataFrame, classes: DataFrame, miss: float) -> DataFrame:
    """Pairs (a, b) that pass the posterior test."""
    low = classes.select("rep", "low")
    joined = pairs.join(low.select(F.col("rep").alias("b"), F.col("low").alias("low_b")), "b")
    joined = joined.join(low.select(F.col("rep").alias("a"), F.col("low").alias("low_a")), "a")

    @frugal
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = byte_rows(batch.column("low_a")), byte_rows(batch.column("low_b"))
                keep, _ = plausible(x, y, miss)
                yield batch.select(["a", "b"]).take(pa.array(keep))

    return joined.select("a", "b", "low_a", "low_b").mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    small, large = sorted((len(x), len(y)))
    if 100 * small < PERCENT * large or not small:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (small + large - both)


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id and compressed text, which is what travels through shuffles."""

    @frugal
    def run(batches):
        for batch in batches:
            pack = zstandard.ZstdCompressor(level=3)
            texts = texts_of(batch.column("text")).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([pack.compress(t.encode()) for t in texts], pa.binary()),
                ],
                names=["doc_id", "z"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, z binary")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough; ``texts``: rep, z."""
    joined = pairs.join(texts.select(F.col("rep").alias("b"), F.col("z").alias("z_b")), "b")
    joined = joined.join(texts.select(F.col("rep").alias("a"), F.col("z").alias("z_a")), "a")

    @frugal
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, "z_b", 1 << 20):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            sets = {}
            for ids, column in ((a, "z_a"), (b, "z_b")):
                raw = batch.column(column)
                fresh = {i: k for k, i in enumerate(ids) if i not in sets}
                listed = [unpack.decompress(raw[k].as_py()).decode() for k in fresh.values()]
                sets.update(zip(fresh, shingle_sets(pa.array(listed, pa.string()))[0], strict=True))
            keep = [similar(sets[x], sets[y]) for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return joined.select("a", "b", "z_a", "z_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and component (smallest node reachable) for every node of ``links`` (a, b).

    Labels go to neighbours and then jump to the label's own label, so long chains shorten
    quickly; every round is stored, so a lost executor costs no more than one round.
    """
    both = stage(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))),
        "links",
    )
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("component")
    )
    labels = stage(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        better = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("new")
        )
        ahead = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        jumped = better.join(ahead, "new").select(
            "node", "old", F.least("new", "far").alias("component")
        )
        jumped = stage(jumped, "labels")
        labels = jumped.select("node", "component")
        if not jumped.filter(F.col("old") != F.col("component")).limit(1).count():
            return labels


def class_components(classes: DataFrame, links: DataFrame) -> DataFrame:
    """rep and component of every class; a class without links is its own."""
    found = components(links).withColumnRenamed("node", "rep")
    joined = classes.select("rep").distinct().join(found, "rep", "left")
    return joined.select("rep", F.coalesce("component", "rep").alias("component"))


def first_stars(members: DataFrame) -> DataFrame:
    """One pair (a, b) for every class b: with the smallest id that any of its buckets holds."""
    others = members.filter("leader <> rep").groupBy("rep").agg(F.min("leader").alias("a"))
    return others.select("a", F.col("rep").alias("b"))


def open_stars(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's smallest id with its classes in other components."""
    tagged = members.select("band", "rep").join(parts, "rep")
    mixed = tagged.groupBy("band").agg(
        F.min(F.struct("rep", "component")).alias("lead"),
        F.min("component").alias("low_c"), F.max("component").alias("high_c"),
    ).filter("low_c < high_c").select("band", "lead")
    apart = tagged.join(mixed, "band").filter("component <> lead.component")
    return apart.select(F.col("lead.rep").alias("a"), F.col("rep").alias("b")).distinct()


def dealt_groups(rows: DataFrame, blocks: Column) -> DataFrame:
    """Members of a bucket (band, rep, component, ...) that has several components, sorted by group.

    Large buckets are cut into ``blocks`` (an aggregate), which meet in pairs, so a task holds
    two blocks at most.
    """
    mixed = rows.groupBy("band").agg(
        blocks.alias("_blocks"), F.min("component").alias("low_c"), F.max("component").alias("high_c")
    ).filter("low_c < high_c").select("band", "_blocks")
    cut = rows.join(mixed, "band").withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    dealt = cut.withColumn("_other", other).select(
        "band", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
        "_own", *(c for c in rows.columns if c != "band"),
    )
    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP, "rep")


def open_members(members: DataFrame, classes: DataFrame, parts: DataFrame, miss: float) -> DataFrame:
    """Members (band, rep) with a plausible partner in another component, a row each however many."""
    rows = members.select("band", "rep").join(parts, "rep").join(
        classes.select("rep", "low", "bands"), "rep"
    )

    @frugal
    def run(batches):
        for table in whole_groups(batches, GROUP):
            rep, band = table["rep"].to_numpy(), table["band"].to_numpy()
            open_ones = np.zeros(len(rep), bool)
            for k, at in _plausible_partners(table, miss):
                open_ones[at] = True
                open_ones[k] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(band[open_ones]), pa.array(rep[open_ones])], names=["band", "rep"]
            )

    grouped = dealt_groups(rows, F.ceil(F.count("*") / BLOCK))
    return grouped.mapInArrow(run, "band long, rep long").distinct()


def group_links(
    some: DataFrame, classes: DataFrame, parts: DataFrame, texts: DataFrame, miss: float
) -> DataFrame:
    """Links (a, b) between different components among the members ``some`` (band, rep) of each bucket.

    Full sets are compared where the members meet, so pairs that are not similar enough go
    nowhere; a pair whose components are linked by then needs no test.
    """
    rows = some.join(parts, "rep").join(classes.select("rep", "low", "bands"), "rep").join(texts, "rep")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.length("z")) / BLOCK_BYTES))

    @frugal
    def run(batches):
        joined: dict[int, int] = {}

        def root(part: int) -> int:
            while part in joined:
                joined[part] = part = joined.get(joined[part], joined[part])
            return part

        for table in whole_groups(batches, GROUP):
            rep, part = table["rep"].to_numpy(), table["component"].to_numpy().tolist()
            sets = HeldSets(table)
            a, b = [], []
            for k, at in _plausible_partners(table, miss):
                for other in at.tolist():
                    x, y = root(part[k]), root(part[other])
                    if x != y and similar(sets[k], sets[other]):
                        joined[max(x, y)] = min(x, y)
                        a.append(min(rep[k], rep[other]))
                        b.append(max(rep[k], rep[other]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
            )

    return dealt_groups(rows, blocks).mapInArrow(run, "a long, b long")


class HeldSets:
    """Shingle sets of the table's rows (rep, z), made when first asked for; at most
    ``SET_BYTES`` are held, and the two last asked for."""

    def __init__(self, table: pa.Table):
        self.rep, self.z = table["rep"].to_numpy(), table["z"]
        self.unpack = zstandard.ZstdDecompressor()
        self.held: dict[int, np.ndarray] = {}
        self.size = 0

    def __getitem__(self, row: int) -> np.ndarray:
        key = int(self.rep[row])
        if key not in self.held:
            text = self.unpack.decompress(self.z[row].as_py()).decode()
            found = shingle_sets(pa.array([text], pa.string()))[0][0]
            if self.size + found.nbytes > SET_BYTES:
                self.held, self.size = {}, 0
            self.held[key] = found
            self.size += found.nbytes
        return self.held[key]


def _plausible_partners(table: pa.Table, miss: float) -> Iterator[tuple[int, np.ndarray]]:
    """A row and its later plausible partners in other components, by groups of the table, whose
    rows are sorted by group and id. A pair belongs to the first band that it shares."""
    part, own = table["component"].to_numpy(), table["_own"].to_numpy()
    crossed = table["_i"].to_numpy() != table["_j"].to_numpy()
    low = byte_rows(table["low"].combine_chunks())
    bands = pc.list_flatten(table["bands"].combine_chunks()).to_numpy().reshape(-1, BANDS)
    here = table["band"].to_numpy()
    for start, stop in group_spans(table, GROUP):
        for k in range(start, stop - 1):
            partner = part[k + 1 : stop] != part[k]
            if crossed[k]:  # pairs within a block belong to the block's own group
                partner &= own[k + 1 : stop] != own[k]
            at = np.flatnonzero(partner) + k + 1
            if not len(at):
                continue
            keep, _ = plausible(np.broadcast_to(low[k], (len(at), low.shape[1])), low[at], miss)
            first = (bands[at[keep]] == bands[k]).argmax(1)
            at = at[keep[bands[k][first] == here[k]]]
            if len(at):
                yield k, at


def near_duplicates(docs: DataFrame, miss: float = MISS) -> DataFrame:
    """Classes of near-duplicate rows of ``docs`` (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; two texts are linked if
    100 * common >= 75 * all of their distinct 5-word shingles (a shorter text is one
    shingle). Returns doc_id, n_shingles, component_id (smallest linked doc_id), kept.
    Null and empty texts have no shingle and no link. Rows without doc_id link nothing
    and are kept with a null component; rows that repeat an id are each answered, with one
    component if their texts are equal. Other columns are ignored; an empty table
    gives an empty result. Shingles are compared as 64-bit hashes.
    """
    drawn = stage(sketches(docs), "sketches")
    usable = drawn.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    by_key = usable.groupBy("key").agg(F.min(F.struct("doc_id", "low", "bands")).alias("r"))
    classes = stage(
        by_key.select("key", F.col("r.doc_id").alias("rep"), "r.low", "r.bands"), "classes"
    )
    bands = classes.select(F.explode("bands").alias("band"), "rep")
    shared = bands.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("n"))
    members = stage(bands.join(shared.filter("n > 1"), "band"), "members")
    wanted = members.select("rep").distinct()
    texts = packed_texts(docs).withColumnRenamed("doc_id", "rep").join(wanted, "rep", "left_semi")
    texts = stage(texts.groupBy("rep").agg(F.first("z").alias("z")), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        return stage(confirmed(likely_pairs(pairs, classes, miss), texts), "links")

    links = verified(first_stars(members))
    parts = stage(class_components(classes, links), "parts")
    for step in ("stars", "all"):
        if step == "stars":
            found = verified(open_stars(members, parts))
        else:
            some = stage(open_members(members, classes, parts, miss), "open")
            found = stage(group_links(some, classes, parts, texts, miss), "links")
        if found.limit(1).count():  # else nothing changes
            links = links.union(found)
            parts = stage(class_components(classes, links), "parts")
    by_key = classes.select("key", "rep").join(parts, "rep").select("key", "component")
    answered = drawn.select("doc_id", "key", "n_shingles").join(by_key, "key", "left")
    component = F.when(
        (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")
    ).otherwise(F.col("doc_id"))
    out = answered.select("doc_id", "n_shingles", component.alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.withColumn("kept", kept)
