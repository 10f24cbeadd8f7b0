"""Quality rules: gradient-boosted trees over document statistics.

Statistics are exact and computed in batches. The trees are trained on a bounded sample of
labelled rows, with monotonic constraints, and flattened into node arrays, so a batch
is scored with a few array operations per tree level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import stage
from .batches import coded_words, frugal, slices, sums, texts_of

#: Labelled rows that the trees are trained on: those whose hashed id comes first.
TRAIN_ROWS = 20_000
#: Documents whose probability of good quality is at least this are kept.
THRESHOLD = 0.5

# name and direction: -1 if more of it may only lower the quality, +1 only raise, 0 free
FEATURES = [
    ("log_words", 0), ("word_length", 0), ("symbols", -1), ("dup_lines", -1),
    ("repeat_words", -1), ("distinct_words", 0), ("upper", -1), ("digits", 0),
    ("punctuation", 0), ("lines", 0), ("longest_word", 0),
]
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: words that lie in 3-word windows found twice or more in the text."""
    n = len(codes)
    if n < 3:
        return np.zeros(len(bounds) - 1, np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(text[2:] == text[:-2])
    codes = codes.astype(np.int64)
    size = int(codes.max()) + 1
    # pairs and triples are numbered one after the other, so that equal numbers mean equal words
    _, pair = np.unique(codes[:-1] * size + codes[1:], return_inverse=True)
    _, triple = np.unique(pair[inside] * size + codes[inside + 2], return_inverse=True)
    kinds = int(triple.max()) + 1 if len(triple) else 1
    _, back, number = np.unique(text[inside] * kinds + triple, return_inverse=True, return_counts=True)
    again = inside[number[back] > 1]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[again + k] = True
    return sums(covered.astype(np.int64), bounds)


def repeated_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and how many of them equal an earlier line."""
    lists = pc.split_pattern(texts, "\n")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    coded = lists.flatten().dictionary_encode()
    with_word = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]")
    used = with_word.to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    real = used[codes] if len(codes) else np.zeros(0, bool)
    lines = np.bincount(text[real], minlength=len(texts))
    once = np.unique(text[real] * max(len(used), 1) + codes[real]) // max(len(used), 1)
    return lines, lines - np.bincount(once, minlength=len(texts))


def describe(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The five exact counts, and the features of the trees."""
    bounds, codes, distinct = coded_words(texts)
    n_words = np.diff(bounds)
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    each = length[codes] if len(codes) else np.zeros(0, np.int64)
    word_chars = sums(each, bounds)

    def count(pattern: str) -> np.ndarray:
        found = pc.count_substring_regex(texts, pattern)
        return found.to_numpy(zero_copy_only=False).astype(np.int64)

    symbols = count("[#*$%&|<>]")
    lines, dup_lines = repeated_lines(texts)
    repeats = repeated_words(codes, bounds)
    text = np.repeat(np.arange(len(texts)), n_words)
    kinds = np.unique(text * max(len(distinct), 1) + codes) // max(len(distinct), 1)
    longest = np.zeros(len(texts))
    np.maximum.at(longest, text, each)
    chars, words = np.maximum(word_chars, 1), np.maximum(n_words, 1)
    features = np.stack(
        [
            np.log1p(n_words), word_chars / words, symbols / chars, dup_lines / np.maximum(lines, 1),
            repeats / words, np.bincount(kinds, minlength=len(texts)) / words,
            count("[A-Z]") / chars, count("[0-9]") / chars, count(r"[!?.,;:]") / chars,
            lines / words, longest,
        ],
        axis=1,
    )
    return [n_words, word_chars, symbols, dup_lines, repeats], features


def statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the five counts and ``features`` of every row of ``docs`` (doc_id, text); columns
    in ``carry`` come along."""

    @frugal
    def run(batches):
        for batch in slices(batches):
            counts, features = describe(texts_of(batch.column("text")))
            width = features.shape[1]
            bounds = pa.array(np.arange(0, features.size + 1, width), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), *map(pa.array, counts),
                    pa.ListArray.from_arrays(bounds, pa.array(features.ravel())),
                    *(batch.column(c) for c in carry),
                ],
                names=["doc_id", *(c.split()[0] for c in COUNTS.split(", ")), "features", *carry],
            )

    needed = [c for c in ("doc_id", "text") if c not in carry]
    return docs.select(*needed, *carry).mapInArrow(
        run, f"doc_id long, {COUNTS}, features array<double>{carried(docs, carry)}"
    )


def carried(docs: DataFrame, carry: tuple[str, ...]) -> str:
    """Schema of columns that come along."""
    types = dict(docs.dtypes)
    return "".join(f", `{c}` {types[c]}" for c in carry)


@dataclass
class Forest:
    """Trees as flat node arrays; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    child: np.ndarray  # (nodes, 2): at most the limit, above it
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality, all rows and one tree level at a time."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            for _ in range(self.depth):
                above = x[rows, self.feature[node]] > self.limit[node]
                node = self.child[node, above.astype(np.int8)]
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def train(
    x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4,
    rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: int = 10,
) -> Forest:
    """Logistic boosting on quantile bins. A split on a constrained feature must order its
    two values by the sign, and their middle bounds all values below it."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)
    roots, feature, limit, child, value = [], [], [], [], []

    def node(v: float) -> int:
        feature.append(0)
        limit.append(np.inf)
        child.append([len(value), len(value)])
        value.append(v)
        return len(value) - 1

    def grow(rows, own, low, high, level):
        if level == depth or len(rows) < 2 * least:
            return
        best = None
        g, h = grad[rows], hess[rows]
        total_g, total_h = g.sum(), h.sum()
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, f]
            n = len(c) + 1
            left_g = np.cumsum(np.bincount(b, g, n))[:-1]
            left_h = np.cumsum(np.bincount(b, h, n))[:-1]
            left_n = np.cumsum(np.bincount(b, minlength=n))[:-1]
            a = np.clip(-left_g / (left_h + ridge), low, high)
            z = np.clip(-(total_g - left_g) / (total_h - left_h + ridge), low, high)
            gain = -(left_g * a + (left_h + ridge) * a * a / 2) - (
                (total_g - left_g) * z + (total_h - left_h + ridge) * z * z / 2
            )
            allowed = (left_n >= least) & (len(rows) - left_n >= least)
            if signs[f]:
                allowed &= (z - a) * signs[f] >= 0
            gain = np.where(allowed, gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > (best[0] if best else 1e-6):
                best = (gain[k], f, k, a[k], z[k])
        if best is None:
            return
        _, f, k, a, z = best
        under = binned[rows, f] <= k
        left, right = node(a * rate), node(z * rate)
        feature[own], limit[own], child[own] = f, cuts[f][k], [left, right]
        middle = (a + z) / 2
        for part, at, up in ((rows[under], left, signs[f] > 0), (rows[~under], right, signs[f] < 0)):
            bounded = signs[f] != 0
            grow(part, at, middle if bounded and not up else low, middle if bounded and up else high, level + 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        first = node(float(np.clip(-grad.sum() / (hess.sum() + ridge), -4, 4)) * rate)
        roots.append(first)
        grow(np.arange(len(y)), first, -4.0, 4.0, 0)
        one = Forest(np.array([first]), np.array(feature), np.array(limit), np.array(child),
                     np.array(value), 0.0, depth)
        p = one.score(x)
        score += np.log(p / (1 - p))
    return Forest(np.array(roots), np.array(feature), np.array(limit), np.array(child),
                  np.array(value), base, depth)


def fit(described: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Forest | None:
    """Trees from at most ``train_rows`` labelled rows; None if both classes are not there."""
    known = labels.select("doc_id", "quality").filter(
        F.col("doc_id").isNotNull() & F.col("quality").isNotNull()
    ).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = described.select("doc_id", "features").join(known, "doc_id")
    order = [F.xxhash64("doc_id"), "doc_id", F.hash("features")]
    rows = sample.orderBy(*order).limit(train_rows).select("features", "quality").toArrow()
    if not rows.num_rows:
        return None
    x = pc.list_flatten(rows["features"].combine_chunks()).to_numpy().reshape(rows.num_rows, -1)
    y = rows["quality"].to_numpy().astype(float)
    if y.min() == y.max():
        return None
    return train(x, y, [s for _, s in FEATURES])


def quality_rules(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS,
    threshold: float = THRESHOLD, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Verdict on every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, quality).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    quality (the trees' probability) and kept. A null text has no words and fails the base rule;
    a null doc_id stays null; repeated rows are each answered; of contradicting labels the
    best counts; null labels are ignored; without labels of both classes the trees keep
    everything (quality 1). Columns in ``carry`` come along, others are ignored; an empty
    table gives an empty result.
    """
    described = stage(statistics(docs, carry), "statistics")
    forest = fit(described, labels, train_rows)

    @frugal
    def run(batches):
        for batch in batches:
            x = pc.list_flatten(batch.column("features")).to_numpy().reshape(-1, len(FEATURES))
            p = np.ones(len(x)) if forest is None else forest.score(x)
            kept = [c for c in batch.schema.names if c != "features"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(p)], names=[*kept, "quality"]
            )

    scored = described.mapInArrow(run, f"doc_id long, {COUNTS}{carried(docs, carry)}, quality double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
