"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word's letters are a binary vector with a dimension per (letter, how often it came before).
Replacing a code point changes two dimensions of a word of the same length, inserting one
changes one. The dimensions are dealt to t parts; a signature hashes all parts but d of them.
Two vectors that differ in at most d dimensions differ in at most d parts, so leaving out
those gives them an equal signature: words of equal length meet on signatures without two
parts, words whose lengths differ by one on signatures without one part. As the one edit lies
in one half of the longer word, the other half is equal too, so each signature is emitted once
with a hash of either half; this keeps groups small where many words share their letters.
Pairs that meet are verified by their edit distance inside the join.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stage import stage
from .batches import mix, slices
from .linededup import LOWER, UPPER

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Parts for pairs of equal length and of neighbouring lengths, by the longer word's length:
#: a long word has letters enough for a signature of few parts.
SHORT_PARTS, LONG_PARTS, LONG = (4, 3), (3, 2), 16
#: Bytes of words that a task turns into signatures at a time.
WORD_BYTES = 1 << 20


def counted_words(
    docs: DataFrame, least_length: int = 5, least_count: int = 3, modulus: int = 97
) -> DataFrame:
    """Distinct words (word, n) of ``docs`` (doc_id, text).

    A run of letters is lower-cased (A-Z only); where ``modulus`` divides the crc32 h of
    ``<doc_id>:<run>`` it loses its code point h % length. A null id is written as nothing.
    """
    run = F.translate(F.col("run"), UPPER, LOWER)
    mark = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(mark.alias("mark"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select(run.alias("run"), F.crc32(F.concat("mark", F.lit(":"), run).cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("run")).alias("word"))
    words = words.filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def letter_ranks(words: DataFrame) -> dict[int, int]:
    """Code points of the words by falling frequency; at most as many as the pattern allows."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).filter("c != ''")
    counts = letters.groupBy("c").agg(F.count("*").alias("n")).collect()
    order = sorted(counts, key=lambda r: (-r["n"], r["c"]))
    return {ord(r["c"]): k for k, r in enumerate(order)}


def running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])


class Letters:
    """Letter vectors of many words: a hash and a rank per dimension that is set."""

    def __init__(self, words: list[str], ranks: np.ndarray):
        self.lengths = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.word = np.repeat(np.arange(len(words)), self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(points)) - np.repeat(self.starts, self.lengths)
        high = points.astype(np.uint64) << np.uint64(32)
        self.from_start = running(mix(high + place.astype(np.uint64)))
        place = np.repeat(self.lengths, self.lengths) - place
        self.from_end = running(mix(high - place.astype(np.uint64)))
        order = np.lexsort((points, self.word))
        points = points[order]  # self.word is sorted already
        new = np.ones(len(points), bool)
        new[1:] = (points[1:] != points[:-1]) | (self.word[1:] != self.word[:-1])
        starts = np.flatnonzero(new)
        before = np.arange(len(points)) - np.repeat(starts, np.diff(np.append(starts, len(points))))
        self.rank = ranks[points] + before
        self.hash = mix((points.astype(np.uint64) << np.uint64(32)) + before.astype(np.uint64))

    def halves(self, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``longer // 2`` code points of each word, and of the last ones
        that make up the rest of a word of length ``longer``."""
        first = longer // 2
        end = self.starts + self.lengths
        head = self.from_start[self.starts + first] - self.from_start[self.starts]
        tail = self.from_end[end] - self.from_end[end - (longer - first)]
        return mix(head), mix(tail + np.uint64(1))

    def parts(self, t: int) -> np.ndarray:
        """(words, t): the hash of each word's dimensions in each part."""
        out = np.zeros((len(self.lengths), t), np.uint64)
        np.add.at(out, (self.word, self.rank % t), self.hash)
        return out


def signatures(parts: np.ndarray, longer: np.ndarray, left_out: int) -> np.ndarray:
    """(words, ways): a hash of all parts but ``left_out``, of which ones, and of the length."""
    whole = parts.sum(1) + mix(longer.astype(np.uint64) * np.uint64(4) + np.uint64(left_out))
    columns = []
    for k, gone in enumerate(combinations(range(parts.shape[1]), left_out)):
        columns.append(mix(whole - parts[:, gone].sum(1) + mix(np.full(1, k + 1, np.uint64))))
    return np.stack(columns, 1)


def signed(words: DataFrame, ranks: dict[int, int]) -> DataFrame:
    """(word, n) -> (sig, kind, word, n): kind 0 meets kind 0, kind 1 (the longer) kind 2."""
    table = np.zeros(max(ranks, default=0) + 1, np.int64)
    for point, rank in ranks.items():
        table[point] = rank

    def run(batches):
        for batch in slices(batches, "word", WORD_BYTES):
            texts = batch.column("word").to_pylist()
            letters = Letters(texts, table)
            parts = {t: letters.parts(t) for t in {*SHORT_PARTS, *LONG_PARTS}}
            for kind, grow, left_out in ((0, 0, 2), (1, 0, 1), (2, 1, 1)):
                longer = letters.lengths + grow
                halves = letters.halves(longer)
                for long, chosen in ((False, SHORT_PARTS), (True, LONG_PARTS)):
                    rows = np.flatnonzero((longer >= LONG) == long)
                    if not len(rows):
                        continue
                    t = chosen[left_out == 1]
                    sig = signatures(parts[t][rows], longer[rows], left_out)
                    sig = np.concatenate([mix(sig + h[rows, None]) for h in halves], 1)
                    at = pa.array(np.repeat(rows, sig.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(sig.ravel().view(np.int64)),
                            pa.array(np.full(sig.size, kind, np.int32)),
                            batch.column("word").take(at), batch.column("n").take(at),
                        ],
                        names=["sig", "kind", "word", "n"],
                    )

    return words.mapInArrow(run, "sig long, kind int, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of words one edit apart, both ways: (word, n, other, other_n)."""
    spark = words.sparkSession
    rows = stage(signed(words, letter_ranks(words)), "signatures")
    left = rows.filter("kind < 2").select("sig", "kind", F.col("word").alias("a"), F.col("n").alias("an"))
    right = rows.filter("kind != 1").select(
        "sig", F.when(F.col("kind") == 2, 1).otherwise(0).alias("kind"),
        F.col("word").alias("b"), F.col("n").alias("bn"),
    )
    one_way = (F.col("kind") == 1) | (F.col("a") < F.col("b"))
    met = left.join(right, ["sig", "kind"]).filter(one_way & (F.levenshtein("a", "b", 1) == 1))
    pairs = stage(met.select("a", "an", "b", "bn").distinct(), "pairs")
    back = pairs.select(F.col("b"), F.col("bn"), F.col("a"), F.col("an"))
    return pairs.union(back).toDF("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): where following forms ends. A form is at least twice as
    frequent as its word, so chains are short and jumping halves them every round."""
    found = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = found.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        found = stage(jumped, "roots")
        if not found.filter("moved").limit(1).count():
            return found.select("word", "root")
        found = found.select("word", "root")


def spelling_variants(
    docs: DataFrame, least_length: int = 5, least_count: int = 3, modulus: int = 97, times: int = 2
) -> DataFrame:
    """Group the words of ``docs`` (doc_id, text) by spelling.

    Returns word, form, root, n, n_near, form_n, a row per distinct word of at least
    ``least_length`` code points and ``least_count`` occurrences. Near words differ by one
    inserted, deleted or replaced code point; the form is the near word of largest n (ties: the
    smallest) if that is at least ``times`` the word's own n. Rows that repeat an id count each,
    null or empty texts have no words, other columns are ignored, an empty table gives an
    empty result.
    """
    words = stage(counted_words(docs, least_length, least_count, modulus), "words")
    first: Column = F.min(F.struct((-F.col("other_n")).alias("k"), F.col("other").alias("word")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), first.alias("best"))
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.k") >= times * F.col("n"), F.col("best")).alias("best"),
    )
    judged = stage(
        judged.select(
            "word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.k")).alias("form_n")
        ),
        "judged",
    )
    ends = roots(judged.filter("form is not null").select("word", "form"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
