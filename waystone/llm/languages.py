"""Language of texts and of their spans, from words.

Training counts letter trigrams of words per language over all training texts. To predict,
the script of a word (ranges of code points) narrows the languages that it may be in, each
word gets a score per language, and a Viterbi search over the words of a text with a
penalty for every switch labels spans. The batch's texts take each step together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import MIX_A, buffer_of, coded_words, frugal, mix, slices, texts_of

#: Cells for hashed trigrams of a language; with the scripts, all that is kept of one.
CELLS = 1 << 14
#: Cost of a change of language between two words, in nats.
PENALTY = 12.0
#: A language is a candidate for a script that at least this share of its words is in.
SCRIPT_SHARE = 1e-3
IMPOSSIBLE = -1e4

# First code points of letter ranges and their scripts.
RANGES = [
    (0x0041, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"),
    (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
SCRIPTS = sorted({name for _, name in RANGES})
STARTS = np.array([start for start, _ in RANGES])
SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in RANGES])


class Words:
    """Distinct words of a batch: letters, script, and hashed trigrams of the lower-case form."""

    def __init__(self, distinct: pa.Array):
        letter = pc.match_substring_regex(distinct, r"\pL")
        self.letter = letter.to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(distinct)
        only = pc.replace_substring_regex(lower, r"[^\pL\pM]+", "")
        self.size = pc.utf8_length(only).to_numpy(zero_copy_only=False).astype(np.int64)
        self.script = self._scripts(only)
        framed = pc.binary_join_element_wise(pa.scalar(" "), only, pa.scalar(" "), "")
        data, bounds = buffer_of(framed)
        wide = data.astype(np.uint64)
        n = max(len(data) - 2, 0)
        gram = wide[:n] | wide[1 : n + 1] << np.uint64(8) | wide[2 : n + 2] << np.uint64(16)
        owner = np.repeat(np.arange(len(distinct)), np.diff(bounds))
        whole = (owner[:n] == owner[2 : n + 2]) & self.letter[owner[:n]]
        self.owner = owner[:n][whole]
        self.cell = (mix(gram[whole] * MIX_A) >> np.uint64(50)).astype(np.int64)

    def _scripts(self, words: pa.Array) -> np.ndarray:
        """Script of each word's first letter, -1 without a letter."""
        first = "".join((w[:1] or "\0") for w in words.to_pylist())
        points = np.frombuffer(first.encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.searchsorted(STARTS, points, "right") - 1
        return np.where(at >= 0, SCRIPT_OF[np.maximum(at, 0)], -1)


def training_counts(docs: DataFrame) -> DataFrame:
    """lang, cell, n: trigrams (and, behind them, scripts of words) of all rows of
    ``docs`` (text, lang) whose lang is known. A task adds up what it has read first."""

    @frugal
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            known = pc.is_valid(batch.column("lang"))
            batch = batch.filter(known)
            if not batch.num_rows:
                continue
            langs = batch.column("lang").dictionary_encode()
            names = langs.dictionary.to_pylist()
            lang = langs.indices.to_numpy(zero_copy_only=False)
            bounds, codes, distinct = coded_words(texts_of(batch.column("text")))
            words = Words(distinct)
            of = np.repeat(lang, np.diff(bounds))
            for k, name in enumerate(names):
                times = np.bincount(codes[of == k], minlength=len(distinct)).astype(np.int64)
                own = total.setdefault(name, np.zeros(CELLS + len(SCRIPTS), np.int64))
                own[:CELLS] += np.bincount(
                    words.cell, times[words.owner], minlength=CELLS
                ).astype(np.int64)
                has = words.script >= 0
                own[CELLS:] += np.bincount(
                    words.script[has], times[has], minlength=len(SCRIPTS)
                ).astype(np.int64)
        for name, counts in total.items():
            cell = np.flatnonzero(counts)
            cell = cell if len(cell) else np.zeros(1, np.int64)  # a language without words
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(cell)), pa.array(cell.astype(np.int32)), pa.array(counts[cell])],
                names=["lang", "cell", "n"],
            )

    found = docs.select("text", "lang").mapInArrow(run, "lang string, cell int, n long")
    return found.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    score: np.ndarray  # (cells, langs): log probability of a trigram
    allowed: np.ndarray  # (scripts, langs)


def fit(docs: DataFrame) -> Model:
    """The model of all rows of ``docs`` (text, lang); its size depends on the number of
    languages only."""
    rows = training_counts(docs).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((CELLS + len(SCRIPTS), max(len(langs), 1)))
    place = {name: k for k, name in enumerate(langs)}
    column = np.array([place[x] for x in rows["lang"].to_pylist()], np.int64)
    counts[rows["cell"].to_numpy().astype(np.int64), column] = rows["n"].to_numpy()
    grams, scripts = counts[:CELLS] + 0.5, counts[CELLS:]
    score = np.log(grams / grams.sum(0))
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    allowed[~allowed.any(1)] = True  # a script that no language uses excludes none
    return Model(langs, score.astype(np.float32), allowed)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Log likelihood of every distinct word per language; 0 without letters."""
    out = np.zeros((len(words.letter), len(model.langs)), np.float32)
    for k in range(len(model.langs)):
        out[:, k] = np.bincount(
            words.owner, model.score[words.cell, k], minlength=len(words.letter)
        )
    has = words.script >= 0
    out[has] += np.where(model.allowed[words.script[has]], 0, IMPOSSIBLE)
    out[~words.letter] = 0
    return out


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word; ``scores`` has a row per word, texts lie between bounds."""
    n, langs = scores.shape
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    first, active = bounds[:-1][order], np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left")
    switch = np.zeros((n, langs), bool)
    source = np.zeros(n, np.int16)
    best = np.zeros((len(sizes), langs), np.float32)
    for step in range(len(active)):
        live = active[step]
        at = first[:live] + step
        own = best[:live]
        if step:
            top = own.argmax(1)
            change = own[np.arange(live), top][:, None] - np.float32(penalty)
            moved = change > own
            switch[at], source[at] = moved, top
            np.maximum(own, change, out=own)
        own += scores[at]
    label = np.zeros(n, np.int16)
    now = best.argmax(1).astype(np.int16)
    for step in range(len(active) - 1, -1, -1):
        live = active[step]
        at = first[:live] + step
        here = now[:live]
        label[at] = here
        now[:live] = np.where(switch[at, here], source[at], here)
    return label


def label_batch(texts: pa.Array, model: Model, penalty: float):
    """Per text: its language (-1: none) and the share of letters in it; per word: bounds, labels."""
    bounds, codes, distinct = coded_words(texts)
    if not len(codes) or not model.langs:
        return np.full(len(texts), -1), np.zeros(len(texts)), bounds, np.zeros(len(codes), np.int16)
    words = Words(distinct)
    label = viterbi(word_scores(words, model)[codes], bounds, penalty)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    letters = np.where(words.letter, words.size, 0)[codes]
    width = len(model.langs)
    by = np.bincount(text * width + label, letters, minlength=len(texts) * width)
    by = by.reshape(len(texts), width)
    total = by.sum(1)
    best = np.where(total > 0, by.argmax(1), -1)
    return best, by.max(1) / np.maximum(total, 1), bounds, label


def predict(
    docs: DataFrame, model: Model, penalty: float = PENALTY, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text).

    ``lang_pred`` is the language of most letters and ``score`` their share; a null
    text or one without a letter is ``und`` with score 0. A null doc_id stays null, repeated
    rows are each answered, columns in ``carry`` come along and others are ignored, an empty
    table gives an empty result; ties go to the first name.
    """

    @frugal
    def run(batches):
        for batch in slices(batches):
            best, score, _, _ = label_batch(texts_of(batch.column("text")), model, penalty)
            names = [model.langs[k] if k >= 0 else "und" for k in best.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()),
                    pa.array(score, pa.float64()), *(batch.column(c) for c in carry),
                ],
                names=["doc_id", "lang_pred", "score", *carry],
            )

    types = dict(docs.dtypes)
    extra = "".join(f", `{c}` {types[c]}" for c in carry)
    needed = [c for c in ("doc_id", "text") if c not in carry]
    return docs.select(*needed, *carry).mapInArrow(
        run, f"doc_id long, lang_pred string, score double{extra}"
    )


def spans(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """Spans of one language in every text: doc_id, first_word, n_words, lang."""

    @frugal
    def run(batches):
        for batch in slices(batches):
            ids = batch.column("doc_id").cast(pa.int64())
            _, _, bounds, label = label_batch(texts_of(batch.column("text")), model, penalty)
            text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (label[1:] != label[:-1])
            start = np.flatnonzero(new) if model.langs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(text[start])), pa.array(start - bounds[text[start]]),
                    pa.array(np.diff(np.append(start, len(text)))[: len(start)]),
                    pa.array([model.langs[k] for k in label[start].tolist()], pa.string()),
                ],
                names=["doc_id", "first_word", "n_words", "lang"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, first_word long, n_words long, lang string"
    )


def fold(folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in no fold (null)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def identify(docs: DataFrame, folds: int = 5, penalty: float = PENALTY) -> DataFrame:
    """Learn from the rows outside fold 0 and predict every row: doc_id, held_out, lang_pred,
    score. Rows without an id are not learned from and not held out."""
    held_out = F.coalesce(fold(folds) == 0, F.lit(False))
    learned = docs.select("doc_id", "text", "lang").filter(fold(folds) != 0)
    model = fit(learned)
    return predict(docs, model, penalty).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )
