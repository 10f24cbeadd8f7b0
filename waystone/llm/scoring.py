"""Scores of texts: a word unigram base and a causal attention model over subwords.

Counts cover all training texts: each block sends its words with their training counts to
value ranges, a range adds them up, asks the tokenizer for the subword ids of each
word once, and answers every block. The attention weights learn from every window of every
training text: a few windows in one task first, then tasks side by side in rounds, each as
large as all before it, whose weights are averaged. Only arrays of weights reach the driver.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import stage
from .attention import BATCH, CLIMB, RATE, Model, State, UNITS, input_windows
from .batches import buffer_of, coded_words, hash_strings, mix, ragged, sums, whole_groups
from .blocks import Block, range_count, spread, squeeze, stored_blocks, unpacked, with_answers
from .languages import fold
from .packing import word_ids

FOLDS, HELD_OUT = 7, 2
#: Steps of training at least; a small corpus is passed over several times for them.
STEPS = 800
#: Units that a task shuffles at a time, and tasks that add up the weights of a round.
SHUFFLED, ADDERS = 1 << 21, 4
#: Stands for the end of a text; no word holds a line end.
END = "\n"


def fold_of(ids: list) -> np.ndarray:
    """crc32 of the id as text, modulo the folds; -1 without an id."""
    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) % FOLDS for i in ids])


class Words:
    """Words of a block: distinct ones by value range, and where each text uses them."""

    def __init__(self, block: Block, ranges: int):
        texts = pc.ascii_lower(pa.array(block.texts(), pa.string()))
        self.bounds, codes, distinct = coded_words(texts)
        distinct = pa.concat_arrays([distinct.cast(pa.string()), pa.array([END])])
        part = (hash_strings(distinct, 5) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.part = distinct.take(pa.array(order)), part[order]
        self.codes, self.end = rank[codes], int(rank[-1])
        fold = fold_of(block.ids)
        self.held_out = fold == HELD_OUT
        self.learned = (fold >= 0) & ~self.held_out
        used = self.codes[np.repeat(self.learned, np.diff(self.bounds))]
        self.counts = np.bincount(used, minlength=len(self.words)).astype(np.int64)
        self.counts[self.end] += int(self.learned.sum())


def word_lists(blocks: DataFrame, ranges: int) -> DataFrame:
    """Per value range and block: the block's words there and their training counts."""

    def run(batches):
        for block in unpacked(batches):
            words = Words(block, ranges)
            starts = np.flatnonzero(np.append(True, words.part[1:] != words.part[:-1]))
            ends = np.append(starts[1:], len(words.part))
            rows = {"part": [], "sizes": [], "words": [], "counts": []}
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                data, bounds = buffer_of(words.words.slice(a, b - a))
                rows["part"].append(int(words.part[a]))
                rows["sizes"].append(squeeze(np.diff(bounds).astype(np.int32)))
                rows["words"].append(squeeze(data))
                rows["counts"].append(squeeze(words.counts[a:b]))
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["part"], pa.int64()), pa.array([block.number] * n, pa.int64()),
                    *(pa.array(rows[c], pa.binary()) for c in ("sizes", "words", "counts")),
                ],
                names=["part", "block", "sizes", "words", "counts"],
            )

    return blocks.mapInArrow(run, "part long, block long, sizes binary, words binary, counts binary")


ANSWERS = "block long, part long, counts binary, sizes binary, ids binary, n long, v long"


def word_answers(lists: DataFrame, ranges: int, path: str) -> DataFrame:
    """For every block and range: training counts and subword ids of its words. A row with
    block -1 per range holds its share of N and V and, for each subword, how often training
    words hold it, how many begin with it and how many of those were seen once."""

    def run(batches):
        for table in whole_groups(batches, ["part"]):
            part = table["part"].to_numpy()
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
            for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
                yield _answer(table.slice(a, b - a), path)

    dealt = lists.repartition(ranges, "part").sortWithinPartitions("part", "block")
    return dealt.mapInArrow(run, ANSWERS)


def _answer(table: pa.Table, path: str) -> pa.RecordBatch:
    sizes = [spread(x, np.int32) for x in table["sizes"].to_pylist()]
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    data = np.concatenate([spread(x, np.uint8) for x in table["words"].to_pylist()])
    listed = pa.Array.from_buffers(
        pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]
    ).dictionary_encode()
    code = listed.indices.to_numpy(zero_copy_only=False)
    counts = np.concatenate([spread(x, np.int64) for x in table["counts"].to_pylist()])
    total = np.bincount(code, counts, minlength=len(listed.dictionary)).astype(np.int64)
    words = listed.dictionary.to_pylist()
    own = word_ids(path)
    numbers = own.find([w if w != END else "" for w in words])
    n_ids = own.bounds[numbers + 1] - own.bounds[numbers]
    ids = own.ids[ragged(own.bounds[numbers], n_ids)]
    kinds, place = np.unique(ids, return_inverse=True)
    seen = np.bincount(place, np.repeat(total, n_ids), minlength=len(kinds)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n_ids)])
    begin, of = place[first[:-1][n_ids > 0]], total[n_ids > 0]
    starts = np.bincount(begin, of, minlength=len(kinds)).astype(np.int64)
    once = np.bincount(begin, of == 1, minlength=len(kinds)).astype(np.int64)
    rows = {"counts": [squeeze(np.concatenate([seen, starts, once]))], "sizes": [b""], "ids": [squeeze(kinds.astype(np.uint32))]}
    ends = np.cumsum([len(s) for s in sizes])
    for end, size in zip(ends.tolist(), map(len, sizes), strict=True):
        mine = code[end - size : end]
        rows["counts"].append(squeeze(total[mine]))
        rows["sizes"].append(squeeze(n_ids[mine].astype(np.int32)))
        rows["ids"].append(squeeze(ids[ragged(first[mine], n_ids[mine])].astype(np.uint16)
                                   if not len(ids) or ids.max() < 65536 else
                                   ids[ragged(first[mine], n_ids[mine])]))
    blocks = [-1, *table["block"].to_pylist()]
    none = [None] * (len(blocks) - 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(blocks, pa.int64()), pa.array([table["part"][0].as_py()] * len(blocks), pa.int64()),
            *(pa.array(rows[c], pa.binary()) for c in ("counts", "sizes", "ids")),
            pa.array([int(total.sum()), *none], pa.int64()),
            pa.array([int((total > 0).sum()), *none], pa.int64()),
        ],
        names=["block", "part", "counts", "sizes", "ids", "n", "v"],
    )


def subword_counts(answers: DataFrame) -> DataFrame:
    """id, n, starts, once over all training texts; at most a row for each id of the vocabulary."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids = spread(batch.column("ids")[k].as_py(), np.uint32)
                n = spread(batch.column("counts")[k].as_py(), np.int64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.astype(np.int64)), *(pa.array(x) for x in n)],
                    names=["id", "n", "starts", "once"],
                )

    found = answers.filter("block = -1").select("ids", "counts").mapInArrow(
        run, "id long, n long, starts long, once long"
    )
    return found.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("n", "starts", "once")))


@dataclass
class Units:
    """Ids of the vocabulary in few units: frequent ids alone, the others by whether they end
    a word and by frequency. Unit 0 is the end of a text."""

    unit: np.ndarray  # of every id
    share: np.ndarray  # ln P(id | its unit)
    starts: np.ndarray  # training words that begin with each unit
    spelled: np.ndarray  # ln of the Good-Turing mass of unseen words among them

    @classmethod
    def of(cls, counts: np.ndarray, starts: np.ndarray, once: np.ndarray, ends_word: np.ndarray) -> Units:
        alone = UNITS // 2
        order = np.argsort(-counts, kind="stable")
        unit = np.zeros(len(counts), np.int64)
        unit[order[: alone - 1]] = np.arange(1, alone)
        rest = order[alone - 1 :]
        half = (UNITS - alone) // 2
        for k, side in enumerate((rest[~ends_word[rest]], rest[ends_word[rest]])):
            mass = np.cumsum(counts[side] + 0.5)
            at = np.minimum((mass - 0.5) / max(mass[-1] if len(mass) else 1, 1) * half, half - 1)
            unit[side] = alone + k * half + at.astype(np.int64)
        seen = counts + 0.5
        share = np.log(seen / np.bincount(unit, seen, minlength=UNITS)[unit])
        begun = np.bincount(unit, starts, minlength=UNITS)
        unseen = (np.bincount(unit, once, minlength=UNITS) + 1) / (begun + 2)
        return cls(unit, share, begun, np.log(unseen))

    def listed(self, counts: np.ndarray, first_id: np.ndarray) -> np.ndarray:
        """ln P(a word | it begins with the unit of its first id) that its count alone gives."""
        unit = self.unit[first_id]
        with np.errstate(divide="ignore"):
            given = np.log(counts) - np.log(np.maximum(self.starts, 1))[unit]
        return given + np.log1p(-np.exp(self.spelled))[unit]


def unit_texts(ids: np.ndarray, bounds: np.ndarray, units: Units):
    """Units of all texts with unit 0 before and behind each, and their bounds."""
    limits = bounds + 2 * np.arange(len(bounds))
    out = np.zeros(int(limits[-1]), np.int64)
    out[id_places(bounds)] = units.unit[ids]
    return out, limits


def id_places(bounds: np.ndarray) -> np.ndarray:
    """Where the ids of all texts lie in ``unit_texts``."""
    return ragged(bounds[:-1] + 2 * np.arange(len(bounds) - 1) + 1, np.diff(bounds))


def _answered(block: Block, answers: pa.Table, ranges: int, units: Units):
    """Words of a block, their training counts, numbers of subwords, and subword ids."""
    words = Words(block, ranges)
    rows = answers.sort_by("part").to_pylist()
    counts = np.concatenate([spread(r["counts"], np.int64) for r in rows])
    n_ids = np.concatenate([spread(r["sizes"], np.int32) for r in rows]).astype(np.int64)
    wide = np.uint16 if len(units.unit) <= 65536 else np.uint32
    ids = np.concatenate([spread(r["ids"], wide) for r in rows]).astype(np.int64)
    if len(counts) != len(words.words):
        raise ValueError(f"block {block.number} lost answers")
    return words, counts, n_ids, ids


LEARNED = "place double, windows long, units binary, sizes binary"


def _learned_block(block: Block, answers: pa.Table, ranges: int, units: Units) -> list:
    """Units of the block's training texts, and its place among all blocks, from 0 to 1."""
    words, _, n_ids, ids = _answered(block, answers, ranges, units)
    chosen = words.learned
    if "chosen" in block.row:
        chosen = chosen & np.array(block.row["chosen"], bool)
    if not chosen.any():
        return []
    n_words = np.diff(words.bounds)
    codes = words.codes[np.repeat(chosen, n_words)]
    first = np.concatenate([[0], np.cumsum(n_ids)])
    ends = np.concatenate([[0], np.cumsum(n_ids[codes])])
    own = np.concatenate([[0], np.cumsum(n_words[chosen])])
    seq, limits = unit_texts(ids[ragged(first[codes], n_ids[codes])], ends[own], units)
    place = float(mix(np.array([block.number + 1], np.uint64))[0] >> np.uint64(11)) / (1 << 53)
    columns = [
        pa.array([place]), pa.array([len(input_windows(limits)[0])]),
        pa.array([squeeze(seq.astype(np.uint8))], pa.binary()),
        pa.array([squeeze(np.diff(limits))], pa.binary()),
    ]
    return [pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in LEARNED.split(", ")])]


def _shuffled(batches, end: float):
    """Blocks that are learned from together: units, bounds and the places where they begin and
    where the next ones do (``end`` for the last)."""
    held, n, begin = [], 0, 0.0

    def joined():
        sizes = np.concatenate([z for _, z in held])
        return np.concatenate([u for u, _ in held]).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])

    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if n >= SHUFFLED:
                yield *joined(), begin, row["place"]
                held, n = [], 0
            begin = begin if held else row["place"]
            held.append((spread(row["units"], np.uint8), spread(row["sizes"], np.int64)))
            n += len(held[-1][0])
    if held:
        yield *joined(), begin, end


def _added(rows) -> pa.RecordBatch | None:
    """One row for rows of (windows, windows x steps, windows x state)."""
    n, steps, flat = 0, 0.0, 0.0
    for row in rows:
        n, steps = n + row["n"], steps + row["steps"]
        flat = flat + np.frombuffer(row["flat"], np.float64)
    if not n:
        return None
    columns = [pa.array([n]), pa.array([steps]), pa.array([flat.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["n", "steps", "flat"])


def fit(learned: DataFrame, steps: int) -> tuple[Model, int]:
    """The model after every window of ``learned`` (see ``_learned_block``), and how many windows
    it learned from. Blocks come in the order of their places; the rate falls with the place."""
    n = learned.agg(F.sum("windows").alias("n")).first()["n"] or 0
    state, seen, alone = State.fresh(), 0, max(1, steps) * BATCH
    if not n:
        return Model(state.weights), 0
    passes = -(-alone // n)
    rounds = max(0, math.ceil(math.log2(n / (2 * alone))))
    edges = [0.0, *(0.5**k for k in range(rounds, -1, -1))]
    schema = "n long, steps double, flat binary"

    for low, high in zip(edges, edges[1:], strict=False):
        flat, before = state.flat(), state.steps

        def learn(batches, flat=flat, before=before, low=low, high=high):
            own, windows = State.of(flat, before), 0
            for units, bounds, begin, end in _shuffled(batches, high):
                number = len(input_windows(bounds)[0])
                if number == n:
                    begin = low
                start, each = own.steps, passes * -(-number // BATCH)

                def rate(k, start=start, each=each, begin=begin, end=end):
                    place = begin + (end - begin) * (k - start) / (each + 1)
                    return RATE * min(1.0, k / CLIMB) * (1 - place)

                own.learn(units, bounds, np.random.default_rng(int(begin * (1 << 53))), rate, passes)
                windows += number
            if windows:
                row = {"n": windows, "steps": own.steps * windows, "flat": (own.flat() * windows).tobytes()}
                yield _added([row])

        def add(batches):
            made = _added(row for batch in batches for row in batch.to_pylist())
            if made is not None:
                yield made

        some = learned.filter((F.col("place") >= low) & (F.col("place") < high))
        if not low:
            some = some.repartition(1)
        some = some.sortWithinPartitions("place").mapInArrow(learn, schema)
        if low:
            some = some.repartition(ADDERS).mapInArrow(add, schema)
        total = _added(r.asDict() for r in some.collect())  # at most ADDERS rows
        if total is not None:
            row = total.to_pylist()[0]
            state = State.of(np.frombuffer(row["flat"], np.float64) / row["n"], row["steps"] / row["n"])
            seen += row["n"]
    return Model(state.weights), seen


def _score_block(block: Block, answers: pa.Table, ranges: int, known, model, units) -> list:
    words, counts, n_ids, ids = _answered(block, answers, ranges, units)
    n, v = known
    each = np.log10((counts + 1) / (n + v + 1))
    base = sums(each[words.codes], words.bounds) + each[words.end]
    n_words = np.diff(words.bounds)
    is_known = (counts > 0).astype(np.int64)
    n_known = sums(is_known[words.codes], words.bounds) + is_known[words.end]
    first = np.concatenate([[0], np.cumsum(n_ids)])
    has_ids = n_ids > 0
    first_id = np.zeros(len(n_ids), np.int64)
    first_id[has_ids] = ids[first[:-1][has_ids]]
    listed, opening = units.listed(counts, first_id), units.spelled[units.unit[first_id]]
    score = np.zeros(len(block.ids))
    for a, b in _portions(words.bounds):
        codes = words.codes[words.bounds[a] : words.bounds[b]]
        flat = ids[ragged(first[codes], n_ids[codes])]
        ends = np.concatenate([[0], np.cumsum(n_ids[codes])])
        own = words.bounds[a : b + 1] - words.bounds[a]
        seq, limits = unit_texts(flat, ends[own], units)
        found = model.log_probabilities(seq, limits)
        each_id = found[id_places(ends[own])]
        real = has_ids[codes]
        head = np.zeros(len(codes))
        head[real] = each_id[ends[:-1][real]]
        rest = sums(each_id + units.share[flat], ends) - head  # of the word, after its first unit
        whole = head + np.logaddexp(rest + opening[codes], listed[codes])
        whole[~real] = -np.log(n + 1)  # a word without any subword
        score[a:b] = sums(whole, own) + found[limits[1:] - 1]
    columns = [
        pa.array(block.ids, pa.int64()), pa.array(words.held_out), pa.array(n_words + 1),
        pa.array(n_known), pa.array(np.full(len(n_words), n)), pa.array(base),
        pa.array(score / np.log(10)),
    ]
    return [pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])]


def _portions(bounds: np.ndarray, words: int = 1 << 18):
    """Spans of texts with about so many words each."""
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + words, "right")) - 1)
        yield a, b
        a = b


RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


def score_texts(
    docs: DataFrame, train_texts: int | None = None, steps: int = STEPS, path: str | None = None
) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text), learned from the rows whose crc32(doc_id)
    mod 7 is not 2.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased and one end. Returns doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram, log10) and score (log10
    probability of the text and its end). The attention model gives the unit that each word begins
    with; the rest of a word is mixed from its share among the training words that begin so and
    from its spelling by the attention model, which has the mass of words seen once. A null or empty
    text is only its end; a row without doc_id is neither learned from nor held out; rows that
    repeat are learned from and answered each; without training rows nothing is known and the
    model stays as it was drawn. Other columns are ignored; an empty table gives an empty result.

    The model learns from all training texts, in ``steps`` steps or as many more as that takes;
    ``train_texts`` is for trials: only the texts whose hashed id comes first, about so many.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    if train_texts is None:
        blocks = stored_blocks(docs)
    else:
        key, learns = F.xxhash64("doc_id"), F.coalesce(fold(FOLDS) != HELD_OUT, F.lit(False))
        first = docs.filter(learns).select(key.alias("k")).orderBy("k").limit(train_texts)
        last = first.agg(F.max("k").alias("k")).first()["k"]
        chosen = learns & (key <= F.lit(last)) if last is not None else F.lit(False)
        blocks = stored_blocks(docs.withColumn("chosen", chosen), carry=("chosen",))
    ranges = range_count(blocks, 0.2)
    answers = stage(word_answers(word_lists(blocks, ranges), ranges, path), "answers")
    known = answers.filter("block = -1").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = known["n"] or 0, known["v"] or 0
    own = word_ids(path)
    size = own.library.get_vocab_size()
    counts, starts, once = np.zeros((3, size))
    for row in subword_counts(answers).collect():  # a row for each id of the vocabulary at most
        counts[row["id"]], starts[row["id"]], once[row["id"]] = row["n"], row["starts"], row["once"]
    ends_word = np.zeros(size, bool)
    ends_word[[i for t, i in own.library.get_vocab().items() if t.endswith("</w>")]] = True
    units = Units.of(counts, starts, once, ends_word)
    answers = answers.filter("block >= 0")
    learned = with_answers(
        blocks, answers, lambda block, table: _learned_block(block, table, ranges, units), LEARNED
    )
    model, _ = fit(stage(learned, "learned"), steps)
    return with_answers(
        blocks, answers,
        lambda block, table: _score_block(block, table, ranges, (n, v), model, units), RESULT,
    )
