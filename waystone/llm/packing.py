"""Best-fit packing planned on a histogram of lengths.

Only the number of pieces of each length reaches the driver (at most ``capacity``
rows). Best-fit-decreasing runs over these counts: whole groups of equal sequences
take items at once. The plan says, for ranks i..j within a length, which
sequences and offsets they get; pieces join it on their length and rank.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stage import stage
from .batches import REMEMBERED, coded_words, frugal, ragged, slices, texts_of
from .bpe import EASY, EASY_PIECE, byte_letters

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

#: Bytes of words a worker remembers between batches; beyond it the memory starts afresh.
MEMORY_BYTES = 64 << 20
#: What a remembered word takes besides its letters.
WORD_BYTES = 150
#: Parts of words that are remembered besides.
MEMORY_PARTS = 50_000
#: UTF-8 bytes of text that are encoded at a time.
ENCODE_BYTES = 4 << 20
#: Pieces of one length that are ranked together.
RANK_GROUP = 256


class WordIds:
    """Library ids of distinct words; no token of the vocabulary crosses a blank.

    A word of plain letters is cut by the vocabulary's split rule and its pieces go to
    the library's model; any other word takes the library's whole way.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = {b: c for c, b in byte_letters().items()}
        self.tokenize = self.library.model.tokenize
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.bounds, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.held = 0
        self.pieces: dict[str, list[int]] = {}

    def ids_of(self, text: str) -> list[int]:
        plain = text if text.isascii() and text.isprintable() else "".join(
            self.letters[b] for b in text.encode()
        )
        return [t.id for t in self.tokenize(plain)]

    def piece(self, text: str) -> list[int]:
        """Ids of a part of a word; other words may have it too."""
        found = self.pieces.get(text)
        if found is None:
            if len(self.pieces) >= MEMORY_PARTS:
                self.pieces.clear()
            found = self.pieces[text] = self.ids_of(text)
        return found

    def learn(self, fresh: list[str]) -> None:
        rows: list = [None] * len(fresh)
        other = []
        for k, word in enumerate(fresh):
            special = "<|" in word and any(s in word for s in self.special)
            if special or not EASY.fullmatch(word):
                other.append(k)
                continue
            parts = EASY_PIECE.findall(word.lower())
            rows[k] = self.ids_of(parts[0]) if len(parts) == 1 else [
                i for p in parts for i in self.piece(p)
            ]
        found = self.library.encode_batch_fast(
            [fresh[k] for k in other], add_special_tokens=False
        )
        for k, one in zip(other, found, strict=True):
            rows[k] = one.ids
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter(chain.from_iterable(rows), np.uint32, int(lengths.sum()))
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(lengths))
        self.ids = np.concatenate([self.ids, flat])

    def find(self, words: list[str]) -> np.ndarray:
        numbers = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        new = numbers < 0
        fresh = [words[k] for k in np.flatnonzero(new).tolist()]
        size = sum(map(len, fresh)) + WORD_BYTES * len(fresh)
        if self.held and self.held + size > MEMORY_BYTES:
            self.forget()
            fresh, new = words, np.ones(len(words), bool)
            size = sum(map(len, fresh)) + WORD_BYTES * len(fresh)
        if fresh:
            numbers[new] = len(self.place) + np.arange(len(fresh))
            self.learn(fresh)
            self.held += size
        return numbers


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


REMEMBERED[__name__] = word_ids.cache_clear


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and their bounds by text."""
    own = word_ids(path)
    marked = pc.any(pc.match_substring(texts, "<|")).as_py()
    bounds, codes, distinct = coded_words(texts if marked else pc.ascii_lower(texts))
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    numbers = own.find(distinct.to_pylist())[codes]
    lengths = own.bounds[numbers + 1] - own.bounds[numbers]
    ids = own.ids[ragged(own.bounds[numbers], lengths)]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return ids, ends[bounds]


def token_pieces(docs: DataFrame, capacity: int, end_id: int, path: str) -> DataFrame:
    """Pieces of at most ``capacity`` ids; every text ends in ``end_id``."""

    @frugal
    def run(batches):
        for batch in slices(batches, limit=ENCODE_BYTES):
            ids, bounds = encode(texts_of(batch.column("text")), path)
            sizes = np.diff(bounds) + 1
            ends = np.cumsum(sizes)
            flat = np.full(int(ends[-1]), end_id, "<u4")
            flat[ragged(ends - sizes, sizes - 1)] = ids
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = ragged(np.zeros(len(sizes), np.int64), pieces)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            at = (ends - sizes)[row] + start
            view = memoryview(flat).cast("B")
            crc = [
                zlib.crc32(view[4 * a : 4 * (a + n)])
                for a, n in zip(at.tolist(), length.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()).take(pa.array(row)),
                    pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit-decreasing over counts.

    Returns (length, first rank, first sequence, items per sequence, offset): the
    items of a length from that rank on fill consecutive sequences.
    """
    space: dict[int, list[list[int]]] = {}  # room left -> [first sequence, number of sequences]
    rooms = np.zeros(capacity + 1, np.int64)  # sequences by room left
    plan, made = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            found = np.flatnonzero(rooms[length:])
            room = int(found[0]) + length if len(found) else capacity
            each = room // length  # best fit keeps filling the fullest sequence
            if not len(found):
                space.setdefault(room, []).append([made, -(-left // each)])
                rooms[room] += -(-left // each)
                made += -(-left // each)
            group = space[room][-1]
            used = min(group[1], -(-left // each))
            plan.append((length, rank, group[0], each, capacity - room))
            full = min(used, left // each)
            rest = left - full * each if used > full else 0
            for first, number, items in ((group[0], full, each), (group[0] + full, 1, rest)):
                if number and items and room - items * length:
                    space.setdefault(room - items * length, []).append([first, number])
                    rooms[room - items * length] += number
            rooms[room] -= used
            group[0], group[1] = group[0] + used, group[1] - used
            if not group[1]:
                space[room].remove(group)
            rank, left = rank + full * each + rest, left - full * each - rest
    return plan


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Rank 0, 1, ... within each length. A frequent length is ranked in groups of bounded
    size, whose starts come from their counts."""
    spark = pieces.sparkSession
    groups = spark.createDataFrame(
        [(n, -(-c // RANK_GROUP)) for n, c in counts.items()] or [(0, 1)], "length long, n_groups long"
    )
    salted = pieces.join(F.broadcast(groups), "length").withColumn(
        "_group", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("n_groups"))
    )
    before = Window.partitionBy("length").orderBy("_group")
    starts = salted.groupBy("length", "_group").agg(F.count("*").alias("_n")).select(
        "length", "_group", (F.sum("_n").over(before) - F.col("_n")).alias("_first")
    )
    within = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("_rank", F.row_number().over(within) - 1)
    out = numbered.join(starts, ["length", "_group"])
    return out.withColumn("_rank", F.col("_rank") + F.col("_first")).drop("_group", "_first", "n_groups")


def best_fit_pack(
    docs: DataFrame, capacity: int = 4096, end_id: int = 1, path: str | None = None
) -> DataFrame:
    """Pack all texts of ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text is one piece holding only ``end_id``; a null doc_id stays null;
    repeated rows are packed as often as they occur; other columns are ignored; an empty
    table gives an empty result. Only texts longer than ``capacity`` are cut.
    Ties in the ranking (equal rows) may take either slot.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    pieces = stage(token_pieces(docs, capacity, end_id, path), "pieces")
    counted = pieces.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in counted.collect()}  # at most ``capacity`` rows
    plan = plan_slots(counts, capacity)
    by_length: dict[int, list] = {}
    for row in plan:
        by_length.setdefault(row[0], []).append(row[1:])
    slots = docs.sparkSession.createDataFrame(
        [(n, *map(list, zip(*rows, strict=True))) for n, rows in by_length.items()],
        "length long, _ranks array<long>, _sequences array<long>, _each array<long>, _at array<long>",
    )
    # the plan has a row per length, so its size is bounded by the capacity
    joined = ranked(pieces, counts).join(F.broadcast(slots), "length")
    part = F.expr("size(filter(_ranks, x -> x <= _rank)) - 1")
    joined = joined.withColumn("_part", part)
    into = F.col("_rank") - F.col("_ranks")[F.col("_part")]
    each = F.col("_each")[F.col("_part")]
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_sequences")[F.col("_part")] + F.floor(into / each)).alias("sequence_id"),
        (F.col("_at")[F.col("_part")] + F.pmod(into, each) * F.col("length")).alias("offset"),
    )
