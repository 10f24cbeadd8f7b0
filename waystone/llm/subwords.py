"""Encoding and decoding with a SentencePiece byte-pair model, batched in numpy.

The model file at hand holds merge priorities, not unigram scores, so the Viterbi
transitions between neighbouring pieces are 0 where they would stay apart and minus
infinity where they would merge; the best path is then the library's own
encoding (see ``bpe``). Words of equal length advance together: substring hashes
probe the sorted piece keys and the maximum over piece lengths is the backpointer.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from .batches import ragged, slices, texts_of
from .bpe import MergeTable, Pieces, advance, symbols_by_length

SPACE = "▁"
MEMORY_WORDS = 400_000


def _numbers(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)


class PieceModel:
    """Pieces, merges and byte pieces of a model file, and a memory of encoded words."""

    def __init__(self, path: str):
        library = self.library = SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        texts = [library.id_to_piece(i) for i in range(size)]
        special = [
            library.is_byte(i) or library.is_control(i) or library.is_unknown(i)
            for i in range(size)
        ]
        if library.normalize(" a  \tb ") != " a  \tb ".replace(" ", SPACE).join([SPACE, ""]):
            raise ValueError("only models that keep the text as it is are supported")
        self.bytes = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        usual = {t: i for i, t in enumerate(texts) if not special[i]}
        if any(SPACE in t.lstrip(SPACE) or "\n" in t for t in usual):
            raise ValueError("only models whose pieces end at blanks are supported")
        by_score = sorted((i for i in usual.values()), key=lambda i: (-library.get_score(i), i))
        order = {i: k for k, i in enumerate(by_score)}
        pairs = []
        for text, i in usual.items():
            for k in range(1, len(text)):
                if text[:k] in usual and text[k:] in usual:
                    pairs.append((usual[text[:k]], usual[text[k:]], i, order[i]))
        halves, rank = np.full((size, 2), -1, np.int64), np.full(size, -1, np.int64)
        merged = {(a, b): (r, c) for a, b, c, r in pairs}
        for text, i in usual.items():
            if len(text) > 1:
                rank[i] = order[i]
                halves[i] = self._halves(text, i, usual, merged)
        broken = {i for i in usual.values() if rank[i] >= 0 and halves[i, 0] < 0}
        self.table = MergeTable(size, pairs, halves, np.where(halves[:, 0] < 0, -1, rank))
        good = self.table.own()
        kept = [(t, i) for t, i in usual.items() if good[i] and i not in broken]
        self.pieces = Pieces([_numbers(t) for t, _ in kept], np.array([i for _, i in kept]))
        raw = [t.encode() for t in texts]
        for b, i in enumerate(self.bytes.tolist()):
            raw[i] = bytes([b])
        for i in range(size):
            if library.is_control(i):
                raw[i] = b""
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.forget()

    @staticmethod
    def _halves(text, token, usual, merged):
        """The last merge when the piece's own text is encoded; (-1, -1) if it is not reached."""
        parts = [usual.get(c, -1) for c in text]
        while len(parts) > 2:
            best = min(
                ((merged.get((a, b), (1 << 60, -1)), k)
                 for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))),
                key=lambda x: (x[0][0], x[1]),
            )
            if best[0][1] < 0:
                return (-1, -1)
            parts[best[1] : best[1] + 2] = [best[0][1]]
        return parts if merged.get(tuple(parts), (0, -1))[1] == token else (-1, -1)

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.bounds, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def viterbi(self, words: list[str]) -> list[np.ndarray]:
        """Ids of every word, given with its leading mark."""
        out: list = [np.zeros(0, np.int32)] * len(words)
        raw = [w.encode("utf-32-le") for w in words]
        for places, symbols in symbols_by_length(raw, 4):
            last, back, count = advance(symbols, self.table, self.pieces)
            m, n = symbols.shape
            rows, at, step = np.arange(m), np.full(m, n), count[:, n].copy()
            ids = np.full((m, int(step.max())), -1, np.int64)
            starts = np.zeros_like(ids)
            while len(rows):  # back along the pointers, all words at once
                step[rows] -= 1
                ids[rows, step[rows]] = last[rows, at[rows]]
                at[rows] -= back[rows, at[rows]]
                starts[rows, step[rows]] = at[rows]
                rows = rows[at[rows] > 0]
            sizes = count[:, n]
            unknown = (ids == self.table.size).any(1)
            for k, place in enumerate(places.tolist()):
                row = ids[k, : sizes[k]]
                if unknown[k]:  # symbols without a piece become their bytes
                    word = words[place]
                    parts = [
                        self.bytes[np.frombuffer(word[s].encode(), np.uint8)] if i == self.table.size
                        else np.array([i])
                        for i, s in zip(row.tolist(), starts[k, : sizes[k]].tolist(), strict=True)
                    ]
                    row = np.concatenate(parts)
                out[place] = row
        return out

    def learn(self, fresh: list[str]) -> None:
        """Words without their leading mark; line ends have no piece, so they part a word."""
        cut = [
            None if w.startswith(" ") else [p for p in re.split("(\n)", SPACE + w) if p]
            for w in fresh
        ]
        parts = list({p for row in cut if row for p in row if p != "\n"})
        table = dict(zip(parts, self.viterbi(parts), strict=True))
        table["\n"] = self.bytes[[10]]
        rows = [
            # runs of blanks: all their merges tie, which the library settles
            np.array(self.library.encode(w)) if row is None
            else table[row[0]] if len(row) == 1 else np.concatenate([table[p] for p in row])
            for w, row in zip(fresh, cut, strict=True)
        ]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(lengths))
        self.ids = np.concatenate([self.ids, *rows]).astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and their bounds by text."""
        runs = pc.or_(
            pc.match_substring(texts, "  "),
            pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")),
        )
        lists = pc.split_pattern(texts, " ")
        if pc.any(runs).as_py():
            odd = runs.to_pylist()
            lists = pa.array(
                [
                    [w[1:] for w in re.findall(" +[^ ]*", " " + t)] if o else t.split(" ")
                    for t, o in zip(texts.to_pylist(), odd, strict=True)
                ],
                pa.list_(pa.string()),
            )
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        fresh = [w for w in words if w not in self.place]
        if len(self.place) + len(fresh) > MEMORY_WORDS:
            self.forget()
            fresh = words
        if fresh:
            self.learn(fresh)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        numbers = np.fromiter((self.place[w] for w in words), np.int64, len(words))[codes]
        lengths = self.bounds[numbers + 1] - self.bounds[numbers]
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        lengths = np.where(empty[row], 0, lengths)  # no text, no leading mark
        ids = self.ids[ragged(self.bounds[numbers], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[bounds - bounds[0]]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of all id sequences."""
        lengths = self.raw_bounds[ids + 1] - self.raw_bounds[ids]
        data = self.raw[ragged(self.raw_bounds[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[bounds]
        texts = [
            data[a:b].decode("utf-8", "replace").replace(SPACE, " ")
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
        ]
        return [t[1:] if t.startswith(" ") else t for t in texts]


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_subwords(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``ids`` of every row of ``docs`` (doc_id, text).

    A null or empty text has no ids, a null doc_id stays null, repeated rows are each
    encoded, other columns are ignored, an empty table gives an empty result.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        for batch in slices(batches):
            ids, bounds = model(path).encode(texts_of(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "ids"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_subwords(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``text`` of every row of ``encoded`` (doc_id, ids); null ids: empty.

    A mark that the text itself holds comes back as a blank, as in the library.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        for batch in batches:
            lists = pc.fill_null(batch.column("ids"), pa.scalar([], pa.list_(pa.int32())))
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            texts = model(path).decode(lists.flatten().to_numpy().astype(np.int64), bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())],
                names=["doc_id", "text"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def subword_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, decode again and describe both: doc_id, n_tokens, ids_crc32 (little-endian
    unsigned 32-bit ids), decoded_sha256, round_trip."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        for batch in slices(batches):
            texts = texts_of(batch.column("text"))
            ids, bounds = model(path).encode(texts)
            decoded = model(path).decode(ids.astype(np.int64), bounds)
            view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(bounds)),
                    pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in spans], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                    pc.equal(pa.array(decoded, pa.string()), texts),
                ],
                names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
