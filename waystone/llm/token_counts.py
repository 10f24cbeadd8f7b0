"""Token counts of texts and of all their prefixes, without encoding a text twice.

A prefix dynamic program (``bpe.advance``) gives, for each distinct word, the token
count of each of its prefixes. A text is a run of words between ASCII blanks,
which no token crosses, so the count at any prefix of the text is the sum over the
whole words before it plus one entry of the table of its last, cut word. Truncation
and budget questions are looked up there.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .batches import byte_lengths, coded_words, slices, sums, texts_of
from .bpe import EASY, EASY_PIECE, WordBpe

# Pieces whose two-letter prefix splits otherwise.
SPLIT_SHORT_FORMS = {"'re", "'ve", "'ll"}

#: Words a worker remembers between batches; beyond it the memory starts afresh.
MEMORY_WORDS = 600_000


class PrefixCounter:
    """Exact token counts at every code point prefix of a word."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.bpe = WordBpe(path)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}  # number of a word; its counts lie between two bounds
        self.bounds, self.counts = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def slow(self, word: str) -> np.ndarray:
        """Words that the split rule or normal forms tie together: by the library itself."""
        prefixes = [word[: k + 1] for k in range(len(word))]
        found = self.library.encode_batch(prefixes, add_special_tokens=False)
        return np.array([len(e.ids) for e in found], np.int32)

    def hard(self, word: str) -> list[tuple[str, int]] | None:
        """Normalised pieces with the code points of the word they cover; None: ask the library."""
        low = self.library.normalizer.normalize_str(word)
        if len(low) != len(word) or any(len(c.lower()) != 1 for c in word):
            return None
        if [self.library.normalizer.normalize_str(c) for c in word] != list(low):
            return None
        out, at = [], 0
        for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(low):
            out += [("", a - at)] if a > at else []  # white space beyond ASCII: no token
            out.append((low[a:b], b - a))
            at = b
        return out + ([("", len(low) - at)] if len(low) > at else [])

    def tables(self, texts: set[str]) -> dict[str, np.ndarray]:
        """Counts at the code point prefixes of every piece."""
        texts = texts | {"'"} | {p[1] for p in texts & SPLIT_SHORT_FORMS}
        listed = list(texts)
        raw = [p.encode() for p in listed]
        table = {}
        for piece, data, counts in zip(listed, raw, self.bpe.prefix_counts(raw), strict=True):
            if len(piece) != len(data):  # keep the byte prefixes that end a code point
                here = np.frombuffer(data, np.uint8)
                ends = np.append(np.flatnonzero((here & 0xC0) != 0x80)[1:], len(here)) - 1
                counts = counts[ends]
            table[piece] = counts
        for piece in texts & SPLIT_SHORT_FORMS:  # "'r" is two pieces, "'re" is one
            table[piece] = table[piece].copy()
            table[piece][1] = table["'"][0] + table[piece[1]][0]
        return table

    def learn(self, fresh: list[str]) -> None:
        cut: list = []
        texts: set[str] = set()
        for word in fresh:
            if "<|" in word and any(s in word for s in self.special):
                parts = None
            elif EASY.fullmatch(word):
                parts = EASY_PIECE.findall(word.lower())
                texts.update(parts)
            elif parts := self.hard(word):
                texts.update(p for p, _ in parts if p)
            cut.append(parts)
        table = self.tables(texts)
        rows = []
        for word, parts in zip(fresh, cut, strict=True):
            if parts is None:
                rows.append(self.slow(word))
            elif len(parts) == 1 and isinstance(parts[0], str):
                rows.append(table[parts[0]])
            else:
                total, own = 0, []
                for part in parts:
                    piece, n = part if isinstance(part, tuple) else (part, 0)
                    row = table[piece] + total if piece else np.full(n, total, np.int32)
                    own.append(row)
                    total = int(row[-1])
                rows.append(np.concatenate(own))
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(lengths))
        self.counts = np.concatenate([self.counts, *rows])

    def find(self, words: list[str]) -> np.ndarray:
        """Numbers of the words; their tables are ``row(number)``."""
        fresh = [w for w in words if w not in self.place]
        if len(self.place) + len(fresh) > MEMORY_WORDS:
            self.forget()
            fresh = words
        if fresh:
            self.learn(fresh)
        return np.fromiter((self.place[w] for w in words), np.int64, len(words))

    def totals(self, numbers: np.ndarray) -> np.ndarray:
        return self.counts[self.bounds[numbers + 1] - 1].astype(np.int64)

    def row(self, number: int) -> np.ndarray:
        return self.counts[self.bounds[number] : self.bounds[number + 1]]


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_batch(texts: pa.Array, budget: int, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and code points of its longest prefix of at most ``budget`` tokens."""
    own = counter(path)
    marked = pc.any(pc.match_substring(texts, "<|")).as_py()
    bounds, codes, distinct = coded_words(texts if marked else pc.ascii_lower(texts))
    numbers = own.find(distinct.to_pylist())
    each = own.totals(numbers)[codes] if len(codes) else np.zeros(0, np.int64)
    totals = sums(each, bounds)
    fit = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    for k in np.flatnonzero(totals > budget).tolist():
        ends = np.cumsum(each[bounds[k] : bounds[k + 1]])
        at = int(np.searchsorted(ends, budget, "right"))  # the first word that is cut
        left = budget - (int(ends[at - 1]) if at else 0)
        within = np.flatnonzero(own.row(numbers[codes[bounds[k] + at]]) <= left)
        inside = int(within[-1]) + 1 if len(within) else 0
        fit[k] = _word_start(texts[k].as_py(), at) + inside
    return totals, fit


def _word_start(text: str, index: int) -> int:
    for k, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if k == index:
            return m.start()
    return len(text)


def prefix_table(text: str, path: str | None = None) -> np.ndarray:
    """Token counts of the prefixes of one text, by code points 0..n."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    out = np.zeros(len(text) + 1, np.int64)
    total = 0
    at = 0
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        out[at : m.start() + 1] = total
        own = counter(path)
        row = own.row(own.find([m.group()])[0])
        out[m.start() + 1 : m.end() + 1] = total + row
        total += int(row[-1])
        at = m.end()
    out[at:] = total
    return out


def token_counts(
    docs: DataFrame, budget: int = 2048, path: str | None = None
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_bytes, n_tokens, over_limit, fit_chars.

    ``fit_chars`` is the longest prefix, in code points, of at most ``budget`` tokens. A null or
    empty text has no tokens; a null doc_id stays null; repeated rows are each
    answered; other columns are ignored; an empty table gives an empty result.
    A very long text needs memory in proportion to itself only.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        for batch in slices(batches):
            texts = texts_of(batch.column("text"))
            totals, fit = count_batch(texts, budget, path)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), pa.array(byte_lengths(texts)),
                    pa.array(totals), pa.array(totals > budget), pa.array(fit),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
