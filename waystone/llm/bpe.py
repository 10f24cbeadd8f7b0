"""Byte-pair encoding as a dynamic program over prefixes, for many words at a time.

A token sequence is the encoding of its text exactly if each token encodes to
itself and no two neighbours would merge across their border. So the encoding
of a prefix is the encoding of a shorter prefix plus one token that fits its last
one, and exactly one token fits: a Viterbi search whose transitions are 0 or
minus infinity. Words of equal length advance together.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .batches import mix

BASE = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.int64(1) << 40
MEMO_BITS = 20

# The split rule of the vocabulary file for words of these letters,
# which no normal form changes.
EASY = re.compile(r"[\x00-\x7FÀ-ÖØ-öø-ÿ]*")  # letters that no normal form changes
EASY_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _hash_rows(symbols: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(symbols), np.uint64)
    with np.errstate(over="ignore"):
        for k, row in enumerate(symbols):
            h = np.uint64(0)
            for s in row:
                h = h * BASE + np.uint64(int(s) + 1)
            out[k] = h
    return out


class Pieces:
    """Sorted keys of token texts, behind a bitmap that settles most misses."""

    def __init__(self, symbols: list[np.ndarray], ids: np.ndarray):
        keys = _hash_rows(symbols)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.asarray(ids, np.int64)[order]
        if len(self.keys) > 1 and (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two tokens share a hash")
        self.seen = np.zeros(1 << 20, bool)
        self.seen[mix(self.keys) >> np.uint64(44)] = True
        self.longest = max((len(s) for s in symbols), default=0)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Token of each hash, -1 for none."""
        flat = hashes.ravel()
        out = np.full(len(flat), -1, np.int64)
        maybe = np.flatnonzero(self.seen[mix(flat) >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.keys, flat[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == flat[maybe]
        out[maybe[hit]] = self.ids[at[hit]]
        return out.reshape(hashes.shape)


class MergeTable:
    """Merges of a vocabulary: which two tokens join, into what, and how early.

    ``pairs``: (left, right, result, rank); ``halves``: the last merge of each token's
    own encoding, or (-1, -1) for a single symbol. Token number ``size`` stands
    for a symbol outside the vocabulary.
    """

    def __init__(self, size: int, pairs, halves: np.ndarray, rank: np.ndarray):
        left, right, _, order = (np.asarray(x, np.int64) for x in zip(*pairs, strict=True))
        keys = left * (size + 1) + right
        by = np.argsort(keys)
        self.size, self.keys, self.order = size, keys[by], order[by]
        self.left = np.append(halves[:, 0], -1)
        self.right = np.append(halves[:, 1], -1)
        self.rank = np.append(rank, -1)
        self.memo_key = np.full(1 << MEMO_BITS, -1, np.int64)
        self.memo = np.zeros(1 << MEMO_BITS, bool)

    def joins_at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * (self.size + 1) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether encoding the joint text of two tokens leaves them as they are.

        Merges are undone from the latest back: whenever the tokens at the border
        could have joined before the later of them was formed, they would have.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), NEVER) if until is None else until
        while len(live):
            crossed = self.joins_at(a, b) < limit
            ok[live[crossed]] = False
            late = self.rank[a] > self.rank[b]
            on = ~crossed & (late | (self.rank[b] >= 0))
            limit = np.where(late, self.rank[a], self.rank[b] + 1)
            a, b = np.where(late, self.right[a], a), np.where(late, b, self.left[b])
            live, a, b, limit = live[on], a[on], b[on], limit[on]
        return ok

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``apart`` with a memory of pairs met before."""
        key = a * (self.size + 1) + b
        slot = mix(key.astype(np.uint64)) >> np.uint64(64 - MEMO_BITS)
        out = self.memo[slot]
        new = np.flatnonzero(self.memo_key[slot] != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            found = self.apart(fresh // (self.size + 1), fresh % (self.size + 1))
            out[new] = found[back]
            slots = mix(fresh.astype(np.uint64)) >> np.uint64(64 - MEMO_BITS)
            # one write for each slot, so that key and answer belong together
            _, first = np.unique(slots, return_index=True)
            self.memo_key[slots[first]], self.memo[slots[first]] = fresh[first], found[first]
        return out

    def own(self) -> np.ndarray:
        """Tokens whose own text encodes to themselves."""
        made = np.flatnonzero(self.rank[: self.size] >= 0)
        made = made[np.argsort(self.rank[made], kind="stable")]
        free = self.apart(self.left[made], self.right[made], self.rank[made])
        good = np.ones(self.size + 1, bool)
        for token, alone in zip(made.tolist(), free.tolist(), strict=True):
            good[token] = alone and good[self.left[token]] and good[self.right[token]]
        return good


def advance(symbols: np.ndarray, table: MergeTable, inner: Pieces, ending: Pieces | None = None):
    """Encodings of all prefixes of equally long words.

    ``symbols``: one word per row. Returns for prefix lengths 0..n the last token, the length
    it covers and the number of tokens; with ``ending``, the last token must be
    one of these and the first three stay the open forms that it continues.
    """
    m, n = symbols.shape
    longest = max(inner.longest, ending.longest if ending else 0)
    rows = np.arange(m)
    hashes = np.zeros((m, n + 1), np.uint64)
    power = np.ones(longest + 1, np.uint64)
    np.cumprod(np.full(longest, BASE), out=power[1:])
    for j in range(n):
        hashes[:, j + 1] = hashes[:, j] * BASE + (symbols[:, j].astype(np.uint64) + np.uint64(1))
    last = np.full((m, n + 1), -1, np.int64)
    back = np.zeros((m, n + 1), np.int32)
    count = np.zeros((m, n + 1), np.int32)
    closed = np.zeros((m, n + 1), np.int32)
    shut = np.full((m, n + 1), -1, np.int64)
    shut_back = np.zeros((m, n + 1), np.int32)
    for j in range(1, n + 1):
        low = max(0, j - longest)
        spans = hashes[:, j : j + 1] - hashes[:, low:j] * power[j - low : 0 : -1]
        for pieces, open_form in ((inner, True), (ending, False)):
            if pieces is None:
                continue
            token = pieces.find(spans)
            if open_form and ending is None:
                token[:, -1] = np.where(token[:, -1] < 0, table.size, token[:, -1])
            r, c = np.nonzero(token >= 0)
            before, this = last[r, low + c], token[r, c]
            good = np.ones(len(r), bool)
            inside = np.flatnonzero(low + c > 0)
            good[inside] = table.fits(before[inside], this[inside])
            score = np.zeros(token.shape, np.int8)
            score[r, c] = good
            best = score.argmax(1)
            if not score[rows, best].all():
                raise ValueError("a prefix has no encoding under this vocabulary")
            if open_form:
                last[:, j], back[:, j] = token[rows, best], j - low - best
                count[:, j] = count[rows, low + best] + 1
            else:
                shut[:, j], shut_back[:, j] = token[rows, best], j - low - best
                closed[:, j] = count[rows, low + best] + 1
    if ending is None:
        return last, back, count
    return shut, shut_back, closed


def symbols_by_length(words: list[bytes], width: int = 1, cells: int = 1 << 20):
    """Groups of equally long words: their places in the list and a matrix of symbols."""
    kind = np.uint8 if width == 1 else np.dtype("<u4")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) // width
    order = np.argsort(lengths, kind="stable")
    bounds = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, bounds) if len(order) else []:
        n = int(lengths[group[0]])
        step = max(1, cells // max(n, 1))
        for k in range(0, len(group), step):
            part = group[k : k + step]
            if n:
                data = b"".join([words[i] for i in part.tolist()])
                yield part, np.frombuffer(data, kind).reshape(len(part), n)


def byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordBpe:
    """A ``tokenizers`` vocabulary with word ends: token counts of all prefixes of a piece."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.mark = model["end_of_word_suffix"]
        vocab, merges = model["vocab"], [tuple(x) for x in model["merges"]]
        size = max(vocab.values()) + 1
        halves, rank = np.full((size, 2), -1, np.int64), np.full(size, -1, np.int64)
        pairs = []
        for order, (a, b) in enumerate(merges):
            token = vocab[a + b]
            pairs.append((vocab[a], vocab[b], token, order))
            if rank[token] < 0:
                halves[token], rank[token] = (vocab[a], vocab[b]), order
        self.table = MergeTable(size, pairs, halves, rank)
        good, letters = self.table.own(), byte_letters()
        inner, ending = ([], []), ([], [])
        for text, token in vocab.items():
            ends = text.endswith(self.mark)
            body = text[: -len(self.mark)] if ends else text
            if good[token] and body and all(c in letters for c in body):
                side = ending if ends else inner
                side[0].append(np.array([letters[c] for c in body]))
                side[1].append(token)
        self.inner, self.ending = Pieces(*inner), Pieces(*ending)

    def prefix_counts(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Tokens of every byte prefix (1..n) of each piece, taken as a whole piece."""
        out: list = [np.zeros(0, np.int32)] * len(pieces)
        for places, symbols in symbols_by_length(pieces):
            counts = advance(symbols, self.table, self.inner, self.ending)[2]
            for place, row in zip(places.tolist(), counts[:, 1:], strict=True):
                out[place] = row
        return out
