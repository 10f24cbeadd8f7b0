"""Removing passages that a document with a smaller id has too, byte by byte.

A byte goes if it lies in a 50-byte string that also starts in a document with a smaller id.

1. Anchors. Of the 24-byte grams of a 50-byte window the one with the smallest hash
   is its anchor; equal windows have equal anchors. Anchors that are in one document only
   rule out their windows, so that only the rest is sorted.
2. Shards. A stretch of windows with one anchor is a piece; pieces go to the shard of their
   anchor, so equal windows meet. Equal pieces of a block go once, with the smallest
   id. Windows of an anchor in very many documents go by their own hash instead,
   so such an anchor is no hot spot.
3. Windows that are in one place of a shard only, by their hash, are ruled out without loss. Each
   shard sorts the suffixes of the rest (``induced``: external induced sorting with common
   prefixes in disk-backed queues); neighbours that share 50 bytes form a class, whose smallest
   id goes back to the blocks.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import stage
from .batches import MIX_A, MIX_B, buffer_of, frugal, mix, ragged, whole_groups
from .blocks import Block, arrow_schema, range_count, spread, squeeze, stored_blocks, unpacked, with_answers
from .induced import suffixes

WINDOW = 50
GRAM = 24
#: Documents from which on an anchor's windows are dealt by their own hash.
HOT = 1000
#: Windows of a piece; longer stretches are cut.
PIECE = 2048
NONE = np.iinfo(np.int64).max


def byte_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` (8 or more) bytes from every place on."""
    word = data.astype(np.uint64)
    for step in (1, 2, 4):
        word = word[:-step] | word[step:] << np.uint64(8 * step)
    n = len(data) - width + 1
    out = np.zeros(n, np.uint64)
    for at in [*range(0, width - 8, 8), width - 8]:
        out += word[at : at + n]
        out *= MIX_B
        out ^= out >> np.uint64(29)
    return mix(out)


class Stretches:
    """Runs of windows with one anchor within one document of a block."""

    def __init__(self, block: Block):
        n = len(block.data)
        count = np.maximum(block.sizes - WINDOW + 1, 0)
        self.doc = self.start = self.size = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if n < WINDOW or not count.any():
            return
        least = byte_hashes(block.data, GRAM)
        span = 1
        width = WINDOW - GRAM + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: span - width], least[width - span :])
        # windows that stay within a document
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        doc_starts = block.bounds[:-1][count > 0]
        new[doc_starts] = True
        tails = (block.bounds[1:] - WINDOW + 1)[count > 0]  # first place that is no window
        new[tails[tails < len(least)]] = True
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(least)))
        doc = np.searchsorted(block.bounds, start, "right") - 1
        real = start + WINDOW <= block.bounds[doc + 1]
        self.start, self.size, self.doc = start[real], size[real], doc[real]
        self.anchor = mix(least[self.start] + MIX_A)

    def tags(self, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """Value range and 32-bit tag of every anchor."""
        into = (self.anchor >> np.uint64(34)) % np.uint64(ranges)
        return into.astype(np.int64), (self.anchor & np.uint64(0xFFFFFFFF)).astype(np.int64)


def listed_tags(runs: Stretches, ranges: int):
    """Distinct (range, tag) of a block in order, and each stretch's place among them."""
    into, tag = runs.tags(ranges)
    return np.unique((into << 32) | tag, return_inverse=True)


def byte_planes(rising: np.ndarray) -> np.ndarray:
    """Steps between sorted numbers, byte by byte, so that their empty high bytes lie together."""
    steps = np.diff(rising, prepend=np.uint32(0)).astype("<u4")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T)


def from_planes(planes: np.ndarray) -> np.ndarray:
    steps = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def anchor_lists(blocks: DataFrame, ranges: int) -> DataFrame:
    """Per value range and block: its tags, and in how many of the block's documents each is."""

    @frugal
    def run(batches):
        for block in unpacked(batches):
            runs = Stretches(block)
            values, place = listed_tags(runs, ranges)
            if not len(values):
                continue
            once = np.unique(place * (len(block.sizes) + 1) + runs.doc) // (len(block.sizes) + 1)
            docs = np.minimum(np.bincount(once, minlength=len(values)), 255).astype(np.uint8)
            into = values >> 32
            starts = np.flatnonzero(np.append(True, into[1:] != into[:-1]))
            ends = np.append(starts[1:], len(values))
            tags = (values & 0xFFFFFFFF).astype("<u4")
            spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(into[starts]), pa.array([block.number] * len(spans), pa.int64()),
                    pa.array([squeeze(byte_planes(tags[a:b])) for a, b in spans], pa.binary()),
                    pa.array([squeeze(docs[a:b]) for a, b in spans], pa.binary()),
                ],
                names=["part", "block", "tags", "docs"],
            )

    return blocks.mapInArrow(run, "part long, block long, tags binary, docs binary")


def anchor_answers(lists: DataFrame, ranges: int) -> DataFrame:
    """Per value range and block, for each tag: 0 in one document, 1 in more, 2 in very many."""

    @frugal
    def run(batches):
        for table in whole_groups(batches, ["part"]):
            part = table["part"].to_numpy()
            for a, b in _spans(part):
                tags = [from_planes(spread(x, np.uint8)) for x in table["tags"][a:b].to_pylist()]
                docs = np.concatenate(
                    [spread(x, np.uint8) for x in table["docs"][a:b].to_pylist()]
                )
                sizes = [len(t) for t in tags]
                _, place = np.unique(np.concatenate(tags), return_inverse=True)
                total = np.bincount(place, docs)[place]
                flag = (total > 1).astype(np.uint8) + (total >= HOT)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        table["block"][a:b].combine_chunks(), table["part"][a:b].combine_chunks(),
                        pa.array([squeeze(flag[e - n : e]) for e, n in zip(ends, sizes, strict=True)]),
                    ],
                    names=["block", "part", "a"],
                )

    dealt = lists.repartition(ranges, "part").sortWithinPartitions("part", "block")
    return dealt.mapInArrow(run, "block long, part long, a binary")


def _spans(keys: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist()
    return list(zip(starts, [*starts[1:], len(keys)], strict=True))


def same_windows(data: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For every window: the number of the first equal one; bytes decide, not hashes."""
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    found = first[back]
    word = data.astype(np.uint64)
    for step in (1, 2, 4):
        word = word[:-step] | word[step:] << np.uint64(8 * step)
    equal = np.ones(len(at), bool)
    for k in [*range(0, WINDOW - 8, 8), WINDOW - 8]:
        equal &= word[at + k] == word[at[found] + k]
    return np.where(equal, found, np.arange(len(at)))


class Pieces:
    """What of a block is to be sorted: stretches, each with its shard."""

    def __init__(self, block: Block, answers: pa.Table, ranges: int, shards: int):
        runs = Stretches(block)
        values, place = listed_tags(runs, ranges)
        order = np.argsort(answers["part"].to_numpy(), kind="stable")
        parts = answers["a"].take(pa.array(order)).to_pylist()
        flags = np.concatenate([spread(p, np.uint8) for p in parts]) if parts else np.zeros(0, np.uint8)
        if len(flags) != len(values):
            raise ValueError(f"block {block.number} lost answers")
        flag = flags[place]
        warm = np.flatnonzero(flag == 1)
        cuts = -(-runs.size[warm] // PIECE)
        index = ragged(np.zeros(len(warm), np.int64), cuts)
        start = np.repeat(runs.start[warm], cuts) + index * PIECE
        size = np.minimum(np.repeat(runs.size[warm], cuts) - index * PIECE, PIECE)
        route = np.repeat(runs.anchor[warm], cuts)
        lengths = size + WINDOW - 1
        bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        data = block.data[ragged(start, lengths)]
        hot = np.flatnonzero(flag == 2)
        if len(hot):
            single = ragged(runs.start[hot], runs.size[hot])
            hashes = byte_hashes(block.data, WINDOW)[single]
            first = same_windows(block.data, single, hashes)
            once = np.unique(first)
            # equal windows share the content of the first of them
            bounds = np.append(bounds, bounds[-1] + WINDOW * np.arange(1, len(once) + 1))
            data = np.append(data, block.data[ragged(single[once], np.full(len(once), WINDOW))])
            again = len(start) + np.searchsorted(once, first)
            start = np.concatenate([start, single])
            size = np.concatenate([size, np.ones(len(single), np.int64)])
            route = np.concatenate([route, hashes[once]])
        else:
            again = np.zeros(0, np.int64)
        self.start, self.size = start, size
        listed = pa.Array.from_buffers(
            pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]
        )
        coded = listed.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        shard = np.empty(len(coded.dictionary), np.int64)
        shard[code] = (mix(route) % np.uint64(shards)).astype(np.int64)
        # distinct contents by shard, in an order that every run finds again
        order = np.argsort(shard, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.contents, self.shard = coded.dictionary.take(pa.array(order)), shard[order]
        all_codes = np.concatenate([code[: len(start) - len(again)], code[again]])
        self.code = rank[all_codes]


PIECES = "shard long, block long, ids binary, sizes binary, data binary"


def own_ids(block: Block, at: np.ndarray) -> np.ndarray:
    """Ids of the documents that places of a block belong to."""
    ids = np.array([NONE if i is None else i for i in block.ids], np.int64)
    return ids[np.searchsorted(block.bounds, at, "right") - 1]


def cut_pieces(block: Block, answers: pa.Table, ranges: int, shards: int) -> list:
    """Rows for the shards: distinct contents with the smallest id that has each."""
    pieces = Pieces(block, answers, ranges, shards)
    if not len(pieces.start):
        return []
    least = np.full(len(pieces.contents), NONE)
    np.minimum.at(least, pieces.code, own_ids(block, pieces.start))
    rows = {"shard": [], "block": [], "ids": [], "sizes": [], "data": []}
    raw, ends = buffer_of(pieces.contents)
    sizes = np.diff(ends).astype(np.int32)
    for a, b in _spans(pieces.shard):
        rows["shard"].append(int(pieces.shard[a]))
        rows["block"].append(block.number)
        rows["ids"].append(squeeze(least[a:b]))
        rows["sizes"].append(squeeze(sizes[a:b]))
        rows["data"].append(squeeze(raw[ends[a] : ends[b]], 4))
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return [pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows)
    )]


def least_ids(sizes: np.ndarray, ids: np.ndarray, data: np.ndarray, folder: str) -> np.ndarray:
    """For every window of all pieces in order: the smallest id among equal windows.

    ``sizes``: bytes of the pieces, ``ids``: their smallest ids. The text of the shard and
    what the sort keeps lie on disk in ``folder``.
    """
    windows = sizes - WINDOW + 1
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])  # a zero parts the pieces
    total = int(bounds[-1])
    text = np.memmap(os.path.join(folder, "text"), np.uint8, "w+", shape=(max(total, 1),))
    at = 0
    for start in range(0, len(sizes), 1 << 16):  # UTF-8 has no byte 255, so one more fits
        some = sizes[start : start + (1 << 16)]
        length = int(some.sum())
        text[ragged(bounds[start : start + len(some)], some)] = data[at : at + length] + 1
        at += length
    number = np.full(total, -1, np.int32 if total < 1 << 31 else np.int64)  # window at each place
    places = ragged(bounds[:-1], windows)
    number[places] = np.arange(len(places))
    of = np.repeat(ids, windows)
    least = of.copy()
    # neighbours in order that share a whole window are one class
    open_members, open_least = [], NONE
    for records in suffixes(text[:total], folder, WINDOW):
        joined = records["lcp"] >= WINDOW
        here = number[records["at"]]
        starts = np.flatnonzero(~joined)
        if not len(starts):
            open_members.append(here)
            open_least = min(open_least, int(of[here].min()))
            continue
        head = here[: starts[0]]
        if len(head):
            open_members.append(head)
            open_least = min(open_least, int(of[head].min()))
        for members in open_members:
            least[members[members >= 0]] = open_least
        rest = here[starts[0] :]
        value = np.where(rest >= 0, of[rest], NONE)
        first = starts - starts[0]
        low = np.minimum.reduceat(value, first)
        sizes_of = np.diff(np.append(first, len(rest)))
        spread_low = np.repeat(low, sizes_of)
        closed = len(rest) - sizes_of[-1]
        kept = rest[:closed]
        real = kept >= 0
        least[kept[real]] = spread_low[:closed][real]
        open_members, open_least = [rest[closed:]], int(low[-1])
    for members in open_members:
        least[members[members >= 0]] = open_least
    del text
    return least


def shared_runs(sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs (first window, number of windows) of all pieces in order, within one piece each, of
    windows whose hash comes again: all others differ from every window of the pieces."""
    windows = sizes - WINDOW + 1
    none = np.zeros(0, np.int64)
    if not len(sizes):
        return none, none
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    hashes = byte_hashes(data, WINDOW)[ragged(bounds[:-1], windows)]
    rising = np.sort(hashes)
    again = rising[1:][rising[1:] == rising[:-1]]
    del rising
    bits = np.uint64(64 - min(max(int(8 * len(hashes)).bit_length(), 16), 26))
    found = np.zeros(1 << int(64 - bits), bool)
    found[(again >> bits).astype(np.int64)] = True
    kept = np.flatnonzero(found[(hashes >> bits).astype(np.int64)])
    if not len(kept):
        return none, none
    piece = np.repeat(np.arange(len(sizes)), windows)[kept]
    new = np.ones(len(kept), bool)
    new[1:] = (kept[1:] != kept[:-1] + 1) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    return kept[first], np.diff(np.append(first, len(kept)))


def distinct_pieces(
    sizes: np.ndarray, ids: np.ndarray, data: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, smallest ids and bytes of the distinct pieces, and which of them each piece is."""
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    listed = pa.Array.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(data)]
    ).dictionary_encode()
    code = listed.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    least = np.full(len(listed.dictionary), NONE)
    np.minimum.at(least, code, ids)
    _, index = np.unique(code, return_index=True)
    return sizes[index], least, data[ragged(bounds[index], sizes[index])], code


def least_shared(sizes: np.ndarray, ids: np.ndarray, data: np.ndarray, folder: str) -> np.ndarray:
    """As ``least_ids``, of which only windows that may occur again are sorted."""
    windows = sizes - WINDOW + 1
    least = np.repeat(ids, windows)
    first, n = shared_runs(sizes, data)
    if not len(first):
        return least
    own = np.searchsorted(np.cumsum(windows), first, "right")
    start = first + own * (WINDOW - 1)  # each piece has that many more bytes than windows
    run_sizes = n + WINDOW - 1
    some, low, text, code = distinct_pieces(run_sizes, ids[own], data[ragged(start, run_sizes)])
    found = least_ids(some, low, text, folder)
    starts = np.concatenate([[0], np.cumsum(some - WINDOW + 1)])
    least[ragged(first, n)] = found[ragged(starts[code], n)]
    return least


def shard_answers(pieces: DataFrame, shards: int) -> DataFrame:
    """Per shard and block, for its contents: runs of windows and the smallest id of each run."""

    @frugal
    def run(batches):
        for table in whole_groups(batches, ["shard"]):
            for a, b in _spans(table["shard"].to_numpy()):
                yield _answer_shard(table.slice(a, b - a))

    dealt = pieces.repartition(shards, "shard").sortWithinPartitions("shard", "block")
    return dealt.mapInArrow(run, "block long, part long, a binary, b binary, c binary")


def _answer_shard(table: pa.Table) -> pa.RecordBatch:
    sizes = [spread(x, np.int32).astype(np.int64) for x in table["sizes"].to_pylist()]
    ids = [spread(x, np.int64) for x in table["ids"].to_pylist()]
    data = np.concatenate([spread(x, np.uint8) for x in table["data"].to_pylist()])
    ends_of = np.concatenate([[0], np.cumsum([len(s) for s in sizes])]).tolist()
    distinct, low, text, code = distinct_pieces(np.concatenate(sizes), np.concatenate(ids), data)
    with tempfile.TemporaryDirectory() as folder:
        least = least_shared(distinct, low, text, folder)
    windows = distinct - WINDOW + 1
    ends = np.concatenate([[0], np.cumsum(windows)])
    # runs of one smallest id within each distinct content
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[ends[:-1]] = True
    run_start = np.flatnonzero(new)
    run_size = np.diff(np.append(run_start, len(least)))
    run_bounds = np.searchsorted(run_start, ends)
    n_runs = np.diff(run_bounds)
    counts, lengths, found = [], [], []
    for k in range(len(sizes)):
        mine = code[ends_of[k] : ends_of[k + 1]]
        at = ragged(run_bounds[mine], n_runs[mine])
        counts.append(squeeze(n_runs[mine].astype(np.int32)))
        lengths.append(squeeze(run_size[at].astype(np.int32)))
        found.append(squeeze(least[run_start[at]]))
    return pa.RecordBatch.from_arrays(
        [
            table["block"].combine_chunks(), table["shard"].combine_chunks(),
            pa.array(counts, pa.binary()), pa.array(lengths, pa.binary()), pa.array(found, pa.binary()),
        ],
        names=["block", "part", "a", "b", "c"],
    )


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed_bytes(block: Block, answers: pa.Table, ranges: int, shards: int) -> np.ndarray:
    """Which bytes of a block go; ``answers`` hold the anchors' flags and the shards' runs."""
    mark = np.zeros(len(block.data) + 1, np.int32)
    from_shards = answers["b"].is_valid()
    pieces = Pieces(block, answers.filter(pc.invert(from_shards)), ranges, shards)
    rows = answers.filter(from_shards).sort_by("part").to_pylist()
    if len(pieces.start):
        counts = np.concatenate([spread(r["a"], np.int32) for r in rows]).astype(np.int64)
        lengths = np.concatenate([spread(r["b"], np.int32) for r in rows]).astype(np.int64)
        least = np.concatenate([spread(r["c"], np.int64) for r in rows])
        if len(counts) != len(pieces.contents):
            raise ValueError(f"block {block.number} lost answers")
        bounds = np.concatenate([[0], np.cumsum(counts)])
        before = np.concatenate([[0], np.cumsum(lengths)])
        code = pieces.code
        at = ragged(bounds[code], counts[code])  # runs of every piece
        piece = np.repeat(np.arange(len(code)), counts[code])
        first = pieces.start[piece] + before[at] - before[bounds[code[piece]]]
        gone = least[at] < own_ids(block, first)
        np.add.at(mark, first[gone], 1)
        np.add.at(mark, first[gone] + lengths[at][gone] + WINDOW - 1, -1)
    return np.cumsum(mark[:-1]) > 0


def _results(block: Block, gone: np.ndarray, with_text: bool, carry: list) -> list:
    total = np.concatenate([[0], np.cumsum(gone)])
    n_removed = np.diff(total[block.bounds])
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    heads = block.bounds[:-1][block.sizes > 0]
    edge[heads] = gone[heads]
    n_spans = np.diff(np.concatenate([[0], np.cumsum(edge)])[block.bounds])
    digests, texts = [], []
    ends = block.bounds.tolist()
    for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        rest = block.raw[a:b] if not n_removed[k] else block.data[a:b][~gone[a:b]].tobytes()
        digests.append(hashlib.sha256(rest).hexdigest())
        if with_text:
            texts.append(rest.decode("utf-8", "ignore"))
    columns = {
        "doc_id": pa.array(block.ids, pa.int64()), "n_bytes": pa.array(block.sizes),
        "n_removed": pa.array(n_removed), "n_spans": pa.array(n_spans),
        "kept_sha256": pa.array(digests, pa.string()),
    }
    if with_text:
        columns["kept_text"] = pa.array(texts, pa.string())
    columns |= {name: pa.array(block.row[name], kind) for name, kind in carry}
    return [pa.RecordBatch.from_pydict(columns)]


def remove_repeats(
    docs: DataFrame, with_text: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """What is left of every row of ``docs`` (doc_id, text) without repeated passages.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the
    remaining bytes; with ``with_text`` also kept_text (characters that lost a byte go). Strings are
    judged on the input; matches never cross documents. A null or empty text has nothing
    to remove; a row without doc_id counts as the last one, and such rows take nothing from
    each other. Rows that repeat an id do not either and are each answered; columns in
    ``carry`` come along, others are ignored; an empty table gives an empty result.
    """
    blocks = stored_blocks(docs, carry)
    ranges = range_count(blocks, 0.3)
    shards = range_count(blocks, 1.2)
    flags = stage(anchor_answers(anchor_lists(blocks, ranges), ranges), "flags")
    pieces = with_answers(
        blocks, flags, lambda block, table: cut_pieces(block, table, ranges, shards), PIECES
    )
    # the pieces themselves only travel to their shard; blocks cut them again for the answers
    none = F.lit(None).cast("binary")
    answers = shard_answers(pieces, shards).union(
        flags.select("block", "part", "a", none.alias("b"), none.alias("c"))
    )
    types = dict(docs.dtypes)
    schema = RESULT + (", kept_text string" if with_text else "")
    schema += "".join(f", `{c}` {types[c]}" for c in carry)
    kinds = [(f.name, f.type) for f in arrow_schema(schema) if f.name in carry]

    def finish(block: Block, table: pa.Table) -> list:
        return _results(block, removed_bytes(block, table, ranges, shards), with_text, kinds)

    return with_answers(blocks, answers, finish, schema)
