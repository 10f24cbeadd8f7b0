"""Arrow batches inside tasks: bounded slices, words, and 64-bit hashes."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of text that a task works on at a time (one longer text is its own slice).
SLICE_BYTES = 12 << 20

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: What operators remember between the tasks of a worker, by module: how to drop it.
REMEMBERED: dict[str, Callable[[], None]] = {}


def free_memory() -> None:
    """Hand memory that nothing uses any more back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)


def frugal(run):
    """A task of ``mapInArrow`` whose worker, which outlives it, keeps no memory but what the
    task's own module remembers; what others remembered is handed back before the task begins."""

    @wraps(run)
    def task(batches):
        for module, forget in REMEMBERED.items():
            if module != run.__module__:
                forget()
        free_memory()
        try:
            yield from run(batches)
        finally:
            free_memory()

    return task


def texts_of(column: pa.Array) -> pa.Array:
    """Plain strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "").cast(pa.string())


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``column``, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: bounds by text (n + 1), all words in order."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    keep = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    return kept[bounds], flat.filter(keep)


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Bounds by text, each word's number, and the distinct words."""
    bounds, words = split_words(texts)
    coded = words.dictionary_encode()
    return bounds, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def buffer_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings in a row, and their bounds (n + 1)."""
    n = len(strings)
    wide = pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = strings.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, kind)[strings.offset : strings.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def hash_strings(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash per string (no nulls), eight bytes at a time over all strings together."""
    data, bounds = buffer_of(strings)
    lengths = np.diff(bounds)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = mix(lengths.astype(np.uint64) + np.uint64(seed) * MIX_A + np.uint64(0x9E3779B97F4A7C15))
    live = np.flatnonzero(lengths > 0)
    at, left = bounds[:-1][live], lengths[live]
    while len(live):
        word = np.zeros(len(live), np.uint64)
        for k in range(8):
            inside = left > k
            byte = padded[np.where(inside, at + k, 0)].astype(np.uint64)
            word |= np.where(inside, byte, np.uint64(0)) << np.uint64(8 * k)
        out[live] = mix(out[live] * MIX_B + word)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    first = np.repeat(starts - (ends - lengths), lengths)
    return first + np.arange(total)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each run; an empty run gives 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def group_spans(table: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    """Bounds of the runs of rows with equal keys."""
    if not table.num_rows:
        return []
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        column = table[key].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(new).tolist()
    return list(zip(starts, [*starts[1:], table.num_rows], strict=True))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by integer keys, cut anew so that no group is split."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        last = group_spans(held, keys)[-1][0] if held.num_rows else 0
        if last:
            yield held.slice(0, last).combine_chunks()
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks()
