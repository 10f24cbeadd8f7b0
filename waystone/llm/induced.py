"""External induced sorting of suffixes with common-prefix lengths.

Suffixes are sorted as in SA-IS: the leftmost suffixes of rising runs are named and, if
names repeat, sorted recursively as a shorter text; all others follow from them in two
sweeps over the alphabet. Each sweep is driven by a priority queue of tuples (first symbol,
arrival, position, common prefix with the one before). Arrivals within a symbol come in
order, so the queue is a run per symbol, kept on disk beyond a memory limit and read in
chunks. The text, its ranks and the names of a shard are arrays in memory, so shards are kept small.

Common prefixes travel with the tuples: two suffixes that follow from X and Y share
one symbol more than X and Y, which is the least prefix met on the way from X to Y in the
sweep. The same numbers tell, in the naming sweep, which runs are equal (``SAME``).
"""

from __future__ import annotations

import os

import numpy as np

SAME = np.uint16(65535)
#: Records that are taken from a queue at a time, and kept in memory by a queue.
CHUNK = 1 << 18
HELD = 1 << 21
#: Alphabets up to this size are swept; larger ones are refined by ranks.
SWEPT = 2048
#: a text has fewer than 2^31 symbols; the spare bytes keep the fields aligned
RECORD = np.dtype([("at", "<i4"), ("lcp", "<u2"), ("spare", "<u2")])


class SymbolQueue:
    """Priority queue by symbol; the records of a symbol come out in the order they came in."""

    def __init__(self, folder: str, name: str, held: int = HELD):
        self.path = os.path.join(folder, name)
        self.runs: dict[int, list] = {}
        self.held, self.room = 0, held
        self.file = None

    def push(self, symbol: int, records: np.ndarray) -> None:
        self.runs.setdefault(symbol, []).append(records)
        self.held += len(records)
        if self.held > self.room:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = open(self.path, "w+b")  # noqa: SIM115
        self.file.seek(0, os.SEEK_END)
        for parts in self.runs.values():
            for k, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    start = self.file.tell()
                    self.file.write(part.tobytes())
                    parts[k] = (start, len(part))
        self.held = 0

    def _read(self, part, backwards: bool):
        if isinstance(part, np.ndarray):
            self.held -= len(part)
            spans = [(k, min(k + CHUNK, len(part))) for k in range(0, len(part), CHUNK)]
            for a, b in reversed(spans) if backwards else spans:
                yield part[a:b]
        else:
            start, n = part
            spans = [(k, min(k + CHUNK, n)) for k in range(0, n, CHUNK)]
            for a, b in reversed(spans) if backwards else spans:
                self.file.flush()
                self.file.seek(start + a * RECORD.itemsize)
                yield np.frombuffer(self.file.read((b - a) * RECORD.itemsize), RECORD)

    def pop(self, symbol: int, backwards: bool = False):
        """All records of the symbol that have come in so far, in chunks (last first if asked)."""
        parts = self.runs.pop(symbol, [])
        # small parts are joined, so that a sweep takes few steps
        joined, batch, size = [], [], 0
        for part in parts:
            if isinstance(part, np.ndarray) and len(part) < CHUNK:
                batch.append(part)
                size += len(part)
                if size >= CHUNK:
                    joined.append(np.concatenate(batch))
                    batch, size = [], 0
            else:
                joined += [np.concatenate(batch)] if batch else []
                batch, size = [], 0
                joined.append(part)
        joined += [np.concatenate(batch)] if batch else []
        for part in reversed(joined) if backwards else joined:
            yield from self._read(part, backwards)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            os.unlink(self.path)


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first..last]) of every pair, ends included, from a table of powers of two."""
    out = np.empty(len(first), values.dtype)
    level = (np.frexp((last - first + 1).astype(np.float32))[1] - 1).astype(np.int8)
    table, step = values, 1
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            table = np.minimum(table[:-step], table[step:])
            step *= 2
        here = np.flatnonzero(level == k)
        if not len(here):
            continue
        out[here] = np.minimum(table[first[here]], table[last[here] - step + 1])
    return out


class Sweep:
    """Hands tuples on to the suffixes one symbol longer, with their common prefixes."""

    def __init__(self, text: np.ndarray, rising: np.ndarray, want: bool, queue: SymbolQueue, cap: int):
        self.text, self.rising, self.want, self.queue, self.cap = text, rising, want, queue, cap
        symbols = int(text.max(initial=0)) + 1
        self.least = np.full(symbols, SAME, np.uint16)  # since the last tuple for the symbol
        self.begun = np.zeros(symbols, bool)

    def feed(self, records: np.ndarray) -> None:
        """Take the next tuples of the sweep in their order."""
        if not len(records):
            return
        before, lcp = records["at"] - 1, np.ascontiguousarray(records["lcp"])
        at = np.flatnonzero(before >= 0)
        at = at[self.rising[before[at]] == self.want]
        if len(at):
            target = self.text[before[at]]
            order = np.argsort(target, kind="stable")
            at, target = at[order], target[order]
            first = np.ones(len(at), bool)
            first[1:] = target[1:] != target[:-1]
            least = np.empty(len(at), np.uint16)
            head = np.flatnonzero(first)
            low = np.minimum.accumulate(lcp)
            least[head] = np.minimum(self.least[target[head]], low[at[head]])
            rest = np.flatnonzero(~first)
            least[rest] = range_minima(lcp, at[rest - 1] + 1, at[rest])
            longer = np.where(least == SAME, SAME, np.minimum(least + np.uint16(1), self.cap))
            longer[head[~self.begun[target[head]]]] = 0
            self.begun[target[head]] = True
            out = np.empty(len(at), RECORD)
            out["at"], out["lcp"] = before[at], longer
            ends = np.append(head[1:], len(at))
            symbols = target[head]
            for symbol, a, b in zip(symbols.tolist(), head.tolist(), ends.tolist(), strict=True):
                self.queue.push(symbol, out[a:b])
            behind = np.full(len(lcp) + 1, SAME, np.uint16)
            behind[:-1] = np.minimum.accumulate(lcp[::-1])[::-1]
            self.least = np.minimum(self.least, low[-1])
            self.least[symbols] = behind[at[ends - 1] + 1]
        else:
            self.least = np.minimum(self.least, lcp.min())


def run_length(text: np.ndarray, at: int, most: int) -> int:
    """How often the symbol at a place repeats from there on, up to a limit."""
    part = text[at : at + most]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def induce(text, rising, seeds, seed_lcp, folder: str, cap: int, tag: str, held: int = HELD):
    """All suffixes in falling order, in chunks of (position, common prefix with the one before).

    ``seeds``: leftmost rising suffixes, sorted as far as known; ``seed_lcp``: common prefix
    with the seed before (0 at a new first symbol).
    """
    n = len(text)
    rising_queue = SymbolQueue(folder, f"{tag}-low", held)
    done = SymbolQueue(folder, f"{tag}-falling", held)
    sweep = Sweep(text, rising, False, rising_queue, cap)
    start = np.array([(n, 0, 0)], RECORD)  # the empty suffix comes first
    sweep.feed(start)
    counts = np.bincount(text, minlength=1)
    symbols = np.flatnonzero(counts).tolist()
    seed_symbol = text[seeds]
    bounds = np.searchsorted(seed_symbol, np.arange(int(text.max()) + 2))
    last_falling: dict[int, int] = {}
    for symbol in symbols:
        while symbol in rising_queue.runs:
            for records in rising_queue.pop(symbol):
                done.push(symbol, records)
                last_falling[symbol] = int(records["at"][-1])
                sweep.feed(records)
        for a in range(bounds[symbol], bounds[symbol + 1], CHUNK):
            b = min(a + CHUNK, bounds[symbol + 1])
            records = np.empty(b - a, RECORD)
            records["at"], records["lcp"] = seeds[a:b], seed_lcp[a:b]
            if a == bounds[symbol] and symbol in last_falling:
                records["lcp"][0] = min(
                    run_length(text, last_falling[symbol], cap), run_length(text, int(seeds[a]), cap)
                )
            sweep.feed(records)
    rising_queue.close()
    queue = SymbolQueue(folder, f"{tag}-high", held)
    sweep = Sweep(text, rising, True, queue, cap)
    for symbol in reversed(symbols):
        last = -1
        while symbol in queue.runs:
            for records in queue.pop(symbol):
                last = int(records["at"][-1])
                yield records
                sweep.feed(records)
        carried = np.uint16(0)  # to the one before in this order: from the symbol above, nothing
        if last >= 0 and symbol in last_falling:
            carried = np.uint16(
                min(run_length(text, last, cap), run_length(text, last_falling[symbol], cap))
            )
        for records in done.pop(symbol, backwards=True):
            turned = np.empty(len(records), RECORD)
            turned["at"] = records["at"][::-1]
            turned["lcp"][1:] = records["lcp"][:0:-1]
            turned["lcp"][0] = carried
            carried = records["lcp"][0]
            yield turned
            sweep.feed(turned)
    queue.close()
    done.close()


def rising_places(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the next one; the last is not."""
    n = len(text)
    if n >= 1 << 31:
        raise ValueError("a text is limited to 2^31 symbols; use more shards")
    kind = np.int32
    step = np.zeros(n, np.int8)
    step[:-1] = text[1:] > text[:-1]
    step[:-1] -= text[1:] < text[:-1]
    step[-1] = -1
    place = np.arange(n, dtype=kind)
    place[step == 0] = n
    following = np.minimum.accumulate(place[::-1])[::-1]
    return step[following] > 0


def refined(names: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of a text of names, to at least ``depth`` names; ties are equal."""
    rank = names.astype(np.int64)
    span = 1
    while span < depth:
        size = int(rank.max()) + 2
        parts = 3 if size < (1 << 21) else 2
        key = rank + 1
        for k in range(1, parts):
            ahead = np.zeros(len(rank), np.int64)
            ahead[: max(len(rank) - k * span, 0)] = rank[k * span :] + 1
            key = key * size + ahead
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            break
        span *= parts
    return rank


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, up to ``cap``."""
    out = np.zeros(len(order), np.uint16)
    live = np.arange(1, len(order))
    x, y = order[1:], order[:-1]
    if text.dtype == np.uint8:  # eight symbols at a time; zeros behind the end differ by place
        padded = np.concatenate([text, np.zeros(cap + 8, np.uint8)]).astype(np.uint64)
        for step in (1, 2, 4):
            padded = (padded[:-step] << np.uint64(8 * step)) | padded[step:]
        for k in range(0, cap, 8):
            differ = padded[x + k] ^ padded[y + k]
            equal = differ == 0
            rest = differ[~equal]
            part = np.zeros(len(rest), np.uint16)
            for bits in range(56, 7, -8):
                part += rest < (np.uint64(1) << np.uint64(bits))
            out[live[~equal]] = k + part
            live, x, y = live[equal], x[equal], y[equal]
        out[live] = cap
        room = len(text) - np.maximum(order[1:], order[:-1])
        out[1:] = np.minimum(np.minimum(out[1:], cap), room)
        return out
    n = len(text)
    for k in range(cap):
        inside = (x + k < n) & (y + k < n)
        live, x, y = live[inside], x[inside], y[inside]
        equal = text[x + k] == text[y + k]
        live, x, y = live[equal], x[equal], y[equal]
        out[live] = k + 1
        if not len(live):
            break
    return out


def sorted_seeds(text, rising, places, folder: str, cap: int, level: int, held: int):
    """Places of leftmost rising suffixes in order, equal ones (to ``cap`` symbols) in any."""
    by = np.argsort(text[places], kind="stable")
    first = places[by]
    lcp = np.full(len(first), SAME, np.uint16)
    symbol = text[first]
    lcp[:1] = 0
    lcp[1:][symbol[1:] != symbol[:-1]] = 0
    is_seed = np.zeros(len(text), bool)
    is_seed[places] = True
    name = np.zeros(len(text), np.int32)
    count, least = 0, SAME
    # names by falling order: a new one wherever the sweep's common prefix is finite
    for records in induce(text, rising, first, lcp, folder, 60_000, f"name{level}", held):
        hit = np.flatnonzero(is_seed[records["at"]])
        if not len(hit):
            least = min(least, records["lcp"].min())
            continue
        between = np.empty(len(hit), np.uint16)
        between[0] = min(least, np.minimum.accumulate(records["lcp"])[hit[0]])
        between[1:] = range_minima(records["lcp"], hit[:-1] + 1, hit[1:])
        number = count + np.cumsum(between != SAME)
        name[records["at"][hit]] = number
        count = int(number[-1])
        tail = records["lcp"][hit[-1] + 1 :]
        least = tail.min() if len(tail) else SAME
    reduced = count - name[places]  # rising names from 0
    kinds = int(reduced.max()) + 1
    if kinds == len(places):
        return places[np.argsort(reduced)]
    # a name covers two symbols at least
    if kinds <= SWEPT and len(places) > 16 * kinds and level < 8:
        order = np.concatenate(
            [r["at"] for r in suffixes(reduced, folder, -(-cap // 2), level + 1, held)]
        )[::-1]
        return places[order]
    return places[np.argsort(refined(reduced, -(-cap // 2)), kind="stable")]


def suffixes(text: np.ndarray, folder: str, cap: int, level: int = 0, held: int = HELD):
    """Suffixes of ``text`` (small whole numbers) in falling order by their first ``cap`` symbols.

    Yields chunks of (at, lcp): lcp is the common prefix with the suffix before, up to ``cap``.
    """
    if not len(text):
        return
    rising = rising_places(text)
    places = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    order = places
    if len(places) > 1:
        order = sorted_seeds(text, rising, places, folder, cap, level, held)
    lcp = common_prefixes(text, order, cap)
    yield from induce(text, rising, order, lcp, folder, cap, f"all{level}", held)
