"""Induced sorting of the suffixes of a block of strings with common-prefix values, through disk-backed queues, in a stream.

A suffix is L if it is larger than the one that follows it, else S. Sorted S suffixes that follow an L (the seeds) induce all L
suffixes in ascending order, and those all S suffixes in descending order. The priority queue of both passes is keyed by
first symbol and, within it, by time of insertion, as suffixes are inserted in the order in which they leave; so it is
a queue per symbol. A tuple is a suffix and the length of the prefix that it shares with the tuple before it, which is one more
than the least such length between the suffixes that induced the two. Queues and the output of the first pass lie on disk beyond
a limit, blocks of tuples move at a time, and the second pass's output is handed on block by block: in memory are the text,
its types and the seeds.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np

#: Symbols: 0 ends the text, 1 ends a string, 2 to 257 are bytes.
END, STOP, SYMBOLS = 0, 1, 258
#: Seeds are sorted by so many symbols; the order of longer common prefixes is left open, as no one asks for it.
DEPTH, FIELD = 63, 7
CAP = 255
#: Tuples that move at a time.
MOVED = 1 << 15


class Queues:
    """Queues by number, of blocks of arrays; what is beyond `limit` bytes in all lies in a temporary file."""

    def __init__(self, limit: int):
        self.limit, self.size, self.file, self.kinds = limit, 0, None, ()
        self.blocks: defaultdict[int, deque] = defaultdict(deque)

    def push(self, i: int, *arrays: np.ndarray) -> None:
        self.kinds = tuple(a.dtype for a in arrays)
        size = sum(a.nbytes for a in arrays)
        if self.size + size > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            place = self.file.seek(0, 2)
            self.file.write(b"".join(a.tobytes() for a in arrays))
            self.blocks[i].append((place, [len(a) for a in arrays]))
        else:
            self.size += size
            # copies: a slice would keep all of the array it was cut from
            self.blocks[i].append((None, [a.copy() for a in arrays]))

    def _loaded(self, block: tuple) -> list[np.ndarray]:
        place, held = block
        if place is None:
            self.size -= sum(a.nbytes for a in held)
            return held
        self.file.seek(place)
        return [np.frombuffer(self.file.read(n * k.itemsize), k) for n, k in zip(held, self.kinds, strict=True)]

    def pop(self, i: int, most: int = MOVED) -> list[np.ndarray] | None:
        """The next blocks of queue i, joined, until they have `most` items."""
        got, n = [], 0
        while self.blocks[i] and n < most:
            got.append(self._loaded(self.blocks[i].popleft()))
            n += len(got[-1][0])
        return [np.concatenate(x) for x in zip(*got, strict=True)] if got else None

    def pop_last(self, i: int) -> list[np.ndarray] | None:
        """The block that came last into queue i."""
        return self._loaded(self.blocks[i].pop()) if self.blocks[i] else None


def range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first : last + 1] for each pair, by a table of the powers of two."""
    levels = [values]
    width = int((last - first).max()) + 1 if len(first) else 1
    while 2 << (len(levels) - 1) <= width:
        x, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.concatenate([np.minimum(x[:-step], x[step:]), x[-step:]]))
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    table = np.concatenate(levels)
    n = len(values)
    return np.minimum(table[level * n + first], table[level * n + last + 1 - (1 << level)])


class Inducer:
    """One pass: takes suffixes in order and queues those before them that are of its type."""

    def __init__(self, text: np.ndarray, small: np.ndarray, want_small: bool, limit: int):
        self.text, self.small, self.want, self.queues = text, small, want_small, Queues(limit)
        self.least = np.zeros(SYMBOLS, np.uint8)

    def feed(self, at: np.ndarray, shared: np.ndarray) -> None:
        if not len(at):
            return
        take = np.flatnonzero((at > 0) & (self.small[at - 1] == self.want))
        symbol = self.text[at[take] - 1]
        order = np.argsort(symbol, kind="stable")
        take, symbol = take[order], symbol[order]
        rest = np.minimum.accumulate(shared[::-1])[::-1]
        least = self.least
        self.least = np.minimum(least, rest[0])
        if not len(take):
            return
        new = np.concatenate([[True], symbol[1:] != symbol[:-1]])
        first = np.where(new, 0, np.concatenate([[0], take[:-1] + 1]))
        low = range_min(shared, first, take)
        low[new] = np.minimum(low[new], least[symbol[new]])
        low = np.minimum(low, CAP - 1) + np.uint8(1)
        cuts = np.concatenate([np.flatnonzero(new), [len(take)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.queues.push(int(symbol[a]), at[take[a:b]] - 1, low[a:b])
            last = int(take[b - 1]) + 1
            self.least[symbol[a]] = rest[last] if last < len(rest) else CAP

    def popped(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The queue of a symbol in blocks, also what is pushed meanwhile; the first shares nothing with other symbols."""
        new = True
        while (block := self.queues.pop(symbol)) is not None:
            at, shared = block
            if new:
                shared[0], new = 0, False
            yield at, shared


def sorted_seeds(text: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds sorted by their first DEPTH symbols, and what each shares with the one before it."""
    order, group = seeds, np.zeros(len(seeds), np.int64)
    shared = np.full(len(seeds), CAP, np.uint8)
    if len(seeds):
        shared[0] = 0
    open_ = np.arange(len(seeds))
    for depth in range(0, DEPTH, FIELD):
        if not len(open_):
            break
        at, key = order[open_], np.zeros(len(open_), np.uint64)
        for j in range(FIELD):
            key = (key << np.uint64(9)) | text[np.minimum(at + depth + j, len(text) - 1)].astype(np.uint64)
        rank = np.lexsort((key, group[open_]))
        order[open_], key = at[rank], key[rank]
        same = group[open_][1:] == group[open_][:-1]
        differ = key[1:] ^ key[:-1]
        parts = np.flatnonzero(same & (differ != 0))
        shared[open_[parts + 1]] = depth + sum((differ[parts] >> np.uint64(9 * (FIELD - 1 - j)) == 0).astype(np.uint8) for j in range(FIELD))
        starts = np.concatenate([[True], ~same | (differ != 0)])
        group[open_] = open_[np.maximum.accumulate(np.where(starts, np.arange(len(open_)), 0))]
        ends = np.concatenate([starts[1:], [True]])
        open_ = open_[~(starts & ends)]
    return order, shared


def small_types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are S: the symbol after the run of a suffix's first symbol is larger. The last one is."""
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
    small = np.append(text[ends[:-1] + 1] > text[ends[:-1]], True)
    return np.repeat(small, np.diff(ends, prepend=-1))


def suffixes_down(text: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of `text` (symbols, the last one END, no other) in descending order of their first DEPTH symbols at least, in
    blocks, and the length that each shares with the one before it; lengths over DEPTH may be off, but not below DEPTH."""
    small = small_types(text)
    seeds, seeds_shared = sorted_seeds(text, np.flatnonzero(small[1:] & ~small[:-1]) + 1)
    cuts = np.searchsorted(text[seeds], np.arange(SYMBOLS + 1))

    def seam(large: int | None, least_small: int | None) -> np.uint8:
        """What a symbol's last L suffix shares with its first S suffix: the shorter run of the symbol."""
        if large is None or least_small is None:
            return np.uint8(0)
        runs = []
        for x in (large, least_small):
            other = np.flatnonzero(text[x : x + CAP] != text[x])
            runs.append(int(other[0]) if len(other) else CAP)
        return np.uint8(min(*runs, CAP))

    up = Inducer(text, small, False, limit // 2)
    passed = Queues(limit // 2)
    last_large: list[int | None] = [None] * SYMBOLS
    for c in range(SYMBOLS):
        for at, shared in up.popped(c):
            passed.push(c, at, shared)
            last_large[c] = int(at[-1])
            up.feed(at, shared)
        for a in range(cuts[c], cuts[c + 1], MOVED):
            at, shared = seeds[a : min(a + MOVED, cuts[c + 1])], seeds_shared[a : min(a + MOVED, cuts[c + 1])].copy()
            if a == cuts[c]:
                shared[0] = seam(last_large[c], int(at[0]))
            up.feed(at, shared)
    del seeds, seeds_shared, up
    down = Inducer(text, small, True, limit // 2)
    for c in range(SYMBOLS - 1, -1, -1):
        least_small = None
        for at, shared in [(np.array([len(text) - 1]), np.zeros(1, np.uint8))] if c == END else down.popped(c):
            least_small = int(at[-1])
            down.feed(at, shared)
            yield at, shared
        carry = seam(last_large[c], least_small)
        while (block := passed.pop_last(c)) is not None:
            at, shared = block[0][::-1], np.append(carry, block[1][:0:-1]).astype(np.uint8)
            carry = block[1][0]
            down.feed(at, shared)
            yield at, shared
