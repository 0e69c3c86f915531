"""The smallest id of each string of LENGTH bytes in many contexts, by sorted blocks and a merge of runs on disk.

A block of distinct contexts is sorted in memory (induced.py). If there are more blocks than one, each leaves a run: its distinct
strings in descending order, kept as the length shared with the one before and the rest, with their smallest ids. The runs are
merged, a few at a time and a piece of each, and every run's entries get the smallest id over all runs, in the order of the run.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

from tripstrata.llm.induced import CAP, END, STOP, Queues, suffixes_down

LENGTH = 50
#: Bytes of contexts that are sorted at a time; memory of queues, beyond which they lie on disk.
BLOCK_BYTES, QUEUE_BYTES = 4 << 20, 32 << 20
#: Strings of each run that a merge holds; runs that are merged at a time.
RUN_STRINGS, FAN = 1024, 32


def laid_out(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings that raw has end to end, each followed by STOP, and END, as symbols; where each begins."""
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.full(int((sizes + 1).sum()) + 1, STOP, np.uint16)
    text[-1] = END
    text[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(raw))] = raw.astype(np.uint16) + 2
    return text, begin


class Block:
    """The distinct strings of LENGTH bytes of a block of contexts: `piece` of each string in turn, and by piece, in descending
    order of the strings, `shared` with the one before, `least` id and `place` in the symbols of `text`."""

    def __init__(self, raw: np.ndarray, sizes: np.ndarray, ids: np.ndarray, queue_bytes: int):
        self.text, begin = laid_out(raw, sizes)
        windows = sizes - LENGTH + 1
        first = np.cumsum(windows) - windows
        self.piece = np.empty(int(windows.sum()), np.int32)
        shared_, least_, place_ = [], [], []
        n, carry = 0, CAP
        for at, shared in suffixes_down(self.text, queue_bytes):
            doc = np.searchsorted(begin, at, "right") - 1
            off = at - begin[doc]
            ok = np.flatnonzero(off < windows[doc])
            if not len(ok):
                carry = min(carry, int(shared.min()))
                continue
            low = np.minimum.reduceat(shared[: ok[-1] + 1], np.concatenate([[0], ok[:-1] + 1]))
            low[0] = min(low[0], carry)
            carry = int(shared[ok[-1] + 1 :].min(initial=CAP))
            cut = low < LENGTH
            self.piece[first[doc[ok]] + off[ok]] = n - 1 + np.cumsum(cut)
            starts, mine = np.flatnonzero(cut), ids[doc[ok]]
            if not cut[0]:
                least_[-1][-1] = min(least_[-1][-1], mine[: starts[0] if len(starts) else len(mine)].min())
            if len(starts):
                shared_.append(low[starts])
                least_.append(np.minimum.reduceat(mine, starts))
                place_.append(at[ok[starts]])
                n += len(starts)
        self.shared, self.least, self.place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (shared_, least_, place_))

    def run(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """shared, least and the rests of the strings, `most` strings at a time."""
        for a in range(0, len(self.place), most):
            shared, place = self.shared[a : a + most], self.place[a : a + most]
            rows = (self.text[place[:, None] + np.arange(LENGTH)] - 2).astype(np.uint8)
            yield shared, self.least[a : a + most], rows[np.arange(LENGTH) >= shared[:, None]]


def restored(shared: np.ndarray, rests: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Rows of LENGTH bytes from what each shares with the one before it, and the rest."""
    own = np.arange(LENGTH) >= shared[:, None]
    rows = np.zeros((len(shared) + 1, LENGTH), np.uint8)
    rows[0] = before
    rows[1:][own] = rests
    source = np.maximum.accumulate(np.where(own, np.arange(1, len(shared) + 1)[:, None], 0), axis=0)
    return rows[source, np.arange(LENGTH)]


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as numbers of the same order, column by column."""
    wide = np.zeros((len(rows), -(-LENGTH // 8) * 8), np.uint8)
    wide[:, :LENGTH] = rows
    return wide.view(">u8").astype(np.uint64)


class Tape:
    """Records of arrays, one after the other in a temporary file; a run is a stretch of it."""

    KINDS = (np.uint8, np.int64, np.uint8)

    def __init__(self) -> None:
        self.file, self.end = tempfile.TemporaryFile(), 0

    def write(self, *arrays: np.ndarray) -> None:
        self.file.seek(self.end)
        self.end += self.file.write(np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays))

    def read(self, start: int, end: int) -> Iterator[list[np.ndarray]]:
        while start < end:
            self.file.seek(start)
            sizes = np.frombuffer(self.file.read(8 * len(self.KINDS)), np.int64)
            yield [np.frombuffer(self.file.read(int(n) * np.dtype(k).itemsize), k) for n, k in zip(sizes, self.KINDS, strict=True)]
            start += 8 * len(self.KINDS) + sum(int(n) * np.dtype(k).itemsize for n, k in zip(sizes, self.KINDS, strict=True))


class Gathered:
    """Queues that are filled by small arrays."""

    def __init__(self, queue_bytes: int):
        self.queues, self.held = Queues(queue_bytes), defaultdict(list)

    def add(self, i: int, a: np.ndarray) -> None:
        self.held[i].append(a)
        if sum(map(len, self.held[i])) >= 4096:
            self.queues.push(i, np.concatenate(self.held.pop(i)))

    def done(self) -> Queues:
        """All that was added; called before other queues are filled, it leaves nothing waiting."""
        for i in list(self.held):
            self.queues.push(i, np.concatenate(self.held.pop(i)))
        return self.queues


def merge_steps(tape: Tape, runs: list[tuple[int, int]]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]]:
    """Merges runs of descending strings with a record of each in memory: (run, number of strings) of what a step takes, its distinct
    strings as rows, the number of each taken string's row, and the smallest id of each row."""
    records = [tape.read(*x) for x in runs]
    held: list[list[np.ndarray] | None] = [None] * len(runs)
    before = np.zeros((len(runs), LENGTH), np.uint8)
    open_ = set(range(len(runs)))
    while True:
        for r in sorted(open_):
            if held[r] is None:
                record = next(records[r], None)
                if record is None:
                    open_.discard(r)
                    continue
                rows = restored(record[0], record[2], before[r])
                before[r] = rows[-1]
                held[r] = [rows, as_keys(rows), record[1]]
        alive = [r for r in range(len(runs)) if held[r] is not None]
        if not alive:
            return
        # strings down to the largest of the last ones held can't come again
        last = max(tuple(held[r][1][-1].tolist()) for r in alive)
        takes = []
        for r in alive:
            keys = held[r][1]
            more, same = np.zeros(len(keys), bool), np.ones(len(keys), bool)
            for j, x in enumerate(last):
                more |= same & (keys[:, j] > np.uint64(x))
                same &= keys[:, j] == np.uint64(x)
            takes.append(int((more | same).sum()))
        rows, keys, least = (np.concatenate([held[r][i][:k] for r, k in zip(alive, takes, strict=True)]) for i in range(3))
        order = np.lexsort(keys.T[::-1])[::-1]
        new = np.append(True, (keys[order[1:]] != keys[order[:-1]]).any(1))
        row = np.empty(len(order), np.int64)
        row[order] = np.cumsum(new) - 1
        yield [x for x in zip(alive, takes, strict=True) if x[1]], rows[order[new]], row, np.minimum.reduceat(least[order], np.flatnonzero(new))
        for r, k in zip(alive, takes, strict=True):
            held[r] = [x[k:] for x in held[r]] if k < len(held[r][2]) else None


def smallest_over_runs(tape: Tape, runs: list[tuple[int, int]], queue_bytes: int, fan: int = FAN) -> Queues:
    """By run, the smallest ids of its strings over all runs, in its order. At most `fan` runs are merged at a time; more are first
    merged to fewer, which then tell each of their strings' ids."""
    out = Gathered(queue_bytes)
    if len(runs) <= fan:
        for parts, _, row, least in merge_steps(tape, runs):
            at = 0
            for r, k in parts:
                out.add(r, least[row[at : at + k]])
                at += k
        return out.done()
    above, places = [], Gathered(queue_bytes)
    for first in range(0, len(runs), fan):
        start, n, before = tape.end, 0, None
        for parts, rows, row, least in merge_steps(tape, runs[first : first + fan]):
            at = 0
            for r, k in parts:
                places.add(first + r, n + row[at : at + k])
                at += k
            differ = rows != np.concatenate([~rows[:1] if before is None else before, rows[:-1]])
            shared = differ.argmax(1).astype(np.uint8)
            for a in range(0, len(rows), RUN_STRINGS):
                x = slice(a, a + RUN_STRINGS)
                tape.write(shared[x], least[x], rows[x][np.arange(LENGTH) >= shared[x][:, None]])
            before, n = rows[-1:], n + len(rows)
        above.append((start, tape.end))
        places.done()
    found = smallest_over_runs(tape, above, queue_bytes, fan)
    for g, first in enumerate(range(0, len(runs), fan)):
        waiting = {r: np.zeros(0, np.int64) for r in range(first, min(first + fan, len(runs)))}
        n = 0
        while (block := found.pop(g)) is not None:
            for r in waiting:
                while True:
                    k = int(np.searchsorted(waiting[r], n + len(block[0])))
                    out.add(r, block[0][waiting[r][:k] - n])
                    waiting[r] = waiting[r][k:]
                    more = None if len(waiting[r]) else places.queues.pop(r, 1)
                    if more is None:
                        break
                    waiting[r] = more[0]
            n += len(block[0])
        out.done()
    return out.queues


Contexts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def distinct(pieces: list[Contexts]) -> Contexts:
    """(h, hi, lo, id, size, raw) of distinct contexts, each with its smallest id."""
    h, hi, lo, ids, sizes, raw = (np.concatenate(x) for x in zip(*pieces, strict=True))
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    order = np.lexsort((ids, lo, hi))
    first = order[np.append(True, (hi[order[1:]] != hi[order[:-1]]) | (lo[order[1:]] != lo[order[:-1]]))] if len(order) else order
    taken = sizes[first].astype(np.int64)
    at = np.repeat(starts[first] - (np.cumsum(taken) - taken), taken) + np.arange(int(taken.sum()))
    return h[first], hi[first], lo[first], ids[first], taken, raw[at]


def cut_out(found: Contexts, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """raw, sizes and ids of some of the contexts."""
    *_, ids, sizes, raw = found
    return raw[np.repeat(np.isin(np.arange(len(sizes)), some), sizes)], sizes[some], ids[some]


def results(h: np.ndarray, hi: np.ndarray, lo: np.ndarray, windows: np.ndarray, least: np.ndarray, alone: np.ndarray | None = None, ids: np.ndarray | None = None) -> tuple:
    """(h, hi, lo, start, count, values): a context's results are values[start : start + count], one if all its strings have it.
    `least` has the results of the strings of the contexts that aren't `alone`; those have their own id."""
    if alone is None:
        alone, ids = np.zeros(len(h), bool), np.zeros(0, np.int64)
    rest = np.flatnonzero(~alone)
    first = np.cumsum(windows[rest]) - windows[rest]
    count, start = np.ones(len(h), np.int64), np.arange(len(h))
    if len(rest):
        mixed = np.minimum.reduceat(least, first) != np.maximum.reduceat(least, first)
        count[rest[mixed]] = windows[rest[mixed]]
        start[rest] = len(ids) + first
    return h, hi, lo, start, count, np.concatenate([ids, least])


def smallest_by_context(pieces: Iterator[Contexts], block_bytes: int = BLOCK_BYTES, queue_bytes: int = QUEUE_BYTES, fan: int = FAN) -> Iterator[tuple]:
    """results() of the distinct contexts of the pieces (h, hi, lo, id, size, raw), a block at a time."""
    held, size, runs = [], 0, []
    tape, about = None, Queues(queue_bytes)

    def close(found: Contexts) -> None:
        nonlocal tape
        tape = tape or Tape()
        h, hi, lo, ids, sizes, raw = found
        block, start = Block(raw, sizes, ids, queue_bytes), tape.end
        for record in block.run(RUN_STRINGS):
            tape.write(*record)
        about.push(len(runs), h, hi, lo, sizes - LENGTH + 1, block.piece)
        runs.append((start, tape.end))

    for piece in pieces:
        held.append(piece)
        size += len(piece[-1])
        if size >= 2 * block_bytes:
            held = [distinct(held)]
            size = len(held[0][-1])
            if size >= block_bytes:
                close(held[0])
                held, size = [], 0
    if not runs:
        if not held:
            return
        found = distinct(held)
        h, hi, lo, ids, sizes, raw = found
        # a context alone with its minimizer shares its strings with no other
        _, back, k = np.unique(h, return_inverse=True, return_counts=True)
        alone = k[back] == 1
        least = np.zeros(0, np.int64)
        if not alone.all():
            block = Block(*cut_out(found, np.flatnonzero(~alone)), queue_bytes)
            least = block.least[block.piece]
        yield results(h, hi, lo, sizes - LENGTH + 1, least, alone, ids)
        return
    if held:
        close(distinct(held))
    by_run = smallest_over_runs(tape, runs, queue_bytes, fan)
    for i in range(len(runs)):
        h, hi, lo, windows, piece = about.pop(i)
        yield results(h, hi, lo, windows, by_run.pop(i, 1 << 62)[0][piece])
