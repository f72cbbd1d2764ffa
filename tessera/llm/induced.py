"""External induced sorting: suffixes of a string far larger than memory in order, with their common prefixes.

The string ``s`` ends with its only 0. Its suffixes are sorted as in SA-IS, and the lengths of common prefixes of
neighbours come out of the same scans. What waits for its turn stands in a monotone priority queue on disk, as tuples
of place, the symbols before it, own run of equal symbols, and the prefix that it shares with the tuple before it in the queue.

* *Scan.* Suffixes leave the queue in order, and each puts the suffix one place to its left back under that one's symbol,
  which the tuple carries; equal symbols leave first in, first out. The first scan induces the larger-than-next (L) suffixes
  in ascending order from the leftmost-smaller (LMS) ones, the second, descending and with mirrored symbols, all smaller (S)
  ones from those. Neighbours under one symbol share one symbol more than the least prefix between the two that sent them; at
  the border between queue and stream, the shorter run of equal symbols. Tuples leave in batches, into which what the
  batch puts back below its end is sorted at once.
* *Recursion.* A first induction sorts LMS substrings, whose prefixes also tell which are equal; their names make a string at
  most half as long, sorted by recursion to the end, whatever its alphabet. Prefixes counted in names are turned into symbols and extended.
* *Memory.* Queues, streams, places, names and the text itself are files beyond ``Scratch.memory`` bytes each; a batch has ``Scratch.step`` tuples.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

ITEM = np.dtype([("at", "<i8"), ("left", "<u8"), ("symbol", "<i4"), ("run", "<i4"), ("same", "<i4")], align=True)
FAR = np.int32(2**31 - 1)
DEPTH = 24  # steps over which a batch takes up what it puts back
Emit = Callable[[np.ndarray, np.ndarray], None]


class Scratch:
    """A folder of the task's own, bytes that one structure may hold in memory, tuples of a batch."""

    def __init__(self, folder: str, memory: int = 64 << 20, step: int = 1 << 16) -> None:
        self.folder, self.memory, self.step, self.files = folder, memory, step, 0

    def path(self) -> str:
        self.files += 1
        return os.path.join(self.folder, f"{self.files}.bin")

    def array(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.memory:
            return np.zeros(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))


def joined(arrays: list[np.ndarray]) -> np.ndarray:
    """Concatenation of tuples."""
    if len(arrays) == 1:
        return arrays[0]
    out, at = np.empty(sum(map(len, arrays)), arrays[0].dtype), 0
    for a in arrays:
        out[at : at + len(a)] = a
        at += len(a)
    return out


class Parts:
    """Arrays, as they are or as pieces of a file."""

    def __init__(self, scratch: Scratch, dtype=ITEM) -> None:
        self.scratch, self.dtype, self.file = scratch, np.dtype(dtype), None

    def write(self, a: np.ndarray) -> tuple[int, int]:
        if self.file is None:
            self.file = open(self.scratch.path(), "w+b")
        at = self.file.seek(0, os.SEEK_END)
        self.file.write(np.ascontiguousarray(a).data)
        return at, len(a)

    def read(self, part) -> np.ndarray:
        if isinstance(part, np.ndarray):
            return part
        self.file.flush()
        return np.fromfile(self.file.name, self.dtype, part[1], offset=part[0])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            os.unlink(self.file.name)
            self.file = None


class Queue(Parts):
    """Monotone priority queue of tuples by symbol: nothing below what has left comes in; equal symbols first in, first out.

    Symbols fall into groups of ``1 << shift``. The group at the front is sorted in memory; one too large for that
    is dealt into a queue of its own with smaller groups, and a group of one symbol is read piece by piece."""

    def __init__(self, scratch: Scratch, n_symbols: int, n_items: int, shift: int | None = None) -> None:
        super().__init__(scratch)
        self.shift = max(0, int(n_symbols).bit_length() - (n_items // scratch.step + 1).bit_length()) if shift is None else shift
        self.groups: dict[int, list] = {}
        self.sizes: dict[int, int] = {}
        self.front, self.at, self.group, self.sub = np.zeros(0, ITEM), 0, -1, None
        self.held = self.count = 0

    def push(self, items: np.ndarray) -> None:
        """``items`` are ordered by symbol."""
        if not len(items):
            return
        self.count += len(items)
        group = items["symbol"] >> self.shift
        cut = np.flatnonzero(group[1:] != group[:-1]) + 1
        heads = group[np.concatenate([[0], cut])].tolist()
        ends = [0, *cut.tolist(), len(items)]
        for k, g in enumerate(heads):
            own = items[ends[k] : ends[k + 1]]
            if g == self.group and self.sub is not None:
                self.sub.push(own)
            elif g == self.group and self.shift:
                both = joined([self.front[self.at :], own])
                self.front, self.at = both[np.argsort(both["symbol"], kind="stable")], 0
            else:
                self.groups.setdefault(g, []).append(own)
                self.sizes[g] = self.sizes.get(g, 0) + len(own)
                self.held += own.nbytes
        if self.held > self.scratch.memory:
            for parts in self.groups.values():
                fresh = [p for p in parts if isinstance(p, np.ndarray)]
                if fresh:  # they stand behind what was written before
                    parts[:] = [p for p in parts if not isinstance(p, np.ndarray)] + [self.write(joined(fresh))]
            self.held = 0

    def _next(self, g: int) -> np.ndarray:
        part = self.groups[g].pop(0)
        if isinstance(part, np.ndarray):
            self.held -= part.nbytes
        elif part[1] > self.scratch.step:
            self.groups[g].insert(0, (part[0] + self.scratch.step * ITEM.itemsize, part[1] - self.scratch.step))
            part = (part[0], self.scratch.step)
        if not self.groups[g]:
            del self.groups[g]
        got = self.read(part)
        self.sizes[g] -= len(got)
        return got

    def floor(self) -> int:
        """No tuple in the queue has a symbol below this."""
        if self.sub is not None and self.sub.count:
            return self.sub.floor()
        return int(self.front["symbol"][self.at]) if self.at < len(self.front) else min(self.groups) << self.shift

    def head(self, bound: int | None = None) -> np.ndarray:
        """Some of the least tuples, in order; none if all are above ``bound``, so that lower ones may still come in."""
        if self.sub is not None and not self.sub.count:
            self.sub.close()
            self.sub = None
        if not self.count or bound is not None and self.floor() > bound:
            return self.front[:0]
        if self.sub is not None:
            return self.sub.head(bound)
        if self.at == len(self.front):
            g = self.group = min(self.groups)
            if not self.shift:
                self.front = self._next(g)
            elif self.sizes[g] * ITEM.itemsize <= self.scratch.memory:
                whole = []
                while g in self.groups:
                    whole.append(self._next(g))
                whole = joined(whole)
                self.front = whole[np.argsort(whole["symbol"], kind="stable")]
            else:
                self.front, self.at = self.front[:0], 0
                self.sub = Queue(self.scratch, 0, 0, max(0, self.shift - 8))
                while g in self.groups:
                    part = self._next(g)
                    self.sub.push(part[np.argsort(part["symbol"], kind="stable")])
                return self.sub.head(bound)
            self.at = 0
        return self.front[self.at : self.at + self.scratch.step]

    def known(self, n: int) -> int:
        """Nothing below this is missing in the ``n`` tuples that ``head`` has given."""
        if not n:
            return self.floor()
        if self.sub is not None:
            return self.sub.known(n) if n < self.sub.count else (self.group + 1) << self.shift
        if self.at + n < len(self.front) or self.group in self.groups:
            return int(self.front["symbol"][self.at + n - 1])
        return (self.group + 1) << self.shift

    def take(self, n: int) -> None:
        self.count -= n
        if self.sub is not None:
            self.sub.take(n)
        else:
            self.at += n


class Records(Parts):
    """Tuples written in one order and read in the other; ``same`` then belongs to the neighbour on the other side."""

    def __init__(self, scratch: Scratch) -> None:
        super().__init__(scratch)
        self.blocks: list = []
        self.front, self.at, self.held, self.count, self.same, self.mirror = np.zeros(0, ITEM), 0, 0, 0, 0, None

    def add(self, items: np.ndarray) -> None:
        if len(items):
            self.blocks.append(items)
            self.count += len(items)
            self.held += items.nbytes
            if self.held > self.scratch.memory:
                fresh = [b for b in self.blocks if isinstance(b, np.ndarray)]
                self.blocks = [b for b in self.blocks if not isinstance(b, np.ndarray)] + [self.write(joined(fresh))]
                self.held = 0

    def head(self) -> np.ndarray:
        if self.at == len(self.front) and self.count:
            part, step = self.blocks.pop(), self.scratch.step
            n = len(part) if isinstance(part, np.ndarray) else part[1]
            if n > step:
                if isinstance(part, np.ndarray):
                    self.blocks.append(part[: n - step])
                    part = part[n - step :]
                else:
                    self.blocks.append((part[0], n - step))
                    part = (part[0] + (n - step) * ITEM.itemsize, step)
            got = self.read(part)[::-1].copy()
            after = int(got["same"][-1])
            got["same"][1:] = got["same"][:-1].copy()
            got["same"][0], self.same = self.same, after
            if self.mirror is not None:
                got["symbol"] = self.mirror - got["symbol"]
            self.front, self.at = got, 0
        return self.front[self.at :]

    def take(self, n: int) -> None:
        self.at += n
        self.count -= n


class Least:
    """Least value of ranges of an array, by doubled blocks."""

    def __init__(self, a: np.ndarray) -> None:
        self.levels = [a]

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the places lo..hi, both included."""
        n = hi - lo + 1
        k = np.frexp(n)[1] - 1
        for j in range(len(self.levels), int(k.max(initial=0)) + 1):
            a, h = self.levels[-1], 1 << j - 1
            self.levels.append(np.minimum(a[:-h], a[h:]))
        out = np.empty(len(lo), np.int32)
        for j in np.flatnonzero(np.bincount(k)).tolist():
            own = np.flatnonzero(k == j)
            out[own] = np.minimum(self.levels[j][lo[own]], self.levels[j][hi[own] - (1 << j) + 1])
        return out


class Picked:
    """Hands on the picked tuples only, with the least prefix since the one before."""

    def __init__(self, emit: Emit) -> None:
        self.emit, self.low = emit, FAR

    def __call__(self, at: np.ndarray, same: np.ndarray, pick: np.ndarray) -> None:
        k = np.flatnonzero(pick)
        if not len(k):
            self.low = min(self.low, same.min(initial=FAR))
            return
        least = np.minimum.reduceat(same[: k[-1] + 1], np.concatenate([[0], k[:-1] + 1]))
        least[0] = min(least[0], self.low)
        self.low = same[k[-1] + 1 :].min(initial=FAR)
        self.emit(at[k], least)


class Text:
    """The string, and how many of its symbols a tuple carries."""

    def __init__(self, s: np.ndarray, n_symbols: int, scratch: Scratch) -> None:
        self.s, self.n_symbols, self.scratch = s, n_symbols, scratch
        self.bits = 16 if n_symbols < 0xFFFF else 32
        self.none = np.uint64((1 << self.bits) - 1)

    def left(self, at: np.ndarray) -> np.ndarray:
        """The symbols before each place, the nearest in the lowest bits; ``none`` where there is none or it is not carried."""
        order = np.argsort(at, kind="stable") if isinstance(self.s, np.memmap) else slice(None)  # along the file
        place = at[order]
        packed = np.zeros(len(at), np.uint64)
        for k in range(64 // self.bits):
            x = np.where(place > k, self.s[np.maximum(place - 1 - k, 0)].astype(np.uint64), self.none)
            packed |= x << np.uint64(self.bits * k)
        out = np.empty_like(packed)
        out[order] = packed
        return out

    def before(self, left: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``left`` of the places ``at``, one to the left of those that had it."""
        out = left >> np.uint64(self.bits) | self.none << np.uint64(64 - self.bits)
        spent = np.flatnonzero((out & self.none == self.none) & (at > 0))
        if len(spent):
            out[spent] = self.left(at[spent])
        return out

    def sends(self, m: np.ndarray, other: np.ndarray, top: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to the left (mirrored with ``top``), and which tuples put the suffix there into the queue."""
        c, x = m["symbol"], (m["left"] & self.none).astype(np.int64)
        if top is not None:
            x = top - x
        return x, (m["at"] > 0) & ((x > c) | (x == c) & ~other)

    def put_back(self, m: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The tuples one place to the left, whose symbols are ``x``; what they share is still to be told."""
        new = np.empty(len(m), ITEM)
        new["at"], new["symbol"], new["same"] = m["at"] - 1, x, 0
        new["left"] = self.before(m["left"], new["at"])
        new["run"] = np.where(x == m["symbol"], m["run"] + 1, 1)
        return new


def _inside(text: Text, m: np.ndarray, other: np.ndarray, bound: int, top: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A batch with all tuples that it puts back below ``bound``, in order.

    Returns tuples, which are the stream's, for each tuple the place of the one that it puts back (or -1), and the bound, lowered
    where tuples put back tuples over more than ``DEPTH`` steps. Of equal symbols those already in the queue come first, then those put
    back, by the order of their senders, then the stream's."""
    layers, kinds, senders = [m], [np.where(other, 2, 0)], [np.full(len(m), -1)]
    keys = [np.stack([m["symbol"].astype(np.int64) * 4 + kinds[0], np.arange(len(m))])]
    offset, cur, own = 0, m, other
    for depth in range(1, DEPTH + 2):
        x, sends = text.sends(cur, own, top)
        k = np.flatnonzero(sends & (x < bound))
        if not len(k):
            break
        if depth > DEPTH:
            bound = int(x[k].min())
            break
        new = text.put_back(cur[k], x[k])
        senders.append(offset + k)
        keys.append(np.concatenate([[x[k] * 4 + 1], keys[-1][:, k]]))
        offset += len(cur)
        cur, own = new, np.zeros(len(new), bool)
        layers.append(cur)
        kinds.append(np.ones(len(new), np.int64))
    if len(layers) == 1:
        n = int(np.searchsorted(m["symbol"], bound, "left"))
        return m[:n], other[:n], np.full(n, -1), bound
    late = np.zeros((len(keys[-1]), offset + len(cur) - len(m)), np.int64)
    at = 0
    for key in keys[1:]:
        late[: len(key), at : at + key.shape[1]] = key
        at += key.shape[1]
    late_order = np.lexsort(late[::-1])
    every = joined([m, joined(layers[1:])[late_order]])
    kind = np.concatenate([kinds[0], np.ones(len(late_order), np.int64)])
    order = np.argsort(every["symbol"].astype(np.int64) * 4 + kind, kind="stable")
    order = order[: np.searchsorted(every["symbol"][order], bound, "left")]
    place = np.full(len(every), -1)  # of each tuple, numbered as in the layers, in the batch
    number = np.concatenate([np.arange(len(m)), len(m) + late_order])
    place[number[order]] = np.arange(len(order))
    sender = np.concatenate(senders)
    back = np.full(len(order), -1)
    got = np.flatnonzero((sender >= 0) & (place >= 0))
    back[place[sender[got]]] = place[got]
    return every[order], kind[order] == 2, back, bound


def scan(text: Text, queue: Queue, stream: Queue | Records, mirrored: bool, done: Callable) -> None:
    """Take tuples in order from queue and stream (of equal symbols, the queue's first) and put those to their left into the queue.

    ``done`` gets each batch: tuples, prefixes shared with the tuple before, symbols to the left, and which are the stream's."""
    top = text.n_symbols - 1 if mirrored else None
    least, sender = text.scratch.array(text.n_symbols, np.int32), text.scratch.array(text.n_symbols, np.int32)
    sender[:] = -1
    last_symbol, last_run, last_own = -1, 0, False
    while queue.count or stream.count:
        b = stream.head()
        a = queue.head(int(b["symbol"][0]) if len(b) else None)
        bound = queue.known(len(a)) if queue.count else int(FAR)  # of what is below, nothing is missing
        if len(b) < stream.count:
            bound = min(bound, int(b["symbol"][-1]))
        if len(a) and len(b):
            m = joined([a, b])
            order = np.argsort(m["symbol"], kind="stable")
            m, other = m[order], order >= len(a)
        else:
            m, other = (a, np.zeros(len(a), bool)) if len(a) else (b, np.ones(len(b), bool))
        first = int(m["symbol"][0])
        back = None
        if bound > first:
            n = int(np.searchsorted(m["symbol"], bound, "left"))
            all_m, all_other, back, bound = _inside(text, m[:n], other[:n], bound, top)
            if bound > first:
                n = int(np.searchsorted(m["symbol"], bound, "left"))
                n_other = int(other[:n].sum())
                m, other = all_m, all_other
            else:
                back = None
        if back is None:  # very many of one symbol, or long runs of it: those that are there, of the queue's if it has one
            own = len(a) and int(a["symbol"][0]) == first
            m = a[: np.searchsorted(a["symbol"], first, "right")] if own else b[: np.searchsorted(b["symbol"], first, "right")]
            other, n = np.full(len(m), not own), len(m)
            n_other, back = 0 if own else n, np.full(n, -1)
        queue.take(n - n_other)
        stream.take(n_other)

        c = m["symbol"].astype(np.int64)
        x, sends = text.sends(m, other, top)
        before_c, before_run, before_other = (np.concatenate([[v], w[:-1]]) for v, w in ((last_symbol, c), (last_run, m["run"]), (not last_own, other)))
        border, start = np.flatnonzero(other & ~before_other), np.flatnonzero(c != before_c)
        at_border = np.minimum(before_run, m["run"])[border]

        def prefixes(raw: np.ndarray) -> np.ndarray:
            raw[border] = at_border
            raw[start] = 0
            return raw

        same = prefixes(m["same"].copy())
        k = np.flatnonzero(sends)
        goes_on = int(c[0]) == last_symbol == int(c[-1])
        if len(k):
            k = k[np.argsort(x[k], kind="stable")]
            xs, cs, inner = x[k], c[k], back[k] >= 0
            fresh = np.concatenate([[True], xs[1:] != xs[:-1]])
            pair = np.flatnonzero(~fresh & np.concatenate([[False], cs[1:] == cs[:-1]]))
            f = np.flatnonzero(fresh)
            who = sender[xs[f]]
            none, again = f[who < 0], f[who == cs[f]]
            while True:  # prefixes of what the batch puts back into itself follow from others of the batch
                shared = np.ones(len(k), np.int32)
                if len(pair):
                    shared[pair] += Least(same)(k[pair - 1] + 1, k[pair])
                shared[none] = 0
                if len(again):
                    shared[again] += np.minimum(least[xs[again]], np.minimum.accumulate(same)[k[again]])
                if not inner.any():
                    break
                then = same.copy()
                then[back[k[inner]]] = shared[inner]
                then = prefixes(then)
                if np.array_equal(then, same):
                    break
                same = then
            done(m, same, x, other)
            out = np.flatnonzero(~inner)
            if goes_on:
                np.minimum(least, same.min(), out=least)
            z = np.append(f[1:], len(k)) - 1
            rest = np.append(np.minimum.accumulate(same[::-1])[::-1], FAR)
            sender[xs[z]], least[xs[z]] = cs[z], rest[k[z] + 1]
            new = text.put_back(m[k[out]], xs[out])
            new["same"] = shared[out]
            queue.push(new)
        else:
            done(m, same, x, other)
            if goes_on:
                np.minimum(least, same.min(), out=least)
        last_symbol, last_run, last_own = int(c[-1]), int(m["run"][-1]), not other[-1]


def induce(text: Text, seeds: Queue | Records, emit: Emit, lms_only: bool = False) -> None:
    """All suffixes, or the LMS ones, in descending order, from the LMS suffixes in ascending order."""
    top, scratch = text.n_symbols - 1, text.scratch
    large = Records(scratch)

    def keep(m, same, x, other):
        own = m[~other]
        own["same"] = same[~other]
        large.add(own)

    queue = Queue(scratch, text.n_symbols, len(text.s))
    scan(text, queue, seeds, False, keep)
    queue.close()
    seeds.close()
    large.mirror = top
    picked = Picked(emit)

    def give(m, same, x, other):
        pick = ~other & (m["at"] > 0) & (x < m["symbol"]) if lms_only else np.ones(len(m), bool)
        picked(m["at"], same, pick)

    queue = Queue(scratch, text.n_symbols, len(text.s))
    scan(text, queue, large, True, give)
    queue.close()
    large.close()
    picked(np.array([len(text.s) - 1]), np.zeros(1, np.int32), np.ones(1, bool))  # the end, which nothing sends


def lms_places(s: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Places of the LMS suffixes, the end included, and their runs of equal symbols: the valleys of the string."""
    held, files, count, block = [], Parts(scratch, np.int64), 0, scratch.step
    carry = np.zeros(0, np.int64)
    for a in range(0, len(s), block):
        part = np.asarray(s[max(a - 1, 0) : a + block])
        new = np.flatnonzero(part[1:] != part[:-1]) + max(a, 1)
        starts = np.concatenate([carry, [0] if a == 0 else [], new]).astype(np.int64)
        y = np.asarray(s[starts])
        k = np.flatnonzero((y[:-2] > y[1:-1]) & (y[1:-1] < y[2:])) + 1
        held.append(np.stack([starts[k], starts[k + 1] - starts[k]], 1))
        count += len(k)
        carry = starts[-2:]
        if sum(h.nbytes for h in held) > scratch.memory:
            files.write(np.concatenate(held))
            held = []
    held.append(np.array([[len(s) - 1, 1]], np.int64))
    count += 1
    if files.file is None:
        both = np.concatenate(held)
    else:
        files.write(np.concatenate(held))
        files.file.flush()
        both = np.memmap(files.file.name, np.int64, "r", shape=(count, 2))
    return both[:, 0], both[:, 1]


def extended(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols two different suffixes share, for each pair of places."""
    out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    for _ in range(64):
        open_ = open_[s[a[open_] + out[open_]] == s[b[open_] + out[open_]]]
        if not len(open_):
            return out
        out[open_] += 1
    for k in open_.tolist():  # few are longer, and they are read in growing blocks
        x, y, n = int(a[k] + out[k]), int(b[k] + out[k]), 256
        while True:
            m = min(n, len(s) - max(x, y))
            differ = np.flatnonzero(s[x : x + m] != s[y : y + m])
            if len(differ):
                out[k] += differ[0]
                break
            out[k] += m
            x, y, n = x + m, y + m, min(2 * n, 1 << 20)
    return out


def suffixes(s: np.ndarray, n_symbols: int, scratch: Scratch, emit: Emit) -> None:
    """``emit(places, same)`` gets all suffixes of ``s`` in descending order, batch by batch, each with the number of
    symbols that it shares with the one before it (the next larger; 0 for the first)."""
    text = Text(s, n_symbols, scratch)
    lms, runs = lms_places(s, scratch)
    step = scratch.step

    def items(at, run, same):
        out = np.empty(len(at), ITEM)
        out["at"], out["left"], out["symbol"], out["run"], out["same"] = at, text.left(at), s[at], run, same
        return out

    seeds = Queue(scratch, n_symbols, len(lms))
    for a in range(0, len(lms), step):
        some = items(np.asarray(lms[a : a + step]), 1, 1)  # of one symbol so far, and equal in it
        seeds.push(some[np.argsort(some["symbol"], kind="stable")])
    name = scratch.array(len(lms), np.int32 if len(lms) < 2**31 else np.int64)
    order = Records(scratch)
    state = [-1, 0]  # names given, length of the LMS substring before

    def named(at, same):
        way = np.argsort(at, kind="stable") if isinstance(lms, np.memmap) else slice(None)
        i = np.empty(len(at), np.int64)
        i[way] = np.searchsorted(lms, at[way])
        size = lms[np.minimum(i + 1, len(lms) - 1)] - at + 1
        before = np.concatenate([[state[1]], size[:-1]])
        n = state[0] + np.cumsum((size != before) | (same < size))
        name[i] = n
        state[:] = int(n[-1]), int(size[-1])
        if not_yet_seeds:
            out = np.empty(len(at), ITEM)
            out["at"], out["same"] = i, same
            order.add(out)

    not_yet_seeds = True
    induce(text, seeds, named, True)
    n_names = state[0] + 1
    for a in range(0, len(lms), step):
        name[a : a + step] = state[0] - name[a : a + step]
    if n_names < len(lms):
        order.close()
        order = Records(scratch)

        def kept(at, same):
            out = np.empty(len(at), ITEM)
            out["at"], out["same"] = at, same
            order.add(out)

        suffixes(name, n_names, scratch, kept)
    last = [None]
    sorted_ = Records(scratch)

    def ready(i, same):  # descending LMS suffixes, by number, with names or symbols in common
        other = np.concatenate([i[:1] if last[0] is None else [last[0]], i[:-1]])
        if n_names < len(lms):
            x, y = lms[i + same], lms[other + same]
        else:
            x, y = lms[i] + same, lms[other] + same
        shared = (x - lms[i]).astype(np.int64)
        some = np.flatnonzero(other != i)
        shared[some] += extended(s, x[some], y[some])
        sorted_.add(items(np.asarray(lms[i]), runs[i], np.minimum(shared, FAR)))
        last[0] = i[-1]

    for part in order.blocks:
        n = len(part) if isinstance(part, np.ndarray) else part[1]
        for a in range(0, n, step):
            k = min(step, n - a)
            got = part[a : a + k] if isinstance(part, np.ndarray) else order.read((part[0] + a * ITEM.itemsize, k))
            ready(got["at"], got["same"])
    order.close()
    induce(text, sorted_, emit)
