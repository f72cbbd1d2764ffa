"""Whole-batch text arithmetic in numpy: words, lines and their hashes straight from Arrow's byte buffers.

A chunk is a run of whole texts of about ``CHUNK`` bytes (one text alone if it is longer), so memory is
bounded by the longest text; nothing is cut. The hash of a span is the sum, over its blocks of eight bytes, of a mixed
function of block and place. Unlike a polynomial modulo 2**64, it has no strings of its own that collide
(Thue-Morse words); two given spans that differ have equal hashes with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U = np.uint64
WORD_BASE = U(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PLACE, SIZE = U(0x9E3779B97F4A7C15), U(0xA0761D6478BD642F)
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U)  # the first k bytes of a block


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that the low bits are as good as the high ones."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def parts(weight: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose weights add up to about ``most`` (one alone if it has more)."""
    total, a = np.cumsum(weight), 0
    while a < len(weight):
        b = max(a + 1, int(np.searchsorted(total, total[a] - weight[a] + most, "right")))
        yield a, b
        a = b


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    arr = arr.cast(pa.large_binary())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK, kind: type | None = None) -> Iterator[tuple[int, int, "Chunk"]]:
    """Row ranges [a, b) with their texts."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b, (kind or Chunk)(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


@dataclass
class Chunk:
    """Texts side by side: ``data`` holds their bytes, text k is ``data[off[k]:off[k+1]]``."""

    data: np.ndarray
    off: np.ndarray
    separator = SPACE  # of words; another kind of chunk may have another

    @cached_property
    def blocks(self) -> np.ndarray:
        """The eight bytes from each place on, as one number; zeros follow the last byte."""
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        return np.ndarray((len(self.data) + 1,), "<u8", padded, 0, (1,))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes [start, end); the length is part of it."""
        size = end - start
        h = mix(self.blocks[start] & LOW[np.minimum(size, 8)])
        for a, b in parts((size + 7) >> 3):  # what is left of longer spans, so many blocks at a time
            long = a + np.flatnonzero(size[a:b] > 8)
            if not len(long):
                continue
            n = (size[long] - 1) >> 3
            first = np.cumsum(n) - n
            which = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(which)) - first[which] + 1
            block = self.blocks[start[long][which] + 8 * k] & LOW[np.minimum(size[long][which] - 8 * k, 8)]
            h[long] += np.add.reduceat(mix(mix(block) + k.astype(U) * PLACE), first)
        return mix(h + size.astype(U) * SIZE)

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, first): byte ranges of the words, and for each text the index of its first word (n + 1)."""
        n = len(self.data)
        flag = np.zeros(n + 1, bool)
        np.logical_not(self.separator[self.data], out=flag[:n])
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        before = np.zeros(n + 1, bool)
        before[1:] = flag[:-1]
        start = np.flatnonzero(flag & (~before | edge))
        end = np.flatnonzero(before & (~flag | edge))
        return start, end, np.searchsorted(start, self.off)

    @cached_property
    def word_doc(self) -> np.ndarray:
        first = self.words[2]
        return np.repeat(np.arange(len(self.off) - 1), np.diff(first))

    @cached_property
    def word_hash(self) -> np.ndarray:
        return self.spans(self.words[0], self.words[1])

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""(start, end, text) of the \n-split lines; every text has at least one."""
        cut = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.off[:-1], cut + 1]), kind="stable")
        end = np.sort(np.concatenate([cut, self.off[1:]]), kind="stable")
        doc = np.sort(np.concatenate([np.arange(len(self.off) - 1), np.searchsorted(self.off, cut, "right") - 1]), kind="stable")
        return start, end, doc

    @cached_property
    def chars(self) -> np.ndarray:
        """Code points before each byte position."""
        c = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=c[1:])
        return c


def windows(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (positions too near the end hold rubbish beyond len - n)."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    h = word_hash[:m].copy()
    for j in range(1, n):
        h = h * WORD_BASE + word_hash[j : j + m]
    return mix(h)


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Positions whose n-word window ends within the same text."""
    total = int(first[-1])
    last = np.repeat(first[1:], np.diff(first))
    return np.flatnonzero(np.arange(total) + n <= last)
