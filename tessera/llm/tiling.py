r"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased and cut into words (runs of letters, digits and marks; in scripts written without spaces each character
is a word). A seed is a run of
``MIN_MATCH`` words that a document and a benchmark item share; seeds are found by joining rolling hashes.
For each (document, item) with a seed the tiling runs: the shared seeds, found by Karp-Rabin hashes of
``MIN_MATCH`` words, are grown along their diagonals to maximal matches, and again and again the longest match
that is not overlapped is marked in both texts, until none of ``MIN_MATCH`` words is left. The share of the
item's words under tiles is its coverage. As tiles may stand in any order, reordered passages are caught.

The seed table of the benchmark goes to the executors only if it has at most ``MOST_SEEDS`` rows (a counted
bound, some tens of MB); then documents are read once and nothing of them is shuffled. A larger benchmark takes
the other way: documents emit their seed hashes, a shuffle join finds the (document, item) pairs, and the pairs
fetch both texts. Both ways give the same rows.

Cases: null and empty texts and items shorter than ``MIN_MATCH`` words match nothing; repeated documents and
items are each reported; equal matches are marked from the left of the document; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as T
from .common import arrow_map, shared_dir, stored, table

MIN_MATCH = 5
COVERAGE = 0.5
MOST_SEEDS = 1_000_000
SCHEMA = "doc_id long, item_id long, coverage double, n_tiles long, n_matched long, n_item_words long"


KIND = np.zeros(256, np.uint8)  # of a byte: 0 between words, 1 in a word
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
SIZE = np.zeros(256, np.int64)  # of the character that a byte beyond ASCII leads
SIZE[0xC0:0xE0], SIZE[0xE0:0xF0], SIZE[0xF0:] = 2, 3, 4
SPACELESS = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]"


@cache
def kinds() -> np.ndarray:
    """Of each code point: 0 between words, 1 in a word (letters, digits, marks), 2 a word of its own (scripts without spaces)."""
    out = np.zeros(0x110000, np.uint8)
    for a in (0, 0x10000, 0x20000, 0x30000):  # the planes that have letters
        text = "".join(chr(c) for c in range(a, a + 0x10000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((1, r"[\p{L}\p{N}\p{M}]"), (2, SPACELESS)):
            out[[ord(c) for c in regex.findall(pattern, text)]] = kind
    return out


class Words(T.Chunk):
    """A chunk whose words are runs of letters, digits and marks, or single characters of scripts written without spaces."""

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, n = self.data, len(self.data)
        kind = np.zeros(n + 1, np.uint8)
        kind[:n] = KIND[data]
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            size = SIZE[data[lead]]
            point = data[lead] & (0xFF >> (size + 1)).astype(np.uint8)
            point = point.astype(np.int64)
            for k in (1, 2, 3):
                more = size > k
                point[more] = point[more] << 6 | data[lead[more] + k] & 0x3F
            what = kinds()[np.minimum(point, 0x10FFFF)]
            for k in range(4):
                other = (what != 1) & (size > k)
                kind[lead[other] + k] = what[other]
            own = what == 2
            edge[lead[own]] = True
            edge[(lead + size)[own]] = True
        inside = kind > 0
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | edge))
        end = np.flatnonzero(before & (~inside | edge))
        return start, end, np.searchsorted(start, self.off)


def tile(doc: np.ndarray, item: np.ndarray, d: np.ndarray, i: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (document place, item place, words) from seeds at (d[k], i[k]); doc and item are word hashes."""
    order = np.lexsort((d, d - i))
    d, i = d[order], i[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 1) | (np.diff(d - i) != 0)]))
    runs = np.diff(np.append(new, len(d))) + least - 1
    heap = [(-int(n), int(d[k]), int(i[k])) for k, n in zip(new, runs) if np.array_equal(doc[d[k] : d[k] + n], item[i[k] : i[k] + n])]
    heapq.heapify(heap)
    in_doc, in_item, tiles = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = ~(in_doc[a : a + n] | in_item[b : b + n])
        if free.all():
            in_doc[a : a + n] = in_item[b : b + n] = True
            tiles.append((a, b, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free, [0]])))
        for s, e in zip(edge[::2], edge[1::2]):  # what is left of the match waits for its turn
            if e - s >= least:
                heapq.heappush(heap, (-int(e - s), a + int(s), b + int(s)))
    return tiles


class Seeds:
    """The benchmark's words and its seed hashes, sorted."""

    def __init__(self, ids: list[int | None], texts: list[str], least: int) -> None:
        c = Words(*T.buffers(pa.array([t.lower() for t in texts], pa.large_string())))
        first = c.words[2]
        self.ids, self.least = ids, least
        self.items = [c.word_hash[first[k] : first[k + 1]] for k in range(len(ids))]
        at = T.inside(first, least)
        h = T.windows(c.word_hash, least)[at]
        order = np.argsort(h, kind="stable")
        self.hash, at = h[order], at[order]
        self.item = c.word_doc[at]
        self.place = at - first[self.item]

    def matches(self, c: Words) -> list[tuple[int, int, float, int, int, int]]:
        """(text, item index, coverage, tiles, matched words, item words) of the pairs that share a seed."""
        first = c.words[2]
        at = T.inside(first, self.least)
        h = T.windows(c.word_hash, self.least)[at] if len(at) else np.zeros(0, np.uint64)
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return []
        n = (hi - lo)[hit]
        seed = np.repeat(lo[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place = np.repeat(at[hit], n)
        doc, item = c.word_doc[place], self.item[seed]
        order = np.lexsort((item, doc))
        doc, item, place, seed = doc[order], item[order], place[order], seed[order]
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0), [True]]))
        out = []
        for a, b in zip(cut[:-1], cut[1:]):
            k, q = int(doc[a]), int(item[a])
            tiles = tile(c.word_hash[first[k] : first[k + 1]], self.items[q], place[a:b] - first[k], self.place[seed[a:b]], self.least)
            words = sum(t[2] for t in tiles)
            out.append((k, q, words / len(self.items[q]), len(tiles), words, len(self.items[q])))
        return out


def _rows(rows: list, names: str = SCHEMA) -> pa.RecordBatch | None:
    if not rows:
        return None
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _by_broadcast(docs: DataFrame, items: list, least: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    seeds: list[Seeds] = []

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch | None:
        if not seeds:
            seeds.append(Seeds([r[0] for r in sent.value], [r[1] for r in sent.value], least))
        ids, rows = b.column("doc_id").to_pylist(), []
        for a, _, c in T.chunks(*T.buffers(b.column("text")), kind=Words):
            rows += [(ids[a + k], seeds[0].ids[q], *rest) for k, q, *rest in seeds[0].matches(c)]
        return _rows(rows)

    return arrow_map(docs, kernel, SCHEMA)


def _by_shuffle(docs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """For a benchmark of any size: pairs from a shuffle join of seed hashes, then both texts by their keys."""

    def hashes(df: DataFrame, key: str) -> DataFrame:
        def kernel(b: pa.RecordBatch) -> pa.RecordBatch | None:
            key_col, parts = b.column("k"), []
            for a, _, c in T.chunks(*T.buffers(b.column("text")), kind=Words):
                at = T.inside(c.words[2], least)
                if len(at):
                    both = np.unique(np.stack([a + c.word_doc[at], T.windows(c.word_hash, least)[at].view(np.int64)], 1), axis=0)
                    parts.append(both)
            if not parts:
                return None
            both = np.concatenate(parts)
            return pa.RecordBatch.from_arrays([key_col.take(pa.array(both[:, 0])), pa.array(both[:, 1])], names=[key, "seed"])

        return arrow_map(df.select(F.xxhash64(key, "text").alias("k"), "text"), kernel, f"{key} long, seed long")

    d, i = docs.withColumn("dk", F.xxhash64("doc_id", "text")), items.withColumn("ik", F.xxhash64("item_id", "text"))
    pairs = hashes(docs, "doc_id").join(hashes(items, "item_id"), "seed").select(F.col("doc_id").alias("dk"), F.col("item_id").alias("ik")).distinct()
    full = pairs.join(i.withColumnRenamed("text", "item_text"), "ik").join(d, "dk").select("doc_id", "text", "item_id", "item_text")

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for doc_id, text, item_id, item in zip(*(b.column(x).to_pylist() for x in ("doc_id", "text", "item_id", "item_text"))):
            got = Seeds([item_id], [item], least).matches(Words(*T.buffers(pa.array([text], pa.large_string()))))
            rows += [(doc_id, item_id, *rest) for _, _, *rest in got]
        return _rows(rows)

    return arrow_map(full, kernel, SCHEMA)


def tilings(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, most_seeds: int = MOST_SEEDS) -> DataFrame:
    """Every (document, item) pair that shares a run of ``least`` words, with the coverage of the item."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]  # a seed starts at a byte of its own
    if size <= 2 * most_seeds:
        return _by_broadcast(docs, [(r[0], r[1]) for r in items.collect()], least)
    return _by_shuffle(docs, items, least)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, **options) -> DataFrame:
    """The pairs whose item is covered by tiles to at least ``coverage``."""
    return tilings(docs, benchmark, **options).filter(F.col("coverage") >= coverage)


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, all columns kept.

    Rows are told apart by a hash of doc_id and text, so null and repeated ids do no harm; ``_rk`` is the operator's own name."""
    rows = docs.withColumn("_rk", F.xxhash64("doc_id", "text"))
    bad = leaks(rows.select(F.col("_rk").alias("doc_id"), "text"), benchmark, coverage, **options).select(F.col("doc_id").alias("_rk")).distinct()
    return rows.join(stored(bad, shared_dir(docs.sparkSession)), "_rk", "left_anti").select(docs.columns)


def op2_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
