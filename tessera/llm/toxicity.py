r"""Toxicity by compression distance to two zstandard dictionaries.

A window is one lower-cased word (letters, digits, non-ASCII characters) between two fixed frames of bytes;
words are the unit in which toxic text differs, and the frames, which both dictionaries hold, keep zstandard
from storing short windows raw. Each window is compressed with a toxic and with an ordinary dictionary. What a
pair of lengths is worth is calibrated: for each (word length, ordinary length, toxic length) the log-odds of
toxic documents having such a window, taken from training documents that the dictionaries have not seen. A
document's highest and summed log-odds and its number of words go through a logistic calibration to a score.

The dictionaries are raw-content ones, filled with the framed words that training documents of one class use
most, by document frequency. (Zstandard's own trainer and longer windows were tried: held out at sf0.1, dictionaries trained on
passages that differ, over windows of 64 to 200 bytes or of two to eight words, give an AUC of 0.83 to 0.93, these 0.98. See the README.)

Training takes at most ``PER_CLASS`` labelled documents of each class, those of least hash, one row of each doc_id, and of each a passage
of at most ``PASSAGE`` characters at a hashed place, which go to the driver (96 MB of characters at the most); class counts over all labels set the weights. Scoring is one map over Arrow batches; equal words
of a batch are compressed once, and a worker keeps up to ``KEPT`` of them.

Cases: null and empty texts have no windows and get the score of that; without labelled rows of both
classes the score is the share of toxic labels (0 without any); of contradicting labels of a doc_id toxic wins; a repeated labelled
doc_id is learned from its least passage; repeated rows are scored alike; null ids have no label.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as T
from .common import arrow_map, held_out, table
from .tiling import Words

PER_CLASS, PASSAGE, ORDINARY_WORDS, TOXIC_WORDS = 3000, 16_000, 8000, 2000
LEVEL, LIFT, MIN_SHARE, MIN_DOCS, TELLING = 15, 8.0, 0.006, 3, 1.0
KEPT = 1_000_000
FRAME = bytes(range(2, 10)), bytes(range(14, 22))
SHAPE = (16, 64, 64)


def framed(words: list[bytes]) -> bytes:
    return b"".join(FRAME[0] + w + FRAME[1] for w in words)


def words_of(texts: list[bytes]) -> list[list[bytes]]:
    out = []
    for _, _, c in T.chunks(*T.buffers(pa.array(texts, pa.large_binary())), kind=Words):
        start, end, first = c.words
        raw = c.data.tobytes()
        every = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
        out += [every[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    return out


def dictionaries(docs: list[np.ndarray], toxic: np.ndarray, names: list[bytes]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) content: the words that most documents of the class have; toxic ones must be over-represented. The
    most telling stand last, nearest to a window. Documents are arrays of distinct word numbers."""
    df = np.zeros((2, len(names)), np.int64)
    for words, x in zip(docs, toxic):
        df[int(x)][words] += 1
    n1 = max(1, int(toxic.sum()))
    n0 = max(1, len(toxic) - n1)
    lift = df[1] / n1 / ((df[0] + 0.5) / n0)
    chosen = np.flatnonzero((df[1] >= max(MIN_DOCS, MIN_SHARE * n1)) & (lift >= LIFT)).tolist()
    bad = sorted(chosen, key=lambda i: (-df[1][i] * np.log(lift[i]), names[i]))[:TOXIC_WORDS]
    often = np.argsort(-df[0], kind="stable")[: ORDINARY_WORDS + len(chosen) + 1000].tolist()
    plain = sorted((i for i in set(often) - set(chosen) if df[0][i]), key=lambda i: (-df[0][i], names[i]))[:ORDINARY_WORDS]
    content = lambda ids: framed([names[i] for i in reversed(ids)]) or FRAME[0] + FRAME[1]
    return content(plain), content(bad)


@dataclass
class Compressor:
    """Lengths of framed words under one dictionary."""

    content: bytes
    _made: zstandard.ZstdCompressor | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"content": self.content, "_made": None}

    def lengths(self, words: list[bytes]) -> np.ndarray:
        if self._made is None:
            d = zstandard.ZstdCompressionDict(self.content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(self.content), source_size=64, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            d.precompute_compress(compression_params=p)
            self._made = zstandard.ZstdCompressor(dict_data=d, compression_params=p)
        if not words:
            return np.zeros(0, np.int64)
        size = np.array([len(w) for w in words]) + len(FRAME[0]) + len(FRAME[1])
        at = np.stack([np.cumsum(size) - size, size], 1).astype("<u8")
        got = self._made.multi_compress_to_buffer(zstandard.BufferWithSegments(framed(words), at.tobytes()), threads=1)
        return np.array([len(x) for x in got])


@dataclass
class Model:
    base: float
    pair: list[Compressor] = field(default_factory=list)
    odds: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weight: np.ndarray | None = None

    def cells(self, words: list[bytes]) -> np.ndarray:
        """The calibration cell of each word."""
        a, b = (np.minimum(c.lengths(words), 63) for c in self.pair)
        return (np.minimum([len(w) for w in words], 15).astype(np.int64) * 64 + a) * 64 + b if words else np.zeros(0, np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weight, -30, 30)))


def features(odds: np.ndarray, n_words: int) -> list[float]:
    v = odds[odds > TELLING]
    return [float(v.max()) if len(v) else 0.0, float(np.log1p(v.sum())), float(np.log1p(n_words))]


def fit(texts: list[bytes], toxic: list[int], counts: tuple[int, int], seed: int = 3) -> Model:
    """``counts``: ordinary and toxic rows that the samples stand for."""
    y = np.array(toxic, np.int64)
    base = counts[1] / max(1, sum(counts))
    if len(np.unique(y)) < 2:
        return Model(base)
    numbers: dict[bytes, int] = {}
    words = [np.array([numbers.setdefault(w, len(numbers)) for w in t], np.int32) for t in words_of(texts)]
    names, sets = list(numbers), [np.unique(w) for w in words]
    fold = np.array([zlib.crc32(t, seed) % 2 for t in texts])
    cell: list[np.ndarray] = [np.zeros(0, np.int64)] * len(y)
    for k in (0, 1):
        half = Model(base, [Compressor(c) for c in dictionaries([s for s, f in zip(sets, fold) if f != k], y[fold != k], names)])
        here = np.flatnonzero(fold == k)
        known = np.unique(np.concatenate([np.zeros(0, np.int32), *(sets[i] for i in here)]))
        of = np.zeros(len(names), np.int64)
        of[known] = half.cells([names[i] for i in known.tolist()])
        for i in here:
            cell[i] = of[words[i]]
    seen, n = np.zeros((2, int(np.prod(SHAPE)))), np.bincount(y, minlength=2)
    for c, x in zip(cell, y):
        seen[x][np.unique(c)] += 1
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    odds[seen.sum(0) < 3] = 0
    x = np.array([features(odds[c], len(c)) for c in cell])
    m = Model(base, [Compressor(c) for c in dictionaries(sets, y, names)], odds.astype(np.float32), x.mean(0), x.std(0) + 1e-9)
    x = np.c_[(x - m.mean) / m.scale, np.ones(len(x))]
    rows = np.array(counts)[y] / n[y]
    rows = rows / rows.mean()
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (rows * (p - y)) + 0.1 * w
        h = (x * (rows * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    m.weight = w
    return m


def train(docs: DataFrame, labels: DataFrame, trainable: Column, per_class: int = PER_CLASS) -> Model:
    rows = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & trainable).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    counts = dict(rows.groupBy("toxic").count().collect())
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64("doc_id", F.lit(11))
    first = [rows.filter(F.col("toxic") == k).orderBy(place, "doc_id").limit(per_class) for k in (0, 1)]
    picked = F.broadcast(first[0].union(first[1]))  # 2 * per_class rows of two numbers
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    start = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.greatest(F.length("text") - (PASSAGE - 1), F.lit(1))) + 1
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(picked, "doc_id").select("doc_id", F.substr("text", start.cast("int"), F.lit(PASSAGE)).alias("text"), "toxic")
    got = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic").collect()
    got = sorted((r["doc_id"], r["text"], r["toxic"]) for r in got)
    return fit([t.encode() for _, t, _ in got], [x for *_, x in got], (counts.get(0, 0), counts.get(1, 0)))


class Scorer:
    """Scores of batches; keeps the log-odds of words by their hash."""

    def __init__(self, model: Model) -> None:
        self.model, self.hash, self.odds = model, np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def look_up(self, c: Words) -> np.ndarray:
        """Log-odds of each word of the chunk."""
        start, end, _ = c.words
        uniq, first, inverse = np.unique(c.word_hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, uniq)
        new = np.ones(len(uniq), bool)
        if len(self.hash):
            new = self.hash[np.minimum(at, len(self.hash) - 1)] != uniq
        if new.any():
            raw = c.data.tobytes()
            words = [raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())]
            if len(self.hash) > KEPT:
                self.hash, self.odds = self.hash[:0], self.odds[:0]
                return self.look_up(c)
            both = np.concatenate([self.hash, uniq[new]])
            odds = np.concatenate([self.odds, self.model.odds[self.model.cells(words)]])
            order = np.argsort(both)
            self.hash, self.odds = both[order], odds[order]
            at = np.searchsorted(self.hash, uniq)
        return self.odds[at][inverse]

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.full(len(off) - 1, self.model.base)
        if self.model.weight is None:
            return out
        for a, b, c in T.chunks(data, off, 4 << 20, Words):
            v = self.look_up(c)
            v = np.where(v > TELLING, v, 0)
            doc, n = c.word_doc, b - a
            most = np.zeros(n)
            some = np.flatnonzero(v)
            np.maximum.at(most, doc[some], v[some])
            out[a:b] = self.model.score(np.stack([most, np.log1p(np.bincount(doc[some], v[some], n)), np.log1p(np.diff(c.words[2]))], 1))
        return out


def toxicity(docs: DataFrame, model: Model, apart: Column | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    scorer: list[Scorer] = []

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        if not scorer:
            scorer.append(Scorer(model))
        s = scorer[0].scores(*T.buffers(b.column("text")))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(False) if apart is None else apart).alias("held_out"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    return arrow_map(rows, kernel, "doc_id long, held_out boolean, score double, predicted int")


def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, apart = table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels"), ~apart), apart)
