r"""Language identification by a byte convolutional network in numpy.

Filters two, three and four bytes wide slide over fixed windows of ``WINDOW`` bytes; each filter's highest
response in the window goes through a ReLU and a linear layer to a softmax over the languages. As the input is
one byte of 256, a filter is a table with a row per byte and offset, and a response is a sum of table rows.
A text is the windows that it fills (the last one padded with zero bytes), all of them; its score for a
language is the mean of the windows' probabilities, weighted by their bytes.

Training: at most ``PER_LANG`` labelled documents of each language, those of least hash, from each of which
``SPANS`` passages are taken at hashed places. These bounds do not grow with the table, so the model is fitted
on the driver; which rows are eligible is found over all rows. The model (about 0.2 MB) goes out with the task.

Cases: a null text, or one without any letter, gives ``und`` with score 0, as does a table without labelled
rows. Repeated rows and ties get equal answers (of equal probabilities the first language in order wins).
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, held_out, table
from .textnum import buffers, chunks

WINDOW = 256
FILTERS = {2: 16, 3: 16, 4: 16}
PER_LANG, SPANS = 400, 4
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
_letter = regex.compile(r"\p{L}").search
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def cut(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes in each) of the texts; windows have 3 zero bytes of padding behind them."""
    size = np.diff(off)
    n = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), n)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    length = np.minimum(size[doc] - at, WINDOW)
    out = np.zeros((len(doc), WINDOW + 3), np.uint8)
    mask = np.arange(WINDOW) < length[:, None]
    out[:, :WINDOW][mask] = data
    return out, doc, length


@dataclass
class ByteCNN:
    """``tables[j]``: contribution of the byte at offset j to the filters wide enough (widest first)."""

    langs: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    out_bias: np.ndarray

    def responses(self, win: np.ndarray) -> np.ndarray:
        a = np.take(self.tables[0], win[:, :WINDOW], axis=0)
        for j, t in enumerate(self.tables[1:], 1):
            a[:, :, : t.shape[1]] += np.take(t, win[:, j : j + WINDOW], axis=0)
        return a

    def probabilities(self, win: np.ndarray, step: int = 48) -> np.ndarray:
        out = np.empty((len(win), len(self.langs)), np.float32)
        for a in range(0, len(win), step):
            h = np.maximum(self.responses(win[a : a + step]).max(axis=1) + self.bias, 0)
            out[a : a + step] = softmax(h @ self.weight + self.out_bias)
        return out

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> "ByteCNN":
        """Adam on the cross-entropy of windows."""
        langs = sorted(set(labels))
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        win, doc, size = cut(np.frombuffer(b"".join(texts), np.uint8), off)
        y = np.array([langs.index(x) for x in labels], np.int64)[doc]
        use = size >= 16
        win, y = win[use], y[use]
        rng = np.random.default_rng(seed)
        total, widest = sum(FILTERS.values()), max(FILTERS)
        tables = [rng.normal(0, 0.3, (256, sum(n for w, n in FILTERS.items() if w > j))).astype(np.float32) for j in range(widest)]
        net = cls(langs, tables, np.zeros(total, np.float32), rng.normal(0, 0.3, (total, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
        share = np.bincount(y, minlength=len(langs))
        balance = (len(y) / np.maximum(share, 1) / len(langs)).astype(np.float32)
        params = [*net.tables, net.bias, net.weight, net.out_bias]
        m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(order), batch):
                k = order[a : a + batch]
                b, r = win[k], net.responses(win[k])
                at = r.argmax(axis=1)
                z = np.take_along_axis(r, at[:, None], 1)[:, 0] + net.bias
                h = np.maximum(z, 0)
                g = softmax(h @ net.weight + net.out_bias)
                g[np.arange(len(k)), y[k]] -= 1
                g *= balance[y[k], None] / len(k)
                gz = (g @ net.weight.T) * (z > 0)
                grads = []
                for j, t in enumerate(net.tables):
                    n = t.shape[1]
                    gt = np.zeros_like(t)
                    np.add.at(gt, (np.take_along_axis(b, at[:, :n] + j, 1), np.arange(n)), gz[:, :n])
                    grads.append(gt)
                grads += [gz.sum(0), h.T @ g, g.sum(0)]
                step += 1
                for p, d, u, v in zip(params, grads, m1, m2):
                    u += 0.1 * (d - u)
                    v += 0.001 * (d * d - v)
                    p -= rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return net


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_sample(docs: DataFrame, trainable: Column, per_lang: int = PER_LANG) -> list[tuple[str, bytes]]:
    """(language, passage) rows: up to ``per_lang`` documents of each language, ``SPANS`` passages of each.

    Counts over all rows set each language's sampling rate, so that few rows beyond the bound are shuffled.
    Every language that has an eligible row is learned.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & trainable)
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return []
    place = F.xxhash64(F.col("doc_id").cast("string"), F.lit(7))
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (3 * per_lang + 60) / r["count"]))])
    near = rows.filter(F.pmod(place, F.lit(1 << 30)) < F.try_element_at(rate, F.col("lang")) * (1 << 30))
    spans = F.transform(
        F.sequence(F.lit(1), F.lit(SPANS)),
        lambda i: F.substr(F.col("text"), (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), i), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)),
    )
    first = near.select("lang", place.alias("place"), "doc_id", spans.alias("spans")).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "spans"))).filter(F.col("k") <= per_lang)
    got = first.select("lang", "place", F.explode("spans").alias("span")).collect()
    return [(r["lang"], r["span"].encode()) for r in sorted(got, key=lambda r: (r["lang"], r["place"], r["span"]))]


def fit_languages(docs: DataFrame, trainable: Column, per_lang: int = PER_LANG) -> ByteCNN | None:
    rows = training_sample(docs, trainable, per_lang)
    return ByteCNN.fit([t for _, t in rows], [x for x, _ in rows]) if rows else None


def identify(docs: DataFrame, model: ByteCNN | None, apart: Column | None = None, rows: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; with ``rows`` also the whole row as a struct ``row``."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        data, off = buffers(b.column("row").field("text") if rows else b.column("text"))
        n = len(off) - 1
        lettered, pred, score = np.zeros(n, bool), np.full(n, -1), np.zeros(n)
        for a, z, c in chunks(data, off):
            letters = np.zeros(len(c.data) + 1, np.int64)
            np.cumsum(LETTER[c.data], out=letters[1:])
            lettered[a:z] = letters[c.off[1:]] > letters[c.off[:-1]]
            for k in np.flatnonzero(~lettered[a:z] & (np.diff(c.off) > 0)):
                lettered[a + k] = _letter(c.data[c.off[k] : c.off[k + 1]].tobytes().decode()) is not None
            win, doc, size = cut(c.data, c.off)
            if model is not None and len(win):
                p = model.probabilities(win) * size[:, None]
                mean = np.stack([np.bincount(doc, p[:, k], z - a) for k in range(len(model.langs))], 1) / np.maximum(np.diff(c.off), 1)[:, None]
                pred[a:z], score[a:z] = mean.argmax(1), mean.max(1)
        langs = np.array([*(model.langs if model else []), "und"], object)
        pred[~lettered] = len(langs) - 1
        score[~lettered | (pred < 0)] = 0
        cols = {x: b.column(x) for x in names} | {"lang_pred": pa.array(langs[pred], pa.string()), "score": pa.array(np.minimum(score, 1.0))}
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    names = ["doc_id", "held_out", *(["row"] if rows else [])]
    text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if rows else F.col("text")
    told = docs.select("doc_id", (F.lit(False) if apart is None else apart).alias("held_out"), text)
    types = dict(told.dtypes)
    return arrow_map(told, kernel, ", ".join([*(f"{x} {types[x]}" for x in names), "lang_pred string", "score double"]))


def op7_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = held_out("doc_id", 3, 1)
    return identify(docs, fit_languages(docs, ~apart), apart)
