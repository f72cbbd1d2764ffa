r"""MinHash near-deduplication by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five lower-cased words. The weight of a shingle in a text is tf * idf, with idf = log(1 + N / df): N texts
have words, and df of them have the shingle (by its 64-bit hash). What less than one text in ``RARE`` has is as rare as that: else the
edits of a copy would weigh the more against the text that it shares with the others, the larger its group and the table are.

1. Texts are packed, a few MB of them in a pack, and the shingle hashes of a pack are dealt by range (see ``weighted``). A
   range meets in one group, which counts df and sends each pack the upper halves of its hashes back with their df; no
   table of shingles is broadcast or collected. Then ``BANDS * ROWS`` weighted samples of each text are drawn and folded into band keys.
   Texts with the same shingles are one node from here on (copies are members of its class).
2. Nodes meet in band buckets. A bucket is never paired in full: its leader, the node that meets most others in all its
   buckets (of edited copies, mostly the text that they come from), is compared with the others. Each pair is verified
   by the weighted Jaccard similarity of the whole texts, 0.8 or more.
3. Verified links make components. A bucket whose nodes fall in one component is done. Otherwise the nodes outside the
   leader's component are compared with the rest of the bucket, in blocks (see ``_in_blocks``). 1 - similarity is a
   metric, so a node inside that is nearer to the leader than the nearest outsider less 0.2 needs no comparison.
   So within the buckets no link that would join two classes is lost. This step's work is outsiders times nodes of
   a bucket, by matrix products; it is small unless a bucket holds very many texts that are alike, but below 0.8.

A pair of similarity 0.8 shares a bucket with probability 1 - (1 - 0.8**3)**10 = 0.9992, more similar ones with more.

Cases: texts of one to four words have one shingle, the whole; null, empty and wordless texts are alone in their
class; rows are told apart by doc_id and text, so a repeated doc_id does no harm, and repeated rows get one class; the class of rows that all lack
a doc_id is null; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analytics import components
from . import textnum as T
from .common import arrow_map, release, shared_dir, slices, stored, table
from .tiling import Words

WORDS, LIKE = 5, 0.8
PACK = 4  # chunks
RARE = 1000
RANGE = 1 << 20  # shingles that a range of hashes has by estimate
MARKS = 1 << 23
WORD = r"[\p{L}\p{N}\p{M}]"  # a text with a match has words
BANDS, ROWS, BLOCK = 10, 3, 256
DRAWS = 1 << 16
U = np.uint64
_rng = np.random.default_rng(31)
_gamma = _rng.gamma(2.0, 1.0, DRAWS).clip(1e-3).astype(np.float32)
_log_c = np.log(_rng.gamma(2.0, 1.0, DRAWS).clip(1e-6)).astype(np.float32)
_beta = _rng.random(DRAWS).astype(np.float32)
_offset = _log_c + _gamma * _beta - _gamma + np.float32(64)  # of ln a = ln c - r (t - beta) - r, kept positive
_inverse = (1 / _gamma).astype(np.float32)
_odd = _rng.integers(1, 2**62, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)


def shingles(c: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with their counts, ordered by both, and the first of each text (n + 1 places)."""
    first = c.words[2]
    n = np.diff(first)
    at = T.inside(first, WORDS)
    h = T.windows(c.word_hash, WORDS)[at] if len(at) else np.zeros(0, U)
    doc = c.word_doc[at]
    for k in np.flatnonzero((n > 0) & (n < WORDS)):
        h, doc = np.append(h, T.windows(c.word_hash[first[k] : first[k + 1]], int(n[k]))), np.append(doc, k)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(h)))
    return doc[new], h[new], count, np.searchsorted(doc[new], np.arange(len(n) + 1))


def samples(h: np.ndarray, log_w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Consistent weighted samples, (texts, BANDS * ROWS): equal entries of two texts are equal draws. Every text has a shingle.

    ln a is a positive float, so its bits order as it does; the low half names (shingle, t)."""
    out = np.empty((len(first) - 1, len(_odd)), U)
    for k, odd in enumerate(_odd):
        x = h * odd
        i = (x >> U(48)).astype(np.int64)
        r = _gamma[i]
        t = np.floor(log_w * _inverse[i] + _beta[i])
        key = np.maximum(_offset[i] - r * t, np.float32(1e-3)).view(np.uint32).astype(U) << U(32)
        key |= (x + t.astype(np.int64).astype(U) * U(0x9E3779B97F4A7C15)) >> U(16) & U(0xFFFFFFFF)
        out[:, k] = np.minimum.reduceat(key, first[:-1])
    return out


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def lowered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))


def coded(v: np.ndarray) -> bytes:
    """Numbers above 0: a byte each, and those over 254 in four bytes more."""
    over = v[v > 254].astype(np.uint32)
    return np.minimum(v, 255).astype(np.uint8).tobytes() + over.tobytes()


def decoded(b: pa.BinaryScalar, n: int) -> np.ndarray:
    raw = np.frombuffer(b.as_buffer(), np.uint8)
    v = raw[:n].astype(np.uint32)
    v[v == 255] = np.frombuffer(raw[n:].tobytes(), np.uint32)
    return v


def groups(batches, names: list[str]):
    """Tables of neighbouring rows that are equal in the columns ``names``."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        keys = [b.column(x).to_numpy(zero_copy_only=False) for x in names]
        cuts = (np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist() if b.num_rows else []
        for x, y in zip([0, *cuts], [*cuts, b.num_rows]):
            if y > x:
                key = tuple(int(k[x]) for k in keys)
                if key != last and held:
                    yield pa.Table.from_batches(held)
                    held = []
                last = key
                held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


PACKED = "range int, pack long, ids array<long>, k1 array<long>, k2 array<long>, n binary, h binary, tf binary"


def packs(docs: DataFrame, ranges: int) -> DataFrame:
    """For each pack and each range of hashes: the texts' numbers of shingles, these in order of text and hash, and
    their counts. The row of range 0 names the texts with words and their contents."""

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def flush():
            nonlocal part
            ids = pa.concat_arrays([x[0] for x in held])
            h, count = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            n = np.concatenate([x[3] for x in held])
            k1, k2 = content_key(h, count, np.concatenate([[0], np.cumsum(n)]))
            names = [ids.to_pylist(), k1.tolist(), k2.tolist()]
            text = np.repeat(np.arange(len(n)), n)
            where = range_of(h, ranges)
            order = np.argsort(where, kind="stable")
            ends = np.searchsorted(where[order], np.arange(ranges + 1))
            rows = []
            for r in range(ranges):
                some = order[ends[r] : ends[r + 1]]
                if r == 0 or len(some):
                    many = np.bincount(text[some], minlength=len(n)).astype(np.uint32)
                    rows.append((r, part, *(names if r == 0 else [None] * 3), many.tobytes(), h[some].tobytes(), coded(count[some])))
            part += 1
            held.clear()
            types = [pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=[x.split()[0] for x in PACKED.split(", ")])

        for b in slices(batches):
            for a, _, c in T.chunks(*T.buffers(b.column("text")), kind=Words):
                _, h, count, first = shingles(c)
                n = np.diff(first)
                full = np.flatnonzero(n > 0)
                if len(full):
                    held.append((b.column("rk").take(pa.array(a + full)), h, count, n[full]))
                if len(held) == PACK:
                    yield flush()
        if held:
            yield flush()
        release()

    return docs.mapInArrow(run, PACKED)


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def with_frequency(rows: DataFrame) -> DataFrame:
    """The rows of ``packs`` with df, the number of all texts that have the shingle, and of its hash the upper half."""

    def run(batches):
        for t in groups(batches, ["range"]):
            hs = [np.frombuffer(x.as_buffer(), U) for x in t.column("h")]
            own = [np.unique(h, return_counts=True) for h in hs]  # one entry a pack, however many of its texts have the shingle
            every, place = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True)
            df = np.bincount(place, weights=np.concatenate([n for _, n in own]), minlength=len(every)).astype(np.int64)
            for k, b in enumerate(b.slice(j, 1) for b in t.to_batches() for j in range(b.num_rows)):
                own = {"h": (hs[k] >> U(32)).astype(np.uint32).tobytes(), "df": coded(df[np.searchsorted(every, hs[k])])}
                names = [*b.schema.names, "df"]
                yield pa.RecordBatch.from_arrays([pa.array([own[x]], pa.binary()) if x in own else b.column(x) for x in names], names=names)

    return rows.repartition("range").sortWithinPartitions("range").mapInArrow(run, PACKED + ", df binary")


def weighted(docs: DataFrame) -> tuple[DataFrame, int]:
    """The rows of ``packs`` with df, and the number of texts with words."""
    size, n = docs.agg(F.sum(F.octet_length("text")), F.count_if(F.col("text").rlike(WORD))).first()
    return with_frequency(packs(docs, int(size or 0) // (6 * RANGE) + 1)), n


def inverse_frequency(n: int, df: np.ndarray) -> np.ndarray:
    return np.log1p(n / np.maximum(df, n / RARE)).astype(np.float32)


def content_key(h: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name the multiset of shingles of each text."""
    out = []
    for salt in (0x632BE59BD9B4E019, 0x2545F4914F6CDD1D):
        s = np.zeros(len(h) + 1, U)
        np.cumsum(T.mix(h ^ U(salt)) * count.astype(U), out=s[1:])
        out.append((s[first[1:]] - s[first[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(rows: DataFrame, n_texts: int) -> DataFrame:
    """(rk, k1, k2, bands, df) of each text with words; k1 and k2 name its shingles, df has the document
    frequencies of these by order of hash, each as often as the shingle occurs."""
    schema = pa.schema([("rk", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("df", pa.binary())])

    def run(batches):
        for t in groups(batches, ["pack"]):
            ids, k1, k2 = (next(x for x in t.column(c).to_pylist() if x is not None) for c in ("ids", "k1", "k2"))
            n = [np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("n")]
            order = np.argsort(np.concatenate([np.repeat(np.arange(len(ids)), x) for x in n]), kind="stable")
            h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("h")])[order]
            count, df = (np.concatenate([decoded(x, int(k.sum())) for x, k in zip(t.column(c), n)])[order] for c in ("tf", "df"))
            first = np.concatenate([[0], np.cumsum(np.sum(n, axis=0, dtype=np.int64))])
            log_w = np.log(inverse_frequency(n_texts, df)) + np.log(count).astype(np.float32)
            a = 0
            while a < len(ids):
                z = max(a + 1, int(np.searchsorted(first, first[a] + (1 << 17), "right")) - 1)
                cut, at = slice(first[a], first[z]), first[a : z + 1] - first[a]
                s = samples(T.mix(h[cut].astype(U)), log_w[cut], at).reshape(z - a, BANDS, ROWS)
                key = np.zeros((z - a, BANDS), U) + np.arange(BANDS).astype(U)
                for r in range(ROWS):
                    key = T.mix(key * T.WORD_BASE + s[:, :, r])
                out = []
                for j in range(a, z):
                    own = slice(first[j], first[j + 1])
                    out.append((ids[j], k1[j], k2[j], key[j - a].view(np.int64), coded(np.repeat(df[own], count[own]))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                a = z

    return rows.repartition("pack").sortWithinPartitions("pack", "range").mapInArrow(run, "rk long, k1 long, k2 long, bands array<long>, df binary")


def vectors(docs: DataFrame) -> DataFrame:
    """(id, vec): the upper halves of the text's shingle hashes, sorted, each as often as it occurs."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, vecs = [], []
        for _, _, c in T.chunks(*T.buffers(b.column("text")), kind=Words):
            _, h, count, first = shingles(c)
            k1, _ = content_key(h, count, first)
            for k in np.flatnonzero(np.diff(first) > 0):
                s = slice(first[k], first[k + 1])
                ids.append(k1[k])
                vecs.append(np.repeat((h[s] >> U(32)).astype(np.uint32), count[s]).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], names=["id", "vec"]) if ids else None

    return arrow_map(docs.select("text"), kernel, "id long, vec binary")


def _vector(vec: pa.BinaryScalar, df: pa.BinaryScalar, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a text and their weights."""
    v = np.frombuffer(vec.as_buffer(), np.uint32)
    return v, inverse_frequency(n_texts, decoded(df, len(v))).astype(np.float64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> float:
    """Of two sorted multisets of 32-bit shingles and their weights."""
    v, at, inverse = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
    w = np.concatenate([wa, wb])[at]
    x, y = np.bincount(inverse[: len(a)], minlength=len(v)), np.bincount(inverse[len(a) :], minlength=len(v))
    return float((np.minimum(x, y) * w).sum() / (np.maximum(x, y) * w).sum())


def verified(pairs: DataFrame, vecs: DataFrame, n_texts: int) -> DataFrame:
    """(a, b, s): the similarity of each pair."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        s = []
        for va, da, vb, db in zip(*(b.column(x) for x in ("va", "da", "vb", "db"))):
            (x, wx), (y, wy) = _vector(va, da, n_texts), _vector(vb, db, n_texts)
            s.append(weighted_jaccard(x, y, wx, wy))
        return pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(s, pa.float64())], names=["a", "b", "s"])

    one = vecs.groupBy("id").agg(F.first(F.struct("vec", "df")).alias("x"))
    side = lambda c: one.select(F.col("id").alias(c), F.col("x.vec").alias(f"v{c}"), F.col("x.df").alias(f"d{c}")).hint("merge")
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return arrow_map(both.select("a", "b", "va", "da", "vb", "db"), kernel, "a long, b long, s double")


def _links(edges: DataFrame) -> DataFrame:
    """(id, root) of the nodes of links (a, b)."""
    return components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("id"), F.col("component").alias("root"))


def classed_rows(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """(doc_id, rk, class_id, class_rk, node_id, n_links) of each distinct row with words, ``rk`` being a hash of doc_id and text."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    low = lowered(docs)
    packed, n_texts = weighted(low.select("rk", "text"))
    sig = stored(signatures(packed, n_texts), f"{folder}/signatures")
    nodes = stored(sig.groupBy("k1", "k2").agg(F.min("rk").alias("rk"), F.first("bands").alias("bands")), f"{folder}/nodes")
    keys = nodes.select(F.col("k1").alias("id"), "rk", F.explode("bands").alias("bucket"))
    size = stored(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"{folder}/buckets")
    met = stored(keys.join(size.hint("merge"), "bucket").select("bucket", "id", "rk", "n"), f"{folder}/met")
    weight = met.groupBy("id").agg(F.sum("n").alias("weight"), F.first("rk").alias("rk"))
    weight = stored(weight, f"{folder}/weights")
    ranked = met.join(weight.select("id", "weight").hint("merge"), "id")
    leader = ranked.groupBy("bucket").agg(F.max(F.struct("weight", "id"))["id"].alias("leader"))
    members = stored(met.select("bucket", "id").join(stored(leader, f"{folder}/leaders").hint("merge"), "bucket"), f"{folder}/members")
    wanted = weight.select(F.col("id").alias("k1"), "rk")
    texts = _marked(low, wanted, "rk").join(wanted.select("rk").distinct().hint("merge"), "rk", "left_semi")
    dfs = sig.select("rk", "k1", "df").join(wanted.hint("merge"), ["k1", "rk"], "left_semi").groupBy(F.col("k1").alias("id")).agg(F.first("df").alias("df"))
    vecs = stored(vectors(texts).join(dfs.hint("merge"), "id"), f"{folder}/vectors")

    pairs = members.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    compared = stored(verified(pairs, vecs, n_texts), f"{folder}/compared-0")
    root = _links(compared.filter(F.col("s") >= like))
    d = members.join(compared.withColumnsRenamed({"a": "leader", "b": "id"}), ["leader", "id"], "left")
    d = d.select("bucket", "id", "leader", F.when(F.col("id") == F.col("leader"), 0.0).otherwise(1 - F.coalesce("s", F.lit(0.0))).alias("d"))
    left = stored(_left(d, root, 1 - like), f"{folder}/left")
    links = compared.filter(F.col("s") >= like).select("a", "b").unionByName(stored(_in_blocks(left, vecs, n_texts, like), f"{folder}/links"))
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{folder}/all-links")
    root = _links(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))

    node = nodes.select("k1", "k2").join(root.join(degree, "id").withColumnRenamed("id", "k1"), "k1", "left")
    node = node.select("k1", "k2", F.coalesce("root", "k1").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    rows = low.select("doc_id", "rk").distinct().join(sig.select("rk", "k1", "k2").distinct(), "rk").join(node, ["k1", "k2"])
    rows = stored(rows, f"{folder}/rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk"))
    classes = rows.groupBy("root").agg(first.alias("c")).select("root", F.col("c.doc_id").alias("class_id"), F.col("c.rk").alias("class_rk"))
    copies = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("node_id"))
    return rows.join(classes, "root").join(copies, ["k1", "k2"]).select("doc_id", "rk", "class_id", "class_rk", "node_id", "n_links")


def near_classes(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """(doc_id, class_id, node_id, n_links) for each row: the least doc_id of its class, that of its exact copies, and the number
    of texts to which a verified link of the text leads. A bucket's texts are linked as far as its class needs, not in all pairs."""
    classed = classed_rows(docs, like).drop("doc_id")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"))
    return every.join(classed, "rk", "left").select("doc_id", F.when(F.col("class_rk").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("node_id", "doc_id").alias("node_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def _marked(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` less most of those whose key is not in ``wanted``, by a bitmap of ``MARKS`` bits; so that few long rows are moved."""
    at = f"pmod(xxhash64({key}), {MARKS})"
    word, bit = F.expr(f"{at} DIV 64").alias("word"), F.expr(f"shiftleft(1L, CAST({at} % 64 AS INT))")
    bits = wanted.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))  # MARKS / 64 rows at most
    return rows.withColumn("word", word).join(F.broadcast(bits), "word").filter(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def _left(d: DataFrame, root: DataFrame, far: float) -> DataFrame:
    """(bucket, id, own, out): of the buckets with nodes outside their leader's component, these outsiders and the nodes
    inside that one of them could be linked to; own is a node's component."""
    d = d.join(root.select("id", F.col("root").alias("own")), "id", "left").withColumn("own", F.coalesce("own", "id"))
    d = d.join(root.select(F.col("id").alias("leader"), F.col("root").alias("lead")), "leader", "left").withColumn("out", F.col("own") != F.coalesce("lead", "leader"))
    near = d.filter("out").groupBy("bucket").agg(F.min("d").alias("nearest"))
    keep = d.join(near, "bucket").filter(F.col("out") | (F.col("d") >= F.col("nearest") - far - 1e-9))
    return keep.select("bucket", "id", "own", "out")


def _in_blocks(left: DataFrame, vecs: DataFrame, n_texts: int, like: float) -> DataFrame:
    """(a, b) of the links between an outsider and any other node left in its bucket, if their components differ.

    Outsiders and nodes of a bucket are dealt into blocks of about ``BLOCK``; a block of outsiders meets a block of
    nodes in one group, whose similarities are a few matrix products. Rows are copied once for each block of the other
    side, so what a task holds is bounded and no pair but a link becomes a row."""
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    size = left.groupBy("bucket").agg(F.sum(F.col("out").cast("int")).alias("outs"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    one = vecs.groupBy("id").agg(F.first(F.struct("vec", "df")).alias("x")).select("id", "x.vec", "x.df")
    rows = left.join(size, "bucket").join(one.hint("merge"), "id")
    mine = lambda n: F.pmod(F.xxhash64("id"), blocks(F.col(n)))
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(F.col(n)) - 1))
    outs = rows.filter("out").select("bucket", mine("outs").cast("int").alias("i"), every("n").alias("j"), F.lit(True).alias("first"), "id", "own", "vec", "df")
    others = rows.select("bucket", every("outs").alias("i"), mine("n").cast("int").alias("j"), F.lit(False).alias("first"), "id", "own", "vec", "df")
    met = outs.unionByName(others).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches):
        for t in groups(batches, ["bucket", "i", "j"]):
            yield _linked(t, n_texts, like)

    return met.mapInArrow(run, "a long, b long").distinct()


def _linked(t: pa.Table, n_texts: int, like: float) -> pa.RecordBatch:
    """Links between the rows with and without ``first``, of different components."""
    first, ids, own = (t.column(x).to_numpy() for x in ("first", "id", "own"))
    both = [_vector(v, d, n_texts) for v, d in zip(t.column("vec"), t.column("df"))]
    vec = [_numbered(v) for v, _ in both]
    total = np.array([w.sum() for _, w in both])
    x, y = np.flatnonzero(first), np.flatnonzero(~first)
    common = np.intersect1d(np.concatenate([vec[k] for k in x]), np.concatenate([vec[k] for k in y])) if len(x) and len(y) else np.zeros(0, np.uint64)
    weight = np.zeros(len(common))
    for v, (_, w) in zip(vec, both):
        inside = np.isin(v, common)
        weight[np.searchsorted(common, v[inside])] = w[inside]
    both = np.zeros((len(x), len(y)))
    place = [np.searchsorted(common, v[np.isin(v, common)]) for v in vec]
    for c in range(0, len(common), 8192):
        m = np.zeros((len(vec), min(8192, len(common) - c)))
        for k, p in enumerate(place):
            m[k, p[(p >= c) & (p < c + 8192)] - c] = 1
        both += (m[x] * weight[c : c + 8192]) @ m[y].T
    s = both / np.maximum(total[x][:, None] + total[y][None, :] - both, 1e-12)
    i, j = np.nonzero((s >= like) & (own[x][:, None] != own[y][None, :]))
    a, b = ids[x[i]], ids[y[j]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _numbered(v: np.ndarray) -> np.ndarray:
    """A sorted multiset as a sorted set: the n-th occurrence of an element is an element of its own."""
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    n = np.arange(len(v)) - np.repeat(start, np.diff(np.append(start, len(v))))
    return (v.astype(U) << U(32)) | n.astype(U)


def deduplicated(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """``docs`` with one row of each class, that of least doc_id (null last), and one of rows equal in doc_id and text; texts without
    words stay, but of rows equal in doc_id and text one."""
    later = classed_rows(docs, like).filter("rk <> class_rk").select(F.col("rk").alias("_nd_rk"))
    rows = docs.withColumn("_nd_rk", row_key())
    kept = rows.join(stored(later, shared_dir(docs.sparkSession)), "_nd_rk", "left_anti")
    return kept.dropDuplicates(["_nd_rk"]).select(docs.columns)


def op8_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
