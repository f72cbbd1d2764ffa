r"""Suffix-array dedup of byte strings of ``SPAN`` = 200 bytes by external induced sorting in shards.

Every byte that a 200-byte string covers which also starts anywhere else in the corpus is removed.

1. *Anchors.* The anchor of a 200-byte window is the least hash of its 64-byte strings (the leftmost of equals), so equal
   windows have equal anchors at equal places in them. Neighbouring windows share an anchor; about one position in 60 is
   one. Anchor hashes that one text alone has, once, are dropped (a partial aggregate over all texts).
2. *Hot anchors.* An anchor of more than ``HOT`` texts is split by longer context: its windows go into groups of 16 neighbouring
   offsets, named by the 185 bytes that all windows of the group have, and a group that is hot again into single windows. Names that
   one text alone has, once, are dropped as before. So however many texts share a passage, no shard grows with them.
3. *Shards.* For each name left in a text the bytes of its windows are one chunk. Distinct chunks of a batch are
   shuffled by name, so that equal windows meet in one task; where they came from stays behind.
4. *Induced sorting.* A task reads its distinct chunks as strings of 8-byte words, counted from the anchor (equal windows lie on
   equal word borders), and sorts their suffixes with ``induced.suffixes``, which gives the common prefixes too. Chunks, words,
   symbols and flags are files of the task's own folder beyond ``MEMORY`` bytes each, deleted at its end; some 50 bytes a
   chunk stay in memory. Places that share 24 words make an interval; of these, windows are equal whose 8 bytes beside the 24 words are.
5. The repeated intervals of the chunks join the chunks' places (Spark may split a hot one) and then their texts,
   which are cut.

Exact copies are found before all that by a 128-bit hash of the text: with 200 bytes or more they are removed
whole, and one of each stands for the others in the shards. Texts are shuffled once (chunks and cutting reuse it).

Cases: null texts are empty; texts under 200 bytes lose nothing; each row is a document of its own, so repeated
rows are removed whole; a null doc_id is like any other; extra columns are ignored; the empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import shutil
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as T
from .common import arrow_map, release, shared_dir, slices, stored, table
from .induced import Picked, Scratch, suffixes

SPAN, MER, WORD = 200, 64, 8
HOT = 2_000  # texts with a name from which its windows are named by longer context
WIDTHS = (0, 16, 1)  # offsets of a group: all of an anchor, then fewer
SHARD = 60_000  # chunks of a shard on average, equal ones included; the number of shards grows with the input
MEMORY = 64 << 20
U = np.uint64
FACTORS = np.random.default_rng(17).integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)


def mers(c: T.Chunk, mer: int) -> np.ndarray:
    """Hash of the ``mer`` bytes (a multiple of 8) from each place on, out of blocks of 8, 16, 32 .. bytes."""
    h, n, at, out = c.blocks[: len(c.data) - 7] * FACTORS[0], 8, 0, None
    for k in range(1, 32):
        if mer // 8 >> k - 1 & 1:
            block = h[at : at + len(c.data) - mer + 1]
            out = block.copy() if out is None else out * FACTORS[-k] + block
            at += n
        if at == mer:
            return T.mix(out)
        h = h[:-n] * FACTORS[k] + h[n:]
        n *= 2


def superwindows(c: T.Chunk, span: int = SPAN, mer: int = MER) -> tuple[np.ndarray, ...]:
    """(first, last, name, text, anchor): runs of windows that share an anchor, as window starts, named by the anchor's hash."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    m, w = len(c.data) - mer + 1, span - mer + 1
    if m < w:
        return none
    h = mers(c, mer)
    bits = U(max(21, int(m).bit_length()))
    key = (h >> bits << bits) | np.arange(m, dtype=U)
    x = np.concatenate([key, np.full(-m % w + w, ~U(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    n = m - w + 1
    place = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & ((U(1) << bits) - U(1))).astype(np.int64)
    size = np.diff(c.off)
    long = np.flatnonzero(size >= span)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, c.off[long], 1)
    np.add.at(inside, np.minimum(c.off[long + 1] - span + 1, n), -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(at):
        return none
    place = place[at]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last], h[place[first]], np.searchsorted(c.off, at[first], "right") - 1, place[first]


def refined(c: T.Chunk, runs: tuple[np.ndarray, ...], width: int, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """The runs cut into groups of ``width`` offsets from the anchor, named by what all windows of the group have."""
    first, last, h, doc, anchor = runs
    low, high = (anchor - last) // width, (anchor - first) // width
    n = high - low + 1
    of = np.repeat(np.arange(len(n)), n)
    group = high[of] - (np.arange(len(of)) - (np.cumsum(n) - n)[of])
    start, end = anchor[of] - group * width - (width - 1), anchor[of] - group * width  # of all the group's windows
    name = T.mix(c.spans(end, start + span) + T.mix(h[of] + group.astype(U)))
    return np.maximum(start, first[of]), np.minimum(end, last[of]), name, doc[of], anchor[of]


def _among(h: np.ndarray, doc: np.ndarray, sets: pa.ListArray) -> np.ndarray:
    """Whether a name is in its text's set."""
    flat, owner = sets.flatten().to_numpy(zero_copy_only=False).view(U), np.repeat(np.arange(len(sets)), np.diff(sets.offsets.to_numpy()))
    return np.isin(T.mix(h ^ T.mix(doc.astype(U))), T.mix(flat ^ T.mix(owner.astype(U))))


def names(docs: DataFrame, level: int) -> DataFrame:
    """(h, rk, c1, again): the names of each text, and whether it has one twice; beyond level 0 only of windows under the texts' hot names."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for a, z, c in T.chunks(*T.buffers(b.column("text"))):
            runs = superwindows(c)
            for k in range(level):
                hot = _among(runs[2], runs[3], b.column(f"hot{k}").slice(a, z - a))
                runs = refined(c, tuple(x[hot] for x in runs), WIDTHS[k + 1])
            h, doc = runs[2], runs[3]
            if not len(h):
                continue
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
            out.append((h[new].view(np.int64), a + doc[new], np.diff(np.append(new, len(h))) > 1))
        if not out:
            return None
        h, doc, again = (np.concatenate(x) for x in zip(*out))
        own = pa.array(doc)
        return pa.RecordBatch.from_arrays([pa.array(h), b.column("rk").take(own), b.column("c1").take(own), pa.array(again)], names=["h", "rk", "c1", "again"])

    return arrow_map(docs.select("rk", "c1", "text", *(f"hot{k}" for k in range(level))), kernel, "h long, rk long, c1 long, again boolean")


def _chosen(c: T.Chunk, b: pa.RecordBatch, a: int, z: int, levels: int) -> tuple[np.ndarray, ...]:
    """The runs of windows that the names of the texts stand for, of all levels."""
    runs, out = superwindows(c), []
    for k in range(levels):
        take = _among(runs[2], runs[3], b.column(f"take{k}").slice(a, z - a))
        out.append(tuple(x[take] for x in runs))
        if k + 1 < levels:
            hot = _among(runs[2], runs[3], b.column(f"hot{k}").slice(a, z - a))
            runs = refined(c, tuple(x[hot] for x in runs), WIDTHS[k + 1])
    return tuple(np.concatenate(x) for x in zip(*out))


def chunks_of(texts: DataFrame, levels: int, places: bool) -> DataFrame:
    """The chunks of the texts' names: distinct (h, v, n, lead, chunk) of a batch, n times each, or with ``places`` all (h, v, rk, at)."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch | None:
        rk, parts, blobs = b.column("rk").to_numpy(zero_copy_only=False), [], []
        for a, z, c in T.chunks(*T.buffers(b.column("text"))):
            first, last, h, doc, anchor = _chosen(c, b, a, z, levels)
            if not len(h):
                continue
            lead = (first - anchor) % WORD
            v = c.spans(first, last + SPAN) + lead.astype(U)
            if places:
                parts.append((h.view(np.int64), v.view(np.int64), rk[a + doc], first - c.off[doc]))
                continue
            order = np.lexsort((v, h))
            h, v = h[order], v[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (v[1:] != v[:-1])]))
            one = order[new]
            parts.append((h[new].view(np.int64), v[new].view(np.int64), np.diff(np.append(new, len(order))), lead[one]))
            raw = c.data.tobytes()
            blobs += [raw[x:y] for x, y in zip(first[one].tolist(), (last[one] + SPAN).tolist())]
        if not parts:
            return None
        cols = [np.concatenate(x) for x in zip(*parts)]
        if places:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["h", "v", "rk", "at"])
        h, v, n, lead = cols
        order = np.lexsort((v, h))
        new = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (v[order][1:] != v[order][:-1])]))
        some = order[new]
        return pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(v[some]), pa.array(np.add.reduceat(n[order], new)), pa.array(lead[some]), pa.array([blobs[k] for k in some.tolist()], pa.binary())], names=["h", "v", "n", "lead", "chunk"])

    sets = [f"{x}{k}" for k in range(levels) for x in ("take", "hot")]
    return arrow_map(texts.select("rk", "text", *sets), kernel, "h long, v long, rk long, at long" if places else "h long, v long, n long, lead long, chunk binary", 32 << 20)


def symbols_of(words: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, int]:
    """Words as symbols from 2 on, and how many symbols there are; ranges of mixed words in turn, as many as memory asks for."""
    out = scratch.array(len(words) + 1, np.int32)
    ranges, n, block = 1 + words.nbytes * 4 // scratch.memory, 2, scratch.step * 4
    for r in range(ranges):
        found, where = [], []
        for a in range(0, len(words), block):
            x = T.mix(np.asarray(words[a : a + block]))
            own = np.flatnonzero(((x >> U(32)) * U(ranges) >> U(32)) == U(r)) if ranges > 1 else np.arange(len(x))
            found.append(x[own])
            where.append(a + own)
        every, place = np.unique(np.concatenate(found), return_inverse=True) if found else (np.zeros(0), np.zeros(0, int))
        out[np.concatenate(where) if where else np.zeros(0, int)] = place + n
        n += len(every)
    return out, n


def _bytes_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers; ``data`` is padded."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))[at]


def repeated_windows(data: np.ndarray, off: np.ndarray, size: np.ndarray, lead: np.ndarray, scratch: Scratch, span: int = SPAN) -> np.ndarray:
    """Flags over the bytes of chunks: where a window starts that stands elsewhere too. Chunk k has ``size[k]`` bytes from ``data[off[k]]`` on,
    and its first byte lies ``lead[k]`` bytes behind a word border; ``data`` has 8 bytes to spare."""
    flags = scratch.array(len(data), bool)
    skip = -lead % WORD  # bytes before the chunk's first whole word
    n_words = np.maximum(size - skip, 0) // WORD
    cut = np.concatenate([[0], np.cumsum(n_words + 1)])  # each chunk's words and a separator
    total, need = int(cut[-1]), span // WORD - 1
    if not total:
        return flags
    text_words = scratch.array(total, np.uint64)
    is_end = scratch.array(total + 1, bool)
    step = scratch.step
    for a, z in T.parts(n_words + 1, step):
        of = np.repeat(np.arange(a, z), n_words[a:z] + 1)
        k = np.arange(cut[a], cut[z]) - cut[of]
        end = k == n_words[of]
        text_words[cut[a] : cut[z]] = np.where(end, U(0), _bytes_at(data, np.where(end, 0, off[of] + skip[of] + k * WORD)))
        is_end[cut[a] : cut[z]] = end
    s, n_symbols = symbols_of(text_words, scratch)
    for a in range(0, total, step):
        part = s[a : a + step][: total - a]
        part[is_end[a : a + len(part)]] = 1
    s[total] = 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = [0]

    def settle(q: np.ndarray, g: np.ndarray) -> None:
        """Whole intervals ``g`` of word places ``q``."""
        many = np.bincount(g - g[0])[g - g[0]] > 1
        q, g = q[many], g[many]
        if not len(q):
            return
        of = np.searchsorted(cut, q, "right") - 1
        byte = off[of] + skip[of] + (q - cut[of]) * WORD
        keys = []
        for left in range(WORD):
            p = byte - left
            ok = np.flatnonzero((p >= off[of]) & (p + span <= off[of] + size[of]))
            low = U((1 << 8 * left) - 1)
            extra = (_bytes_at(data, p[ok]) & low) | (_bytes_at(data, p[ok] + left + need * WORD) << U(8 * left) if left else _bytes_at(data, p[ok] + need * WORD))
            keys.append((p[ok], g[ok] * WORD + left, extra))
        p, g, extra = (np.concatenate(x) for x in zip(*keys))
        order = np.lexsort((extra, g))
        p, g, extra = p[order], g[order], extra[order]
        same = (g[1:] == g[:-1]) & (extra[1:] == extra[:-1])
        flags[p[1:][same]] = True
        flags[p[:-1][same]] = True

    def interval(q: np.ndarray, same: np.ndarray) -> None:
        g = last[0] + np.cumsum(same < need)
        last[0] = int(g[-1])
        cut_at = int(np.searchsorted(g, g[-1]))  # the last interval may go on
        if cut_at:
            held.append((q[:cut_at], g[:cut_at]))
            settle(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
        held.append((q[cut_at:], g[cut_at:]))

    picked = Picked(interval)

    def sorted_(q: np.ndarray, same: np.ndarray) -> None:
        of = np.minimum(np.searchsorted(cut, q, "right") - 1, len(size) - 1)
        picked(q, same, q + need <= cut[of] + n_words[of])

    suffixes(s, n_symbols, scratch, sorted_)
    if held:
        settle(*(np.concatenate(x) for x in zip(*held)))
    return flags


def sort_shard(batches):
    """One task's chunks in, (h, v, start, end) of their repeated bytes out."""
    folder = tempfile.mkdtemp(prefix="shard-")
    try:
        yield from _sorted_shard(batches, Scratch(folder, MEMORY))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        release()


def _sorted_shard(batches, scratch: Scratch):
    cols: list[list[np.ndarray]] = [[], [], [], [], []]
    total = 0
    with open(scratch.path(), "w+b") as file:
        for b in slices(batches):
            for k, name in enumerate(("h", "v", "n", "lead")):
                cols[k].append(b.column(name).to_numpy(zero_copy_only=False))
            data, off = T.buffers(b.column("chunk"))
            file.write(data.data)
            cols[4].append(total + off[:-1])
            total += len(data)
        if not cols[0]:
            return
        file.write(bytes(WORD))
    data = np.memmap(file.name, np.uint8, "r") if total > scratch.memory else np.fromfile(file.name, np.uint8)
    h, v, n, lead, off = (np.concatenate(x) for x in cols)
    size = np.append(off[1:], total) - off
    order = np.lexsort((v, h))
    new = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (v[order][1:] != v[order][:-1])]))
    count = np.add.reduceat(n[order], new)
    one = order[new]  # of equal chunks one
    by_place = np.argsort(one)
    one, count = one[by_place], count[by_place]
    h, v, lead, off, size = (x[one] for x in (h, v, lead, off, size))
    flags = repeated_windows(data, off, size, lead, scratch)
    for k in np.flatnonzero(count > 1):
        flags[off[k] : off[k] + size[k] - SPAN + 1] = True
    for a, z in T.parts(size, 4 << 20):
        part = np.asarray(flags[off[a] : off[z - 1] + size[z - 1] + 1]).view(np.int8)
        edge = np.flatnonzero(np.diff(part, prepend=0, append=0)) + off[a]
        start, end = edge[::2], edge[1::2]  # runs of window starts, none beyond a chunk
        if len(start):
            owner = np.searchsorted(off, start, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(h[owner]), pa.array(v[owner]), pa.array(start - off[owner]), pa.array(end - 1 + SPAN - off[owner])], names=["h", "v", "start", "end"])


def cut(texts: DataFrame, whole: bool) -> DataFrame:
    """(rk, n_removed, n_spans, kept_sha256) of texts with ``gone``, arrays of (start, end); with ``whole`` also the kept bytes."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        data, off = T.buffers(b.column("text"))
        out: list[list] = [[], [], [], []]
        for k, gone in enumerate(b.column("gone")):
            raw = data[off[k] : off[k + 1]]
            edge = np.zeros(len(raw) + 1, np.int64)
            pairs = gone.values
            np.add.at(edge, pairs.field("start").to_numpy(), 1)
            np.add.at(edge, pairs.field("end").to_numpy(), -1)
            keep = np.cumsum(edge[:-1]) == 0
            kept = raw[keep].tobytes()
            out[0].append(int((~keep).sum()))
            out[1].append(int((np.diff(np.concatenate([[True], keep]).astype(np.int8)) < 0).sum()))
            out[2].append(hashlib.sha256(kept).hexdigest())
            out[3].append(kept)
        arrays = [b.column("rk"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
        names = ["rk", "n_removed", "n_spans", "kept_sha256"]
        if whole:
            arrays, names = [*arrays, pa.array(out[3], pa.binary())], [*names, "kept"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return arrow_map(texts.select("rk", "text", "gone"), kernel, "rk long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * whole)


def _named(rows: DataFrame, level: int, hot: int, folder: str) -> tuple[DataFrame, bool]:
    """(rk, take, hot): of each text the names of a level that stand elsewhere too, and whether any is hot."""
    every = stored(names(rows, level), f"{folder}/names-{level}")
    is_hot = F.count(F.lit(1)) > hot if level + 1 < len(WIDTHS) else F.lit(False)
    both = every.groupBy("h").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi"), F.max("again").alias("again"), is_hot.alias("hot")).filter("lo < hi OR again").select("h", "hot")
    both = stored(both, f"{folder}/shared-{level}")
    mine = lambda c: F.collect_set(F.when(c, F.col("h")))
    sets = every.select("h", "rk").join(both, "h").groupBy("rk").agg(mine(~F.col("hot")).alias(f"take{level}"), mine(F.col("hot")).alias(f"hot{level}"))
    return sets, not both.filter("hot").isEmpty()


def byte_deduplicated(docs: DataFrame, whole: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row, with ``whole`` also the kept bytes as binary."""
    folder = shared_dir(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", F.xxhash64("doc_id", "text").alias("rk"), F.xxhash64("text").alias("c1"))
    heads = rows.select("doc_id", "rk", "c1", F.xxhash64(F.lit("text"), "text").alias("c2"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    heads = stored(heads, f"{folder}/heads")
    contents = stored(heads.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("copies"), F.min("rk").alias("rk")), f"{folder}/contents")
    sets, any_hot = _named(rows, 0, hot, folder)
    found = stored(sets.join(contents.select("rk"), "rk", "left_semi"), f"{folder}/found-0")
    levels = 1
    while any_hot:  # twice at most
        behind = rows.join(found.filter(F.size(f"hot{levels - 1}") > 0).select("rk", *(f"hot{k}" for k in range(levels))).hint("merge"), "rk")
        sets, any_hot = _named(behind, levels, hot, folder)
        found = found.join(sets, "rk", "left")
        for c in (f"take{levels}", f"hot{levels}"):
            found = found.withColumn(c, F.coalesce(c, F.array().cast("array<long>")))
        found = stored(found, f"{folder}/found-{levels}")
        levels += 1
    taken = [f"take{k}" for k in range(levels)]
    texts = rows.select("rk", "text").join(found.filter(sum(F.size(c) for c in taken) > 0).hint("merge"), "rk")
    n = found.agg(F.coalesce(F.sum(sum(F.size(c) for c in taken)), F.lit(0)).alias("n")).first()["n"]
    shards = chunks_of(texts, levels, False).repartition(max(1, -(-n // SHARD)), "h").mapInArrow(sort_shard, "h long, v long, start long, end long")
    gone = chunks_of(texts, levels, True).join(shards.hint("merge"), ["h", "v"]).select("rk", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"))
    gone = gone.groupBy("rk").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    done = cut(texts.join(gone.hint("merge"), "rk"), whole)
    out = heads.join(contents.select("c1", "c2", "copies"), ["c1", "c2"]).join(done.dropDuplicates(["rk"]), "rk", "left")
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= SPAN)
    pick = lambda all_, cut_, none: F.when(copy, all_).when(F.col("n_removed").isNotNull() & (F.col("copies") == 1), cut_).otherwise(none)
    cols = ["doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).alias("n_removed"), pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"), pick(F.lit(hashlib.sha256().hexdigest()), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256")]
    if whole:
        out = out.join(rows.select("rk", "text").dropDuplicates(["rk"]), "rk")
        cols.append(pick(F.lit(b""), F.col("kept"), F.col("text").cast("binary")).alias("kept"))
    return out.select(cols)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_deduplicated(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, md5(raw[i:i + 199]) AS h FROM (SELECT doc_id, raw, unnest(range(1, n - 198)) AS i FROM b WHERE n >= 200)),
r AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM k GROUP BY doc_id, run),
p AS (SELECT doc_id, coalesce(lag(z) OVER o, 1) AS a, a - 1 AS z FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY a) UNION ALL SELECT doc_id, max(z), NULL FROM s GROUP BY doc_id),
t AS (SELECT b.doc_id, unhex(string_agg(CASE WHEN coalesce(p.z, n) >= p.a THEN hex(raw[p.a:coalesce(p.z, n)]) ELSE '' END, '' ORDER BY p.a)) AS kept FROM p JOIN b ON b.doc_id = p.doc_id GROUP BY b.doc_id)
SELECT b.doc_id, n AS n_bytes, CAST(coalesce(x.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(x.spans, 0) AS BIGINT) AS n_spans, sha256(CASE WHEN x.spans IS NULL THEN raw ELSE t.kept END) AS kept_sha256
FROM b LEFT JOIN (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM s GROUP BY doc_id) x ON x.doc_id = b.doc_id LEFT JOIN t ON t.doc_id = b.doc_id
"""
