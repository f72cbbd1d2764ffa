"""Byte-level BPE with a hierarchical-bitmap rank queue, over all new pre-tokens of a batch at once.

The bytes of the pre-tokens lie side by side in one linked list of parts (links end at each pre-token's ends).
Buckets, one per merge rank, hold list positions. A bitmap marks the ranks whose bucket is not empty, a bitmap
above it the words of that bitmap that are not zero, and so on; find-first-set from the top gives the lowest
rank in a step per level. The bucket's entries whose pair has changed since are stale and are skipped; the rest
are merged together, overlapping ones from the left. Every merge gives at most two new entries, so the work is
near-linear in the bytes and one very long pre-token costs no more than many short ones.

Merging a whole bucket is right where the merged token forms no pair of a lower rank. Tokens that can form one
are listed when a table is read; of their bucket only the leftmost entry of each pre-token is merged at a time.

Each Python worker reads the rank table once and keeps ids of short pre-tokens in a bounded table.
The operator is one map over Arrow batches without shuffle. Null texts count as empty; each row is encoded on
its own, repeated rows included.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import keyed, table

BITS = 8
WIDTH = 1 << BITS  # bits in a word of the bitmaps
ROWS = 1000  # texts encoded at a time
KEPT, KEPT_CHARS = 250_000, 48  # entries of a worker's pre-token table, and the longest pre-token that it keeps
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class RankQueue:
    """Arrays of positions by merge rank; ``pop`` gives the lowest rank with all its entries."""

    def __init__(self, n_ranks: int) -> None:
        self.levels: list[list[int]] = []
        while True:
            n_ranks = -(-n_ranks // WIDTH)
            self.levels.append([0] * n_ranks)
            if n_ranks <= 1:
                break
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for words in self.levels:
            bit = 1 << (rank & WIDTH - 1)
            rank >>= BITS
            was = words[rank]
            words[rank] = was | bit
            if was:
                return

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if len(ranks) == 1:
            return self.push(int(ranks[0]), positions)
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for a, b, r in zip([0, *cut.tolist()], [*cut.tolist(), len(ranks)], ranks[np.concatenate([[0], cut])].tolist()):
            self.push(r, positions[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        i = 0
        for words in reversed(self.levels):
            if not (w := words[i]):
                return None
            i = (i << BITS) + (w & -w).bit_length() - 1
        bucket, at = self.buckets.pop(i), i
        for words in self.levels:
            bit = 1 << (at & WIDTH - 1)
            at >>= BITS
            words[at] ^= bit
            if words[at]:
                break
        return i, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class BytePairEncoder:
    """Encode and decode by a rank table; pre-tokens are the matches of ``pattern``, each merged separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.decoder = ranks, {v: k for k, v in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys = np.array([(a << 32 | b, r) for a, b, r in pairs], np.int64).reshape(-1, 2)
        self.turns = {x for a, b, r in pairs for x in (a, b) if x > r}
        keys = keys[np.argsort(keys[:, 0])]
        self.pair_key, self.pair_rank = np.append(keys[:, 0], np.int64(2**62)), np.append(keys[:, 1], np.int64(-1))
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, or -1."""
        key = left << 32 | right
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def _lower(self, rank: int, i: np.ndarray, tok: np.ndarray, after: np.ndarray, before: np.ndarray) -> bool:
        """Whether merging the pairs at ``i`` could form a pair of a rank below theirs at any point."""
        k, p, own = after[after[i]], before[i], np.int64(rank)
        sides = np.unique(np.append(tok[k[k < len(tok)]], own)), np.unique(np.append(tok[p[p >= 0]], own))
        got = np.concatenate([self._rank(np.full(len(sides[0]), own), sides[0]), self._rank(sides[1], np.full(len(sides[1]), own))])
        return bool(((got >= 0) & (got < rank)).any())

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each pre-token; none may be empty."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, ends = len(data), np.cumsum([len(p) for p in pieces])
        tok = self.byte[data]
        after, before = np.arange(1, n + 1), np.arange(-1, n)  # before has a slot for the end, which takes what nobody reads
        after[ends - 1] = n
        before[ends] = -1
        before[0] = -1
        pair, dead, queue = np.full(n, -1, np.int64), np.zeros(n, bool), self.queue
        left = np.flatnonzero(after < n)
        pair[left] = self._rank(tok[left], tok[left + 1])
        left = left[pair[left] >= 0]
        if len(left):
            queue.push_all(pair[left], left)
        while (top := queue.pop()) is not None:
            rank, i = top
            i = i[pair[i] == rank]  # the others are stale
            if len(i) > 1:
                i = np.unique(i)
                if (meets := after[i[:-1]] == i[1:]).any():  # of overlapping pairs, every second one from the left
                    new = np.flatnonzero(np.concatenate([[True], ~meets]))
                    i = i[(np.arange(len(i)) - np.repeat(new, np.diff(np.append(new, len(i))))) % 2 == 0]
                if rank in self.turns and self._lower(rank, i, tok, after, before):  # only the first of each pre-token is merged now
                    first = np.unique(np.searchsorted(ends, i, "right"), return_index=True)[1]
                    if len(first) < len(i):
                        queue.push(rank, np.delete(i, first))
                        i = i[first]
            elif not len(i):
                continue
            j = after[i]
            k = after[j]
            tok[i] = rank
            after[i] = k
            before[k] = i
            dead[j] = True
            pair[j] = pair[i] = -1
            a = i[k < n]
            p = before[i]
            a = np.concatenate([a, p[p >= 0]])
            if len(a):
                r = self._rank(tok[a], tok[after[a]])
                fresh = (r >= 0) & (r != pair[a])
                pair[a] = r
                if fresh.any():
                    queue.push_all(r[fresh], a[fresh])
        live = np.zeros(n + 1, np.int64)
        np.cumsum(~dead, out=live[1:])
        ids, cut = tok[~dead].astype("<u4").tobytes(), (live[ends] * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *cut], cut)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        known, ranks = self.known, self.ranks
        if len(known) > KEPT:
            known.clear()
        found = [self.find(t) for t in texts]
        new = list(set().union(*found).difference(known))
        raw = [p.encode() for p in new]
        ids = dict(zip(new, (np.array([ranks[r]], "<u4").tobytes() if r in ranks else b"" for r in raw)))
        rest = [k for k, p in enumerate(new) if not ids[p]]
        if rest:
            ids.update(zip((new[k] for k in rest), self.merge([raw[k] for k in rest])))
        known.update(ids)
        out = [b"".join(map(known.__getitem__, f)) for f in found]
        for p in new:
            if len(p) > KEPT_CHARS:
                del known[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.decoder.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(raw: bytes, pattern: str) -> BytePairEncoder:
    return BytePairEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, pattern)


def _groups(texts: list[str], most: int = 2 << 20):
    """Runs of texts of about ``most`` characters, so that a batch of long texts does not stand in memory at once."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def byte_bpe(docs: DataFrame, ranks: bytes, pattern: str, tokens: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ``tokens`` also the ids as array<int>.

    ``ranks`` is the content of a rank file (base64 token, rank): a vocabulary of fixed size, broadcast once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        enc = encoder(sent.value, pattern)
        for b in batches:
            for a in range(0, b.num_rows, ROWS):
                part, n, ids_sha, text_sha, ids = b.slice(a, ROWS), [], [], [], []
                for texts in _groups(part.column("text").to_pylist()):
                    for got in enc.encode_all(texts):
                        n.append(len(got) // 4)
                        ids_sha.append(hashlib.sha256(got).hexdigest())
                        text_sha.append(hashlib.sha256(enc.decode(got)).hexdigest())
                        if tokens:
                            ids.append(np.frombuffer(got, "<i4"))
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if tokens:
                    cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return keyed(docs).mapInArrow(run, SCHEMA + ", ids array<int>" * tokens)


def public_ranks(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """A public rank file's content and the pre-token pattern that goes with it (read on the driver)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"), *public_ranks())
