"""Similarity of embeddings, and rank fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import Down, ranked

SLICE = 64  # queries whose similarities with a block of items are held at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(queries: DataFrame, items: DataFrame, k: int = 10, block: int = 1024, items_block: int = 16384) -> DataFrame:
    """(query, item, similarity): the k items of highest cosine for each query, exact.

    Queries and items (id, vector) are dealt into blocks; a block of queries meets a block of items in one group, whose cosines are one
    matrix product, a slice of queries at a time, and passes on its own k best for each query. Rows are copied once for each block of the other side.
    """
    n, m = queries.count(), items.count()
    nq, ni = -(-n // block) or 1, -(-m // items_block) or 1
    own = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    q = queries.select(own(nq).alias("i"), every(ni).alias("j"), F.col("id").cast("long").alias("id"), "vector")
    v = items.select(every(nq).alias("i"), own(ni).alias("j"), F.col("id").cast("long").alias("id"), "vector")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = (np.array(t.column("vector").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1) for t in (a, b))
        ids, others = a.column("id").to_numpy(), b.column("id").to_numpy()
        if not len(ids) or not len(others):
            return pa.table({"query": pa.array([], pa.int64()), "item": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        order = np.argsort(others)
        x, y = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300) for z in (x, y[order]))
        found = [], [], []
        for c in range(0, len(ids), SLICE):
            s = np.round(x[c : c + SLICE] @ y.T, 12)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            for out, part in zip(found, (np.repeat(ids[c : c + SLICE], top.shape[1]), others[order][top].ravel(), np.take_along_axis(s, top, 1).ravel())):
                out.append(part)
        return pa.table(dict(zip(("query", "item", "similarity"), map(np.concatenate, found))))

    found = q.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInArrow(best, "query long, item long, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "item")
    return found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).drop("n")


def fused(a: DataFrame, b: DataFrame, alpha: float = 0.5, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two scored lists (id, score): alpha / (k + rank) + (1 - alpha) / (k + rank)."""
    both = ranked(a.select("id", "score"), [Down("score"), "id"], "ra").drop("score").join(ranked(b.select("id", "score"), [Down("score"), "id"], "rb").drop("score"), "id", "full")
    part = lambda w, c: F.coalesce(F.lit(w) / (k + F.col(c)), F.lit(0.0))
    return both.select("id", (part(alpha, "ra") + part(1 - alpha, "rb")).alias("score"))
