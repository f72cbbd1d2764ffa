"""Uncertain statements, entity resolution and private release."""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .analytics import components


def noisy_or(c: Column) -> Column:
    """1 - product of (1 - c) over a group; a certain statement makes the whole certain."""
    return F.when(F.max(c) >= 1.0, 1.0).otherwise(1 - F.exp(F.sum(F.log1p(-F.when(c < 1.0, c).otherwise(0.0)))))


def bayes(prior: Column, likelihood_ratio: Column) -> Column:
    """Posterior in odds form: l p / (l p + 1 - p)."""
    return likelihood_ratio * prior / (likelihood_ratio * prior + 1 - prior)


def blocked_pairs(records: DataFrame, block: Column, key: str = "id") -> DataFrame:
    """(block, a, b): pairs with the same blocking key, in order. Choose keys whose groups are small."""
    rows = records.select(block.alias("block"), F.col(key).alias("id"), F.struct("*").alias("r")).filter("block IS NOT NULL")
    return rows.alias("x").join(rows.alias("y"), F.col("x.block") == F.col("y.block")).filter("x.id < y.id").select(F.col("x.block").alias("block"), F.col("x.r").alias("a"), F.col("y.r").alias("b"))


def resolved(records: DataFrame, block: Column, similarity, threshold: float, key: str = "id") -> DataFrame:
    """(id, entity): records of one block that are alike enough, closed transitively; the entity is the least id."""
    pairs = blocked_pairs(records, block, key)
    alike = pairs.filter(similarity(F.col("a"), F.col("b")) >= threshold)
    linked = components(alike.select(F.col(f"a.{key}").alias("src"), F.col(f"b.{key}").alias("dst")))
    return records.select(F.col(key).alias("id")).join(linked.select(F.col("node").alias("id"), F.col("component").alias("entity")), "id", "left").withColumn("entity", F.coalesce("entity", "id"))


def evaluated(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (tp, fp, fn, precision, recall, f1) of pairs (a, b)."""
    both = found.select("a", "b").distinct().withColumn("f", F.lit(1)).join(truth.select("a", "b").distinct().withColumn("t", F.lit(1)), ["a", "b"], "full")
    n = both.agg(F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("f").isNull(), 1)).alias("fn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select("*", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def canonicalised(quads: DataFrame, same: DataFrame) -> DataFrame:
    """``quads`` with each term of a sameAs class (src, dst of IRIs) replaced by the least one."""
    rep = components(same)
    out = quads
    for side in ("s", "o"):
        r = rep.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        out = out.join(r, (out[side]["v"] == F.col("_n")) & (out[side]["k"] == 0), "left").withColumn(side, F.when(F.col("_c").isNull(), F.col(side)).otherwise(F.col(side).withField("v", F.col("_c")))).drop("_n", "_c")
    return out.distinct()


def bloom_encoded(df: DataFrame, column: str, key: str, k: int = 10, bits: int = 512) -> DataFrame:
    """``df`` with ``bloom``: the column's padded bigrams set k HMAC-SHA256 positions each, as longs of 64 bits."""
    secret = key.encode()

    def encode(text: str | None) -> list[int] | None:
        if text is None:
            return None
        padded, words = f"_{text.lower()}_", [0] * (bits // 64)
        for i in range(len(padded) - 1):
            d = hmac.new(secret, padded[i : i + 2].encode(), hashlib.sha256).digest()
            a, b = int.from_bytes(d[:8], "big"), int.from_bytes(d[8:16], "big") | 1
            for n in range(k):
                at = (a + n * b) % bits
                words[at // 64] |= 1 << (at % 64)
        return [w - (1 << 64) if w >> 63 else w for w in words]

    names = df.columns

    def run(batches):
        for b in batches:
            made = pa.array([encode(x) for x in b.column(column).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*names, "bloom"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("bloom", ArrayType(LongType()))]))


def laplace(epsilon: float, seed: int | None = None) -> Column:
    """Noise of scale 1 / epsilon, 0 < epsilon <= 10."""
    if not 0 < epsilon <= 10:
        raise ValueError("epsilon must be in (0, 10]")
    u = (F.rand() if seed is None else F.rand(seed)) - 0.5
    return -F.signum(u) * F.log1p(-2 * F.abs(u)) / epsilon


def noisy_count(df: DataFrame, epsilon: float, seed: int | None = None) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") + laplace(epsilon, seed)).alias("noisy_count"))


def noisy_histogram(df: DataFrame, column: str, epsilon: float, seed: int | None = None) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).select(column, (F.col("n") + laplace(epsilon, seed)).alias("noisy_count"))
