"""Property paths: pairs (s, o) of terms. Closures run as a semi-naive fixpoint whose path lengths double each round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import fixpoint


def link(quads: DataFrame, p: str) -> DataFrame:
    return quads.filter(F.col("p") == p).select("s", "o")


def inverse(path: DataFrame) -> DataFrame:
    return path.select(F.col("o").alias("s"), F.col("s").alias("o"))


def sequence(*paths: DataFrame) -> DataFrame:
    step = lambda a, b: a.withColumnRenamed("o", "m").join(b.withColumnRenamed("s", "m"), "m").select("s", "o")
    return reduce(step, paths)


def alternative(*paths: DataFrame) -> DataFrame:
    """A bag, as the specification has it."""
    return reduce(DataFrame.unionByName, paths)


def negated(quads: DataFrame, *predicates: str) -> DataFrame:
    return quads.filter(~F.col("p").isin(*predicates)).select("s", "o")


def nodes(quads: DataFrame) -> DataFrame:
    """Every subject and object as a pair with itself."""
    ends = quads.select("s").unionByName(quads.select(F.col("o").alias("s"))).distinct()
    return ends.select("s", F.col("s").alias("o"))


def zero_or_one(path: DataFrame, quads: DataFrame) -> DataFrame:
    return path.unionByName(nodes(quads)).distinct()


def one_or_more(path: DataFrame, start: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """Distinct reachable pairs. From given ``start`` terms (column ``s``) only their frontier is followed, link by link;
    so it is with a ``max_depth``."""
    path = path.distinct()
    if start is not None or max_depth is not None:
        seed = path if start is None else path.join(start.select("s").distinct(), "s", "left_semi")
        return fixpoint(seed.select("s", "o"), lambda new, _: sequence(new, path), ["s", "o"], None if max_depth is None else max_depth - 1)
    return fixpoint(path, lambda new, all_: sequence(new, all_).unionByName(sequence(all_, new)), ["s", "o"])


def zero_or_more(path: DataFrame, quads: DataFrame) -> DataFrame:
    return one_or_more(path).unionByName(nodes(quads)).distinct()


def confident(quads: DataFrame, confidence: DataFrame, p: str, least: float) -> DataFrame:
    """Closure over links of at least the given confidence; ``confidence``: (s, p, o, confidence), the highest counts, none is 1."""
    best = confidence.groupBy("s", "p", "o").agg(F.max("confidence").alias("c"))
    edges = quads.filter(F.col("p") == p).join(best, ["s", "p", "o"], "left").filter(F.coalesce("c", F.lit(1.0)) >= least)
    return one_or_more(edges.select("s", "o"))
