"""SPARQL Update: each operation gives a new set of quads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import QUAD


def insert_data(quads: DataFrame, new: DataFrame) -> DataFrame:
    return quads.select(QUAD).unionByName(new.select(QUAD)).distinct()


def delete_data(quads: DataFrame, gone: DataFrame) -> DataFrame:
    return quads.join(gone.select(QUAD).distinct(), QUAD, "left_anti").select(QUAD)


def modify(quads: DataFrame, delete: DataFrame | None, insert: DataFrame | None) -> DataFrame:
    """DELETE/INSERT WHERE: both templates come from the same solutions; deletions go first."""
    out = quads if delete is None else delete_data(quads, delete)
    return out if insert is None else insert_data(out, insert)


def clear(quads: DataFrame, graph: str | None = None, named: bool = False) -> DataFrame:
    """One graph (the default one: ""), all ``named`` ones, or all."""
    return quads.filter(F.col("g") == "") if named else quads.filter(F.lit(False)) if graph is None else quads.filter(F.col("g") != graph)


def _moved(quads: DataFrame, source: str, target: str) -> DataFrame:
    return quads.filter(F.col("g") == source).withColumn("g", F.lit(target))


def add(quads: DataFrame, source: str, target: str) -> DataFrame:
    return insert_data(quads, _moved(quads, source, target))


def copy(quads: DataFrame, source: str, target: str) -> DataFrame:
    return quads if source == target else clear(quads, target).select(QUAD).unionByName(_moved(quads, source, target).select(QUAD))


def move(quads: DataFrame, source: str, target: str) -> DataFrame:
    return quads if source == target else clear(copy(quads, source, target), source)


def graphs(quads: DataFrame) -> DataFrame:
    """(g, triples) of the named graphs."""
    return quads.filter(F.col("g") != "").groupBy("g").agg(F.count(F.lit(1)).alias("triples"))


def find(quads: DataFrame, s=None, p: str | None = None, o=None, g: str | None = None) -> DataFrame:
    """Quads by pattern; None is a wildcard."""
    from ..terms import constant

    for name, x in (("s", s), ("o", o)):
        if x is not None:
            quads = quads.filter(F.col(name) == constant(x))
    for name, x in (("p", p), ("g", g)):
        if x is not None:
            quads = quads.filter(F.col(name) == x)
    return quads.select(QUAD)


def erase_subject(quads: DataFrame, subject: str) -> DataFrame:
    """Every quad that names the term as subject or object."""
    from ..terms import constant

    return quads.filter((F.col("s") != constant(subject)) & (F.col("o") != constant(subject))).select(QUAD)


def conflict_resolved(quads: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Of several graphs' values of a subject and predicate, those of the graph of highest priority."""
    rank = F.coalesce(*[F.when(F.col("g") == g, F.lit(n)) for g, n in priority.items()], F.lit(-1))
    ranked = quads.withColumn("_r", rank)
    best = ranked.groupBy("s", "p").agg(F.max("_r").alias("_r"))
    return ranked.join(best, ["s", "p", "_r"]).select(QUAD)
