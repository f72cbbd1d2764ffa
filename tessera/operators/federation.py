"""Access by graph, quotas, provenance and semi-join tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import algebra as A
from ..store import QUAD


def visible(quads: DataFrame, grants: DataFrame, role: str) -> DataFrame:
    """The default graph and the graphs that ``grants`` (role, g) opens to the role."""
    mine = grants.filter(F.col("role") == role).select("g").distinct()
    return quads.filter(F.col("g") == "").select(QUAD).unionByName(quads.join(mine, "g").select(QUAD))


def quota(quads: DataFrame, limits: DataFrame) -> DataFrame:
    """(g, triples, quota, over) of the graphs with a limit (g, quota)."""
    n = quads.groupBy("g").agg(F.count(F.lit(1)).alias("triples"))
    return limits.join(n, "g", "left").select("g", F.coalesce("triples", F.lit(0)).cast("long").alias("triples"), "quota", (F.coalesce("triples", F.lit(0)) > F.col("quota")).alias("over"))


def provenance(quads: DataFrame, source: str, agent: str) -> DataFrame:
    """PROV-O statements about each named graph: what it was derived from and who loaded it."""
    prov = "http://www.w3.org/ns/prov#"
    rows = quads.filter(F.col("g") != "").select(A.iri(F.col("g")).alias("x")).distinct()
    return A.construct(rows, [("?x", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", f"<{prov}Entity>"), ("?x", prov + "wasDerivedFrom", f"<{source}>"), ("?x", prov + "wasAttributedTo", f"<{agent}>")])


def semi_joined(quads: DataFrame, p1: str, p2: str, kind: str = "SS") -> DataFrame:
    """The statements of p1 that join with some of p2: subject-subject, object-subject or subject-object. Store it where a pair of predicates is often joined."""
    a, b = {"SS": ("s", "s"), "OS": ("o", "s"), "SO": ("s", "o")}[kind]
    other = quads.filter(F.col("p") == p2).select(F.col(b).alias(a)).distinct()
    return quads.filter(F.col("p") == p1).join(other, a, "left_semi").select(QUAD)


def summary(quads: DataFrame) -> DataFrame:
    """(class, predicate, subjects, triples): the schema that the data show."""
    from ..terms import TYPE

    cls = quads.filter(F.col("p") == TYPE).select("s", F.col("o.v").alias("class"))
    return quads.filter(F.col("p") != TYPE).join(cls, "s").groupBy("class", F.col("p").alias("predicate")).agg(F.count_distinct("s").alias("subjects"), F.count(F.lit(1)).alias("triples"))
