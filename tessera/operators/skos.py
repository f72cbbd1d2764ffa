"""SKOS concept schemes: hierarchy with depths, siblings, labels, integrity and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import fixpoint
from ..terms import SKOS
from .algebra import same


def broader(quads: DataFrame) -> DataFrame:
    """(x, y): y is a broader concept of x, by ``broader`` or ``narrower``."""
    up = quads.filter(F.col("p") == SKOS + "broader").select(F.col("s").alias("x"), F.col("o").alias("y"))
    return up.unionByName(quads.filter(F.col("p") == SKOS + "narrower").select(F.col("o").alias("x"), F.col("s").alias("y"))).distinct()


def ancestors(quads: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """(x, y, depth): every broader concept y of x, at its least distance; of the ``concepts`` (column x) only, if given."""
    up = broader(quads)
    seed = up if concepts is None else up.join(concepts, "x", "left_semi")
    link = up.withColumnsRenamed({"x": "m", "y": "y2"})
    step = lambda new, _: new.join(link, same(F.col("y"), F.col("m"))).select("x", F.col("y2").alias("y"), (F.col("depth") + 1).alias("depth"))
    return fixpoint(seed.withColumn("depth", F.lit(1)), step, ["x", "y"])


def siblings(quads: DataFrame) -> DataFrame:
    """(x, y): different concepts with a broader concept in common."""
    up = broader(quads)
    return up.join(up.select(F.col("x").alias("z"), "y"), "y").filter(~same(F.col("x"), F.col("z"))).select("x", F.col("z").alias("y")).distinct()


def labels(quads: DataFrame, languages: list[str]) -> DataFrame:
    """(x, label): the preferred label of each concept in the first of the languages that it has, any other one else; alternative labels last."""
    rows = quads.filter(F.col("p").isin(SKOS + "prefLabel", SKOS + "altLabel"))
    order = F.coalesce(*[F.when(F.lower("o.lang") == t, F.lit(k)) for k, t in enumerate(languages)], F.lit(len(languages)))
    ranked = rows.select(F.col("s").alias("x"), F.col("o").alias("label"), (F.col("p") == SKOS + "altLabel").alias("alt"), order.alias("rank"))
    w = Window.partitionBy("x").orderBy("alt", "rank", "label.v", "label.lang")
    return ranked.withColumn("n", F.row_number().over(w)).filter("n = 1").select("x", "label")


def violations(quads: DataFrame) -> DataFrame:
    """(x, rule, y) by SKOS's integrity conditions: two preferred labels of a language, a label of two kinds, related concepts
    one of which is broader, and concepts broader than themselves."""
    pref, alt = (quads.filter(F.col("p") == SKOS + k).select(F.col("s").alias("x"), F.col("o").alias("y")) for k in ("prefLabel", "altLabel"))
    up = ancestors(quads).select("x", "y")
    twice = pref.groupBy("x", F.col("y.lang").alias("lang")).agg(F.count_distinct("y").alias("n"), F.max("y").alias("y")).filter("n > 1").select("x", F.lit("two prefLabels of a language").alias("rule"), "y")
    related = quads.filter(F.col("p") == SKOS + "related").select(F.col("s").alias("x"), F.col("o").alias("y"))
    either = related.unionByName(related.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    named = lambda rows, rule: rows.select("x", F.lit(rule).alias("rule"), "y")
    return reduce(DataFrame.unionByName, [twice, named(pref.join(alt, ["x", "y"], "left_semi").distinct(), "label of two kinds"), named(either.join(up, ["x", "y"], "left_semi"), "related and broader"), named(up.filter(same(F.col("x"), F.col("y"))), "broader than itself")])


def coverage(quads: DataFrame, tagged: DataFrame) -> DataFrame:
    """(y, direct, below): how many things in ``tagged`` (thing, x) bear a concept, and how many it or a narrower one."""
    own = tagged.groupBy(F.col("x").alias("y")).agg(F.count_distinct("thing").alias("direct"))
    all_up = tagged.select("thing", F.col("x").alias("y")).unionByName(tagged.join(ancestors(quads).select("x", "y"), "x").select("thing", "y")).distinct()
    return all_up.groupBy("y").agg(F.count(F.lit(1)).alias("below")).join(own, "y", "left").select("y", F.coalesce("direct", F.lit(0).cast("long")).alias("direct"), "below")
