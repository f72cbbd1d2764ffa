"""Full-text search over literals: an inverted index as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..terms import LITERAL


def index(quads: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """(word, s, p, tf): lower-cased words of letters and digits of the literals. Store it partitioned or sorted by word."""
    rows = quads.filter((F.col("o")["k"] == LITERAL) & (F.col("o")["dt"] == ""))
    rows = rows if predicates is None else rows.filter(F.col("p").isin(predicates))
    words = F.filter(F.split(F.lower(F.col("o.v")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return rows.select("s", "p", F.explode(words).alias("word")).groupBy("word", "s", "p").agg(F.count(F.lit(1)).alias("tf"))


def search(idx: DataFrame, query: str, every: bool = True) -> DataFrame:
    """(s, score): subjects with all words of the query (or any), scored by the sum of log(1 + tf)."""
    words = sorted({w for w in query.lower().split() if w})
    hits = idx.filter(F.col("word").isin(words)).groupBy("s").agg(F.count_distinct("word").alias("n"), F.sum(F.log1p("tf")).alias("score"))
    return hits.filter(F.col("n") == len(words)).drop("n") if every else hits.drop("n")


def one_edit_keys(name: Column) -> Column:
    """The name and all that it becomes by the loss of one character: names within one edit of each other share a key."""
    cut = lambda k: F.concat(F.substr(name, F.lit(1), k - 1), F.substr(name, k + 1))
    return F.array_distinct(F.concat(F.array(name), F.when(F.length(name) > 0, F.transform(F.sequence(F.lit(1), F.length(name)), cut)).otherwise(F.array().cast("array<string>"))))


def duplicates(records: DataFrame, rank: DataFrame, similarity, threshold: float, block: str, keys=None) -> DataFrame:
    """(keep, drop, similarity): fuzzy duplicates within a block; the one of higher rank (node, rank) is kept.

    Without ``keys`` all pairs of a block are compared. ``keys``: a function from a name to an array such that names of ``threshold`` or
    more share an entry; then only these are compared, each two different names of a block once, however many records bear them."""
    r = records.join(rank.withColumnsRenamed({"node": "id"}), "id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    if keys is None:
        both = r.alias("a").join(r.alias("b"), (F.col(f"a.{block}") == F.col(f"b.{block}")) & (F.col("a.id") < F.col("b.id")))
        both = both.withColumn("_similarity", similarity(F.col("a.name"), F.col("b.name")))
    else:
        names = r.select(block, "name").filter(F.col(block).isNotNull() & F.col("name").isNotNull()).distinct()
        keyed = names.select(block, "name", F.explode(keys(F.col("name"))).alias("_key"))
        met = keyed.withColumnRenamed("name", "_a").join(keyed.withColumnRenamed("name", "_b"), [block, "_key"]).select(block, "_a", "_b").distinct()
        s = similarity(F.col("_a"), F.col("_b"))
        alike = met.withColumn("_similarity", s).filter(F.col("_similarity") >= threshold)
        left, right = r.alias("a"), r.alias("b")
        both = alike.join(left, (F.col("a.name") == F.col("_a")) & (F.col(f"a.{block}") == alike[block]))
        both = both.join(right, (F.col("b.name") == F.col("_b")) & (F.col(f"b.{block}") == alike[block]) & (F.col("a.id") < F.col("b.id")))
    first = (F.col("a.rank") > F.col("b.rank")) | ((F.col("a.rank") == F.col("b.rank")) & (F.col("a.id") < F.col("b.id")))
    pairs = both.select(F.when(first, F.col("a.id")).otherwise(F.col("b.id")).alias("keep"), F.when(first, F.col("b.id")).otherwise(F.col("a.id")).alias("drop"), F.col("_similarity").alias("similarity"))
    return pairs.filter(F.col("similarity") >= threshold)


def neighbourhood(quads: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(s, p, o, g, hop): statements within ``hops`` links of the terms in ``seeds`` (column ``x``), in either direction."""
    seen = near = seeds.select("x").distinct()
    out = None
    for k in range(1, hops + 1):
        a = quads.join(near.withColumnRenamed("x", "s"), "s", "left_semi").unionByName(quads.join(near.withColumnRenamed("x", "o"), "o", "left_semi")).distinct().withColumn("hop", F.lit(k))
        out = a if out is None else out.unionByName(a)
        ends = a.select(F.explode(F.array("s", "o")).alias("x")).distinct().join(seen, "x", "left_anti")
        seen, near = seen.unionByName(ends), ends
    return out.groupBy("s", "p", "o", "g").agg(F.min("hop").alias("hop"))
