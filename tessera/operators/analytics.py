"""Graph analytics over edges (src, dst[, weight]) of strings or longs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..store import remove_dir, shared_dir, stored
from ..terms import IRI


def edges(quads: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """Distinct IRI links."""
    rows = quads.filter(F.col("o")["k"] == IRI)
    if predicates:
        rows = rows.filter(F.col("p").isin(predicates))
    return rows.select(F.col("s.v").alias("src"), F.col("o.v").alias("dst")).distinct()


def pagerank(edges: DataFrame, damping: float = 0.85, max_rounds: int = 100, delta: float = 1e-4, direction: str = "forward", seeds: DataFrame | None = None) -> DataFrame:
    """(node, rank), summing to 1. Dangling mass is spread like the teleport, evenly or over ``seeds`` (column ``node``).

    Links and out-degrees are stored once and kept dealt and sorted by source, so that a round moves ranks and contributions only. A round is one
    job: a join and an aggregate, written to the shared folder, with the largest change and the dangling mass observed on the way.
    """
    spark = edges.sparkSession
    folder = shared_dir(spark)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    edges = {"forward": edges, "reverse": back, "both": edges.unionByName(back)}[direction].select("src", "dst").distinct()
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = stored(edges.join(degree, "src"), f"{folder}/links")
    dealt = links.select("src", "dst").repartition(parts, "src").sortWithinPartitions("src").persist()
    nodes = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct()
    nodes = nodes.join(degree.select(F.col("src").alias("node"), "n"), "node", "left")
    if seeds is not None:
        nodes = nodes.join(seeds.select("node", F.lit(True).alias("seed")).distinct(), "node", "left")
    else:
        nodes = nodes.withColumn("seed", F.lit(True))
    nodes = stored(nodes, f"{folder}/nodes")
    total, seeded = nodes.agg(F.count(F.lit(1)), F.count("seed")).first()
    if not total:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    jump = F.when(F.col("seed"), 1.0 / max(1, seeded)).otherwise(0.0)
    ranks = stored(nodes.select("node", "n", "seed", F.lit(1.0 / total).alias("rank")), f"{folder}/0")
    lost = nodes.filter("n IS NULL").count() / total
    for k in range(1, max_rounds + 1):
        share = ranks.filter("n IS NOT NULL").select(F.col("node").alias("src"), (F.col("rank") / F.col("n")).alias("share"))
        given = dealt.join(share, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("given"))
        new = (1 - damping) * jump + damping * (F.coalesce("given", F.lit(0.0)) + lost * jump)
        after = ranks.join(given, "node", "left").select("node", "n", "seed", new.alias("rank"), F.abs(new - F.col("rank")).alias("change"))
        seen = Observation()
        after = stored(after.observe(seen, F.max("change").alias("change"), F.sum(F.when(F.col("n").isNull(), F.col("rank")).otherwise(0.0)).alias("lost")), f"{folder}/{k}")
        change, lost = seen.get["change"], seen.get["lost"]
        remove_dir(spark, f"{folder}/{k - 1}")
        ranks = after.drop("change")
        if change < delta:
            break
    dealt.unpersist()
    return ranks.select("node", "rank")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): the seeds (column ``node``) and all nodes to which links lead from them."""
    from ..store import fixpoint

    links = edges.select(F.col("src").alias("node"), F.col("dst").alias("_to"))
    return fixpoint(seeds.select("node").distinct(), lambda new, _: new.join(links, "node").select(F.col("_to").alias("node")), ["node"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component), the component named by its least node: alternating large and small stars."""
    spark = edges.sparkSession
    folder, k, last = shared_dir(spark), 0, None
    alone = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    star = stored(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), f"{folder}/0")
    while True:
        k += 1
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hop = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        star = stored(large.join(low, "a").select(F.inline(hop)).filter("a <> b").distinct(), f"{folder}/{k}")
        now = tuple(star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if k > 1:
            remove_dir(spark, f"{folder}/{k - 2}")
        if now == last:
            return alone.join(star.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
        last = now


def centrality(edges: DataFrame, kind: str) -> DataFrame:
    """(node, score) of the degree proxies: degree share, mean closeness, in-degree over sources."""
    degree = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    if kind == "eigenvector":
        sources = edges.agg(F.count_distinct("src").alias("n"))
        return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("d")).crossJoin(F.broadcast(sources)).select("node", (F.col("d") / F.col("n")).alias("score"))
    total = degree.agg(F.sum("d").alias("total"), F.count(F.lit(1)).alias("n"))
    rows = degree.crossJoin(F.broadcast(total))
    return rows.select("node", (F.col("d") / F.col("total") if kind == "betweenness" else (F.col("n") - 1) / F.col("total")).alias("score"))


def katz(edges: DataFrame, alpha: float = 0.01, rounds: int = 10) -> DataFrame:
    """(node, score): x = alpha A' x + 1, a fixed number of rounds."""
    folder = shared_dir(edges.sparkSession)
    x = stored(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("score", F.lit(1.0)), f"{folder}/0")
    for k in range(1, rounds + 1):
        got = edges.join(x.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("score").alias("in"))
        x = stored(x.select("node").join(got, "node", "left").select("node", (1 + alpha * F.coalesce("in", F.lit(0.0))).alias("score")), f"{folder}/{k}")
    return x


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) once each: edges point from lower to higher degree, so no node's out-list is long.

    Links and out-lists are stored once. A link u -> x carries what follows x in u's list to x, where x's own list meets it: a row a link, not one
    a pair of links, is shuffled and sorted, and only closed pairs become rows. What is sent is many times the stored lists' size on disk, by which
    Spark would judge it and broadcast it through the driver, so a merge join is asked for.
    """
    folder = shared_dir(edges.sparkSession)
    e = stored(edges.filter("src <> dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct(), f"{folder}/links")
    degree = e.select(F.explode(F.array("x", "y")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    named = e.join(degree.select(F.col("v").alias("x"), F.col("d").alias("dx")), "x").join(degree.select(F.col("v").alias("y"), F.col("d").alias("dy")), "y")
    x, y = F.struct(F.col("dx").alias("d"), F.col("x").alias("v")), F.struct(F.col("dy").alias("d"), F.col("y").alias("v"))
    out = named.select(F.least(x, y)["v"].alias("u"), F.greatest(x, y).alias("to")).groupBy("u").agg(F.sort_array(F.collect_list("to"))["v"].alias("out"))
    out = stored(out, f"{folder}/out")
    sent = out.filter(F.size("out") > 1).select("u", "out", F.posexplode("out").alias("k", "x")).filter(F.col("k") + 1 < F.size("out"))
    sent = sent.select("u", "x", F.slice("out", F.col("k") + 2, F.size("out")).alias("rest"))
    closed = sent.join(out.select(F.col("u").alias("x"), "out").hint("merge"), "x").select("u", "x", F.explode(F.array_intersect("rest", "out")).alias("y"))
    return closed.select(F.array_sort(F.array("u", "x", "y")).alias("t")).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))
