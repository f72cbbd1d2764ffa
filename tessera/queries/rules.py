"""Datalog and reasoning in queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as G
from ..operators import algebra as A
from ..operators import uncertain as N
from ..plans import datalog as D
from ..plans import rulesets as R
from ..sources.mapping import graph
from ..store import triples
from ..terms import OWL, RDFS, SKOS, TYPE, num
from .registry import EX, query, read

IN = EX + "in"
LOCATED = [
    D.Rule(("?x", IN, "?y"), [("?x", EX + "nation", "?y")]),
    D.Rule(("?x", IN, "?y"), [("?x", EX + "region", "?y")]),
    D.Rule(("?x", IN, "?z"), [("?x", IN, "?y"), ("?y", IN, "?z")]),
]


def _spo(df):
    return df.select(F.col("s.v").alias("s"), F.regexp_extract("p", r"(\w+)$", 1).alias("p"), F.col("o.v").alias("o"))


@query("""SELECT 'urn:supplier:' || s_suppkey AS s, 'urn:nation:' || s_nationkey AS o FROM supplier UNION SELECT 'urn:nation:' || n_nationkey, 'urn:region:' || n_regionkey FROM nation
UNION SELECT 'urn:supplier:' || s_suppkey, 'urn:region:' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def datalog_transitive(spark, d):
    g = graph(spark, d, "supplier", "nation")
    return D.inferred(g, LOCATED).select(F.col("s.v").alias("s"), F.col("o.v").alias("o"))


@query("""SELECT 'urn:customer:' || c_custkey AS s FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def datalog_negation(spark, d):
    g = graph(spark, d, "customer", "orders")
    rules = [
        D.Rule(("?c", EX + "big", "yes"), [("?o", EX + "customer", "?c"), ("?o", EX + "totalprice", "?t")], guard=lambda: num(F.col("t")) > 300000),
        D.Rule(("?c", EX + "watch", "yes"), [("?c", EX + "acctbal", "?b")], [("?c", EX + "big", "yes")], lambda: num(F.col("b")) < 0),
    ]
    return A.match(D.infer(g.filter(F.col("p").isin(EX + "customer", EX + "totalprice", EX + "acctbal")), rules), ("?c", EX + "watch", "?y"), "").select(F.col("c.v").alias("s"))


@query("""SELECT 'urn:nation:' || c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 60""")
def datalog_aggregate(spark, d):
    g = graph(spark, d, "customer")
    rules = [D.Aggregate(EX + "customers", ("?c", EX + "nation", "?n"), "n", lambda: G.sum_(A.constant(1)))]
    out = A.match(D.infer(g.filter(F.col("p") == EX + "nation"), rules), ("?n", EX + "customers", "?k"), "")
    return out.select(F.col("n.v").alias("nation"), num(F.col("k")).cast("long").alias("n")).filter("n > 60")


@query("""SELECT 'urn:supplier:' || s_suppkey AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 UNION SELECT 'urn:nation:' || n_nationkey FROM nation WHERE n_regionkey = 2""")
def datalog_goal(spark, d):
    g = graph(spark, d, "supplier", "nation", "region")
    return D.ask_goal(g, LOCATED, ("?x", IN, "<urn:region:2>")).select(F.col("x.v").alias("x"))


@query("""SELECT 'urn:order:' || o_orderkey AS o FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0) AND o_totalprice > 200000""")
def integrity_violations(spark, d):
    g = graph(spark, d, "customer", "orders")
    out = D.violations(g, [("?o", EX + "customer", "?c"), ("?o", EX + "totalprice", "?t"), ("?c", EX + "acctbal", "?b")], guard=lambda: (num(F.col("t")) > 200000) & (num(F.col("b")) < 0))
    return out.select(F.col("o.v").alias("o"))


@query("""SELECT * FROM (VALUES ('a', 'certain'), ('b', 'unknown'), ('c', 'unknown'), ('e', 'certain')) t(x, truth)""")
def well_founded_game(spark, d):
    """A position wins if a move leads to one that does not; a <-> b cycles are unknown."""
    m = EX + "move"
    g = triples(spark, [("<urn:b>", m, "<urn:c>"), ("<urn:c>", m, "<urn:b>"), ("<urn:e>", m, "<urn:f>"), ("<urn:a>", m, "<urn:f>")])
    out = D.well_founded(g, [D.Rule(("?x", EX + "win", "yes"), [("?x", m, "?y")], [("?y", EX + "win", "yes")])])
    return out.filter(F.col("p") == EX + "win").select(F.replace(F.col("s.v"), F.lit("urn:"), F.lit("")).alias("x"), "truth")


@query("""WITH RECURSIVE e AS (SELECT turn AS a, turn + 1 AS b, min(length(text)) AS w FROM conversations GROUP BY 1, 2), r AS (SELECT 0::BIGINT AS node, 0::BIGINT AS cost UNION ALL SELECT e.b, r.cost + e.w FROM r JOIN e ON r.node = e.a) SELECT node, min(cost) AS value FROM r GROUP BY 1""")
def lattice_shortest(spark, d):
    """Least cost by a min lattice."""
    edges = read(spark, d, "conversations").groupBy(F.col("turn").alias("node"), (F.col("turn") + 1).alias("to")).agg(F.min(F.length("text")).cast("long").alias("w"))
    seed = spark.createDataFrame([(0, 0)], "node long, value long")
    step = lambda new: new.join(edges, "node").select(F.col("to").alias("node"), (F.col("value") + F.col("w")).alias("value"))
    return D.lattice(seed, step, ["node"], lambda: F.min("value"))


@query("""SELECT s, p, o FROM (VALUES ('urn:ann', 'type', 'Person'), ('urn:ann', 'type', 'Agent'), ('urn:bob', 'type', 'Person'), ('urn:bob', 'type', 'Agent'), ('urn:ann', 'related', 'urn:bob')) t(s, p, o)""")
def rdfs_reasoning(spark, d):
    g = triples(spark, [
        ("<urn:Parent>", RDFS + "subClassOf", "<urn:Person>"), ("<urn:Person>", RDFS + "subClassOf", "<urn:Agent>"), ("<urn:parentOf>", RDFS + "domain", "<urn:Person>"),
        ("<urn:parentOf>", RDFS + "range", "<urn:Person>"), ("<urn:parentOf>", RDFS + "subPropertyOf", "<urn:related>"), ("<urn:ann>", "urn:parentOf", "<urn:bob>"),
    ])
    out = D.inferred(g, R.rdfs()).filter(~F.col("p").contains("subClassOf"))
    return out.select(F.col("s.v").alias("s"), F.regexp_extract("p", r"(\w+)$", 1).alias("p"), F.regexp_replace(F.col("o.v"), "^urn:(?=[A-Z])", "").alias("o"))


@query("""SELECT s, p, o FROM (VALUES ('urn:b', 'knows', 'urn:a'), ('urn:x', 'before', 'urn:z'), ('urn:k', 'childOf', 'urn:p'), ('urn:g', 'grand', 'urn:k2'), ('urn:m2', 'sameAs', 'urn:m1'), ('urn:m1', 'sameAs', 'urn:m2')) t(s, p, o)""")
def owl_reasoning(spark, d):
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    g = triples(spark, [
        ("<urn:knows>", TYPE, f"<{OWL}SymmetricProperty>"), ("<urn:a>", "urn:knows", "<urn:b>"), ("<urn:before>", TYPE, f"<{OWL}TransitiveProperty>"), ("<urn:x>", "urn:before", "<urn:y>"), ("<urn:y>", "urn:before", "<urn:z>"),
        ("<urn:parentOf>", OWL + "inverseOf", "<urn:childOf>"), ("<urn:p>", "urn:parentOf", "<urn:k>"), ("<urn:grand>", OWL + "propertyChainAxiom", "_:l"), ("_:l", rdf + "first", "<urn:par>"), ("_:l", rdf + "rest", "_:m"),
        ("_:m", rdf + "first", "<urn:par>"), ("_:m", rdf + "rest", f"<{rdf}nil>"), ("<urn:g>", "urn:par", "<urn:h>"), ("<urn:h>", "urn:par", "<urn:k2>"),
        ("<urn:mail>", TYPE, f"<{OWL}InverseFunctionalProperty>"), ("<urn:m1>", "urn:mail", "q"), ("<urn:m2>", "urn:mail", "q"),
    ])
    out = D.inferred(g, R.owl_rl()).filter(F.col("s.v") != F.col("o.v"))
    return _spo(out)


@query("""SELECT x, y, depth FROM (VALUES ('cat', 'animal', 1), ('animal', 'thing', 1), ('cat', 'thing', 2)) t(x, y, depth)""")
def skos_ancestors(spark, d):
    from ..store import fixpoint

    g = triples(spark, [("<urn:cat>", SKOS + "broader", "<urn:animal>"), ("<urn:animal>", SKOS + "broader", "<urn:thing>")])
    up = g.filter(F.col("p") == SKOS + "broader").select(F.col("s.v").alias("x"), F.col("o.v").alias("y"))
    seed = up.withColumn("depth", F.lit(1))
    step = lambda new, _: new.withColumnRenamed("y", "m").join(up.withColumnRenamed("x", "m"), "m").select("x", "y", (F.col("depth") + 1).alias("depth"))
    short = lambda c: F.replace(c, F.lit("urn:"), F.lit("")).alias(c)
    return fixpoint(seed, step, ["x", "y"]).select(short("x"), short("y"), "depth")


@query("""SELECT s, p, o FROM (VALUES ('urn:animal', 'narrower', 'urn:cat'), ('urn:cat', 'broaderTransitive', 'urn:animal'), ('urn:animal', 'narrowerTransitive', 'urn:cat')) t(s, p, o)""")
def skos_rules(spark, d):
    g = triples(spark, [("<urn:cat>", SKOS + "broader", "<urn:animal>")])
    return _spo(D.inferred(g, R.skos()))


@query("""SELECT 'urn:supplier:' || s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 1 AND n_nationkey <> 5
UNION SELECT 'urn:nation:' || n_nationkey FROM nation WHERE n_regionkey <> 1 AND n_nationkey <> 5""")
def retraction(spark, d):
    """What still lies in a region when a region's links and one nation's are deleted."""
    g = graph(spark, d, "supplier", "nation").filter(F.col("p").isin(EX + "nation", EX + "region"))
    gone = g.filter((F.col("p") == EX + "region") & ((F.col("o.v") == "urn:region:1") | (F.col("s.v") == "urn:nation:5")))
    out = D.retracted(g, gone, LOCATED)
    return out.filter((F.col("p") == IN) & F.col("o.v").startswith("urn:region")).select(F.col("s.v").alias("s"))


@query("""SELECT 'urn:supplier:' || s_suppkey AS s, 'lost' AS change FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'urn:nation:3', 'lost' UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'gained' FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'urn:nation:3', 'gained'""")
def hypothetical_move(spark, d):
    """What changes if nation 3 moved to a new region."""
    g = graph(spark, d, "supplier", "nation").filter(F.col("p").isin(EX + "nation", EX + "region"))
    old = g.filter((F.col("p") == EX + "region") & (F.col("s.v") == "urn:nation:3"))
    out = D.hypothetical(g, LOCATED, triples(spark, [("<urn:nation:3>", EX + "region", "<urn:region:77>")]), old)
    return out.filter(F.col("p") == IN).select(F.col("s.v").alias("s"), "change")


@query("""SELECT 'urn:doc:' || doc_id AS d, CAST(round(CASE WHEN quality = 1 AND toxic = 1 THEN 1 - (1 - 0.9 * 0.8) * (1 - 0.5 * 0.8) WHEN quality = 1 THEN 0.9 * 0.8 ELSE 0.5 * 0.8 END, 9) AS DOUBLE) AS confidence FROM labels WHERE quality = 1 OR toxic = 1""")
def noisy_or_rules(spark, d):
    g = graph(spark, d, "labels").withColumn("g", F.lit(""))
    facts = g.filter(F.col("p").isin(EX + "quality", EX + "toxic") & (F.col("o.v") == "1"))
    sure = facts.select("s", "p", "o", F.lit(0.8).alias("confidence"))
    flag = EX + "flag"
    rules = [D.Rule(("?d", flag, "yes"), [("?d", EX + "quality", 1)], weight=0.9), D.Rule(("?d", flag, "yes"), [("?d", EX + "toxic", 1)], weight=0.5)]
    return D.weighted(facts, sure, rules).select(F.col("s.v").alias("d"), F.round("confidence", 9).alias("confidence"))


@query("""SELECT 'urn:event:' || event_id AS e, round(3.0 * p / (3.0 * p + 1 - p), 9) AS posterior FROM (SELECT event_id, (event_id % 10) / 10.0 AS p FROM events)""")
def bayes_update(spark, d):
    p = (F.col("event_id") % 10) / 10.0
    return read(spark, d, "events").select(F.concat(F.lit("urn:event:"), "event_id").alias("e"), F.round(N.bayes(p, F.lit(3.0)), 9).alias("posterior"))


@query("""SELECT 0 AS rule, '<urn:nation:' || n_nationkey || '>' AS s, '<urn:nation:' || n_nationkey || '> <http://example.org/region> <urn:region:' || n_regionkey || '>' AS fact FROM nation""")
def derivation_steps(spark, d):
    g = graph(spark, d, "nation").filter(F.col("p") == EX + "region")
    out = D.derivations(g, [D.Rule(("?x", IN, "?y"), [("?x", EX + "region", "?y")])])
    return out.select("rule", F.col("head_s").alias("s"), F.col("facts")[0].alias("fact"))
