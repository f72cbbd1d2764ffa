"""SHACL constraints in queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import algebra as A
from ..operators import paths as P
from ..operators import shacl as V
from ..sources.mapping import graph
from ..store import triples
from ..terms import num
from .registry import EX, query


def _out(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports).select(F.col("focus.v").alias("focus"), "constraint", "value")


@query("""SELECT 'urn:doc:' || d.doc_id AS focus, 'minCount' AS "constraint", '0' AS value FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def shacl_count(spark, d):
    g = graph(spark, d, "documents", "labels")
    return _out(V.count(V.subjects_of(g, EX + "source"), P.link(g, EX + "quality"), 1, 1))


@query("""SELECT 'urn:customer:' || c_custkey AS focus, 'minInclusive' AS "constraint", CAST(c_acctbal AS VARCHAR) AS value FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'urn:customer:' || c_custkey, 'in', c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT 'urn:customer:' || c_custkey, 'pattern', c_name FROM customer WHERE NOT regexp_matches(c_name, '[0-4]$')""")
def shacl_values(spark, d):
    g = graph(spark, d, "customer")
    c = V.target_class(g, EX + "Customer")
    return _out(V.within(c, P.link(g, EX + "acctbal"), 0), V.one_of(c, P.link(g, EX + "segment"), ["BUILDING", "MACHINERY"]), V.pattern(c, P.link(g, EX + "name"), "[0-4]$"))


@query("""SELECT 'urn:part:' || p_partkey AS focus, 'datatype' AS "constraint", CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT 'urn:part:' || p_partkey, 'maxLength', p_name FROM part WHERE length(p_name) > 12 UNION ALL SELECT 'urn:part:' || p_partkey, 'nodeKind', p_brand FROM part""")
def shacl_types(spark, d):
    g = graph(spark, d, "part")
    f = V.subjects_of(g, EX + "size")
    long = V.length(f, P.link(g, EX + "name"), 0, 12)
    return _out(V.datatype(f, P.link(g, EX + "size"), "http://www.w3.org/2001/XMLSchema#string"), long, V.node_kind(f, P.link(g, EX + "brand"), "IRI"))


@query("""SELECT 'urn:doc:' || doc_id AS focus, 'languageIn' AS "constraint", text AS value FROM documents WHERE lang NOT IN ('en', 'de') AND text IS NOT NULL""")
def shacl_language(spark, d):
    g = graph(spark, d, "documents")
    return _out(V.language_in(V.subjects_of(g, EX + "text"), P.link(g, EX + "text"), ["en", "de"]), V.unique_lang(V.subjects_of(g, EX + "text"), P.link(g, EX + "text")))


@query("""SELECT 'urn:nation:' || n_nationkey AS focus, 'class' AS "constraint", 'urn:region:' || n_regionkey AS value FROM nation WHERE n_regionkey = 4 UNION ALL SELECT 'urn:nation:' || n_nationkey, 'hasValue', NULL FROM nation WHERE n_regionkey <> 2""")
def shacl_class_value(spark, d):
    g = graph(spark, d, "nation", "region").filter(F.col("s.v") != "urn:region:4")
    f = V.target_class(g, EX + "Nation")
    return _out(V.cls(f, P.link(g, EX + "region"), g, EX + "Region"), V.has_value(f, P.link(g, EX + "region"), "<urn:region:2>"))


@query("""SELECT 'urn:region:' || r_regionkey AS focus, 'closed' AS "constraint", 'http://example.org/name' AS value FROM region""")
def shacl_closed(spark, d):
    g = graph(spark, d, "region")
    return _out(V.closed(V.target_class(g, EX + "Region"), g, ["http://www.w3.org/1999/02/22-rdf-syntax-ns#type"]))


@query("""SELECT 'urn:doc:' || doc_id AS focus, 'equals' AS "constraint", v AS value FROM (SELECT doc_id, unnest([CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR)]) AS v FROM labels WHERE quality <> toxic)
UNION ALL SELECT 'urn:doc:' || doc_id, 'disjoint', CAST(quality AS VARCHAR) FROM labels WHERE quality = toxic UNION ALL SELECT 'urn:doc:' || doc_id, 'lessThan', CAST(toxic AS VARCHAR) FROM labels WHERE NOT toxic < quality""")
def shacl_pairs(spark, d):
    g = graph(spark, d, "labels")
    f, q, t = V.subjects_of(g, EX + "quality"), P.link(g, EX + "quality"), P.link(g, EX + "toxic")
    return _out(V.equals(f, q, t), V.disjoint(f, q, t), V.less_than(f, t, q))


@query("""SELECT 'urn:customer:' || c_custkey AS focus, 'xone' AS "constraint", CAST(n AS VARCHAR) AS value FROM (SELECT c_custkey, CAST(c_acctbal >= 0 AS INT) + CAST(c_mktsegment = 'BUILDING' AS INT) AS n FROM customer) WHERE n <> 1
UNION ALL SELECT 'urn:customer:' || c_custkey, 'not', '1' FROM customer WHERE c_acctbal >= 0""")
def shacl_logic(spark, d):
    g = graph(spark, d, "customer")
    f = V.target_class(g, EX + "Customer")
    rich = V.conforming(f, V.within(f, P.link(g, EX + "acctbal"), 0))
    building = V.conforming(f, V.one_of(f, P.link(g, EX + "segment"), ["BUILDING"]))
    return _out(V.logical(f, "xone", [rich, building]), V.logical(f, "not", [rich]))


@query("""SELECT 'urn:nation:' || n_nationkey AS focus, 'qualifiedMinCount' AS "constraint", CAST(n AS VARCHAR) AS value FROM (SELECT n_nationkey, count(*) FILTER (c_acctbal >= 9000) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) WHERE n < 6""")
def shacl_qualified(spark, d):
    """An inverse path to rich customers."""
    g = graph(spark, d, "nation", "customer")
    f = V.target_class(g, EX + "Nation")
    c = V.target_class(g, EX + "Customer")
    rich = V.conforming(c, V.within(c, P.link(g, EX + "acctbal"), 9000))
    return _out(V.qualified(f, P.inverse(P.link(g, EX + "nation")), rich, 6))


@query("""SELECT 'urn:order:' || o_orderkey AS focus, 'sparql' AS "constraint", NULL AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000 AND c_acctbal < 0""")
def shacl_sparql(spark, d):
    g = graph(spark, d, "orders", "customer")
    rows = A.bgp(g, [("?this", EX + "totalprice", "?t"), ("?this", EX + "customer", "?c"), ("?c", EX + "acctbal", "?b")])
    return _out(V.sparql(rows.filter((num(F.col("t")) > 300000) & (num(F.col("b")) < 0))))


@query("""SELECT 1 - (2.0 * v + 0) / (2.0 * (v + 1) + 1.0) AS score FROM (SELECT count(*) AS v FROM customer WHERE c_acctbal < 0)""")
def shacl_score(spark, d):
    g = graph(spark, d, "customer")
    return V.score(V.within(V.target_class(g, EX + "Customer"), P.link(g, EX + "acctbal"), 0), {"minInclusive": 2.0, "maxCount": 1.0})


@query("""SELECT * FROM (VALUES ('urn:book2', 'nodeKind', 'Ann')) t(focus, "constraint", value)""")
def shacl_node_kind(spark, d):
    g = triples(spark, [("<urn:book1>", "urn:author", "<urn:ann>"), ("<urn:book2>", "urn:author", "Ann")])
    return _out(V.node_kind(V.subjects_of(g, "urn:author"), P.link(g, "urn:author"), "IRI"))
