"""Formats in queries: every writer's lines are read back or compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import algebra as A
from ..sources import export as E
from ..sources import json_docs as J
from ..sources import ntriples as T
from ..sources.mapping import graph
from ..terms import num
from .registry import EX, lexical, query, read


@query("""SELECT 'urn:doc:' || doc_id AS d, text, lang FROM documents WHERE text IS NOT NULL""")
def ntriples_round_trip(spark, d):
    """Texts written as N-Quads lines and parsed again."""
    g = graph(spark, d, "documents")
    back = T.parse(T.line(g), distinct=False)  # the lines are of a set
    rows = A.match(back, ("?d", EX + "text", "?t"), "urn:graph:docs")
    return rows.select(F.col("d.v").alias("d"), F.col("t.v").alias("text"), F.col("t.lang").alias("lang"))


@query("""SELECT '<urn:region:' || r_regionkey || '> <http://example.org/name> "' || r_name || '" .' AS value FROM region UNION ALL SELECT '<urn:region:' || r_regionkey || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://example.org/Region> .' FROM region""")
def export_ntriples(spark, d):
    return T.line(graph(spark, d, "region"), False)


@query("""SELECT '<urn:region:' || r_regionkey || '>' AS subject, '<urn:region:' || r_regionkey || '> <http://example.org/name> "' || r_name || '" ;' || chr(10) || '    a <http://example.org/Region> .' AS value FROM region""")
def export_turtle(spark, d):
    return E.turtle(graph(spark, d, "region"))


@query("""SELECT 'urn:region:' || r_regionkey AS id, '{"@id":"urn:region:' || r_regionkey || '","http://example.org/name":[{"@value":"' || r_name || '"}],"http://www.w3.org/1999/02/22-rdf-syntax-ns#type":[{"@id":"http://example.org/Region"}]}' AS value FROM region""")
def export_jsonld(spark, d):
    return E.jsonld(graph(spark, d, "region"))


@query("""SELECT '<urn:part:' || p_partkey || '>' AS p, '"' || p_size || '"^^<http://www.w3.org/2001/XMLSchema#integer>' AS size FROM part""")
def results_tsv(spark, d):
    return E.results(A.match(graph(spark, d, "part"), ("?p", EX + "size", "?size"), ""), "tsv")


@query("""SELECT 'urn:event:' || event_id AS e, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def json_to_quads(spark, d):
    rows = read(spark, d, "events").select(F.concat(F.lit("urn:event:"), "event_id").alias("id"), "props")
    g = J.json_quads(rows, "id", "props", EX)
    return A.match(g, ("?e", EX + "k", "?k"), "").select(F.col("e.v").alias("e"), num(F.col("k")).alias("k"))


@query("""SELECT 'urn:customer:' || c_custkey AS id, c_name AS name, c_mktsegment AS segment, 'urn:nation:' || c_nationkey AS nation FROM customer""")
def pivot_to_table(spark, d):
    return J.pivoted(graph(spark, d, "customer"), {EX + "name": "name", EX + "segment": "segment", EX + "nation": "nation"})


@query("""SELECT (SELECT count(*) FROM nation) * 3 AS n, (SELECT count(*) FROM nation WHERE n_regionkey = 0) AS renamed""")
def json_upsert(spark, d):
    g = graph(spark, d, "nation")
    new = g.filter((F.col("p") == EX + "name")).join(g.filter(F.col("o.v") == "urn:region:0").select("s"), "s").withColumn("o", F.col("o").withField("v", F.lit("renamed")))
    out = J.ingest(g, new, "upsert")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o.v") == "renamed").alias("renamed"))


@query("""SELECT 'urn:region:' || r_regionkey AS s, CASE WHEN r_regionkey = 0 THEN 'Zero' ELSE r_name END AS o FROM region WHERE r_regionkey <> 1""")
def rdf_patch(spark, d):
    g = graph(spark, d, "region").filter(F.col("p") == EX + "name")
    name = read(spark, d, "region").filter("r_regionkey < 2")
    gone = name.select(F.concat(F.lit("D <urn:region:"), "r_regionkey", F.lit("> <http://example.org/name> \""), "r_name", F.lit('" .')).alias("value"))
    new = spark.createDataFrame([('A <urn:region:0> <http://example.org/name> "Zero" .',), ("# a note",)], "value string")
    return lexical(T.patch(g, gone.unionByName(new)), "s", "o")


@query("""SELECT * FROM (VALUES ('broken line', 1)) t(value, n)""")
def rejected_lines(spark, d):
    lines = spark.createDataFrame([("<urn:a> <urn:b> <urn:c> .",), ("broken line",), ("",), ("# note",), ('<< <urn:a> <urn:b> "x y" >> <urn:p> _:z <urn:g> .',)], "value string")
    return T.rejected(lines).withColumn("n", F.lit(1))
