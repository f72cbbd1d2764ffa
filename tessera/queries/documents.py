"""Turtle, TriG, RDF/XML and JSON-LD in queries: documents made of the tables are read as graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import algebra as A
from ..sources import documents as R
from ..sources import export as E
from ..sources.mapping import graph
from ..store import shared_dir, stored
from ..terms import escaped, num
from .registry import EX, lexical, query, read

_PART = """SELECT 'urn:part:' || p_partkey AS p, p_name AS name, p_size AS size, 'http://example.org/Part' AS kind FROM part"""


def _parts(quads):
    quads = stored(quads, shared_dir(quads.sparkSession))  # three patterns read it; the documents are parsed once
    rows = A.bgp(quads, [("?p", EX + "name", "?n"), ("?p", EX + "size", "?s"), ("?p", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "?k")])
    return rows.select(F.col("p.v").alias("p"), F.col("n.v").alias("name"), num(F.col("s")).cast("long").alias("size"), F.col("k.v").alias("kind"))


@query(_PART)
def load_turtle(spark, d):
    """Prefixes, lists of objects, comments, numbers, long and short strings."""
    text = F.concat(F.lit("@prefix ex: <http://example.org/> . # parts\nPREFIX u: <urn:part:>\nu:"), "p_partkey", F.lit(" a ex:Part ;\n  ex:name '''"), "p_name", F.lit("''' ;\n  ex:size "), "p_size", F.lit(" ; ex:made [ ex:by ( ex:x 'y' ) ] , true ."))
    return _parts(R.parse(read(spark, d, "part").select(text.alias("value")), "turtle"))


@query("""SELECT 'urn:doc:' || doc_id AS d, text, coalesce(lang, '') AS lang FROM documents WHERE text IS NOT NULL""")
def turtle_round_trip(spark, d):
    """Whole texts as Turtle blocks and back."""
    g = graph(spark, d, "documents").filter(F.col("p") == EX + "text").withColumn("g", F.lit(""))
    rows = A.match(R.parse(E.turtle(g).select("value"), "turtle"), ("?d", EX + "text", "?t"), "")
    return rows.select(F.col("d.v").alias("d"), F.col("t.v").alias("text"), F.col("t.lang").alias("lang"))


@query("""SELECT 'urn:graph:' || n_regionkey AS g, 'urn:nation:' || n_nationkey AS n, n_name AS name FROM nation""")
def load_trig(spark, d):
    """A document with a graph block per region."""
    block = F.concat(F.lit("GRAPH <urn:graph:"), "n_regionkey", F.lit('> { <urn:nation:'), "n_nationkey", F.lit('> ex:name "'), escaped(F.col("n_name")), F.lit('"@EN . }'))
    docs = read(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("@prefix ex: <http://example.org/> .\n"), F.array_join(F.collect_list(block), "\n")).alias("value"))
    return lexical(A.match(R.parse(docs, "trig"), ("?n", EX + "name", "?name"), "?g"), "g", "n", "name")


@query(_PART)
def load_rdfxml(spark, d):
    """Typed nodes, datatypes and nested nodes, written to files and read by their ending."""
    name = F.replace(F.replace("p_name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    one = F.concat(F.lit('<ex:Part rdf:about="urn:part:'), "p_partkey", F.lit('"><ex:name>'), name, F.lit('</ex:name><ex:size rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">'), "p_size", F.lit('</ex:size><ex:maker><rdf:Description ex:code="m"/></ex:maker></ex:Part>'))
    text = F.concat(F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://example.org/">'), one, F.lit("</rdf:RDF>"))
    return _parts(R.parse(read(spark, d, "part").select(text.alias("value")), "rdfxml"))


@query("""SELECT 'urn:nation:' || n_nationkey AS s, 'urn:region:' || n_regionkey AS o FROM nation""")
def load_ontology(spark, d):
    """Classes of an ontology file and their superclasses."""
    one = F.concat(F.lit('<owl:Class rdf:about="urn:nation:'), "n_nationkey", F.lit('"><rdfs:subClassOf rdf:resource="urn:region:'), "n_regionkey", F.lit('"/></owl:Class>'))
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'
    docs = read(spark, d, "nation").agg(F.concat(F.lit(head), F.array_join(F.collect_list(one), ""), F.lit("</rdf:RDF>")).alias("value"))
    path = shared_dir(spark) + ".owl"
    docs.write.text(path)
    return lexical(A.match(R.read(spark, path), ("?s", "http://www.w3.org/2000/01/rdf-schema#subClassOf", "?o"), ""), "s", "o")


@query("""SELECT 'urn:part:' || p_partkey AS p, p_name AS name, p_size AS size, 'http://example.org/Part' AS kind FROM part""")
def load_jsonld(spark, d):
    """Terms, typed terms, prefixes, a vocabulary and nested nodes by a context."""
    ctx = '{"@context":{"@vocab":"http://example.org/","u":"urn:part:","label":{"@id":"http://example.org/name"},"size":{"@type":"http://www.w3.org/2001/XMLSchema#integer"},"near":{"@type":"@id"}},"@type":"Part","near":["u:1","u:2"],"made":{"by":{"@list":["x",2]}},'
    one = F.to_json(F.struct(F.concat(F.lit("u:"), "p_partkey").alias("@id"), F.col("p_name").alias("label"), F.col("p_size").cast("string").alias("size")))
    return _parts(R.parse(read(spark, d, "part").select(F.concat(F.lit(ctx), F.substr(one, F.lit(2))).alias("value")), "jsonld"))


@query("""SELECT 'urn:customer:' || c_custkey AS s, c_name AS name FROM customer""")
def jsonld_round_trip(spark, d):
    g = graph(spark, d, "customer")
    return lexical(A.match(R.parse(E.jsonld(g).select("value"), "jsonld"), ("?s", EX + "name", "?name"), ""), "s", "name")
