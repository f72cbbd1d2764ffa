"""Search, framing, geometry, federation and access in queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, topology
from ..functions import sparql as S
from ..operators import algebra as A
from ..operators import analytics as N
from ..operators import federation as E
from ..operators import search as T
from ..operators import skos as K
from ..operators.framing import framed
from ..plans import datalog as D
from ..sources.mapping import graph
from ..terms import SKOS, iri, literal, num
from .registry import EX, lexical, query, read, spread

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word IN ('the', 'is', 'with') GROUP BY 1, 2)
SELECT 'urn:doc:' || doc_id AS s, round(sum(ln(1 + tf)), 9) AS score FROM h GROUP BY doc_id HAVING count(*) = 3""")
def text_search(spark, d):
    idx = T.index(graph(spark, d, "documents"), [EX + "text"])
    return T.search(idx, "the is with").select(F.col("s.v").alias("s"), F.round("score", 9).alias("score"))


@query("""SELECT 'urn:region:' || r_regionkey AS id, '{"@id":"urn:region:' || r_regionkey || '","label":["' || r_name || '"]}' AS value FROM region""")
def frame_regions(spark, d):
    return framed(graph(spark, d, "region"), EX + "Region", {EX + "name": "label"})


@query("""SELECT 'urn:nation:' || n_nationkey AS id, '{"@id":"urn:nation:' || n_nationkey || '","label":["' || n_name || '"],"region":[{"@id":"urn:region:' || r_regionkey || '","label":["' || r_name || '"]}]}' AS value FROM nation JOIN region ON n_regionkey = r_regionkey""")
def frame_nested(spark, d):
    g = graph(spark, d, "nation", "region")
    return framed(g, EX + "Nation", {EX + "name": "label", EX + "region": ("region", {EX + "name": "label"})})


@query("""SELECT p_partkey AS part, x * x + y * y < 1250 AS near, x > 10 AND x < 40 AND y > 5 AND y < 45 AS inside, round(sqrt(x * x + y * y), 9) AS distance FROM (SELECT p_partkey, CAST(p_partkey % 53 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y FROM part) WHERE x NOT IN (10, 40) AND y NOT IN (5, 45)""")
def geometry_points(spark, d):
    p = spread(read(spark, d, "part")).select("p_partkey", (F.col("p_partkey") % 53).alias("x"), F.col("p_size").alias("y")).filter("x NOT IN (10, 40) AND y NOT IN (5, 45)")
    at = F.concat(F.lit("POINT("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")"))
    far = geo.distance(at, F.lit("POINT(0 0)"))
    return p.select(F.col("p_partkey").alias("part"), (far * far < 1250).alias("near"), geo.within(at, F.lit("POLYGON((10 5, 40 5, 40 45, 10 45, 10 5))")).alias("inside"), F.round(far, 9).alias("distance"))


@query("""SELECT CAST(12 AS DOUBLE) AS area, CAST(7 AS DOUBLE) AS length, 'POLYGON((0.0 0.0, 4.0 0.0, 4.0 3.0, 0.0 3.0, 0.0 0.0))' AS box, true AS meet, 'LINESTRING' AS kind""")
def geometry_shapes(spark, d):
    square, line = F.lit("POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))"), F.lit("LINESTRING (0 0, 4 0, 4 3)")
    return spark.range(1).select(geo.area(square).alias("area"), geo.length(line).alias("length"), geo.envelope(line).alias("box"), geo.boxes_meet(square, F.lit("POINT(4 3)")).alias("meet"), geo.kind(line).alias("kind"))


@query("""SELECT 'urn:sales' AS at, 'urn:customer:' || c_custkey AS x, c_name AS name FROM customer UNION ALL SELECT 'urn:stock', 'urn:supplier:' || s_suppkey, s_name FROM supplier""")
def federated_union(spark, d):
    """One pattern over two graphs, each solution with the graph that it comes from."""
    graphs = {"urn:sales": graph(spark, d, "customer"), "urn:stock": graph(spark, d, "supplier")}
    parts = [A.extend(A.bgp(g, [("?x", EX + "name", "?name"), ("?x", EX + "acctbal", "?b")]), "at", iri(name)) for name, g in graphs.items()]
    return lexical(A.union(*parts), "at", "x", "name")


@query("""SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def federated_join(spark, d):
    """A pattern over one graph joined with one over another."""
    rows = A.join(A.bgp(graph(spark, d, "customer"), [("?c", EX + "nation", "?n")]), A.match(graph(spark, d, "nation"), ("?n", EX + "name", "?nation"), ""))
    return rows.groupBy(F.col("nation.v").alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'reader' AS role, (SELECT count(*) FROM labels) * 3 + (SELECT count(*) FROM region) * 2 AS n""")
def graph_access(spark, d):
    g = graph(spark, d, "documents", "labels", "region")
    grants = spark.createDataFrame([("reader", "urn:graph:labels"), ("owner", "urn:graph:docs")], "role string, g string")
    return E.visible(g, grants, "reader").agg(F.count(F.lit(1)).alias("n")).select(F.lit("reader").alias("role"), "n")


@query("""SELECT g, triples, quota, triples > quota AS over FROM (SELECT 'urn:graph:docs' AS g, (SELECT count(*) * 4 FROM documents) AS triples, 1000 AS quota UNION ALL SELECT 'urn:graph:labels', (SELECT count(*) * 3 FROM labels), 1000000 UNION ALL SELECT 'urn:graph:none', 0, 5)""")
def graph_quota(spark, d):
    limits = spark.createDataFrame([("urn:graph:docs", 1000), ("urn:graph:labels", 1000000), ("urn:graph:none", 5)], "g string, quota int")
    return E.quota(graph(spark, d, "documents", "labels"), limits)


@query("""SELECT g, n FROM (VALUES ('urn:graph:docs', 3), ('urn:graph:labels', 3)) t(g, n)""")
def provenance_of_loads(spark, d):
    return E.provenance(graph(spark, d, "documents", "labels"), "file:///data", "urn:agent:loader").groupBy(F.col("s.v").alias("g")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def semi_join_table(spark, d):
    g = graph(spark, d, "documents", "labels")
    return E.semi_joined(g, EX + "source", EX + "quality").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'Customer' AS class, p AS predicate, count(*) AS subjects, count(*) AS triples FROM (SELECT unnest(['name', 'acctbal', 'segment', 'nation']) AS p FROM customer) GROUP BY 2 UNION ALL SELECT 'Nation', p, count(*), count(*) FROM (SELECT unnest(['name', 'region']) AS p FROM nation) GROUP BY 2""")
def schema_summary(spark, d):
    local = lambda c: F.regexp_extract(c, r"(\w+)$", 1).alias(c)
    return E.summary(graph(spark, d, "customer", "nation")).select(local("class"), local("predicate"), "subjects", "triples")


@query("""WITH one AS (SELECT 'urn:nation:' || n_nationkey AS x FROM nation WHERE n_regionkey = 1) SELECT hop, count(*) AS n FROM (SELECT 1 AS hop FROM region, (SELECT 1) WHERE r_regionkey = 1 UNION ALL SELECT 1 FROM region WHERE r_regionkey = 1 UNION ALL SELECT 1 FROM one UNION ALL SELECT 2 FROM one UNION ALL SELECT 2 FROM one
UNION ALL SELECT 2 FROM region WHERE r_regionkey <> 1) GROUP BY 1""")
def neighbourhood_of_region(spark, d):
    g = graph(spark, d, "region", "nation")
    return T.neighbourhood(g, spark.range(1).select(iri("urn:region:1").alias("x")), 2).groupBy("hop").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT greatest(a.s_suppkey, b.s_suppkey) AS drop, least(a.s_suppkey, b.s_suppkey) AS keep FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND levenshtein(a.s_name, b.s_name) <= 1""")
def ranked_duplicates(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_nationkey")
    rank = s.select(F.col("id").alias("node"), F.lit(1.0).alias("rank"))
    return T.duplicates(s, rank, lambda a, b: (F.levenshtein(a, b) <= 1).cast("double"), 1.0, "s_nationkey", T.one_edit_keys).select("keep", "drop")


@query("""SELECT 'urn:region:2' AS node UNION ALL SELECT 'urn:nation:' || n_nationkey FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'urn:customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2
UNION ALL SELECT 'urn:order:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2""")
def reverse_reach(spark, d):
    """Nodes from which links lead to a region."""
    e = N.edges(graph(spark, d, "orders", "customer", "nation"), [EX + "customer", EX + "nation", EX + "region"])
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return N.reachable(back, spark.createDataFrame([("urn:region:2",)], "node string"))


_BOX = "p_partkey % 53 AS x, p_size AS y"


@query(f"""SELECT p_partkey AS part, far AS disjoint, NOT far AND edge AS touches, NOT far AND NOT edge AND inside AS within, NOT far AND NOT edge AND NOT inside AS overlaps FROM (SELECT p_partkey, x > 40 OR x + 5 < 10 OR y > 45 OR y + 5 < 5 AS far, x = 40 OR x + 5 = 10 OR y = 45 OR y + 5 = 5 AS edge, x >= 10 AND x + 5 <= 40 AND y >= 5 AND y + 5 <= 45 AS inside FROM (SELECT p_partkey, {_BOX} FROM part))""")
def geometry_relations(spark, d):
    """A square a part against one large square."""
    p = spread(read(spark, d, "part")).select("p_partkey", (F.col("p_partkey") % 53).cast("int").alias("x"), F.col("p_size").cast("int").alias("y"))
    at = lambda dx, dy: F.concat_ws(" ", F.col("x") + dx, F.col("y") + dy)
    square = F.concat(F.lit("POLYGON(("), F.concat_ws(", ", at(0, 0), at(5, 0), at(5, 5), at(0, 5), at(0, 0)), F.lit("))"))
    r = topology.relate(square, F.lit("POLYGON((10 5, 40 5, 40 45, 10 45, 10 5))"))
    return p.select(F.col("p_partkey").alias("part"), r.alias("r")).select("part", "r.disjoint", "r.touches", "r.within", "r.overlaps")


@query("""SELECT p_partkey AS part, x > 10 AND x < 40 AS crosses, x IN (10, 40) AS touches, x < 10 OR x > 40 AS disjoint FROM (SELECT p_partkey, p_partkey % 53 AS x FROM part)""")
def geometry_lines(spark, d):
    """An upright line a part against the square."""
    x = (F.col("p_partkey") % 53).cast("int")
    r = topology.relate(F.concat(F.lit("LINESTRING("), x, F.lit(" 0, "), x, F.lit(" 50)")), F.lit("POLYGON((10 5, 40 5, 40 45, 10 45, 10 5))"))
    return spread(read(spark, d, "part")).select(F.col("p_partkey").alias("part"), r.alias("r")).select("part", "r.crosses", "r.touches", "r.disjoint")


@query("""SELECT p_partkey AS part, CAST(0.5 * s * s AS DOUBLE) AS hull_area, CAST(s AS DOUBLE) + s + sqrt(2.0 * s * s) AS rim, CAST((s + 2) * (s + 2) - 2 AS DOUBLE) > 0.5 * s * s AS grown FROM (SELECT p_partkey, p_size AS s FROM part)""")
def geometry_outlines(spark, d):
    """Hull, boundary and buffer of a triangle with a point inside."""
    s = F.col("p_size").cast("int")
    corners = F.concat(F.lit("LINESTRING(0 0, "), s, F.lit(" 0, "), s / 4, F.lit(" "), s / 4, F.lit(", 0 "), s, F.lit(")"))
    p = spread(read(spark, d, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("part"), topology.shaped(corners, "hull").alias("hull"))
    hull = F.col("hull")
    p = p.withColumn("border", topology.shaped(hull, "boundary")).withColumn("wide", topology.shaped(hull, "buffer", 1.0))
    return p.select("part", geo.area(hull).alias("hull_area"), geo.length(F.col("border")).alias("rim"), (geo.area(F.col("wide")) > geo.area(hull)).alias("grown"))


def _scheme(spark, d):
    """Nations as narrower concepts of regions, with labels; every fifth nation is wrongly related to its region."""
    n = read(spark, d, "nation")
    node = lambda kind, c: iri(F.concat(F.lit(f"urn:{kind}:"), F.col(c).cast("string")))
    quad = lambda rows, p, o: rows.select(node("nation", "n_nationkey").alias("s"), F.lit(SKOS + p).alias("p"), o.alias("o"), F.lit("").alias("g"))
    region = node("region", "n_regionkey")
    parts = [quad(n, "broader", region), quad(n, "prefLabel", S.strlang(literal(F.col("n_name")), "en")), quad(n, "prefLabel", S.strlang(literal(F.lower("n_name")), "fr")), quad(n.filter("n_nationkey % 5 = 0"), "related", region)]
    return A.union(*parts)


@query("""SELECT 'urn:nation:' || a.n_nationkey AS x, 'urn:nation:' || b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""")
def skos_siblings(spark, d):
    return lexical(K.siblings(_scheme(spark, d)), "x", "y")


@query("""SELECT 'urn:nation:' || n_nationkey AS x, lower(n_name) AS label FROM nation""")
def skos_labels(spark, d):
    return lexical(K.labels(_scheme(spark, d), ["fr", "en"]), "x", "label")


@query("""SELECT 'urn:nation:' || n_nationkey AS x, 'related and broader' AS rule, 'urn:region:' || n_regionkey AS y FROM nation WHERE n_nationkey % 5 = 0""")
def skos_violations(spark, d):
    return K.violations(_scheme(spark, d)).select(F.col("x.v").alias("x"), "rule", F.col("y.v").alias("y"))


@query("""SELECT 'urn:region:' || n_regionkey AS y, CAST(0 AS BIGINT) AS direct, count(*) AS below FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT 'urn:nation:' || c_nationkey, count(*), count(*) FROM customer GROUP BY 1""")
def skos_coverage(spark, d):
    """Customers by the concept of their nation, and by its region."""
    tagged = A.match(graph(spark, d, "customer"), ("?thing", EX + "nation", "?x"), "")
    return K.coverage(_scheme(spark, d), tagged).select(F.col("y.v").alias("y"), "direct", "below")


@query("""SELECT 'urn:part:' || p_partkey AS p, CAST(length(p_name) + 1 AS BIGINT) AS n FROM part WHERE regexp_matches(p_name, '^[a-m]') AND levenshtein(p_brand, 'Brand#11') <= 1""")
def datalog_guards(spark, d):
    """String guards and an assigned variable."""
    g = graph(spark, d, "part").filter(F.col("p").isin(EX + "name", EX + "brand"))
    guard = lambda: S.regex(F.col("n"), "^[a-m]") & S.levenshtein_within(F.col("b.v"), F.lit("Brand#11"), 1)
    rule = D.Rule(("?p", EX + "marked", "?k"), [("?p", EX + "name", "?n"), ("?p", EX + "brand", "?b")], [], guard, {"k": lambda: S.add(S.strlen(F.col("n")), literal(1))})
    return D.inferred(g, [rule]).select(F.col("s.v").alias("p"), num(F.col("o")).cast("long").alias("n"))


@query("""SELECT 'urn:supplier:' || s_suppkey AS s, 'urn:nation:' || s_nationkey AS o FROM supplier UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'urn:region:' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def datalog_incremental(spark, d):
    """A closed graph of nations, to which suppliers are added: only what the added facts lead to is derived."""
    from .rules import LOCATED

    nations, suppliers = (graph(spark, d, t).filter(F.col("p").isin(EX + "nation", EX + "region")) for t in ("nation", "supplier"))
    out = D.extended(D.infer(nations, LOCATED), suppliers, LOCATED)
    return out.select(F.col("s.v").alias("s"), F.col("o.v").alias("o"))


@query("""SELECT 'urn:customer:' || c_custkey AS s, 'urn:nation:' || c_nationkey AS o FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'""")
def datalog_conflicts(spark, d):
    """Customers that one rule trusts in their nation and another one bars."""
    g = graph(spark, d, "customer")
    body = [("?c", EX + "nation", "?n")]
    rules = [
        D.Rule(("?c", EX + "trusted", "?n"), [*body, ("?c", EX + "acctbal", "?b")], guard=lambda: num(F.col("b")) > 5000),
        D.Rule(("?c", EX + "barred", "?n"), [*body, ("?c", EX + "segment", "BUILDING")]),
    ]
    return lexical(D.conflicts(g, rules, [(EX + "trusted", EX + "barred")]), "s", "o")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents), u AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 30, 1), 270)) AS a FROM w WHERE len(w) > 0)
SELECT doc_id AS document_id, CAST(a / 270 AS BIGINT) AS position, array_to_string(w[a + 1:a + 300], ' ') AS text, len(w[a + 1:a + 300]) AS n_tokens FROM u""")
def graph_text_units(spark, d):
    """Text units, written with entities and relationships as Parquet and read again."""
    from ..sources.export import write_graph_tables
    from ..store import shared_dir

    folder = shared_dir(spark)
    write_graph_tables(graph(spark, d, "nation"), EX + "name", read(spark, d, "documents").select("doc_id", "text"), folder)
    return spark.read.parquet(f"{folder}/text_units").drop("id")
