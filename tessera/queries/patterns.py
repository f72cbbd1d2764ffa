"""Graph patterns, query forms, paths and updates over the mapped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sparql as S
from ..operators import aggregates as G
from ..operators import algebra as A
from ..operators import paths as P
from ..operators import update as U
from ..sources.mapping import graph
from ..terms import TYPE, iri, literal, num, sort_key
from .registry import EX, lexical, query


@query("""SELECT 'urn:customer:' || c_custkey AS c, c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def bgp_star(spark, d):
    g = graph(spark, d, "customer", "nation")
    return lexical(A.bgp(g, [("?c", EX + "name", "?name"), ("?c", EX + "nation", "?n"), ("?n", EX + "name", "?nation")]), "c", "name", "nation")


@query("""SELECT r_name AS region, count(*) AS customers, sum(c_acctbal) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def bgp_chain_aggregate(spark, d):
    g = graph(spark, d, "customer", "nation", "region")
    rows = A.bgp(g, [("?c", EX + "acctbal", "?b"), ("?c", EX + "nation", "?n"), ("?n", EX + "region", "?r"), ("?r", EX + "name", "?region")])
    return rows.groupBy(F.col("region.v").alias("region")).agg(G.count().alias("customers"), F.round(F.sum(num(F.col("b"))), 2).alias("balance"))


ORDERS_BY_NATION = "SELECT n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 100000 GROUP BY 1"


@query(ORDERS_BY_NATION)
def bgp_snowflake_filter(spark, d):
    g = graph(spark, d, "orders", "customer", "nation")
    rows = A.bgp(g, [("?o", EX + "totalprice", "?price"), ("?o", EX + "customer", "?c"), ("?c", EX + "nation", "?n"), ("?n", EX + "name", "?nation")])
    rows = rows.filter(num(F.col("price")) > 100000)
    return rows.groupBy(F.col("nation.v").alias("nation")).agg(G.count().alias("orders"), F.round(F.sum(num(F.col("price"))), 2).alias("total"))


@query("""SELECT p, count(*) AS n FROM (SELECT unnest(['name', 'acctbal', 'segment', 'nation', 'type']) AS p FROM customer) GROUP BY 1""")
def variable_predicate(spark, d):
    g = graph(spark, d, "customer")
    rows = A.match(g, ("?s", "?p", "?o"), "")
    return rows.groupBy(F.regexp_extract(F.col("p.v"), r"([A-Za-z]+)$", 1).alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'urn:doc:' || d.doc_id AS d, CAST(quality AS VARCHAR) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def optional_labels(spark, d):
    g = graph(spark, d, "documents", "labels")
    return lexical(A.optional(A.match(g, ("?d", EX + "source", "?s"), None), A.match(g, ("?d", EX + "quality", "?q"), None)), "d", "q")


@query("""SELECT 'urn:doc:' || d.doc_id AS d, CAST(quality AS VARCHAR) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND d.n_chars > 2000""")
def optional_with_condition(spark, d):
    g = graph(spark, d, "documents", "labels")
    left = A.match(g, ("?d", EX + "length", "?n"), None)
    return lexical(A.optional(left, A.match(g, ("?d", EX + "quality", "?q"), None), num(F.col("n")) > 2000), "d", "q")


@query("""SELECT 'urn:doc:' || doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def minus_labels(spark, d):
    g = graph(spark, d, "documents", "labels")
    return lexical(A.minus(A.match(g, ("?d", EX + "source", "?s"), None), A.match(g, ("?d", EX + "quality", "?q"), None)), "d")


@query("""SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def exists_big_order(spark, d):
    g = graph(spark, d, "customer", "orders")
    big = A.bgp(g, [("?o", EX + "customer", "?c"), ("?o", EX + "totalprice", "?price")]).filter(num(F.col("price")) > 400000)
    return lexical(A.exists(A.match(g, ("?c", EX + "segment", "?s"), ""), big.select("c")), "c")


@query("""SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)""")
def not_exists_order(spark, d):
    g = graph(spark, d, "customer", "orders")
    big = A.bgp(g, [("?o", EX + "customer", "?c"), ("?o", EX + "totalprice", "?price")]).filter(num(F.col("price")) > 200000)
    return lexical(A.not_exists(A.match(g, ("?c", EX + "segment", "?s"), ""), big.select("c")), "c")


@query("""SELECT 'urn:customer:' || c_custkey AS x, c_name AS name, NULL AS brand FROM customer UNION ALL SELECT 'urn:part:' || p_partkey, NULL, p_brand FROM part""")
def union_padded(spark, d):
    g = graph(spark, d, "customer", "part")
    both = A.union(A.bgp(g, [("?x", TYPE, f"<{EX}Customer>"), ("?x", EX + "name", "?name")]), A.match(g, ("?x", EX + "brand", "?brand"), ""))
    return lexical(both, "x", "name", "brand")


@query("""WITH a AS (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l USING (doc_id)), b AS (SELECT * FROM (VALUES (1, 'good'), (0, 'bad'), (NULL, 'any')) v(q, word))
SELECT 'urn:doc:' || a.doc_id AS d, CAST(coalesce(a.q, b.q) AS VARCHAR) AS q, b.word FROM a JOIN b ON a.q IS NULL OR b.q IS NULL OR a.q = b.q""")
def compatible_join(spark, d):
    """A join on a variable that may be unbound on both sides."""
    g = graph(spark, d, "documents", "labels")
    a = A.optional(A.match(g, ("?d", EX + "source", "?s"), None).select("d"), A.match(g, ("?d", EX + "quality", "?q"), None))
    b = A.values(g, ["q", "word"], [(1, "good"), (0, "bad"), (None, "any")])
    return lexical(A.join(a, b, ["q"]), "d", "q", "word")


@query("""SELECT g, count(*) AS n FROM (SELECT 'urn:graph:docs' AS g FROM documents UNION ALL SELECT 'urn:graph:labels' FROM labels) GROUP BY 1""")
def graph_variable(spark, d):
    g = graph(spark, d, "documents", "labels", "region")
    return A.match(g, ("?s", TYPE, "?c"), "?g").groupBy(F.col("g.v").alias("g")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_mktsegment AS segment, count(*) AS n, sum(c_acctbal) AS total, avg(c_acctbal) AS mean, min(c_acctbal) AS least, max(c_acctbal) AS most, median(c_acctbal) AS med FROM customer GROUP BY 1 HAVING count(*) > 10""")
def aggregates_having(spark, d):
    g = graph(spark, d, "customer")
    rows = A.bgp(g, [("?c", EX + "segment", "?s"), ("?c", EX + "acctbal", "?b")])
    b = F.col("b")
    out = rows.groupBy(F.col("s.v").alias("segment")).agg(
        G.count(b).alias("n"), num(G.sum_(b)).alias("total"), num(G.avg(b)).alias("mean"), num(G.min_(b)).alias("least"), num(G.max_(b)).alias("most"), G.median(b).alias("med")
    ).filter("n > 10")
    return out.select("segment", "n", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"), "least", "most", "med")


query_sql = """SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 6) AS mean, min(c_acctbal) AS least, max(c_acctbal) AS most, median(c_acctbal) AS med FROM customer GROUP BY 1 HAVING count(*) > 10"""
query(query_sql)(aggregates_having)
query("""SELECT r_name AS region, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")(bgp_chain_aggregate)


@query("""SELECT r_name AS region, string_agg(n_name, '|' ORDER BY n_name) AS nations, min(n_name) AS first, count(DISTINCT n_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def group_concat_sample(spark, d):
    g = graph(spark, d, "nation", "region")
    rows = A.bgp(g, [("?n", EX + "region", "?r"), ("?n", EX + "name", "?name"), ("?r", EX + "name", "?region")])
    n = F.col("name")
    return rows.groupBy(F.col("region.v").alias("region")).agg(G.group_concat(n, "|", True).alias("nations"), G.sample(n)["v"].alias("first"), G.count(n, True).alias("n"))


@query("""SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS total, CAST(0 AS DOUBLE) AS mean""")
def aggregate_of_nothing(spark, d):
    rows = A.match(graph(spark, d, "region"), ("?s", EX + "population", "?x"), "")
    return rows.agg(G.count(F.col("x")).alias("n"), num(G.sum_(F.col("x"))).alias("total"), num(G.avg(F.col("x"))).alias("mean"))


@query("""SELECT brand, size FROM (SELECT p_brand AS brand, CAST(p_size AS VARCHAR) AS size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, CAST(p_size AS VARCHAR)) AS n FROM part GROUP BY 1, 2) WHERE n = 1""")
def mode_of_sizes(spark, d):
    """The most frequent size of each brand, the least lexical form of equals."""
    rows = A.bgp(graph(spark, d, "part"), [("?p", EX + "brand", "?b"), ("?p", EX + "size", "?s")])
    return rows.groupBy(F.col("b.v").alias("brand")).agg(G.mode(F.col("s")).alias("size"))


@query("""SELECT DISTINCT p_brand AS brand FROM part""")
def distinct_brands(spark, d):
    return lexical(A.match(graph(spark, d, "part"), ("?p", EX + "brand", "?brand"), "").select("brand").distinct(), "brand")


@query("""SELECT 'urn:part:' || p_partkey AS part, p_retailprice AS price FROM part ORDER BY p_retailprice DESC, 'urn:part:' || p_partkey LIMIT 25 OFFSET 5""")
def order_limit_offset(spark, d):
    rows = A.match(graph(spark, d, "part"), ("?part", EX + "retailprice", "?price"), "")
    price = num(F.col("price"))
    return rows.select(F.col("part.v").alias("part"), price.alias("price")).orderBy(F.desc("price"), "part").offset(5).limit(25)


@query("""SELECT row_number() OVER (ORDER BY k, n, v) AS pos, v FROM (SELECT 1 AS k, NULL AS n, 'urn:region:' || r_regionkey AS v FROM region UNION ALL SELECT 2, CAST(p_size AS DOUBLE), CAST(p_size AS VARCHAR) FROM (SELECT DISTINCT p_size FROM part))""")
def sparql_order(spark, d):
    """IRIs before literals, numbers by value."""
    from ..operators.ranks import ranked

    g = graph(spark, d, "region", "part")
    rows = A.union(A.match(g, ("?x", EX + "name", "?n"), "").filter(F.col("x.v").startswith("urn:region")).select("x"), A.match(g, ("?p", EX + "size", "?x"), "").select("x").distinct())
    return ranked(rows, sort_key(F.col("x")), "pos").select(F.col("pos").cast("long").alias("pos"), F.col("x.v").alias("v"))


@query("""SELECT count(*) > 0 AS result FROM customer WHERE c_acctbal < 0""")
def ask_negative_balance(spark, d):
    rows = A.match(graph(spark, d, "customer"), ("?c", EX + "acctbal", "?b"), "").filter(num(F.col("b")) < 0)
    return A.ask(rows)


@query("""SELECT s, p, o FROM (SELECT 'urn:nation:' || n_nationkey AS s, 'partOf' AS p, 'urn:region:' || n_regionkey AS o FROM nation UNION SELECT 'urn:region:' || n_regionkey, 'has', 'urn:nation:' || n_nationkey FROM nation)""")
def construct_part_of(spark, d):
    rows = A.match(graph(spark, d, "nation"), ("?n", EX + "region", "?r"), "")
    made = A.construct(rows, [("?n", EX + "partOf", "?r"), ("?r", EX + "has", "?n")])
    return made.select(F.col("s.v").alias("s"), F.replace("p", F.lit(EX), F.lit("")).alias("p"), F.col("o.v").alias("o"))


@query("""SELECT 'urn:region:1' AS s, 'type' AS p, 'http://example.org/Region' AS o UNION ALL SELECT 'urn:region:1', 'name', r_name FROM region WHERE r_regionkey = 1
UNION ALL SELECT 'urn:nation:' || n_nationkey, 'region', 'urn:region:1' FROM nation WHERE n_regionkey = 1""")
def describe_region(spark, d):
    g = graph(spark, d, "region", "nation")
    out = A.describe(g, spark.range(1).select(iri("urn:region:1").alias("x")), "scbd")
    return out.select(F.col("s.v").alias("s"), F.regexp_extract("p", r"(\w+)$", 1).alias("p"), F.col("o.v").alias("o"))


@query("""SELECT 'urn:customer:' || c_custkey AS c, c_acctbal * 1.1 AS x, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'plain' END AS kind FROM customer""")
def bind_if(spark, d):
    rows = A.match(graph(spark, d, "customer"), ("?c", EX + "acctbal", "?b"), "")
    b = F.col("b")
    rows = A.extend(rows, "x", num(S.multiply(b, literal(1.1))))
    return rows.select(F.col("c.v").alias("c"), "x", F.when(num(b) < 0, "debt").when(num(b) > 5000, "rich").otherwise("plain").alias("kind"))


@query("""SELECT 'urn:nation:' || n_nationkey AS n, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey""")
def path_sequence(spark, d):
    g = graph(spark, d, "nation", "region")
    out = P.sequence(P.link(g, EX + "region"), P.link(g, EX + "name"))
    return lexical(out, s="n", o="region")


@query("""SELECT 'urn:region:' || n_regionkey AS s, 'urn:customer:' || c_custkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def path_inverse(spark, d):
    g = graph(spark, d, "customer", "nation")
    return lexical(P.inverse(P.sequence(P.link(g, EX + "nation"), P.link(g, EX + "region"))).filter(F.col("o.v").startswith("urn:customer")), "s", "o")


@query("""SELECT 'urn:customer:' || c_custkey AS s, 'urn:nation:' || c_nationkey AS o FROM customer UNION ALL SELECT 'urn:nation:' || n_nationkey, 'urn:region:' || n_regionkey FROM nation""")
def path_alternative(spark, d):
    g = graph(spark, d, "customer", "nation")
    return lexical(P.alternative(P.link(g, EX + "nation"), P.link(g, EX + "region")), "s", "o")


CLOSURE = """WITH RECURSIVE e AS (SELECT 'urn:turn:' || conv_id || ':' || turn AS s, 'urn:turn:' || conv_id || ':' || (turn + 1) AS o FROM conversations), r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) """


@query(CLOSURE + "SELECT s, o FROM r")
def path_one_or_more(spark, d):
    return lexical(P.one_or_more(P.link(graph(spark, d, "conversations"), EX + "next")), "s", "o")


@query(CLOSURE + ", n AS (SELECT s FROM e UNION SELECT o FROM e UNION SELECT role FROM conversations UNION SELECT 'http://example.org/Turn') SELECT s, o FROM r UNION SELECT s, s FROM n")
def path_zero_or_more(spark, d):
    g = graph(spark, d, "conversations")
    return lexical(P.zero_or_more(P.link(g, EX + "next"), g), "s", "o")


@query(CLOSURE + "SELECT s, o FROM r WHERE s = 'urn:turn:0:0'")
def path_from_constant(spark, d):
    start = spark.range(1).select(iri("urn:turn:0:0").alias("s"))
    return lexical(P.one_or_more(P.link(graph(spark, d, "conversations"), EX + "next"), start), "s", "o")


@query("""SELECT s, o FROM (SELECT 'urn:nation:' || n_nationkey AS s, 'urn:region:' || n_regionkey AS o FROM nation UNION SELECT x, x FROM (SELECT 'urn:nation:' || n_nationkey AS x FROM nation UNION SELECT n_name FROM nation UNION SELECT 'urn:region:' || n_regionkey FROM nation UNION SELECT 'http://example.org/Nation'))""")
def path_zero_or_one(spark, d):
    g = graph(spark, d, "nation")
    return lexical(P.zero_or_one(P.link(g, EX + "region"), g), "s", "o")


@query("""SELECT 'urn:nation:' || n_nationkey AS s, n_name AS o FROM nation""")
def path_negated_set(spark, d):
    return lexical(P.negated(graph(spark, d, "nation"), TYPE, EX + "region"), "s", "o")


@query("""WITH RECURSIVE e AS (SELECT turn, 'urn:turn:' || conv_id || ':' || turn AS s, 'urn:turn:' || conv_id || ':' || (turn + 1) AS o FROM conversations WHERE turn < 3), r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT s, o FROM r""")
def path_confident(spark, d):
    g = graph(spark, d, "conversations")
    links = g.filter(F.col("p") == EX + "next")
    turn = F.regexp_extract(F.col("s.v"), r"(\d+)$", 1).cast("int")
    sure = links.select("s", "p", "o", F.when(turn < 3, 0.9).otherwise(0.4).alias("confidence"))
    return lexical(P.confident(g, sure, EX + "next", 0.5), "s", "o")


@query("""SELECT count(*) AS n, count(*) FILTER (o = 'urn:region:9') AS moved FROM (SELECT CASE WHEN n_regionkey = 2 THEN 'urn:region:9' ELSE 'urn:region:' || n_regionkey END AS o FROM nation UNION ALL SELECT n_name FROM nation UNION ALL SELECT 'type' FROM nation)""")
def update_where(spark, d):
    """DELETE and INSERT from one WHERE."""
    g = graph(spark, d, "nation")
    rows = A.bgp(g, [("?n", EX + "region", "<urn:region:2>")])
    out = U.modify(g, A.construct(rows, [("?n", EX + "region", "<urn:region:2>")]), A.construct(rows, [("?n", EX + "region", "<urn:region:9>")]))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o.v") == "urn:region:9").alias("moved"))


@query("""SELECT g, n FROM (SELECT 'urn:graph:all' AS g, (SELECT count(*) FROM documents) * 4 + (SELECT count(*) FROM labels) * 3 AS n UNION ALL SELECT 'urn:graph:docs', (SELECT count(*) FROM documents) * 4)""")
def update_copy_move(spark, d):
    g = graph(spark, d, "documents", "labels")
    out = U.move(U.copy(g, "urn:graph:docs", "urn:graph:all"), "urn:graph:none", "urn:graph:other")
    out = U.clear(U.add(out, "urn:graph:labels", "urn:graph:all"), "urn:graph:labels")
    return U.graphs(out).withColumnRenamed("triples", "n")


@query("""SELECT (SELECT count(*) FROM nation) * 3 + 1 - 3 AS n""")
def update_data(spark, d):
    from ..store import triples

    g = graph(spark, d, "nation")
    out = U.insert_data(g, triples(spark, [("<urn:nation:0>", EX + "motto", "x"), ("<urn:nation:0>", EX + "motto", "x")]))
    return U.delete_data(out, U.find(g, s="<urn:nation:3>")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p, o FROM (SELECT 'name' AS p, c_name AS o FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'segment', c_mktsegment FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'nation', 'urn:nation:' || c_nationkey FROM customer WHERE c_custkey = 7)""")
def find_by_subject(spark, d):
    out = U.find(graph(spark, d, "customer"), s="<urn:customer:7>").filter(~F.col("p").isin(TYPE, EX + "acctbal"))
    return out.select(F.regexp_extract("p", r"(\w+)$", 1).alias("p"), F.col("o.v").alias("o"))


@query("""SELECT count(*) AS n FROM labels WHERE quality = 1""")
def quoted_triples(spark, d):
    """Statements about statements: a quoted triple is a term that joins."""
    from ..terms import quoted

    g = graph(spark, d, "labels")
    facts = A.match(g, ("?d", EX + "quality", "?q"), None)
    notes = facts.select(quoted(F.col("d"), iri(EX + "quality"), F.col("q")).alias("t"), F.col("q").alias("q1"))
    asked = facts.filter(num(F.col("q")) == 1).select(quoted(F.col("d"), iri(EX + "quality"), F.col("q")).alias("t"))
    return asked.join(notes, "t").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'urn:doc:' || doc_id AS d, lang FROM documents WHERE lang IN ('de', 'fr')""")
def language_filter(spark, d):
    rows = A.match(graph(spark, d, "documents"), ("?d", EX + "text", "?t"), None)
    rows = rows.filter(S.langmatches(S.lang(F.col("t")), "de") | S.langmatches(S.lang(F.col("t")), "fr"))
    return rows.select(F.col("d.v").alias("d"), S.lang(F.col("t"))["v"].alias("lang"))
