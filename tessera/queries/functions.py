"""Term functions in queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sparql as S
from ..operators import algebra as A
from ..sources.mapping import graph
from ..terms import num
from .registry import EX, query, read


def _names(spark, d):
    return A.match(graph(spark, d, "part"), ("?p", EX + "name", "?n"), "").select(F.col("p.v").alias("p"), "n")


@query("""SELECT 'urn:part:' || p_partkey AS p, upper(p_name) AS up, lower(p_name) AS low, length(p_name) AS len, substr(p_name, 2, 3) AS sub,
CASE WHEN position(' ' IN p_name) > 0 THEN substr(p_name, 1, position(' ' IN p_name) - 1) ELSE '' END AS before, CASE WHEN position(' ' IN p_name) > 0 THEN substr(p_name, position(' ' IN p_name) + 1) ELSE '' END AS after FROM part""")
def string_functions(spark, d):
    n = F.col("n")
    return _names(spark, d).select("p", S.ucase(n)["v"].alias("up"), S.lcase(n)["v"].alias("low"), num(S.strlen(n)).cast("long").alias("len"), S.substr(n, 2, 3)["v"].alias("sub"), S.strbefore(n, " ")["v"].alias("before"), S.strafter(n, " ")["v"].alias("after"))


@query("""SELECT 'urn:part:' || p_partkey AS p, contains(p_name, 'a') AS has, starts_with(p_name, 'P') AS starts, suffix(p_name, '1') AS ends, regexp_matches(lower(p_name), '[aeiou]{2}') AS vowels, regexp_replace(p_name, '[0-9]+', '#', 'g') AS masked, p_name || '-' || p_brand AS both FROM part""")
def string_predicates(spark, d):
    rows = A.bgp(graph(spark, d, "part"), [("?p", EX + "name", "?n"), ("?p", EX + "brand", "?b")])
    n, x = F.col("n"), S.literal
    return rows.select(F.col("p.v").alias("p"), S.contains(n, x("a")).alias("has"), S.strstarts(n, x("P")).alias("starts"), S.strends(n, x("1")).alias("ends"), S.regex(n, "[aeiou]{2}", "i").alias("vowels"), S.replace(n, "[0-9]+", "#")["v"].alias("masked"), S.concat(n, x("-"), F.col("b"))["v"].alias("both"))


@query("""SELECT 'urn:part:' || p_partkey AS p, md5(p_name) AS m, sha1(p_name) AS s1, sha256(p_name) AS s256 FROM part""")
def hash_functions(spark, d):
    return _names(spark, d).select("p", *[S.digest(F.col("n"), k)["v"].alias(a) for k, a in (("md5", "m"), ("sha1", "s1"), ("sha256", "s256"))])


@query("""SELECT 'urn:customer:' || c_custkey AS c, abs(c_acctbal) AS a, ceil(c_acctbal) AS up, floor(c_acctbal) AS down, floor(c_acctbal + 0.5) AS near, c_acctbal / 7 AS part, CAST(trunc(c_acctbal) AS BIGINT) AS whole FROM customer""")
def numeric_functions(spark, d):
    rows = A.match(graph(spark, d, "customer"), ("?c", EX + "acctbal", "?b"), "")
    b = F.col("b")
    return rows.select(F.col("c.v").alias("c"), num(S.abs_(b)).alias("a"), num(S.ceil(b)).alias("up"), num(S.floor(b)).alias("down"), num(S.round_(b)).alias("near"), num(S.divide(b, S.literal(7))).alias("part"), num(b).cast("long").alias("whole"))


@query("""SELECT 'urn:order:' || o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h FROM orders""")
def date_functions(spark, d):
    rows = A.match(graph(spark, d, "orders"), ("?o", EX + "orderdate", "?t"), "")
    t = F.col("t")
    return rows.select(F.col("o.v").alias("o"), *[num(f(t)).cast("long").alias(a) for f, a in ((S.year, "y"), (S.month, "m"), (S.day, "d"), (S.hours, "h"))])


@query("""SELECT 'urn:part:' || p_partkey AS p, 'http://www.w3.org/2001/XMLSchema#integer' AS dt, true AS numeric, false AS iri, p_size > 25 AS big, CAST(p_size AS VARCHAR) AS str FROM part""")
def term_tests(spark, d):
    rows = A.match(graph(spark, d, "part"), ("?p", EX + "size", "?s"), "")
    s = F.col("s")
    return rows.select(F.col("p.v").alias("p"), S.datatype(s)["v"].alias("dt"), S.is_numeric(s).alias("numeric"), S.is_iri(s).alias("iri"), S.less(S.literal(25), s).alias("big"), S.str_(s)["v"].alias("str"))


@query("""SELECT count(*) AS n, 0 AS errors FROM customer""")
def division_errors(spark, d):
    """An error is an unbound value, not a failure."""
    rows = A.match(graph(spark, d, "customer"), ("?c", EX + "name", "?n"), "").filter(F.col("c.v").startswith("urn:customer"))
    bad = S.divide(F.col("n"), S.literal(0))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count(bad).alias("errors"))


@query("""SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS lev, round(jaro_winkler_similarity(a.n_name, b.n_name), 6) AS jw FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey""")
def fuzzy_names(spark, d):
    n = read(spark, d, "nation")
    both = n.alias("a").join(n.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    x, y = F.col("a.n_name"), F.col("b.n_name")
    return both.select(x.alias("a"), y.alias("b"), F.levenshtein(x, y).cast("long").alias("lev"), F.round(S.jaro_winkler(x, y), 6).alias("jw"))


_TRI = "list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')]))"


@query(f"""SELECT a.n_name AS a, b.n_name AS b, round(len(list_intersect({_TRI.format('a.n_name')}, {_TRI.format('b.n_name')})) / len(list_distinct(list_concat({_TRI.format('a.n_name')}, {_TRI.format('b.n_name')}))), 6) AS tri FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey""")
def trigram_names(spark, d):
    n = read(spark, d, "nation")
    both = n.alias("a").join(n.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    x, y = F.col("a.n_name"), F.col("b.n_name")
    return both.select(x.alias("a"), y.alias("b"), F.round(S.trigram_similarity(x, y), 6).alias("tri"))


@query("""SELECT word, soundex FROM (VALUES ('Robert', 'R163'), ('Rupert', 'R163'), ('Tymczak', 'T522')) t(word, soundex)""")
def soundex_words(spark, d):
    return spark.createDataFrame([("Robert",), ("Rupert",), ("Tymczak",)], "word string").select("word", F.soundex("word").alias("soundex"))
