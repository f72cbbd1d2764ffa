"""Typed arithmetic, logic, constructors and patterns that the other modules do not have."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry as X
from ..functions import sparql as S
from ..operators import aggregates as G
from ..operators import algebra as A
from ..operators import paths as P
from ..operators import shacl as V
from ..operators import temporal as T
from ..plans import datalog as D
from ..sources import export as E
from ..sources import ntriples as N
from ..sources.mapping import graph
from ..store import shared_dir
from ..terms import LITERAL, iri, literal, num, quoted, term
from .registry import EX, lexical, query, read, spread

_L = literal
_PART = "'urn:part:' || p_partkey AS p"


def _sizes(spark, d):
    return spread(A.match(graph(spark, d, "part"), ("?p", EX + "size", "?s"), "").select(F.col("p.v").alias("p"), "s"))


@query(f"""SELECT {_PART}, CAST(p_size + 1 AS VARCHAR) || ' integer' AS plus_one, CAST(p_size * p_size AS VARCHAR) || ' integer' AS square, rtrim(rtrim(CAST(CAST(p_size / 8.0 AS DECIMAL(18, 4)) AS VARCHAR), '0'), '.') || ' decimal' AS eighth,
CAST(-p_size AS VARCHAR) || ' integer' AS negative, CAST(9007199254740993 + p_size AS VARCHAR) || ' integer' AS large, CAST(p_size - 10 AS VARCHAR) || ' integer' AS less, CAST(abs(p_size - 10) AS VARCHAR) || ' integer' AS size FROM part""")
def typed_arithmetic(spark, d):
    s = F.col("s")
    show = lambda t: F.concat(t["v"], F.lit(" "), F.regexp_extract(t["dt"], r"(\w+)$", 1))
    less = F.col("less")
    made = {"plus_one": S.add(s, _L(1)), "square": S.multiply(s, s), "eighth": S.divide(s, _L(8)), "negative": S.minus(s), "large": S.add(_L(9007199254740993), s), "less": less, "size": S.abs_(less)}
    rows = A.extend(_sizes(spark, d), "less", S.subtract(s, _L(10)))
    rows = rows.select("p", *[t.alias(k) for k, t in made.items()])
    return rows.select("p", *[show(F.col(k)).alias(k) for k in made])


@query(f"""SELECT {_PART}, ceil(x) AS up, floor(x) AS down, floor(x + 0.5) AS near, x AS tenths FROM (SELECT p_partkey, CAST(p_size / 10.0 AS DOUBLE) AS x FROM part)""")
def rounding_of_decimals(spark, d):
    x = F.col("x")
    return A.extend(_sizes(spark, d), "x", S.divide(F.col("s"), _L(10))).select("p", *[num(t).alias(k) for k, t in {"up": S.ceil(x), "down": S.floor(x), "near": S.round_(x), "tenths": x}.items()])


@query(f"""SELECT {_PART}, p_size > 25 AND p_size % 2 = 0 AS both, p_size > 25 OR p_size % 2 = 0 AS any, NOT p_size > 25 AS none, p_size IN (1, 5, 9) AS few, p_size NOT IN (1, 5, 9) AS others, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind, p_size <> 7 AS not_seven, p_size >= 25 AS least, p_size <= 25 AS most FROM part""")
def logic_functions(spark, d):
    s = F.col("s")
    rows = A.extend(A.extend(_sizes(spark, d), "large", S.boolean(S.less(_L(25), s))), "even", S.boolean(num(s) % 2 == 0))
    large, even = F.col("large"), F.col("even")
    few = [_L(1), S.cast(_L("5.0", "decimal"), "decimal"), _L(9.0)]
    made = {"both": S.ebv(S.and_(large, even)), "any": S.ebv(S.or_(large, even)), "none": S.ebv(S.not_(large)), "few": S.in_(s, *few), "others": S.not_in(s, *few), "kind": S.if_(large, _L("large"), _L("small"))["v"], "not_seven": S.not_equal(s, _L(7)), "least": S.at_least(s, _L(25)), "most": S.at_most(s, _L(25))}
    return rows.select("p", *[c.alias(k) for k, c in made.items()])


@query(f"""SELECT {_PART}, p_size > 0 AS number, length(p_name) > 0 AS string, p_size > 25 AS truth, CAST(NULL AS BOOLEAN) AS error, p_name AS first FROM part""")
def boolean_values(spark, d):
    rows = A.bgp(graph(spark, d, "part"), [("?p", EX + "size", "?s"), ("?p", EX + "name", "?n")])
    s, n = F.col("s"), F.col("n")
    rows, bad = A.extend(rows, "bad", S.add(n, _L(1))), F.col("bad")  # an error
    return rows.select(F.col("p.v").alias("p"), S.ebv(s).alias("number"), S.ebv(n).alias("string"), S.ebv(S.boolean(S.less(_L(25), s))).alias("truth"), S.ebv(S.and_(bad, _L(True))).alias("error"), S.coalesce(bad, n)["v"].alias("first"))


@query("""SELECT n_name AS name, n_name || '@en' AS tagged, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' AS tagged_type, 'http://example.org/code' AS typed_type, 'http://example.org/n/' || replace(n_name, ' ', '_') AS link, true AS blank, true AS plain, replace(n_name, ' ', '%20') || '%2F%C3%A9' AS encoded FROM nation""")
def term_constructors(spark, d):
    n = F.col("n")
    rows = A.match(graph(spark, d, "nation"), ("?x", EX + "name", "?n"), "").filter(F.col("x.v").startswith("urn:nation"))
    tagged, typed = S.strlang(n, "en"), S.strdt(n, EX + "code")
    node = S.bnode_(n, F.col("x"))
    return rows.select(
        F.col("n.v").alias("name"), F.concat(tagged["v"], F.lit("@"), S.lang(tagged)["v"]).alias("tagged"), S.datatype(tagged)["v"].alias("tagged_type"), S.datatype(typed)["v"].alias("typed_type"),
        S.iri_(S.replace(n, " ", "_"), EX + "n/x")["v"].alias("link"), S.is_blank(node).alias("blank"), (S.is_literal(n) & ~S.is_literal(node)).alias("plain"), S.encode_for_uri(S.concat(n, _L("/é")))["v"].alias("encoded"),
    )


@query("""SELECT count(*) AS n, count(*) AS uuids, count(*) AS strings, count(*) AS blanks, count(*) AS shaped, 1 AS times, count(*) AS chances FROM customer""")
def fresh_terms(spark, d):
    rows = A.match(graph(spark, d, "customer"), ("?c", EX + "segment", "?s"), "")
    made = rows.select(S.uuid().alias("u"), S.struuid().alias("s"), S.bnode_().alias("b"), S.now().alias("t"), S.rand(7).alias("r"))
    names = {"u": "uuids", "s": "strings", "b": "blanks"}
    # every term is a key of its own: dealt out first, a task's table of keys holds its share only
    each = made.select(F.explode(F.array(*[F.struct(F.lit(k).alias("made"), F.col(c)["v"].alias("v")) for c, k in names.items()])).alias("x")).select("x.made", "x.v")
    each = each.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "made", "v").groupBy("made", "v").agg(F.count(F.lit(1)).alias("n"))
    distinct = each.agg(*[F.count_if(F.col("made") == k).alias(k) for k in names.values()])
    one = made.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("u.v").rlike("^urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("shaped"),
        F.count_distinct("t").cast("int").alias("times"), F.count_if((num(F.col("r")) >= 0) & (num(F.col("r")) < 1)).alias("chances"),
    )
    return one.crossJoin(distinct).select("n", *names.values(), "shaped", "times", "chances")


@query("""SELECT 'urn:event:' || event_id AS e, minute(ts) AS m, CAST(second(ts) AS BIGINT) AS s, '-PT5H30M' AS zone, '-05:30' AS tz, true AS later FROM events""")
def time_parts(spark, d):
    rows = A.match(graph(spark, d, "events"), ("?e", EX + "ts", "?t"), "")
    t = F.col("t")
    zoned = S.strdt(literal(F.concat(F.replace(t["v"], F.lit(" "), F.lit("T")), F.lit("-05:30"))), "http://www.w3.org/2001/XMLSchema#dateTime")
    utc = S.strdt(literal(F.concat(F.replace(t["v"], F.lit(" "), F.lit("T")), F.lit("Z"))), "http://www.w3.org/2001/XMLSchema#dateTime")
    return rows.select(F.col("e.v").alias("e"), num(S.minutes(t)).cast("int").alias("m"), F.floor(num(S.seconds(t))).alias("s"), S.timezone(zoned)["v"].alias("zone"), S.tz(zoned)["v"].alias("tz"), S.less(utc, zoned).alias("later"))


@query("""SELECT CAST(sum(CAST(9007199254740992 + p_size AS HUGEINT)) AS VARCHAR) AS total, count(*) AS n FROM part""")
def exact_sum(spark, d):
    rows = A.extend(_sizes(spark, d), "x", S.add(_L(9007199254740992), F.col("s")))
    return rows.agg(G.sum_(F.col("x"))["v"].alias("total"), F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand AS brand, CAST(sum(CAST(p_size AS DECIMAL(18, 2)) * 0.25) AS DOUBLE) AS total, round(avg(p_size), 6) AS mean FROM part GROUP BY 1""")
def decimal_aggregates(spark, d):
    rows = A.bgp(graph(spark, d, "part"), [("?p", EX + "brand", "?b"), ("?p", EX + "size", "?s")])
    rows = A.extend(rows, "quarter", S.multiply(F.col("s"), _L("0.25", "decimal")))
    return rows.groupBy(F.col("b.v").alias("brand")).agg(num(G.sum_(F.col("quarter"))).alias("total"), F.round(num(G.avg(F.col("s"))), 6).alias("mean"))


@query("""SELECT count(*) AS n, abs(1 - 1) < 1 AS near FROM (SELECT DISTINCT p_brand, p_size FROM part)""")
def distinct_solutions(spark, d):
    """COUNT(DISTINCT *), and the approximate count within a tenth of it."""
    rows = A.bgp(graph(spark, d, "part"), [("?p", EX + "brand", "?b"), ("?p", EX + "size", "?s")])
    both = F.struct("b", "s")
    return rows.agg(G.count(both, True).alias("n"), G.approx_count_distinct(both).alias("a")).select("n", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


@query("""SELECT r_name AS region, n_name AS nation FROM region CROSS JOIN nation""")
def cross_product(spark, d):
    g = graph(spark, d, "region", "nation")
    a, b = (A.match(graph(spark, d, t), ("?" + t[0], EX + "name", "?" + t), "").select(t) for t in ("region", "nation"))
    return lexical(A.join(a, b), "region", "nation") if g is not None else a


@query("""SELECT count(*) AS n FROM part WHERE p_partkey < 0""")
def unknown_iri(spark, d):
    return A.match(graph(spark, d, "part"), ("<urn:nothing>", EX + "size", "?s"), "").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'urn:part:' || p_partkey AS p, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part""")
def results_csv(spark, d):
    return E.results(A.bgp(graph(spark, d, "part"), [("?p", EX + "name", "?name"), ("?p", EX + "size", "?size")]).select("p", "name", "size"), "csv")


@query("""SELECT '<urn:doc:' || doc_id || '> <http://example.org/toxic> "' || toxic || '"^^<http://www.w3.org/2001/XMLSchema#integer> .' AS value FROM labels UNION ALL
SELECT '<< <urn:doc:' || doc_id || '> <http://example.org/toxic> "' || toxic || '"^^<http://www.w3.org/2001/XMLSchema#integer> >> <urn:confidence> "' || CASE WHEN quality = 1 THEN '0.9' ELSE '0.5' END || '"^^<http://www.w3.org/2001/XMLSchema#double> .' FROM labels""")
def export_with_confidence(spark, d):
    g = graph(spark, d, "labels")
    toxic = g.filter(F.col("p") == EX + "toxic")
    sure = A.bgp(g, [("?s", EX + "toxic", "?o"), ("?s", EX + "quality", "?q")], None).select("s", F.lit(EX + "toxic").alias("p"), "o", F.when(num(F.col("q")) == 1, 0.9).otherwise(0.5).alias("confidence"))
    return E.turtle_star(toxic, sure)


@query("""SELECT 'urn:doc:' || doc_id AS d, CASE WHEN quality = 1 THEN 0.875 ELSE 0.25 END AS confidence FROM labels""")
def load_with_confidence(spark, d):
    """Lines with a confidence behind the statement, written, read again and asked for."""
    rows = read(spark, d, "labels").select(F.concat(F.lit("<urn:doc:"), "doc_id", F.lit('> <http://example.org/toxic> "'), "toxic", F.lit('" '), F.when(F.col("quality") == 1, "0.875").otherwise("0.25"), F.lit(" .")).alias("value"))
    path = shared_dir(spark)
    rows.write.text(path)
    quads, sure = N.with_confidence(spark.read.text(path))
    return A.match(quads, ("?d", EX + "toxic", "?t"), "").join(sure, (F.col("d") == F.col("s")) & (F.col("t") == F.col("o"))).select(F.col("d.v").alias("d"), "confidence")


@query("""SELECT 'urn:part:' || p_partkey AS p, p_name AS name FROM part""")
def load_into_graph(spark, d):
    """N-Triples written to files and read into a named graph."""
    path = shared_dir(spark)
    N.line(graph(spark, d, "part"), False).write.text(path)
    return lexical(A.match(N.read(spark, path, graph="urn:loaded"), ("?p", EX + "name", "?name"), "urn:loaded"), "p", "name")


@query("""SELECT 'é😀' || chr(9) || '"' || p_name AS name, 'urn:é' AS s FROM part""")
def escaped_lines(spark, d):
    """Every kind of escape in N-Triples."""
    lines = read(spark, d, "part").select(F.concat(F.lit('<urn:\\u00E9> <urn:p> "\\u00e9\\U0001F600\\t\\"'), "p_name", F.lit('" <urn:g:'), "p_partkey", F.lit("> .")).alias("value"))
    rows = A.match(N.parse(lines), ("?s", "urn:p", "?n"), "?g")
    return rows.select(F.col("n.v").alias("name"), F.col("s.v").alias("s"))


@query("""SELECT 'urn:doc:' || doc_id AS d, CAST(toxic AS VARCHAR) AS t, 'urn:annotator:' || (doc_id % 3) AS who FROM labels WHERE toxic = 1""")
def quoted_variables(spark, d):
    """Who said of which document that it is toxic: a quoted pattern with variables inside."""
    g = graph(spark, d, "labels").filter(F.col("p").isin(EX + "toxic", EX + "quality")).withColumn("g", F.lit(""))
    number = F.regexp_extract("s.v", r"(\d+)$", 1).cast("long") % 3
    said = g.select(quoted(F.col("s"), iri(F.col("p")), F.col("o")).alias("s"), F.lit(EX + "saidBy").alias("p"), iri(F.concat(F.lit("urn:annotator:"), number.cast("string"))).alias("o"), F.lit("").alias("g"))
    rows = A.quoted_match(said, ("?d", EX + "toxic", "?t"), EX + "saidBy", "?who")
    return lexical(rows.filter(num(F.col("t")) == 1), "d", "t", "who")


@query("""SELECT n_name AS nation, c_name AS customer FROM (SELECT n_name, c_name, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_name) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey) WHERE k <= 2""")
def lateral_top(spark, d):
    """The two richest customers of each nation."""
    a = A.match(graph(spark, d, "nation"), ("?n", EX + "name", "?nation"), "").filter(F.col("n.v").startswith("urn:nation"))
    b = A.bgp(graph(spark, d, "customer"), [("?c", EX + "nation", "?n"), ("?c", EX + "name", "?customer"), ("?c", EX + "acctbal", "?b")])
    return lexical(A.lateral(a, b, [F.desc(num(F.col("b"))), F.col("customer.v")], 2), "nation", "customer")


@query("""SELECT p_brand AS brand, round(exp(avg(ln(p_size))), 6) AS mean, min(upper(p_name) || '!') AS shout FROM part GROUP BY 1""")
def custom_functions(spark, d):
    """A user's function and a user's aggregate, by their IRIs."""
    X.register_function(EX + "shout", lambda t: S.concat(S.ucase(t), _L("!")))
    X.register_aggregate(EX + "geometric", lambda t: S.double(F.exp(F.avg(F.log(num(t))))))
    rows = A.bgp(graph(spark, d, "part"), [("?p", EX + "brand", "?b"), ("?p", EX + "size", "?s"), ("?p", EX + "name", "?n")])
    return rows.groupBy(F.col("b.v").alias("brand")).agg(F.round(num(X.aggregate(EX + "geometric", F.col("s"))), 6).alias("mean"), F.min(X.call(EX + "shout", F.col("n"))["v"]).alias("shout"))


@query("""SELECT 'urn:nation:' || n_nationkey AS s, 'region' AS p, 'urn:region:' || n_regionkey AS o FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'urn:nation:' || n_nationkey, 'name', n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'urn:nation:' || n_nationkey, 'type', 'http://example.org/Nation' FROM nation WHERE n_regionkey = 1""")
def describe_nations(spark, d):
    """The concise bounded descriptions of a region's nations."""
    g = graph(spark, d, "nation")
    who = A.match(g, ("?x", EX + "region", "<urn:region:1>"), "")
    return A.describe(g, who, "cbd").select(F.col("s.v").alias("s"), F.regexp_extract("p", r"(\w+)$", 1).alias("p"), F.col("o.v").alias("o"))


@query("""SELECT 'urn:customer:' || c_custkey AS focus, 'or' AS "constraint", '0' AS value FROM customer WHERE c_acctbal <= 0 AND c_mktsegment <> 'BUILDING' UNION ALL SELECT 'urn:customer:' || c_custkey, 'and', CAST(CAST(c_acctbal > 0 AS INT) + CAST(c_mktsegment = 'BUILDING' AS INT) AS VARCHAR) FROM customer WHERE NOT (c_acctbal > 0 AND c_mktsegment = 'BUILDING')
UNION ALL SELECT 'urn:customer:' || c_custkey, 'maxExclusive', CAST(c_acctbal AS VARCHAR) FROM customer WHERE c_acctbal >= 9000""")
def shacl_or_and(spark, d):
    g = graph(spark, d, "customer")
    f = V.target_class(g, EX + "Customer")
    rich = V.conforming(f, V.within(f, P.link(g, EX + "acctbal"), 0, exclusive=True))
    building = V.conforming(f, V.one_of(f, P.link(g, EX + "segment"), ["BUILDING"]))
    parts = V.logical(f, "or", [rich, building]).unionByName(V.logical(f, "and", [rich, building])).unionByName(V.within(f, P.link(g, EX + "acctbal"), None, 9000, True))
    return parts.select(F.col("focus.v").alias("focus"), "constraint", "value")


@query("""WITH v AS (SELECT user_id, event_type, ts AS f, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS t FROM events), n AS (SELECT u.user_id, count(DISTINCT v.event_type) AS n FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN v ON v.user_id = u.user_id AND v.f < TIMESTAMP '2024-01-11' AND (v.t IS NULL OR v.t > TIMESTAMP '2024-01-10') GROUP BY 1)
SELECT 'urn:user:' || user_id AS focus, 'minCount' AS "constraint", CAST(n AS VARCHAR) AS value FROM n WHERE n < 1 UNION ALL SELECT 'urn:user:' || user_id, 'maxCount', CAST(n AS VARCHAR) FROM n WHERE n > 2""")
def shacl_valid_for(spark, d):
    """Between one and two kinds of state of each user in a day."""
    user = iri(F.concat(F.lit("urn:user:"), F.col("user_id").cast("string")))
    facts = T.versions(read(spark, d, "events"), ["user_id"], "ts", "event_type").select(user.alias("s"), term(LITERAL, F.col("event_type")).alias("o"), "valid_from", "valid_to")
    focus = read(spark, d, "events").select(user.alias("focus")).distinct()
    return V.count_for(focus, facts, "2024-01-10 00:00:00", "2024-01-11 00:00:00", 1, 2).select(F.col("focus.v").alias("focus"), "constraint", "value")


@query("""SELECT 'urn:customer:' || c_custkey AS s, 'urn:region:' || n_regionkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def shacl_rules(spark, d):
    """A triple rule: customers are based in the region of their nation."""
    g = graph(spark, d, "customer", "nation")
    path = P.sequence(P.link(g, EX + "nation"), P.link(g, EX + "region"))
    return V.rule(g, V.target_class(g, EX + "Customer"), F.col("focus"), EX + "basedIn", F.col("value"), path).select(F.col("s.v").alias("s"), F.col("o.v").alias("o"))


@query("""SELECT 'urn:nation:' || n_nationkey AS nation, n AS n FROM (SELECT n_nationkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 GROUP BY 1) WHERE n >= 2""")
def datalog_aggregate_of_derived(spark, d):
    """Counts over a derived predicate, and a rule over the counts."""
    g = graph(spark, d, "supplier")
    rules = [
        D.Rule(("?s", EX + "solventIn", "?n"), [("?s", EX + "nation", "?n"), ("?s", EX + "acctbal", "?b")], guard=lambda: num(F.col("b")) > 0),
        D.Aggregate(EX + "solvent", ("?s", EX + "solventIn", "?n"), "n", lambda: G.sum_(A.constant(1))),
        D.Rule(("?n", EX + "strong", "?k"), [("?n", EX + "solvent", "?k")], guard=lambda: num(F.col("k")) >= 2),
    ]
    out = A.match(D.infer(g.filter(F.col("p").isin(EX + "nation", EX + "acctbal")), rules), ("?n", EX + "strong", "?k"), "")
    return out.select(F.col("n.v").alias("nation"), num(F.col("k")).cast("long").alias("n"))


@query("""SELECT 1 AS depth, 2 AS rule, '<urn:supplier:' || s_suppkey || '>' AS s, '<urn:region:' || n_regionkey || '>' AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 2, 0, '<urn:supplier:' || s_suppkey || '>', '<urn:nation:' || s_nationkey || '>' FROM supplier
UNION ALL SELECT DISTINCT 2, 1, '<urn:nation:' || n_nationkey || '>', '<urn:region:' || n_regionkey || '>' FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def proof_steps(spark, d):
    """All steps of the proofs that suppliers lie in regions."""
    from .rules import IN, LOCATED

    g = graph(spark, d, "supplier", "nation").filter(F.col("p").isin(EX + "nation", EX + "region"))
    found = D.derivations(g, LOCATED).filter(F.col("head_s").startswith("<urn:supplier") & F.col("head_o").startswith("<urn:region"))
    out = D.proof(g, LOCATED, found.filter(F.col("head_p") == f"<{IN}>"))
    return out.select((F.col("depth") + 1).alias("depth"), "rule", F.col("head_s").alias("s"), F.col("head_o").alias("o"))



