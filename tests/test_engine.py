"""Pieces of the engine against small cases and plain Python."""

import math
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import geo, topology
from tessera.functions import sparql as S
from tessera.operators import algebra as A
from tessera.operators import analytics as N
from tessera.operators import paths as P
from tessera.operators import search as W
from tessera.operators import shacl as V
from tessera.operators import uncertain as U
from tessera.operators import update as Q
from tessera.operators import vectors as X
from tessera.plans import datalog as D
from tessera.plans import rulesets as R
from tessera.sources import ntriples as T
from tessera.store import triples
from tessera.terms import OWL, RDFS, TYPE, constant, literal, num

DATA = "/root/testdata/sf0.001"
SLOW = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
EDGES = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=12)


def rows(df):
    return sorted(map(tuple, df.collect()))


@SLOW
@given(EDGES)
def test_closure_matches_search(spark, edges):
    df = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "s string, o string")
    want = set()
    for a in {a for a, _ in edges}:
        seen, stack = set(), [a]
        while stack:
            x = stack.pop()
            for y in {b for c, b in edges if c == x} - seen:
                seen.add(y)
                stack.append(y)
        want |= {(str(a), str(y)) for y in seen}
    assert set(rows(P.one_or_more(df))) == want


@SLOW
@given(EDGES)
def test_components_match_union(spark, edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = N.components(spark.createDataFrame(edges, "src long, dst long"))
    assert rows(got.select("node", "component")) == sorted(root.items())


@SLOW
@given(EDGES)
def test_pagerank_is_a_fixed_point(spark, edges):
    got = dict(rows(N.pagerank(spark.createDataFrame(edges, "src long, dst long"), delta=1e-10)))
    links, n = set(edges), len(got)
    out = {a: len({b for c, b in links if c == a}) for a, _ in links}
    lost = sum(r for v, r in got.items() if v not in out)
    assert math.isclose(sum(got.values()), 1, abs_tol=1e-6) and all(r > 0 for r in got.values())
    for v, r in got.items():
        assert math.isclose(r, 0.15 / n + 0.85 * (lost / n + sum(got[a] / out[a] for a, b in links if b == v)), abs_tol=1e-6)


def test_max_depth_and_start(spark):
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(6)], "s string, o string")
    start = spark.createDataFrame([("0",)], "s string")
    assert rows(P.one_or_more(chain, start, 3)) == [("0", "1"), ("0", "2"), ("0", "3")]


LINES = [
    '<urn:a> <urn:p> "x \\"y\\" \\\\ z\\n"@en .', '<urn:a> <urn:p> "3"^^<http://www.w3.org/2001/XMLSchema#integer> <urn:g> .', '_:b <urn:p> _:c . # note',
    '<< <urn:a> <urn:p> "q r" >> <urn:says> <urn:z> .',
]


def test_ntriples_round_trip(spark):
    df = spark.createDataFrame([(x,) for x in [*LINES, "", "# only a note", "bad line", '<urn:a> <urn:p> "' + "x\\n" * 20_000 + '" .']], "value string")
    quads = T.parse(df)
    assert quads.count() == 5 and T.rejected(df).count() == 1
    assert rows(T.parse(T.line(quads)).select(F.to_json(F.struct("*")))) == rows(quads.select(F.to_json(F.struct("*"))))
    with pytest.raises(Exception, match="malformed"):
        T.parse(df, strict=True).collect()


def test_optional_minus_and_compatible_join(spark):
    g = triples(spark, [("<urn:a>", "urn:p", 1), ("<urn:b>", "urn:p", 2), ("<urn:a>", "urn:q", "x")])
    left = A.optional(A.match(g, ("?s", "urn:p", "?n"), ""), A.match(g, ("?s", "urn:q", "?x"), ""))
    assert rows(left.select("s.v", "x.v")) == [("urn:a", "x"), ("urn:b", None)]
    other = A.values(g, ["x", "y"], [("x", "one"), ("z", "two"), (None, "any")])
    got = A.join(left, other, ["x"]).select("s.v", "x.v", "y.v")
    assert sorted(map(str, rows2(got))) == sorted(map(str, [("urn:a", "x", "one"), ("urn:a", "x", "any"), ("urn:b", "x", "one"), ("urn:b", "z", "two"), ("urn:b", None, "any")]))
    assert rows(A.minus(left, other.filter("x IS NOT NULL"), ["x"]).select("s.v")) == [("urn:b",)]
    assert A.minus(left, A.values(g, ["z"], [(1,)])).count() == 2


def rows2(df):
    return [tuple(r) for r in df.collect()]


def test_functions(spark):
    t = lambda e: spark.range(1).select(e.alias("x")).first()[0]
    a = literal("Ab", lang="en")
    assert t(S.concat(a, literal("c", lang="en"))["lang"]) == "en" and t(S.concat(a, literal("c"))["lang"]) == ""
    assert t(S.encode_for_uri(literal("a b*~é"))["v"]) == "a%20b%2A~%C3%A9"
    assert t(num(S.round_(literal(-2.5)))) == -2 and t(S.divide(literal(1), literal(0))) is None
    assert t(S.equal(literal(1), literal(1.0))) and not t(S.same_term(literal(1), literal(1.0)))
    assert t(S.less(literal("a"), literal("b"))) and t(S.less(literal("a"), literal(1))) is None
    assert t(S.ebv(literal(""))) is False and t(S.ebv(literal(0))) is False and t(S.ebv(literal("x"))) is True
    assert t(S.datatype(a)["v"]).endswith("langString") and t(S.cast(literal("12.7"), "integer")["v"]) == "12"
    assert t(S.cast(literal("no"), "double")) is None and t(num(S.seconds(literal("2024-01-02T03:04:05", "dateTime")))) == 5
    assert t(S.levenshtein_within(F.lit("kitten"), F.lit("sitting"), 3)) and not t(S.levenshtein_within(F.lit("kitten"), F.lit("sitting"), 2))
    assert round(t(S.jaro_winkler(F.lit("MARTHA"), F.lit("MARHTA"))), 4) == 0.9611
    assert t(S.langmatches(literal("de-CH"), "de")) and t(S.token_set_ratio(F.lit("New York City"), F.lit("york new"))) == 1


def test_describe_follows_blank_nodes(spark):
    g = triples(spark, [("<urn:a>", "urn:p", "_:x"), ("_:x", "urn:q", "_:y"), ("_:y", "urn:r", 1), ("<urn:b>", "urn:p", "<urn:a>"), ("<urn:c>", "urn:p", 2)])
    x = spark.range(1).select(constant("<urn:a>").alias("x"))
    assert [A.describe(g, x, f).count() for f in ("simple", "cbd", "scbd")] == [1, 3, 4]


def test_strata_and_negative_cycles():
    p, q = D.Rule(("?x", "q", "?y"), [("?x", "p", "?y")]), D.Rule(("?x", "r", "?y"), [("?x", "p", "?y")], [("?x", "q", "?y")])
    assert [len(s) for s in D.strata([q, p])] == [1, 1]
    with pytest.raises(ValueError):
        D.strata([D.Rule(("?x", "w", "y"), [("?x", "m", "?y")], [("?y", "w", "y")])])


def test_rule_sets(spark):
    g = triples(spark, [("<urn:a>", OWL + "sameAs", "<urn:b>"), ("<urn:a>", TYPE, "<urn:C>"), ("<urn:C>", RDFS + "subClassOf", "<urn:D>")])
    out = D.infer(g, R.owl_rl())
    for s in ("<urn:a>", "<urn:b>"):
        assert Q.find(out, s, TYPE, "<urn:D>").count() == 1
    chain = triples(spark, [(f"<urn:n{k}>", RDFS + "subClassOf", f"<urn:n{k + 1}>") for k in range(5)])
    assert D.infer(chain, R.rdfs()).count() == 15


def test_updates(spark):
    g = triples(spark, [("<urn:a>", "urn:p", 1), ("<urn:b>", "urn:p", 2, "urn:g"), ("<urn:c>", "urn:p", "<urn:a>", "urn:h")])
    assert rows(Q.graphs(Q.copy(g, "", "urn:g"))) == [("urn:g", 1), ("urn:h", 1)]
    assert rows(Q.graphs(Q.move(g, "urn:g", "urn:h"))) == [("urn:h", 1)]
    assert Q.clear(g).count() == 0 and Q.clear(g, named=True).count() == 1 and Q.clear(g, "").count() == 2
    assert Q.erase_subject(g, "<urn:a>").count() == 1
    two = triples(spark, [("<urn:a>", "urn:p", 1, "urn:low"), ("<urn:a>", "urn:p", 2, "urn:high")])
    assert rows(Q.conflict_resolved(two, {"urn:high": 2, "urn:low": 1}).select("o.v")) == [("2",)]


def test_shacl_unique_language_and_paths(spark):
    g = triples(spark, [("<urn:a>", "urn:p", "<urn:b>"), ("<urn:b>", "urn:p", "<urn:c>")])
    named = g.unionByName(spark.range(1).select(F.explode(F.array(literal("x", lang="en"), literal("y", lang="EN"))).alias("o")).select(constant("<urn:a>").alias("s"), F.lit("urn:l").alias("p"), "o", F.lit("").alias("g")))
    f = V.target_node(g, "urn:a")
    assert V.unique_lang(f, P.link(named, "urn:l")).count() == 1
    assert V.count(f, P.one_or_more(P.link(g, "urn:p")), 3).collect()[0]["value"] == "2"
    assert V.node(f, P.link(g, "urn:p"), V.target_node(g, "urn:c")).count() == 1


def test_noisy_or_and_private_counts(spark):
    c = lambda *xs: spark.createDataFrame([(x,) for x in xs], "c double").agg(U.noisy_or(F.col("c"))).first()[0]
    assert math.isclose(c(0.5, 0.5), 0.75) and c(0.3, 1.0) == 1.0 and c(0.0) == 0.0
    n = [U.noisy_count(spark.range(100), 5.0, s).first()[0] for s in range(5)]
    assert all(abs(x - 100) < 10 for x in n) and len(set(n)) == 5
    with pytest.raises(ValueError):
        U.laplace(11)


def test_triangles_shuffle_links_not_pairs_of_links(spark):
    """100 nodes linked to the same 60, of which some are linked to each other: 6,000 links, 177,000 pairs of them. Loops, repeats and nulls are no links."""
    rnd = random.Random(9)
    links = {(t, m) for t in range(1000, 1100) for m in range(60)} | {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(40)}
    given = [*links, *((b, a) for a, b in links if a % 7 == 0), (3, 3), (None, 4), (5, None)]
    both = {(min(p), max(p)) for p in links}
    near = {v: {b for p in both for b in p if v in p and b != v} for p in both for v in p}
    want = sorted({tuple(sorted((a, b, c))) for a, b in both for c in near[a] & near[b]})
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm

    def stages():
        nothing = jvm.java.util.ArrayList()
        found = sc._jsc.sc().statusStore().stageList(nothing, False, False, sc._gateway.new_array(jvm.double, 0), nothing)
        return {(g.stageId(), g.attemptId()): g.shuffleWriteRecords() for g in map(found.apply, range(found.size()))}

    at, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), stages()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rows(N.triangles(spark.createDataFrame(given, "src long, dst long")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)
    assert got == want and len(got) > 3000
    assert max(n for k, n in stages().items() if k not in before) <= 2 * len(given)


def test_triangles_send_no_lists_through_the_driver(spark):
    """60 nodes linked to each other: 1,770 links, in files far below any threshold, send 34,220 numbers, which were broadcast."""
    links = [(a, b) for a in range(60) for b in range(a)]
    at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        found = N.triangles(spark.createDataFrame(links, "src long, dst long"))
        got = rows(found)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)
    assert got == sorted((a, b, c) for c in range(60) for b in range(c) for a in range(b))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_personalised_pagerank_prefers_seeds(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3)], "src long, dst long")
    r = dict(rows(N.pagerank(e, seeds=spark.createDataFrame([(1,)], "node long"))))
    assert r[1] + r[2] > 0.99


def test_partitioned_store_prunes(spark, tmp_path):
    from tessera.store import write_partitioned

    write_partitioned(triples(spark, [("<urn:a>", "urn:p", 1), ("<urn:a>", "urn:q", 2)]), str(tmp_path / "q"))
    df = A.match(spark.read.parquet(str(tmp_path / "q")), ("?s", "urn:p", "?o"), "")
    assert df.count() == 1 and "PartitionFilters: [isnotnull(p" in df._jdf.queryExecution().toString()


@SLOW
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.sampled_from([None, 1, 2]), st.integers(0, 1)), min_size=1, max_size=6), st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.sampled_from([1, 2]), st.integers(5, 6)), min_size=1, max_size=6))
def test_joins_with_unbound_variables(spark, ra, rb):
    a, b = spark.createDataFrame(ra, "x int, y int, u int"), spark.createDataFrame(rb, "x int, y int, w int")
    fits = lambda p, q: all(m is None or n is None or m == n for m, n in zip(p[:2], q[:2]))
    meet = lambda p, q: any(m is not None and n is not None for m, n in zip(p[:2], q[:2]))
    mixed = lambda p, q: (p[0] if p[0] is not None else q[0], p[1] if p[1] is not None else q[1], p[2], q[2])
    got = lambda d: Counter(tuple(r[c] for c in ("x", "y", "u", "w")) for r in d.collect())

    def left(good):
        return Counter(x for p in ra for x in ([mixed(p, q) for q in rb if fits(p, q) and good(q)] or [(*p, None)]))

    assert got(A.optional(a, b, maybe=["x", "y"])) == left(lambda q: True)
    assert got(A.optional(a, b, F.col("w") == 5, ["x", "y"])) == left(lambda q: q[2] == 5)
    assert Counter(map(tuple, A.minus(a, b, ["x", "y"]).collect())) == Counter(p for p in ra if not any(fits(p, q) and meet(p, q) for q in rb))


def test_retraction_and_additions_equal_a_fresh_closure(spark):
    rules = [D.Rule(("?x", "urn:r", "?y"), [("?x", "urn:e", "?y")]), D.Rule(("?x", "urn:r", "?z"), [("?x", "urn:r", "?y"), ("?y", "urn:r", "?z")])]
    edge = lambda a, b: (f"<urn:{a}>", "urn:e", f"<urn:{b}>")
    base = triples(spark, [edge(*x) for x in ("ab", "bc", "ca", "cd", "de", "bd")])
    gone, more = triples(spark, [edge("b", "c")]), triples(spark, [edge("e", "f"), edge("f", "a")])
    lex = lambda d: sorted((r["s"]["v"], r["p"], r["o"]["v"]) for r in d.collect())
    rest = base.join(gone, ["s", "p", "o", "g"], "left_anti").select(base.columns)
    assert lex(D.retracted(base, gone, rules)) == lex(D.infer(rest, rules))
    closed = D.infer(base, rules)
    assert lex(closed.unionByName(more).unionByName(D.extended(closed, more, rules))) == lex(D.infer(base.unionByName(more), rules))
    asked = D.ask_goal(base, rules, ("?x", "urn:r", "<urn:e>"))
    assert sorted(r["x"]["v"] for r in asked.collect()) == [f"urn:{x}" for x in "abcd"]


def test_geometries_are_parsed_once_a_row(spark):
    """Inside a lambda an expression is computed anew at each corner, which made a ring's cost quadratic."""
    w, p = F.col("w"), F.col("p")
    for made, n in ((geo.area(w), 1), (geo.length(w), 1), (geo.bounds(w), 1), (geo.distance(p, w), 2), (geo.within(p, w), 2)):
        assert str(made).count("regexp_extract") == n


def test_outlines_of_a_small_file_are_many_tasks(spark):
    got = topology.shaped(F.col("w"), "buffer", 1.0)
    rows = spark.createDataFrame([("POINT(0 0)",), (None,), ("POINT(0 0)",)], "w string").select(got.alias("w"), geo.area(got).alias("a")).collect()
    assert rows[1]["w"] is None and rows[0] == rows[2] and 3.1 < rows[0]["a"] < math.pi
    for name in ("geometry_points", "geometry_lines", "geometry_outlines", "typed_arithmetic"):
        assert catalog.QUERIES[name](spark, DATA).rdd.getNumPartitions() > 1


def test_duplicates_by_keys_equal_all_pairs(spark):
    names = ["", "a", "b", "ab", "ba", "abc", "axc", "ac", "abcd", "abc", None, "xyz"]
    r = spark.createDataFrame([(k, n, k % 2) for k, n in enumerate(names * 2)] + [(99, "abc", None)], "id long, name string, block int")
    rank = r.select(F.col("id").alias("node"), (F.col("id") % 5).cast("double").alias("rank"))
    alike = lambda a, b: (F.levenshtein(a, b) <= 1).cast("double")
    got = W.duplicates(r, rank, alike, 1.0, "block", W.one_edit_keys)
    assert rows(got) == rows(W.duplicates(r, rank, alike, 1.0, "block")) and got.count() > 20
    plan = catalog.QUERIES["ranked_duplicates"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "_key" in plan  # not all pairs of a nation


def test_nearest_in_slices(spark):
    """The similarities of a whole block of queries with a block of items were held at once, several times."""
    assert X.SLICE * 16384 * 8 < 1 << 24
    v = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(3 * X.SLICE)]
    df = spark.createDataFrame(v, "id long, vector array<double>")
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b), 12)
    want = {(q, i) for q, a in v for i in sorted(range(len(v)), key=lambda i: (-cos(a, v[i][1]), i))[:4]}
    assert {(r["query"], r["item"]) for r in X.nearest(df, df, 4).collect()} == want


def test_fresh_terms_are_dealt_out_before_they_are_counted(spark):
    """Several distinct counts at once copied each row and kept all keys of an input task in one table."""
    plan = catalog.QUERIES["fresh_terms"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
