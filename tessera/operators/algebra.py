"""The SPARQL algebra over quads, as functions from DataFrames to DataFrames.

A solution sequence is a DataFrame with a term column per variable; an unbound variable is null. Names that start
with ``?`` in a pattern are variables. Joins are equi-joins on the shared variables unless one of them may be unbound,
which the caller says with ``maybe``; then rows with a null are joined apart, so that the bound ones stay an equi-join.
"""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..terms import QUOTED, TERM, constant, iri

Pattern = tuple  # (s, p, o) of "?var" or constants


def var(x: object) -> str | None:
    return x[1:] if isinstance(x, str) and x.startswith("?") else None


def same(a: Column, b: Column) -> Column:
    """Equality of terms field by field: constant fields fold away, so that of two mapped IRIs only the strings are compared."""
    return (a["v"] == b["v"]) & (a["k"] == b["k"]) & (a["dt"] == b["dt"]) & (a["lang"] == b["lang"])


def match(quads: DataFrame, pattern: Pattern, graph: str | None = None) -> DataFrame:
    """Solutions of one triple pattern. ``graph``: None any graph (merged), "" the default one, an IRI, or "?g" (named graphs only)."""
    s, p, o = pattern
    rows, out, seen = quads, [], {}
    if graph is not None:
        rows = rows.filter(F.col("g") != "") if var(graph) else rows.filter(F.col("g") == graph)
    for name, x in (("s", s), ("p", p), ("o", o), *([("g", graph)] if graph is not None and var(graph) else [])):
        col = iri(F.col(name)) if name in "pg" else F.col(name)
        if v := var(x):
            if v in seen:
                rows = rows.filter(same(seen[v], col))
            else:
                seen[v] = col
                out.append(col.alias(v))
        elif name == "p":
            rows = rows.filter(F.col("p") == x)
        elif name != "g":
            rows = rows.filter(same(col, constant(x)))
    found = rows.select(*out) if out else rows.select(F.lit(1).alias("_one"))
    return found.distinct() if graph is None else found  # the merge of graphs is a set


def bgp(quads: DataFrame, patterns: list[Pattern], graph: str | None = "") -> DataFrame:
    """Join of triple patterns, connected ones first (a pattern that shares no variable is a cross product, at the end)."""
    todo = list(dict.fromkeys(patterns))
    out = match(quads, todo.pop(0), graph)
    while todo:
        k = next((i for i, t in enumerate(todo) if {v for x in t if (v := var(x))} & set(out.columns)), 0)
        out = join(out, match(quads, todo.pop(k), graph))
    return out.drop("_one") if len(out.columns) > 1 and "_one" in out.columns else out


def shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns and c != "_one"]


def _equal(a: DataFrame, c: str, tag: str) -> Column:
    x, y = F.col(c), F.col(f"{c}_{tag}")
    return same(x, y) if isinstance(a.schema[c].dataType, StructType) else x == y


def join(a: DataFrame, b: DataFrame, maybe: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Compatible-mapping join. ``maybe``: shared variables that may be unbound on a side."""
    on = shared(a, b)
    b = b.drop("_one")
    if not on:
        return a.crossJoin(b) if how == "inner" else a.join(b, F.lit(True), how)
    loose = [c for c in on if c in (maybe or [])]
    tag = uuid4().hex[:6]
    right = b.select([F.col(c).alias(f"{c}_{tag}") if c in on else F.col(c) for c in b.columns])
    firm = [_equal(a, c, tag) for c in on if c not in loose]
    if not loose:
        both = a.join(right, reduce(Column.__and__, firm), how)
        return both if how in ("left_semi", "left_anti") else both.drop(*[f"{c}_{tag}" for c in on])
    # every way in which the loose variables can be bound on each side is one equi-join
    both = reduce(DataFrame.unionByName, [x for x, _ in _ways(a, right, on, loose, firm, tag)])
    if how == "inner":
        keep = [F.coalesce(F.col(c), F.col(f"{c}_{tag}")).alias(c) if c in on else F.col(c) for c in a.columns]
        return both.select(*keep, *[c for c in b.columns if c not in on])
    if how == "left":
        return _left_of(a, lambda keyed: join(keyed, b, maybe))
    met = both.select(a.columns).distinct()
    return _same_rows(a, met, how)


def _ways(a: DataFrame, right: DataFrame, on: list[str], loose: list[str], firm: list[Column], tag: str) -> list[tuple[DataFrame, bool]]:
    """The joins for each way, and whether some variable is bound on both sides."""
    out = []
    for mask in range(4 ** len(loose)):
        conds, la, lb, both = list(firm), F.lit(True), F.lit(True), bool(firm)
        for i, c in enumerate(loose):
            bits = mask >> (2 * i) & 3
            la = la & (F.col(c).isNotNull() if bits & 1 else F.col(c).isNull())
            lb = lb & (F.col(f"{c}_{tag}").isNotNull() if bits & 2 else F.col(f"{c}_{tag}").isNull())
            if bits == 3:
                conds.append(_equal(a, c, tag))
                both = True
        out.append((a.filter(la).join(right.filter(lb), reduce(Column.__and__, conds) if conds else F.lit(True)), both))
    return out


def _same_rows(a: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``a`` with rows that are equal in all its columns, unbound ones included."""
    tag = uuid4().hex[:6]
    keys = rows.select([F.col(c).alias(f"{c}_{tag}") for c in a.columns])
    return a.join(keys, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_{tag}")) for c in a.columns]), how)


def _left_of(a: DataFrame, inner) -> DataFrame:
    """LeftJoin out of an inner join: ``inner`` gets ``a`` with a copy of each column and its rows are told by these."""
    tag = uuid4().hex[:6]
    kept = {c: f"_{tag}_{c}" for c in a.columns}
    both = inner(a.select("*", *[F.col(c).alias(k) for c, k in kept.items()]))
    met = both.select([F.col(k).alias(c) for c, k in kept.items()]).distinct()
    return both.drop(*kept.values()).unionByName(_same_rows(a, met, "left_anti"), allowMissingColumns=True)


def optional(a: DataFrame, b: DataFrame, condition: Column | None = None, maybe: list[str] | None = None) -> DataFrame:
    """LeftJoin; ``condition`` may use both sides' variables."""
    if condition is None:
        return join(a, b, maybe, "left")
    on = shared(a, b)
    if set(on) & set(maybe or []):
        return _left_of(a, lambda keyed: join(keyed, b, maybe).filter(condition))
    tag = uuid4().hex[:6]
    right = b.select([F.col(c).alias(f"{c}_{tag}") if c in on else F.col(c) for c in b.columns])
    conds = [_equal(a, c, tag) for c in on] + [condition]
    return a.join(right, reduce(Column.__and__, conds), "left").drop(*[f"{c}_{tag}" for c in on])


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def minus(a: DataFrame, b: DataFrame, maybe: list[str] | None = None) -> DataFrame:
    """Rows of ``a`` without a compatible row of ``b`` that shares a bound variable; no shared variables, no change."""
    on = shared(a, b)
    if not on:
        return a
    loose = [c for c in on if c in (maybe or [])]
    if not loose:
        return join(a, b.select(on), how="left_anti")
    tag = uuid4().hex[:6]
    right = b.select([F.col(c).alias(f"{c}_{tag}") for c in on]).distinct()
    firm = [_equal(a, c, tag) for c in on if c not in loose]
    ways = [x.select(a.columns) for x, both in _ways(a, right, on, loose, firm, tag) if both]
    return _same_rows(a, reduce(DataFrame.unionByName, ways).distinct(), "left_anti")


def exists(a: DataFrame, b: DataFrame) -> DataFrame:
    return join(a, b, how="left_semi") if shared(a, b) else a.filter(F.lit(not b.isEmpty()))


def not_exists(a: DataFrame, b: DataFrame) -> DataFrame:
    return join(a, b, how="left_anti") if shared(a, b) else a.filter(F.lit(b.isEmpty()))


def lateral(a: DataFrame, b: DataFrame, order: list[Column], limit: int, outer: bool = False) -> DataFrame:
    """For each row of ``a`` the first ``limit`` compatible rows of ``b`` in ``order``; with ``outer`` rows of ``a`` without one stay.

    A join and a window over a key of the row of ``a``, whose least rows Spark picks before it shuffles."""
    from pyspark.sql import Window

    keyed = a.withColumn("_row", F.monotonically_increasing_id())
    both = join(keyed, b, how="left" if outer else "inner")
    return both.withColumn("_n", F.row_number().over(Window.partitionBy("_row").orderBy(*order))).filter(F.col("_n") <= limit).drop("_n", "_row")


def quoted_match(quads: DataFrame, inner: Pattern, p: str, o: object, graph: str | None = "", side: str = "s") -> DataFrame:
    """Solutions of a pattern whose subject (or object: ``side`` "o") is a quoted triple with variables inside: ``<< ?a p ?b >> p o``."""
    from ..sources.ntriples import quoted_parts

    outer = ("?_q", p, o) if side == "s" else (o, p, "?_q")
    rows = match(quads, outer, graph)
    rows = rows.filter(F.col("_q")["k"] == QUOTED).withColumn("_t", quoted_parts(F.col("_q")["v"])).drop("_q")
    out = rows
    for name, x in zip(("s", "p", "o"), inner):
        part = F.col("_t")[name]
        out = out.filter(part.isNotNull())
        if not (v := var(x)):
            out = out.filter(same(part, iri(x) if name == "p" else constant(x)))
        elif v in out.columns:
            out = out.filter(same(part, F.col(v)))
        else:
            out = out.withColumn(v, part)
    return out.drop("_t", "_one")


def extend(a: DataFrame, name: str, value: Column) -> DataFrame:
    return a.withColumn(name, value)


def values(quads: DataFrame, names: list[str], rows: list[tuple]) -> DataFrame:
    """An inline table; None is UNDEF."""
    one = quads.sparkSession.range(1)
    cell = lambda x, c: (F.lit(None).cast(TERM) if x is None else constant(x)).alias(c)
    return reduce(DataFrame.unionByName, [one.select(*[cell(x, c) for x, c in zip(r, names)]) for r in rows])


def ask(a: DataFrame) -> DataFrame:
    """One row: whether there is a solution."""
    return a.select(F.lit(1)).limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))


def construct(a: DataFrame, template: list[Pattern]) -> DataFrame:
    """Triples of the template for each solution; a triple with an unbound part is left out."""
    part = lambda x: F.col(var(x)) if var(x) else constant(x)
    made = [F.struct(part(s).alias("s"), (F.col(var(p))["v"] if var(p) else F.lit(p)).alias("p"), part(o).alias("o")) for s, p, o in template]
    rows = a.select(F.explode(F.array(*made)).alias("t")).select("t.*")
    return rows.filter("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct().withColumn("g", F.lit(""))


def describe(quads: DataFrame, resources: DataFrame, form: str = "cbd") -> DataFrame:
    """Quads about the terms in ``resources`` (column ``x``): ``simple`` their own, ``cbd`` through blank nodes, ``scbd`` also those that point to them."""
    from ..store import QUAD, fixpoint

    own = resources.select(F.col("x").alias("s")).distinct()
    if form != "simple":
        own = fixpoint(own, lambda new, _: quads.join(new, "s").filter(F.col("o")["k"] == 1).select(F.col("o").alias("s")), ["s"])
    out = quads.join(own, "s", "left_semi").select(QUAD)
    if form == "scbd":
        out = out.unionByName(quads.join(own.withColumnRenamed("s", "o"), "o", "left_semi").select(QUAD)).distinct()
    return out
