"""SHACL: each constraint is one DataFrame of violations (focus, constraint, value); a report is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sparql import less
from ..terms import BNODE, IRI, LITERAL, RDFS, TYPE, XSD, constant, num


def target_class(quads: DataFrame, cls: str) -> DataFrame:
    """Instances of the class or of a subclass of it."""
    from .paths import one_or_more

    subs = one_or_more(quads.filter(F.col("p") == RDFS + "subClassOf").select(F.col("o").alias("s"), F.col("s").alias("o")), None) if not quads.filter(F.col("p") == RDFS + "subClassOf").isEmpty() else None
    own = quads.filter((F.col("p") == TYPE) & (F.col("o") == constant(f"<{cls}>"))).select(F.col("s").alias("focus"))
    if subs is None:
        return own.distinct()
    below = subs.filter(F.col("s") == constant(f"<{cls}>")).select("o")
    return own.unionByName(quads.filter(F.col("p") == TYPE).join(below, "o").select(F.col("s").alias("focus"))).distinct()


def target_node(quads: DataFrame, *iris: str) -> DataFrame:
    return quads.sparkSession.range(1).select(F.explode(F.array(*[constant(f"<{x}>") for x in iris])).alias("focus"))


def subjects_of(quads: DataFrame, p: str) -> DataFrame:
    return quads.filter(F.col("p") == p).select(F.col("s").alias("focus")).distinct()


def objects_of(quads: DataFrame, p: str) -> DataFrame:
    return quads.filter(F.col("p") == p).select(F.col("o").alias("focus")).distinct()


def values_of(focus: DataFrame, path: DataFrame) -> DataFrame:
    """(focus, value) along a path (s, o); any property path will do."""
    return focus.join(path.select(F.col("s").alias("focus"), F.col("o").alias("value")).distinct(), "focus")


def _report(rows: DataFrame, name: str, value: Column | None = None) -> DataFrame:
    return rows.select("focus", F.lit(name).alias("constraint"), (F.col("value")["v"] if value is None else value.cast("string")).alias("value"))


def count(focus: DataFrame, path: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """minCount and maxCount; the value is the count."""
    n = focus.join(path.select(F.col("s").alias("focus"), "o").distinct().groupBy("focus").agg(F.count(F.lit(1)).alias("n")), "focus", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = _report(n.filter(F.col("n") < least), "minCount", F.col("n"))
    return out if most is None else out.unionByName(_report(n.filter(F.col("n") > most), "maxCount", F.col("n")))


def count_for(focus: DataFrame, facts: DataFrame, start: str, end: str, least: int = 0, most: int | None = None) -> DataFrame:
    """minCount and maxCount of the values that hold at any time in [start, end): ``facts`` (s, o, valid_from, valid_to)."""
    from .temporal import window

    return count(focus, window(facts, start, end).select("s", "o"), least, most)


def rule(quads: DataFrame, focus: DataFrame, subject: Column, predicate: str, value: Column, path: DataFrame | None = None) -> DataFrame:
    """The quads that a triple rule makes for its focus nodes: ``subject`` and ``value`` are over ``focus`` and, with a path, its ``value``."""
    rows = focus if path is None else values_of(focus, path)
    made = rows.select(subject.alias("s"), F.lit(predicate).alias("p"), value.alias("o"), F.lit("").alias("g"))
    return made.filter("s IS NOT NULL AND o IS NOT NULL").distinct()


def where(focus: DataFrame, path: DataFrame, name: str, good: Column) -> DataFrame:
    """Values for which ``good`` (over ``value``) is not true."""
    return _report(values_of(focus, path).filter(~F.coalesce(good, F.lit(False))), name)


_V = lambda: F.col("value")


def datatype(focus, path, dt: str):
    plain = XSD + "string"
    own = F.when((_V()["dt"] == "") & (_V()["lang"] == ""), plain).otherwise(_V()["dt"])
    return where(focus, path, "datatype", (_V()["k"] == LITERAL) & (own == dt))


def node_kind(focus, path, *kinds: str):
    code = {"IRI": IRI, "BlankNode": BNODE, "Literal": LITERAL}
    return where(focus, path, "nodeKind", _V()["k"].isin([code[k] for k in kinds]))


def pattern(focus, path, regex: str):
    return where(focus, path, "pattern", (_V()["k"] != BNODE) & _V()["v"].rlike(regex))


def length(focus, path, least: int = 0, most: int | None = None):
    n = F.char_length(_V()["v"])
    out = where(focus, path, "minLength", n >= least)
    return out if most is None else out.unionByName(where(focus, path, "maxLength", n <= most))


def within(focus, path, low: float | None = None, high: float | None = None, exclusive: bool = False):
    """min/max Inclusive or Exclusive."""
    parts, kind = [], "Exclusive" if exclusive else "Inclusive"
    if low is not None:
        parts.append(where(focus, path, f"min{kind}", num(_V()) > low if exclusive else num(_V()) >= low))
    if high is not None:
        parts.append(where(focus, path, f"max{kind}", num(_V()) < high if exclusive else num(_V()) <= high))
    return reduce(DataFrame.unionByName, parts)


def one_of(focus, path, allowed: list):
    return where(focus, path, "in", reduce(Column.__or__, [_V() == constant(x) for x in allowed]))


def language_in(focus, path, tags: list[str]):
    return where(focus, path, "languageIn", reduce(Column.__or__, [(F.lower(_V()["lang"]) == t) | F.lower(_V()["lang"]).startswith(t + "-") for t in tags]))


def unique_lang(focus, path):
    tags = values_of(focus, path).filter(_V()["lang"] != "").groupBy("focus", F.lower(_V()["lang"]).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return _report(tags.filter("n > 1"), "uniqueLang", F.col("tag"))


def has_value(focus, path, x):
    have = values_of(focus, path).filter(_V() == constant(x)).select("focus").distinct()
    return _report(focus.join(have, "focus", "left_anti"), "hasValue", F.lit(None))


def cls(focus, path, quads: DataFrame, c: str):
    good = target_class(quads, c).select(F.col("focus").alias("value"))
    return _report(values_of(focus, path).join(good, "value", "left_anti"), "class")


def equals(focus, path, other):
    a, b = values_of(focus, path), values_of(focus, other)
    return _report(a.join(b, ["focus", "value"], "left_anti").unionByName(b.join(a, ["focus", "value"], "left_anti")), "equals")


def disjoint(focus, path, other):
    return _report(values_of(focus, path).join(values_of(focus, other), ["focus", "value"]), "disjoint")


def less_than(focus, path, other, or_equal: bool = False):
    both = values_of(focus, path).join(values_of(focus, other).withColumnRenamed("value", "bound"), "focus")
    bad = F.coalesce(~less(F.col("bound"), _V()) if or_equal else less(_V(), F.col("bound")), F.lit(False))
    return _report(both.filter(~bad), "lessThanOrEquals" if or_equal else "lessThan")


def closed(focus: DataFrame, quads: DataFrame, allowed: list[str]) -> DataFrame:
    used = focus.join(quads.select(F.col("s").alias("focus"), "p").distinct(), "focus").filter(~F.col("p").isin(allowed))
    return _report(used, "closed", F.col("p"))


def conforming(focus: DataFrame, *violations: DataFrame) -> DataFrame:
    bad = reduce(DataFrame.unionByName, violations).select("focus").distinct()
    return focus.join(bad, "focus", "left_anti")


def logical(focus: DataFrame, kind: str, shapes: list[DataFrame]) -> DataFrame:
    """and, or, not, xone over the conforming nodes of the shapes."""
    n = reduce(DataFrame.unionByName, [s.select("focus").distinct() for s in shapes]).groupBy("focus").agg(F.count(F.lit(1)).alias("n"))
    rows = focus.join(n, "focus", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    good = {"and": F.col("n") == len(shapes), "or": F.col("n") >= 1, "not": F.col("n") == 0, "xone": F.col("n") == 1}[kind]
    return _report(rows.filter(~good), kind, F.col("n"))


def node(focus, path, shape: DataFrame):
    """sh:node: values must conform to a shape, given by its conforming nodes."""
    return _report(values_of(focus, path).join(shape.select(F.col("focus").alias("value")), "value", "left_anti"), "node")


def qualified(focus, path, shape: DataFrame, least: int = 0, most: int | None = None):
    good = path.join(shape.select(F.col("focus").alias("o")), "o").select("s", "o")
    return count(focus, good, least, most).withColumn("constraint", F.regexp_replace("constraint", "^m(in|ax)Count", "qualifiedM$1Count"))


def sparql(solutions: DataFrame) -> DataFrame:
    """sh:sparql: each solution of a query that binds ``this`` is a violation."""
    return solutions.select(F.col("this").alias("focus"), F.lit("sparql").alias("constraint"), F.lit(None).cast("string").alias("value"))


def score(report: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row: 1 - sum(w v) / sum(w (v + 1)) over the constraints' violation counts v."""
    n = report.groupBy("constraint").agg(F.count(F.lit(1)).alias("v"))
    w = report.sparkSession.range(1).select(F.explode(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])).alias("constraint", "w"))
    both = w.join(n, "constraint", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    return both.agg((1 - F.sum(F.col("w") * F.col("v")) / F.sum(F.col("w") * (F.col("v") + 1))).alias("score"))
