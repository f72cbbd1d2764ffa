"""SPARQL's aggregates on term columns, for ``groupBy(...).agg(...)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.sparql import decimal_text, exact
from ..terms import LITERAL, XSD, num, term


def count(t: Column | None = None, distinct: bool = False) -> Column:
    if t is None:
        return F.count(F.lit(1))
    return F.count_distinct(t) if distinct else F.count(t)


def approx_count_distinct(t: Column) -> Column:
    return F.approx_count_distinct(t)


def _all_numbers(t: Column) -> Column:
    """Whether no bound value is something else than a number."""
    return F.count(F.when(t.isNotNull() & num(t).isNull(), 1)) == 0


def _class(t: Column) -> Column:
    """The widest numeric type among the values."""
    rank = F.max(F.when(t["dt"].isin(XSD + "double", XSD + "float"), 2).when(t["dt"] == XSD + "decimal", 1).otherwise(0))
    return F.when(rank == 2, XSD + "double").when(rank == 1, XSD + "decimal").otherwise(XSD + "integer")


def _total(t: Column) -> Column:
    """The sum as text: integers and decimals without rounding, in doubles if one value is a double."""
    whole, parts = F.try_sum(exact(t, "decimal(38,0)")), F.try_sum(exact(t, "decimal(38,10)"))
    zero = F.lit("0")
    return F.when(_class(t) == XSD + "integer", F.coalesce(whole.cast("string"), zero)).when(_class(t) == XSD + "decimal", F.coalesce(decimal_text(parts), zero)).otherwise(F.coalesce(F.sum(num(t)), F.lit(0.0)).cast("string"))


def sum_(t: Column) -> Column:
    return F.when(_all_numbers(t), term(LITERAL, _total(t), _class(t)))


def avg(t: Column) -> Column:
    """Of no values 0, as the specification has it; integers give a decimal."""
    kind = F.when(_class(t) == XSD + "double", XSD + "double").otherwise(XSD + "decimal")
    mean = F.try_divide(F.try_sum(exact(t, "decimal(38,10)")), F.count(num(t)))
    text = F.when(kind == XSD + "double", F.coalesce(F.avg(num(t)), F.lit(0.0)).cast("string")).otherwise(F.coalesce(decimal_text(mean), F.lit("0")))
    return F.when(_all_numbers(t), term(LITERAL, text, kind))


def min_(t: Column) -> Column:
    """Least term: numbers by value, other terms by lexical form; a mixture is ordered numbers first."""
    return F.min_by(t, F.struct(num(t).isNull(), num(t), t["v"]))


def max_(t: Column) -> Column:
    return F.max_by(t, F.struct(num(t).isNull(), num(t), t["v"]))


def group_concat(t: Column, separator: str = " ", distinct: bool = False) -> Column:
    return F.array_join(F.array_sort((F.collect_set if distinct else F.collect_list)(t["v"])), separator)


def sample(t: Column) -> Column:
    return F.min(t)


def median(t: Column) -> Column:
    return F.percentile(num(t), 0.5)


def mode(t: Column) -> Column:
    return F.mode(t["v"], True)
