"""SPARQL's functions on term columns. An error is null, as in the specification's three-valued logic.

Bind what a function gives with ``algebra.extend`` before another one uses it: a projection of its own is evaluated once, a nested
expression once for every use of it.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import BNODE, IRI, LITERAL, NUMERIC, XSD, bare, bnode, iri, literal, ntriples, num, term


def _string(t: Column) -> Column:
    """The lexical form of string literals only."""
    return F.when((t["k"] == LITERAL) & (t["dt"] == ""), t["v"])


def _like(t: Column, v: Column) -> Column:
    """A string with the language of ``t``."""
    return term(LITERAL, v, "", t["lang"])


def double(v: Column) -> Column:
    return literal(v.cast("string"), "double")


def integer(v: Column) -> Column:
    return literal(v.cast("long").cast("string"), "integer")


is_iri = lambda t: t["k"] == IRI
is_blank = lambda t: t["k"] == BNODE
is_literal = lambda t: t["k"] == LITERAL
is_numeric = lambda t: num(t).isNotNull()
bound = lambda t: t.isNotNull()
str_ = lambda t: literal(F.when(t["k"] != BNODE, t["v"]))
lang = lambda t: literal(F.when(t["k"] == LITERAL, t["lang"]))
same_term = lambda a, b: a == b


def datatype(t: Column) -> Column:
    own = F.when(t["lang"] != "", F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")).when(t["dt"] == "", F.lit(XSD + "string")).otherwise(t["dt"])
    return iri(F.when(t["k"] == LITERAL, own))


def ebv(t: Column) -> Column:
    """Effective boolean value."""
    return F.when(t["dt"] == XSD + "boolean", t["v"].isin("true", "1")).when(t["dt"].isin(NUMERIC), F.coalesce(num(t) != 0, F.lit(False))).when(_string(t).isNotNull(), F.length(t["v"]) > 0)


DATES = [XSD + "dateTime", XSD + "date"]
SAFE = float(2**53)  # from here on doubles do not tell neighbouring integers apart


def _rank(t: Column) -> Column:
    """0 integers, 1 decimals, 2 floats, 3 doubles; null for other terms."""
    return F.when(num(t).isNotNull(), F.when(t["dt"] == XSD + "double", 3).when(t["dt"] == XSD + "float", 2).when(t["dt"] == XSD + "decimal", 1).otherwise(0))


def exact(t: Column, kind: str = "decimal(38,18)") -> Column:
    """The value of an integer or decimal without rounding; null for other terms."""
    return F.when(_rank(t) < 2, t["v"].try_cast(kind))


def _numbers(a: Column, b: Column, op) -> Column:
    """``op`` on doubles, and on exact values where both are so and too large for doubles."""
    large = (F.abs(num(a)) >= SAFE) & (F.abs(num(b)) >= SAFE) & (_rank(a) < 1) & (_rank(b) < 1)
    return F.when(large, op(exact(a, "decimal(38,0)"), exact(b, "decimal(38,0)"))).otherwise(op(num(a), num(b)))


def _ordered(a: Column, b: Column, op) -> Column:
    both = lambda *dts: (a["k"] == LITERAL) & (b["k"] == LITERAL) & (a["dt"] == b["dt"]) & a["dt"].isin(*dts)
    return (
        F.when(num(a).isNotNull() & num(b).isNotNull(), _numbers(a, b, op))
        .when(both(*DATES), op(when(a), when(b)))
        .when(both(XSD + "boolean"), op(a["v"].isin("true", "1"), b["v"].isin("true", "1")))
        .when(both("") & (a["lang"] == b["lang"]), op(a["v"], b["v"]))
    )


def equal(a: Column, b: Column) -> Column:
    """``=``: numbers, booleans and times by value, other terms by identity."""
    op = lambda x, y: x == y
    return F.coalesce(_ordered(a, b, op), same_term(a, b))


def less(a: Column, b: Column) -> Column:
    """``<`` of two numbers, strings, booleans or times; anything else is an error."""
    return _ordered(a, b, lambda x, y: x < y)


def not_equal(a: Column, b: Column) -> Column:
    return ~equal(a, b)


def greater(a: Column, b: Column) -> Column:
    return less(b, a)


def at_most(a: Column, b: Column) -> Column:
    return _ordered(a, b, lambda x, y: x <= y)


def at_least(a: Column, b: Column) -> Column:
    return at_most(b, a)


def boolean(v: Column) -> Column:
    return literal(v.cast("string"), "boolean")


def and_(*ts: Column) -> Column:
    """``&&`` on effective boolean values: false with an error is false, true with an error an error."""
    return boolean(reduce(Column.__and__, map(ebv, ts)))


def or_(*ts: Column) -> Column:
    return boolean(reduce(Column.__or__, map(ebv, ts)))


def not_(t: Column) -> Column:
    return boolean(~ebv(t))


def in_(t: Column, *others: Column) -> Column:
    """``IN``: true if one is equal, an error if none is and a comparison is an error."""
    return reduce(Column.__or__, [F.when(t.isNotNull() & o.isNotNull(), equal(t, o)) for o in others]) if others else F.lit(False)


def not_in(t: Column, *others: Column) -> Column:
    return ~in_(t, *others)


def coalesce(*ts: Column) -> Column:
    """The first term that is bound and no error."""
    return F.coalesce(*ts)


def if_(condition: Column, then: Column, other: Column) -> Column:
    """``IF`` on an effective boolean value; an error there is an error."""
    return F.when(ebv(condition), then).when(~ebv(condition), other)


strlen = lambda t: integer(F.char_length(t["v"]))
ucase = lambda t: _like(t, F.upper(t["v"]))
lcase = lambda t: _like(t, F.lower(t["v"]))
contains = lambda a, b: _string(a).contains(_string(b))
strstarts = lambda a, b: _string(a).startswith(_string(b))
strends = lambda a, b: _string(a).endswith(_string(b))


def substr(t: Column, start: int, length: int | None = None) -> Column:
    return _like(t, F.substring(t["v"], start, 2147483647 if length is None else length))


def _argument(t: Column, x: Column | str) -> tuple[Column, Column, Column]:
    """The string term that is looked for, its place, and whether it may be compared: plain, or of the same language."""
    x = x if isinstance(x, Column) else literal(x)
    fits = _string(t).isNotNull() & _string(x).isNotNull() & ((x["lang"] == "") | (x["lang"] == t["lang"]))
    return x, F.position(x["v"], t["v"]), fits


def strbefore(t: Column, x: Column | str) -> Column:
    """What stands before the first ``x``: with the language of ``t``, a plain empty string if ``x`` is not there, an error for incompatible arguments."""
    x, at, fits = _argument(t, x)
    return F.when(fits, F.when(at > 0, _like(t, F.substr(t["v"], F.lit(1), at - 1))).otherwise(literal("")))


def strafter(t: Column, x: Column | str) -> Column:
    x, at, fits = _argument(t, x)
    return F.when(fits, F.when(at > 0, _like(t, F.substr(t["v"], at + F.length(x["v"])))).otherwise(literal("")))


def concat(*ts: Column) -> Column:
    same = ts[0]["lang"]
    for t in ts[1:]:
        same = F.when(same == t["lang"], same).otherwise("")
    return term(LITERAL, F.concat(*[_string(t) for t in ts]), "", same)


def regex(t: Column, pattern: str, flags: str = "") -> Column:
    return _string(t).rlike(f"(?{flags}){pattern}" if flags else pattern)


def replace(t: Column, pattern: str, to: str, flags: str = "") -> Column:
    return _like(t, F.regexp_replace(t["v"], f"(?{flags}){pattern}" if flags else pattern, to))


def encode_for_uri(t: Column) -> Column:
    v = F.url_encode(t["v"])
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return literal(v)


def langmatches(tag: Column, wanted: str) -> Column:
    v = F.lower(tag["v"])
    return v != "" if wanted == "*" else (v == wanted.lower()) | v.startswith(wanted.lower() + "-")


def strlang(t: Column, tag: str) -> Column:
    return term(LITERAL, _string(t), "", tag)


def strdt(t: Column, dt: str) -> Column:
    return term(LITERAL, _string(t), dt)


def digest(t: Column, kind: str) -> Column:
    v = t["v"].cast("binary")
    return literal({"md5": F.md5(v), "sha1": F.sha1(v), "sha256": F.sha2(v, 256), "sha384": F.sha2(v, 384), "sha512": F.sha2(v, 512)}[kind])


def decimal_text(v: Column) -> Column:
    """The shortest form of a decimal: no zeros behind, and no point behind a whole number."""
    return F.regexp_replace(F.regexp_replace(v.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _arithmetic(a: Column, b: Column, op, narrow: bool = False, whole: bool = True) -> Column:
    """``op`` in the wider of the two types: integers and decimals without rounding, floats and doubles as such. ``narrow``: decimals of 18 digits, whose product
    fits; ``whole``: of two integers the result is one."""
    rank = F.greatest(_rank(a) + _rank(b) * 0, _rank(b) + _rank(a) * 0)
    kind = "decimal(18,8)" if narrow else "decimal(38,18)"
    integers = op(exact(a, "decimal(38,0)"), exact(b, "decimal(38,0)")) if whole else op(exact(a, kind), exact(b, kind))
    first = F.split_part(integers.cast("string"), F.lit("."), F.lit(1)) if whole else decimal_text(integers)
    return _number(rank, first, decimal_text(op(exact(a, kind), exact(b, kind))), op(num(a), num(b)), "integer" if whole else "decimal")


def _number(rank: Column, whole: Column, parts: Column, real: Column, whole_type: str = "integer") -> Column:
    """One literal out of the forms for each rank."""
    v = F.when(rank == 0, whole).when(rank == 1, parts).when(rank == 2, real.cast("float").cast("string")).when(rank == 3, real.cast("double").cast("string"))
    kinds = F.array(*[F.lit(XSD + x) for x in (whole_type, "decimal", "float", "double")])
    return F.when(v.isNotNull(), bare(LITERAL, v, F.get(kinds, rank), F.lit(""), v.try_cast("double")))


def add(a: Column, b: Column) -> Column:
    return _arithmetic(a, b, F.try_add)


def subtract(a: Column, b: Column) -> Column:
    return _arithmetic(a, b, F.try_subtract)


def multiply(a: Column, b: Column) -> Column:
    return _arithmetic(a, b, F.try_multiply, True)


def divide(a: Column, b: Column) -> Column:
    """Two integers give a decimal; division by an exact zero is an error."""
    out = _arithmetic(a, b, F.try_divide, True, False)
    zero = (_rank(a) >= 2) & (num(b) == 0) | (_rank(b) >= 2) & (num(b) == 0)
    inf = F.when(num(a) == 0, "NaN").when(num(a) > 0, "INF").otherwise("-INF")
    return F.when(zero, literal(inf, "double")).otherwise(out)


def _unary(t: Column, op, doubles=None) -> Column:
    """``op`` in the term's own type."""
    rank, doubles = _rank(t), doubles or op
    return _number(rank, decimal_text(op(exact(t, "decimal(38,0)"))), decimal_text(op(exact(t))), doubles(num(t)))


plus = lambda t: F.when(num(t).isNotNull(), t)
minus = lambda t: _unary(t, lambda v: -v)
abs_ = lambda t: _unary(t, F.abs)
ceil = lambda t: _unary(t, F.ceil)
floor = lambda t: _unary(t, F.floor)
round_ = lambda t: _unary(t, lambda v: F.floor(v + F.lit(0.5).cast("decimal(2,1)")), lambda v: F.floor(v + 0.5))
rand = lambda seed=None: literal((F.rand(seed) if seed is not None else F.rand()).cast("string"), "double")


def uuid() -> Column:
    """A fresh ``urn:uuid:`` IRI for each row."""
    return iri(F.concat(F.lit("urn:uuid:"), F.uuid()))


def struuid() -> Column:
    return literal(F.uuid())


def now() -> Column:
    """The time of the query, one for all rows."""
    return literal(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), "dateTime")


def iri_(t: Column, base: str = "") -> Column:
    """``IRI()``: a string resolved against ``base``; an IRI as it is."""
    absolute = t["v"].rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    root = re.match(r"[a-z]+://[^/]+", base)
    folder = base.rsplit("/", 1)[0] + "/" if "/" in base else base
    relative = F.when(t["v"].startswith("/"), F.concat(F.lit(root.group() if root else base), t["v"])).when(t["v"].startswith("#"), F.concat(F.lit(base), t["v"])).otherwise(F.concat(F.lit(folder), t["v"]))
    return F.when(t["k"] == IRI, t).otherwise(iri(F.when(_string(t).isNotNull(), F.when(absolute, t["v"]).otherwise(relative))))


def bnode_(t: Column | None = None, *solution: Column) -> Column:
    """A fresh blank node for each row, or one for each string and ``solution``."""
    return bnode(F.replace(F.uuid(), F.lit("-"), F.lit(""))) if t is None else bnode(F.md5(F.concat_ws("\x1f", _string(t), *[ntriples(x) for x in solution]).cast("binary")))


def when(t: Column) -> Column:
    """The time of a dateTime or date literal."""
    return F.when(t["dt"].isin(XSD + "dateTime", XSD + "date"), F.try_to_timestamp(F.replace(t["v"], F.lit("T"), F.lit(" "))))


year = lambda t: integer(F.year(when(t)))
month = lambda t: integer(F.month(when(t)))
day = lambda t: integer(F.day(when(t)))
hours = lambda t: integer(F.hour(when(t)))
minutes = lambda t: integer(F.minute(when(t)))
seconds = lambda t: literal(F.extract(F.lit("SECOND"), when(t)).cast("string"), "decimal")
def timezone(t: Column) -> Column:
    """The zone as ``xsd:dayTimeDuration``; an error without one."""
    z = F.regexp_extract(t["v"], r"(Z|[+-]\d\d:\d\d)$", 1)
    h, m = F.substr(z, F.lit(2), F.lit(2)).try_cast("int"), F.substr(z, F.lit(5), F.lit(2)).try_cast("int")
    parts = F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    return literal(F.when(t["dt"].isin(DATES) & (z != ""), F.when((z == "Z") | (h + m == 0), "PT0S").otherwise(parts)), "dayTimeDuration")


tz = lambda t: literal(F.regexp_extract(t["v"], r"(Z|[+-]\d\d:\d\d)$", 1))


def cast(t: Column, kind: str) -> Column:
    """``xsd:kind(t)``; what cannot be cast is unbound."""
    spark = {"integer": "decimal(38,0)", "decimal": "decimal(38,18)", "double": "double", "float": "float", "boolean": "boolean", "dateTime": "timestamp_ntz", "string": "string"}[kind]
    v = t["v"].try_cast(spark)
    if kind == "integer":  # whole numbers as they are, others towards zero
        x = t["v"].try_cast("double")
        v = F.when(t["v"].rlike(r"^[+-]?\d+$"), v).otherwise(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).try_cast(spark))
    return literal(v.cast("string"), kind)


def trigrams(v: Column) -> Column:
    """Distinct three-letter strings of the words, each padded with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(v), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(padded, of)))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Share of the smaller word set that both have."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(v), r"[^\p{L}\p{N}]+"), lambda w: w != "")) for v in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))), F.lit(0.0))


def levenshtein_within(a: Column, b: Column, most: int) -> Column:
    return F.levenshtein(a, b, most) >= 0


def jaro_winkler(a: Column, b: Column, p: float = 0.1) -> Column:
    """Jaro-Winkler similarity, in a vectorised Python function (Spark has none)."""
    return F.pandas_udf(_jaro_winkler(p), "double")(a, b)


def _jaro_winkler(p: float):
    def one(s: str | None, t: str | None) -> float | None:
        if s is None or t is None:
            return None
        if s == t:
            return 1.0
        reach, used, first = max(len(s), len(t)) // 2 - 1, [False] * len(t), []
        for i, x in enumerate(s):
            for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
                if not used[j] and t[j] == x:
                    used[j] = True
                    first.append(x)
                    break
        m = len(first)
        if not m:
            return 0.0
        swaps = sum(x != y for x, y in zip(first, (y for y, u in zip(t, used) if u))) / 2
        jaro = (m / len(s) + m / len(t) + (m - swaps) / m) / 3
        same = 0
        while same < min(4, len(s), len(t)) and s[same] == t[same]:
            same += 1
        return jaro + same * p * (1 - jaro)

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)])

    return run


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of two bit vectors given as arrays of longs."""
    ones = lambda x: F.aggregate(x, F.lit(0), lambda n, w: n + F.bit_count(w))
    both = F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))
    return F.try_divide(2.0 * ones(both), ones(a) + ones(b))
