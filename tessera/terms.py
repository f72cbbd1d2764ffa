"""RDF terms as Spark columns: a struct (k, v, dt, lang, n) of kind, lexical form, datatype, language and numeric value.

``k``: 0 IRI, 1 blank node, 2 plain or typed literal, 5 quoted triple. Absent datatype and language are empty strings,
so terms compare and join as plain structs; an unbound variable is a null struct. ``n`` follows from ``v`` and ``dt``
(null unless the datatype is numeric); it is kept so that a filter on a mapped number is a filter on its own column,
which reaches the Parquet scan, and needs no parsing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IRI, BNODE, LITERAL, QUOTED = 0, 1, 2, 5
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
TYPE = RDF + "type"
TERM = "struct<k:int,v:string,dt:string,lang:string,n:double>"
NUMERIC = [XSD + x for x in ("integer", "decimal", "double", "float", "long", "int", "short", "byte")]


def term(k: int, v: Column, dt: Column | str = "", lang: Column | str = "", n: Column | None = None) -> Column:
    """``n``: the numeric value where it is at hand; otherwise it is read from the lexical form."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    if n is None:
        known = isinstance(dt, str)
        n = F.lit(None).cast("double") if k != LITERAL or known and dt not in NUMERIC else v.try_cast("double") if known else F.when(dt.isin(NUMERIC), v.try_cast("double"))
    return F.when(v.isNotNull(), bare(k, v, as_col(dt), as_col(lang), n))


def bare(k: int, v: Column, dt: Column, lang: Column, n: Column) -> Column:
    """The struct without the guard against a null ``v``: where nulls are filtered out first, its fields fold to their columns."""
    return F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"), dt.alias("dt"), lang.alias("lang"), n.alias("n"))


def iri(v: Column | str) -> Column:
    return term(IRI, F.lit(v) if isinstance(v, str) else v)


def bnode(v: Column) -> Column:
    return term(BNODE, v)


def literal(v: Column | str | int | float | bool, dt: str | None = None, lang: Column | str = "", n: Column | None = None) -> Column:
    """A literal; Python numbers and booleans get their datatype. ``xsd:string`` is the plain literal."""
    if not isinstance(v, Column):
        if dt is None:
            dt = {bool: "boolean", int: "integer", float: "double"}.get(type(v), "")
        v = F.lit(str(v).lower() if isinstance(v, bool) else str(v))
    full = "" if dt in (None, "", "string") else dt if ":" in dt else XSD + dt
    return term(LITERAL, v, full, lang, n)


def constant(x: object) -> Column:
    """``<iri>`` or a CURIE-free absolute IRI as IRI, ``_:b`` as blank node, everything else as literal."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        if x.startswith("<") and x.endswith(">"):
            return iri(x[1:-1])
        if x.startswith("_:"):
            return bnode(F.lit(x[2:]))
        if "://" in x or x.startswith("urn:"):
            return iri(x)
    return literal(x)


def num(t: Column) -> Column:
    """Numeric value, null for terms that are no number."""
    return t["n"]


def sort_key(t: Column) -> list[Column]:
    """SPARQL's order: unbound, blank nodes, IRIs, literals; numbers by value."""
    rank = F.when(t.isNull(), 0).when(t["k"] == BNODE, 1).when(t["k"] == IRI, 2).otherwise(3)
    return [rank, num(t).isNull(), num(t), t["v"], t["dt"], t["lang"]]


def escaped(v: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


#: Escapes of one character in N-Triples and Turtle, fixed by the standard.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", '"': '"', "'": "'"}


def unescaped(v: Column) -> Column:
    """Text without escapes; the parts between backslashes are looked at one by one, only where there is a backslash."""
    mark = "\x00"
    parts = F.split(F.replace(v, F.lit("\\\\"), F.lit(mark)), r"\\")
    point = lambda p, n: F.decode(F.unhex(F.lpad(F.substr(p, F.lit(2), F.lit(n)), 8, "0")), "UTF-32")
    own = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])

    def one(p: Column) -> Column:
        first = F.substr(p, F.lit(1), F.lit(1))
        letter = F.concat(F.coalesce(F.try_element_at(own, first), first), F.substr(p, F.lit(2)))
        return F.when(first == "u", F.concat(point(p, 4), F.substr(p, F.lit(6)))).when(first == "U", F.concat(point(p, 8), F.substr(p, F.lit(10)))).otherwise(letter)

    joined = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))
    return F.when(v.contains("\\"), F.replace(joined, F.lit(mark), F.lit("\\"))).otherwise(v)


def ntriples(t: Column) -> Column:
    """The term in N-Triples syntax."""
    suffix = F.when(t["lang"] != "", F.concat(F.lit("@"), t["lang"])).when(t["dt"] != "", F.concat(F.lit("^^<"), t["dt"], F.lit(">"))).otherwise("")
    return (
        F.when(t["k"] == IRI, F.concat(F.lit("<"), t["v"], F.lit(">")))
        .when(t["k"] == BNODE, F.concat(F.lit("_:"), t["v"]))
        .when(t["k"] == QUOTED, F.concat(F.lit("<< "), t["v"], F.lit(" >>")))
        .otherwise(F.concat(F.lit('"'), escaped(t["v"]), F.lit('"'), suffix))
    )


def quoted(s: Column, p: Column, o: Column) -> Column:
    """A quoted triple; its lexical form is the triple in N-Triples syntax, so equal triples are equal terms."""
    return term(QUOTED, F.concat_ws(" ", ntriples(s), ntriples(p), ntriples(o)))
