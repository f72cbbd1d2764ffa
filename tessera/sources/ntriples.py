"""N-Triples and N-Quads, with quoted triples: parsed line by line in Spark's own regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import QUAD
from ..terms import BNODE, IRI, LITERAL, QUOTED, ntriples, term, unescaped

_IRI, _BNODE = r"<[^<>\s]*>", r"_:[^\s<>\"]+"
_LITERAL = r'"(?:[^"\\]++|\\.)*+"(?:@[A-Za-z0-9-]+|\^\^<[^<>\s]*>)?'
_QUOTED = rf"<<\s*(?:{_IRI}|{_BNODE})\s+{_IRI}\s+(?:{_IRI}|{_BNODE}|{_LITERAL})\s*>>"
_TERM = rf"(?:{_QUOTED}|{_IRI}|{_BNODE}|{_LITERAL})"
MARK = "\uFDD0"  # a code point that no text may use
LINE = rf"^\s*({_QUOTED}|{_IRI}|{_BNODE})\s+({_IRI})\s+({_TERM})(?:\s+({_IRI}|{_BNODE}))?\s*\.\s*(?:#.*)?$"


def parsed(text: Column, bnode_prefix: str = "") -> Column:
    """A term from its N-Triples form."""
    quote = F.regexp_extract(text, r'^"((?:[^"\\]++|\\.)*+)"', 1)
    return (
        F.when(text.startswith("<<"), term(QUOTED, F.trim(F.substr(text, F.lit(3), F.length(text) - 4))))
        .when(text.startswith("<"), term(IRI, unescaped(F.substr(text, F.lit(2), F.length(text) - 2))))
        .when(text.startswith("_:"), term(BNODE, F.concat(F.lit(bnode_prefix), F.substr(text, F.lit(3)))))
        .when(text.startswith('"'), term(LITERAL, unescaped(quote), F.regexp_extract(text, r'"\^\^<([^<>\s]*)>$', 1), F.regexp_extract(text, r'"@([A-Za-z0-9-]+)$', 1)))
    )


def quoted_parts(text: Column) -> Column:
    """A struct (s, p, o) of terms from the inside of a quoted triple; nested ones stay quoted terms."""
    part = F.split(F.regexp_replace(text, rf"^\s*({_QUOTED}|{_IRI}|{_BNODE})\s+({_IRI})\s+({_TERM})\s*$", f"{MARK}$1{MARK}$2{MARK}$3"), MARK)
    return F.when(F.size(part) == 4, F.struct(parsed(F.get(part, F.lit(1))).alias("s"), parsed(F.get(part, F.lit(2))).alias("p"), parsed(F.get(part, F.lit(3))).alias("o")))


def with_confidence(lines: DataFrame, default: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(quads, confidence) of lines in which a statement may be followed by a number: ``s p o . # 0.9`` or ``s p o 0.9 .``."""
    value = F.regexp_extract("value", r"(?:#\s*|\s)([01](?:\.\d+)?)\s*\.?\s*$", 1)
    plain = F.regexp_replace("value", r"\s+[01](?:\.\d+)?\s*\.\s*$", " .")
    rows = lines.select(plain.alias("value"), F.coalesce(value.try_cast("double"), F.lit(default)).alias("confidence"))
    parts = rows.select("confidence", F.split(F.regexp_replace("value", LINE, f"{MARK}$1{MARK}$2{MARK}$3{MARK}$4"), MARK).alias("part")).filter(F.size("part") == 5)
    p = F.get("part", F.lit(2))
    spo = parts.select(parsed(F.get("part", F.lit(1))).alias("s"), F.substr(p, F.lit(2), F.length(p) - 2).alias("p"), parsed(F.get("part", F.lit(3))).alias("o"), "confidence")
    return parse(rows), spo.groupBy("s", "p", "o").agg(F.max("confidence").alias("confidence"))


def parse(lines: DataFrame, graph: str = "", bnode_prefix: str = "", strict: bool = False, distinct: bool = True) -> DataFrame:
    """Quads from lines (column ``value``). Malformed lines are skipped, or with ``strict`` fail the query; ``distinct`` makes a set of them."""
    text = lines.filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    # one pass of the pattern writes the four parts apart (no part can hold the mark), the rest only splits
    text = text.select("value", F.split(F.regexp_replace("value", LINE, f"{MARK}$1{MARK}$2{MARK}$3{MARK}$4"), MARK).alias("part"))
    good = F.size("part") == 5
    text = text.filter(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))).cast("boolean"))) if strict else text.filter(good)
    part = lambda i: F.get(F.col("part"), F.lit(i))
    g, p = part(4), part(2)
    own = F.when(g == "", F.lit(graph)).when(g.startswith("<"), F.substr(g, F.lit(2), F.length(g) - 2)).otherwise(g)
    quads = text.select(parsed(part(1), bnode_prefix).alias("s"), unescaped(F.substr(p, F.lit(2), F.length(p) - 2)).alias("p"), parsed(part(3), bnode_prefix).alias("o"), own.alias("g"))
    return quads.distinct() if distinct else quads


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse(spark.read.text(path), **options)


def rejected(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank, comment nor a statement."""
    return lines.filter(~F.col("value").rlike(r"^\s*(#.*)?$") & ~F.col("value").rlike(LINE))


def line(quads: DataFrame, graphs: bool = True) -> DataFrame:
    """N-Quads lines (N-Triples without graphs), column ``value``."""
    g = F.when(F.col("g") == "", "").otherwise(F.concat(F.lit(" <"), F.col("g"), F.lit(">"))) if graphs else F.lit("")
    return quads.select(F.concat(ntriples(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), ntriples(F.col("o")), g, F.lit(" .")).alias("value"))


def patch(quads: DataFrame, lines: DataFrame) -> DataFrame:
    """An RDF patch (lines ``A quad .`` and ``D quad .``) applied: deletions, then additions."""
    op = lambda x: parse(lines.filter(F.col("value").rlike(rf"^\s*{x}\s")).select(F.regexp_replace("value", rf"^\s*{x}\s+", "").alias("value")))
    return quads.join(op("D"), QUAD, "left_anti").unionByName(op("A")).distinct()
