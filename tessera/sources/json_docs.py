"""JSON rows as quads and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import QUAD
from ..terms import LITERAL, iri, term


def json_quads(df: DataFrame, key: str, column: str, vocabulary: str, graph: str = "") -> DataFrame:
    """Each top-level field of the JSON object in ``column`` is a literal about the IRI ``key``; numbers are integers or decimals."""
    rows = df.select(F.col(key).alias("id"), F.explode(F.from_json(column, "map<string,string>")).alias("f", "v")).filter("v IS NOT NULL")
    kind = F.when(F.col("v").rlike(r"^-?\d+$"), "http://www.w3.org/2001/XMLSchema#integer").when(F.col("v").rlike(r"^-?\d+\.\d+$"), "http://www.w3.org/2001/XMLSchema#decimal").otherwise("")
    return rows.select(iri(F.col("id")).alias("s"), F.concat(F.lit(vocabulary), F.col("f")).alias("p"), term(LITERAL, F.col("v"), kind).alias("o"), F.lit(graph).alias("g"))


def ingest(quads: DataFrame, new: DataFrame, mode: str = "append") -> DataFrame:
    """``append``; ``upsert`` replaces the values of the subject-predicate pairs that come; ``diff`` all statements of the subjects that come."""
    if mode == "upsert":
        quads = quads.join(new.select("s", "p", "g").distinct(), ["s", "p", "g"], "left_anti")
    elif mode == "diff":
        quads = quads.join(new.select("s", "g").distinct(), ["s", "g"], "left_anti")
    return quads.select(QUAD).unionByName(new.select(QUAD)).distinct()


def pivoted(quads: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A relational row per subject: ``columns`` maps predicates to column names; the least value of several."""
    part = quads.filter(F.col("p").isin(list(columns)))
    return part.groupBy(F.col("s.v").alias("id")).agg(*[F.min(F.when(F.col("p") == p, F.col("o.v"))).alias(c) for p, c in columns.items()])
