"""Serialised forms of graphs and results, a row per line or subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..terms import IRI, TYPE, ntriples


def turtle(quads: DataFrame) -> DataFrame:
    """(subject, value): a Turtle block per subject, predicates and objects in order."""
    each = quads.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set(ntriples(F.col("o")))), ", ").alias("objects"))
    name = F.when(F.col("p") == TYPE, "a").otherwise(F.concat(F.lit("<"), F.col("p"), F.lit(">")))
    block = F.array_join(F.array_sort(F.collect_list(F.concat(name, F.lit(" "), F.col("objects")))), " ;\n    ")
    return each.groupBy("s").agg(block.alias("body")).select(ntriples(F.col("s")).alias("subject"), F.concat(ntriples(F.col("s")), F.lit(" "), F.col("body"), F.lit(" .")).alias("value"))


def turtle_star(quads: DataFrame, confidence: DataFrame) -> DataFrame:
    """N-Triples lines, and after each statement with a confidence its annotation."""
    p = F.concat(F.lit("<"), F.col("p"), F.lit(">"))
    spo = F.concat_ws(" ", ntriples(F.col("s")), p, ntriples(F.col("o")))
    rows = quads.join(confidence, ["s", "p", "o"], "left")
    note = F.concat(F.lit("<< "), spo, F.lit(" >> <urn:confidence> \""), F.col("confidence").cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#double> .'))
    return rows.select(F.explode(F.array_compact(F.array(F.concat(spo, F.lit(" .")), note))).alias("value"))


def jsonld(quads: DataFrame) -> DataFrame:
    """(id, value): a JSON-LD node per subject."""
    o = F.col("o")
    obj = F.when(o["k"] == IRI, F.to_json(F.struct(o["v"].alias("@id")))).otherwise(
        F.to_json(F.struct(o["v"].alias("@value"), F.when(o["dt"] != "", o["dt"]).alias("@type"), F.when(o["lang"] != "", o["lang"]).alias("@language")))
    )
    each = quads.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set(obj)), ",").alias("objects"))
    field = F.concat(F.lit('"'), F.col("p"), F.lit('":['), F.col("objects"), F.lit("]"))
    return each.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(field)), ",").alias("body")).select(F.col("s.v").alias("id"), F.concat(F.lit('{"@id":"'), F.col("s.v"), F.lit('",'), F.col("body"), F.lit("}")).alias("value"))


def results(solutions: DataFrame, kind: str = "csv") -> DataFrame:
    """Solutions as CSV values (lexical forms) or TSV values (N-Triples terms), columns as they are."""
    return solutions.select([(F.col(c)["v"] if kind == "csv" else ntriples(F.col(c))).alias(c) for c in solutions.columns])


def entities(quads: DataFrame, title: str) -> DataFrame:
    """(id, title, type, frequency, degree) of every IRI subject: statements about it, and IRI links at either end."""
    links = quads.filter((F.col("o")["k"] == IRI) & (F.col("p") != TYPE)).select(F.col("s.v").alias("a"), F.col("o.v").alias("b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    own = quads.filter(F.col("s")["k"] == IRI).groupBy(F.col("s.v").alias("id")).agg(
        F.min(F.when(F.col("p") == title, F.col("o.v"))).alias("title"), F.min(F.when(F.col("p") == TYPE, F.col("o.v"))).alias("type"), F.count(F.lit(1)).alias("frequency")
    )
    return own.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def relationships(quads: DataFrame) -> DataFrame:
    """(id, source, target, description, weight) of every IRI link but types; weight counts equal links over graphs."""
    links = quads.filter((F.col("o")["k"] == IRI) & (F.col("p") != TYPE)).groupBy(F.col("s.v").alias("source"), F.col("p").alias("description"), F.col("o.v").alias("target")).agg(F.count(F.lit(1)).alias("weight"))
    return links.withColumn("id", F.md5(F.concat_ws("|", "source", "description", "target")))


def text_units(docs: DataFrame, words: int = 300, overlap: int = 30) -> DataFrame:
    """(id, document_id, position, text, n_tokens): runs of ``words`` words of each text (doc_id, text), each sharing ``overlap`` with the next."""
    each = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    rows = docs.select("doc_id", each.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - overlap - 1, F.lit(0)), F.lit(words - overlap))
    unit = rows.select("doc_id", F.posexplode(starts).alias("position", "a"), "w").select("doc_id", "position", F.slice("w", F.col("a") + 1, words).alias("w"))
    return unit.select(F.md5(F.concat_ws("|", "doc_id", "position").cast("binary")).alias("id"), F.col("doc_id").alias("document_id"), F.col("position").cast("long").alias("position"), F.array_join("w", " ").alias("text"), F.size("w").cast("long").alias("n_tokens"))


def write_graph_tables(quads: DataFrame, title: str, docs: DataFrame, folder: str) -> None:
    """Entities, relationships and text units as Parquet tables under ``folder``."""
    for name, table in (("entities", entities(quads, title)), ("relationships", relationships(quads)), ("text_units", text_units(docs))):
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
