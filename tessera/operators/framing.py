"""JSON-LD framing: nested documents from quads, level by level with one join and one aggregate each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..terms import IRI, TYPE


def framed(quads: DataFrame, cls: str, frame: dict) -> DataFrame:
    """(id, value): a JSON object for each instance of ``cls``.

    ``frame`` maps predicates to a field name, or to (field name, inner frame) for an embedded node; what it does not name is
    left out (``@explicit``). A field holds an array, ordered; an embedded node stands wherever it is linked (``@always``).
    """
    roots = quads.filter((F.col("p") == TYPE) & (F.col("o.v") == cls)).select(F.col("s.v").alias("id")).distinct()
    return _nodes(quads, frame).join(roots, "id", "right").select("id", F.coalesce("value", F.concat(F.lit('{"@id":"'), F.col("id"), F.lit('"}'))).alias("value"))


def _nodes(quads: DataFrame, frame: dict) -> DataFrame:
    plain = {p: f for p, f in frame.items() if isinstance(f, str)}
    o = F.col("o")
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))
    string = lambda c: F.regexp_extract(quoted(c), r'^\{"v":(.*)\}$', 1)
    value = F.when(o["k"] == IRI, F.concat(F.lit('{"@id":'), string(o["v"]), F.lit("}"))).otherwise(string(o["v"]))
    name = F.create_map(*[F.lit(x) for kv in plain.items() for x in kv]) if plain else None
    parts = []
    if plain:
        parts.append(quads.filter(F.col("p").isin(list(plain))).select(F.col("s.v").alias("id"), F.element_at(name, F.col("p")).alias("field"), value.alias("item")))
    for p, f in frame.items():
        if not isinstance(f, str):
            inner = _nodes(quads, f[1]).select(F.col("id").alias("to"), F.col("value").alias("item"))
            links = quads.filter((F.col("p") == p) & (o["k"] == IRI)).select(F.col("s.v").alias("id"), F.col("o.v").alias("to"))
            parts.append(links.join(inner, "to").select("id", F.lit(f[0]).alias("field"), "item"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    fields = rows.groupBy("id", "field").agg(F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items"))
    body = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col("field"), F.lit('":['), F.col("items"), F.lit("]")))), ",")
    return fields.groupBy("id").agg(body.alias("body")).select("id", F.concat(F.lit('{"@id":"'), F.col("id"), F.lit('",'), F.col("body"), F.lit("}")).alias("value"))
