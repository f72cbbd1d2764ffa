"""Relational tables as quads: subject templates, classes and predicate-object maps.

The graph is a union with a literal predicate per branch, so a pattern with a constant predicate folds all
other branches away and reads only its own columns of its own table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..terms import IRI, LITERAL, NUMERIC, TYPE, XSD, bare

EX = "http://example.org/"


@dataclass(frozen=True)
class Link:
    """An object IRI made from a template such as ``urn:nation:{n_nationkey}``."""

    template: str


@dataclass(frozen=True)
class Value:
    """An object literal from a column; ``lang`` may name a column."""

    column: str
    datatype: str = ""
    lang: str = ""


@dataclass
class TableMap:
    table: str
    subject: str
    cls: str
    objects: dict[str, Link | Value] = field(default_factory=dict)
    graph: str = ""


def from_template(template: str) -> Column:
    """``{column}`` parts replaced by the percent-encoded value; null if a column is null."""
    out, rest = [], template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        value = F.replace(F.url_encode(F.col(name).cast("string")), F.lit("+"), F.lit("%20"))
        out += [F.lit(text), value]
    return F.concat(*out, F.lit(rest))


def _columns(template: str) -> list[str]:
    return [x.split("}")[0] for x in template.split("{")[1:]]


def mapped(df: DataFrame, m: TableMap) -> DataFrame:
    """The quads of one table. Null source columns are filtered out first, so terms are plain structs whose fields fold to source columns."""
    none, plain = F.lit(None).cast("double"), F.lit("")
    as_iri = lambda v: bare(IRI, v, plain, plain, none)

    def rows(p: str, o: Column, used: list[str]) -> DataFrame:
        full = reduce(Column.__and__, [F.col(c).isNotNull() for c in dict.fromkeys([*_columns(m.subject), *used])])
        return df.filter(full).select(as_iri(from_template(m.subject)).alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(m.graph).alias("g"))

    parts = [rows(TYPE, as_iri(F.lit(m.cls)), [])]
    for p, o in m.objects.items():
        if isinstance(o, Link):
            parts.append(rows(p, as_iri(from_template(o.template)), _columns(o.template)))
        else:
            dt = XSD + o.datatype if o.datatype else ""
            lang = F.coalesce(F.col(o.lang), plain) if o.lang else plain
            parts.append(rows(p, bare(LITERAL, F.col(o.column), F.lit(dt), lang, F.col(o.column).cast("double") if dt in NUMERIC else none), [o.column]))
    return reduce(DataFrame.unionByName, parts)


TABLES = [
    TableMap("region", "urn:region:{r_regionkey}", EX + "Region", {EX + "name": Value("r_name")}),
    TableMap("nation", "urn:nation:{n_nationkey}", EX + "Nation", {EX + "name": Value("n_name"), EX + "region": Link("urn:region:{n_regionkey}")}),
    TableMap("customer", "urn:customer:{c_custkey}", EX + "Customer", {EX + "name": Value("c_name"), EX + "acctbal": Value("c_acctbal", "double"), EX + "segment": Value("c_mktsegment"), EX + "nation": Link("urn:nation:{c_nationkey}")}),
    TableMap("supplier", "urn:supplier:{s_suppkey}", EX + "Supplier", {EX + "name": Value("s_name"), EX + "acctbal": Value("s_acctbal", "double"), EX + "nation": Link("urn:nation:{s_nationkey}")}),
    TableMap("part", "urn:part:{p_partkey}", EX + "Part", {EX + "name": Value("p_name"), EX + "brand": Value("p_brand"), EX + "ptype": Value("p_type"), EX + "size": Value("p_size", "integer"), EX + "retailprice": Value("p_retailprice", "double")}),
    TableMap("orders", "urn:order:{o_orderkey}", EX + "Order", {EX + "customer": Link("urn:customer:{o_custkey}"), EX + "status": Value("o_orderstatus"), EX + "totalprice": Value("o_totalprice", "double"), EX + "orderdate": Value("o_orderdate", "dateTime"), EX + "priority": Value("o_orderpriority")}),
    TableMap("events", "urn:event:{event_id}", EX + "Event", {EX + "user": Link("urn:user:{user_id}"), EX + "etype": Value("event_type"), EX + "value": Value("value", "double"), EX + "ts": Value("ts", "dateTime")}),
    TableMap("documents", "urn:doc:{doc_id}", EX + "Document", {EX + "text": Value("text", "", "lang"), EX + "source": Value("source"), EX + "length": Value("n_chars", "integer")}, "urn:graph:docs"),
    TableMap("labels", "urn:doc:{doc_id}", EX + "Labelled", {EX + "quality": Value("quality", "integer"), EX + "toxic": Value("toxic", "integer")}, "urn:graph:labels"),
    TableMap("conversations", "urn:turn:{conv_id}:{turn}", EX + "Turn", {EX + "role": Value("role"), EX + "next": Link("urn:turn:{conv_id}:{next}")}),
]


def graph(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """The quads of the named tables (all by default)."""
    parts = []
    for m in TABLES:
        if not tables or m.table in tables:
            df = spark.read.parquet(f"{sf_dir}/{m.table}.parquet")
            if m.table == "conversations":
                df = df.withColumn("next", F.col("turn") + 1)
            parts.append(mapped(df, m))
    return reduce(DataFrame.unionByName, parts)
