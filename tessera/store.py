"""Quads as a DataFrame (s, p, o, g), shared scratch tables, and the semi-naive fixpoint.

``p`` is the predicate's IRI as a string, so that a filter on it reaches a partitioned table or prunes the branches of
a mapped relational graph; ``g`` is the graph's IRI, empty for the default graph. A graph has set semantics.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .terms import TERM

SCHEMA = f"s {TERM}, p string, o {TERM}, g string"
QUAD = ["s", "p", "o", "g"]


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``; without that setting under one of our own, on a local master only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = at.get() if at.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/quads-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """Cut lineage with a table in the shared folder."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove_dir(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def triples(spark: SparkSession, rows: list[tuple], g: str = "") -> DataFrame:
    """A small graph from Python tuples (s, p, o[, g]); strings as in ``terms.constant``."""
    from .terms import constant

    parts = None
    for s, p, o, *own in rows:
        one = spark.range(1).select(constant(s).alias("s"), F.lit(p).alias("p"), constant(o).alias("o"), F.lit(own[0] if own else g).alias("g"))
        parts = one if parts is None else parts.unionByName(one)
    return parts if parts is not None else spark.createDataFrame([], SCHEMA)


def write_partitioned(quads: DataFrame, folder: str) -> None:
    """A Parquet table with a folder per predicate: a pattern with a constant predicate reads that folder only."""
    quads.write.mode("overwrite").partitionBy("p").parquet(folder)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], key: list[str], max_rounds: int | None = None) -> DataFrame:
    """Semi-naive: rows of ``seed``, then of ``step(delta, all)`` that are new by ``key``, until there are none.

    Each round's new rows are written to the shared folder; all rows are the union of those tables, so a round reads
    no lineage and nothing is collected.
    """
    spark = seed.sparkSession
    folder, k = shared_dir(spark), 0
    delta = stored(seed.dropDuplicates(key), f"{folder}/0")
    known = delta
    while (max_rounds is None or k < max_rounds) and not delta.isEmpty():
        k += 1
        new = step(delta, known).select(seed.columns).dropDuplicates(key).join(known.select(*key), key, "left_anti").select(seed.columns)
        delta = stored(new, f"{folder}/{k}")
        known = spark.read.schema(seed.schema).parquet(*[f"{folder}/{i}" for i in range(k + 1)])
    return known


def same(a: str, b: str) -> Column:
    return F.col(a) == F.col(b)
