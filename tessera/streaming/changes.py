"""Change streams with Structured Streaming: subscriptions, incremental tables and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import QUAD, SCHEMA, shared_dir

CHANGES = f"op string, {SCHEMA}, seq long, ts timestamp"


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """Files of (op A or D, quad, seq, ts) as a stream."""
    return spark.readStream.schema(CHANGES).parquet(folder)


def subscribed(stream: DataFrame, predicates: list[str] | None = None, where: Column | None = None) -> DataFrame:
    out = stream if predicates is None else stream.filter(F.col("p").isin(predicates))
    return out if where is None else out.filter(where)


def applied(log: DataFrame) -> DataFrame:
    """The quads that a change log leaves: the last operation on each counts."""
    last = log.groupBy(QUAD).agg(F.max_by("op", "seq").alias("op"))
    return last.filter("op = 'A'").select(QUAD)


def maintained(stream: DataFrame, folder: str, checkpoint: str):
    """Append a stream of changes to a table; ``applied`` over it is the current graph, compacted at any time."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(stream: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what there is, batch by batch, to its end."""
    at = shared_dir(stream.sparkSession)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts of a time window and key, final once the watermark has passed."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("window"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")
