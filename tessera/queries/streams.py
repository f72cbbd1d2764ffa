"""Streaming queries: each runs over what there is and ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.mapping import EX
from ..store import shared_dir
from ..streaming import changes as C
from ..terms import iri, literal
from .registry import query, read


@query("""SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_daily_counts(spark, d):
    """Events as a file stream, counted by day and type; the windows left open at the end are closed by a complete output."""
    schema = read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    at = shared_dir(spark)
    counts = C.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 day", "40 days")

    def each(batch, n):
        batch.write.mode("overwrite").parquet(f"{at}/counts")

    counts.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/counts").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT 'urn:user:' || user_id AS s, event_type AS o FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def stream_current_state(spark, d):
    """A change log streamed into a table; the last operation on each quad counts."""
    from pyspark.sql import Window

    at = shared_dir(spark)
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = read(spark, d, "events").withColumn("gone", F.lag("event_type").over(w))
    s, p = iri(F.concat(F.lit("urn:user:"), "user_id")).alias("s"), F.lit(EX + "last").alias("p")
    row = lambda op, v, seq: F.struct(F.lit(op).alias("op"), s, p, literal(v).alias("o"), F.lit("").alias("g"), seq.alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    log = e.select(F.inline(F.array(row("D", F.coalesce("gone", "event_type"), F.col("event_id") * 2), row("A", F.col("event_type"), F.col("event_id") * 2 + 1))))
    log.write.parquet(f"{at}/log")
    stream = C.subscribed(C.changes(spark, f"{at}/log"), [EX + "last"])
    C.maintained(stream, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return C.applied(spark.read.schema(C.CHANGES).parquet(f"{at}/table")).select(F.col("s.v").alias("s"), F.col("o.v").alias("o"))
