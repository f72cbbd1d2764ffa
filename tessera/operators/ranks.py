"""Ranks over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import shared_dir, stored


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 on: sorted by ranges, numbered in each, and moved on by the rows of the ranges before.

    The ranges are written once, as their borders are sampled; the counts are a row for each range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [F.col(f"_o{k}") for k in range(len(order))]
    keyed = rows.select("*", *[(F.lit(v) if not isinstance(v, Column) else v).alias(f"_o{k}") for k, v in enumerate(_bare(order))])
    by = [(c.desc_nulls_last() if down else c.asc_nulls_first()) for c, down in zip(at, _down(order))]
    parts = stored(keyed.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()), f"{shared_dir(rows.sparkSession)}/ranges")
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    out = parts.withColumn("_own", own).join(before.select("_part", "_before"), "_part")
    return out.withColumn(name, F.col("_own") + F.col("_before")).select(*rows.columns, name)


class Down:
    """A column in descending order."""

    def __init__(self, column: Column | str) -> None:
        self.column = F.col(column) if isinstance(column, str) else column


def _bare(order: list) -> list:
    return [x.column if isinstance(x, Down) else F.col(x) if isinstance(x, str) else x for x in order]


def _down(order: list) -> list[bool]:
    return [isinstance(x, Down) for x in order]
