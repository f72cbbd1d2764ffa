"""Where queries register themselves with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
EX = "http://example.org/"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def lexical(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Term columns as their lexical forms."""
    return df.select([F.col(n)["v"].alias(n) for n in names] + [F.col(a)["v"].alias(b) for a, b in renamed.items()])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over the shuffle partitions: a small file is one task's, however much there is to do for each row."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
