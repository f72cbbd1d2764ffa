"""Shared pieces of the training-data operators: table access, the shared scratch folder, Arrow kernels."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import remove_dir, shared_dir, stored  # noqa: F401

SLICE = 4 << 20  # bytes of a batch that a kernel is given at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text) with null texts as empty; one row for rows equal in both is left to the callers."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))


def slices(batches: Iterable[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` bytes, or one row that is longer: a batch of long texts is not copied as a whole."""
    for b in batches:
        step = max(1, b.num_rows * most // max(1, b.nbytes))
        for a in range(0, b.num_rows, step):
            yield b.slice(a, step)


def release() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for the next stages, beside a growing JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def arrow_map(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int = SLICE) -> DataFrame:
    """Apply ``kernel`` to slices of the Arrow batches of ``df`` on the executors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most):
            if b.num_rows and (out := kernel(b)) is not None:
                yield out
        release()

    return df.mapInArrow(run, schema)


def held_out(key: str, mod: int, rest: int):
    """crc32 of the decimal text of ``key`` modulo ``mod`` equals ``rest``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod == rest
