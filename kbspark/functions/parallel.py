"""Parallelism guard for CPU-heavy per-row stages (embedding, parsing, scoring).

A small or single-row-group input scans as one partition, which would run
the heavy stage in one task.  ``spread`` estimates the scan's splits from the
plan's size statistics (no job runs) and only then hash-redistributes (deterministic on retry).  On large
inputs - thousands of scan splits - it returns the DataFrame unchanged, so it
adds no shuffle where the scan already gives enough parallelism.
"""

from __future__ import annotations

from typing import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` (file sizes for scans); runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def target_partitions(df: DataFrame) -> int:
    return max(1, df.sparkSession.sparkContext.defaultParallelism * 2)


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    if df.isStreaming:
        return df
    n = target_partitions(df)
    split = int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if estimated_bytes(df) >= n // 2 * split:
        return df
    if key is not None:
        return df.repartition(n, F.xxhash64(F.col(key)))
    return df.repartition(n)


#: Rows that ``per_row`` holds as Python objects at once.
ROWS_AT_ONCE = 256


def per_row(fn: Callable, column: pa.Array, names: Sequence[str]) -> pa.StructArray:
    """A struct of strings, ``fn(value)`` for each value: an Arrow batch becomes Python objects a few rows at a time."""
    parts = []
    for lo in range(0, len(column), ROWS_AT_ONCE):
        rows = [fn(v) for v in column.slice(lo, ROWS_AT_ONCE).to_pylist()]
        parts.append(pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names))
    return pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays([pa.array([], pa.string())] * len(names), names)
