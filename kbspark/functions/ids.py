"""Identifier functions (X3, X4, X5) and distributed dense surrogate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.session import ensure_checkpoint_dir, scratch_dir, stored


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def update_doc_id(source, updated_at) -> Column:
    """``doc_<source>_<unix seconds>`` (floored; same source and second collide)."""
    return F.concat(F.lit("doc_"), F.coalesce(_col(source), F.lit("")), F.lit("_"),
                    F.unix_seconds(_col(updated_at)).cast("string"))


def unix_nanos(ts, ordinal=None) -> Column:
    """Nanosecond clock value of ``ts`` (micro precision) plus an ordinal that keeps
    the ids of rows stamped in the same run distinct (a stand-in for the reference's
    per-row clock reads)."""
    n = F.unix_micros(_col(ts)) * F.lit(1000)
    return n if ordinal is None else n + _col(ordinal)


def content_doc_id(source_id, ts, ordinal) -> Column:
    """``<source id>-<unix nanos>``."""
    return F.concat(_col(source_id), F.lit("-"), unix_nanos(ts, ordinal).cast("string"))


def source_id(source_type, ts, ordinal) -> Column:
    """``<type>-<unix nanos>``."""
    return F.concat(_col(source_type), F.lit("-"), unix_nanos(ts, ordinal).cast("string"))


def _stamped(df: DataFrame) -> DataFrame:
    """``df`` with (``_pid``, ``_li``) = partition and position, stored (compressed, unlike a checkpoint), so
    that a retried task cannot renumber."""
    pid = F.spark_partition_id()
    numbered = df.withColumn("_pid", pid).withColumn("_li", F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33))
    if any("void" in t for _, t in numbered.dtypes):             # a type that files cannot hold
        ensure_checkpoint_dir(df.sparkSession)
        return numbered.checkpoint(eager=True)
    return stored(numbered, scratch_dir(df.sparkSession, "numbered"))


def _numbered(s: DataFrame, out: str, start: int) -> DataFrame:
    """Offsets from per-partition counts: one row per partition, joined as a table."""
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", (F.coalesce(F.sum("n").over(before), F.lit(0)) + F.lit(start)).alias("_off"))
    return s.join(F.broadcast(offsets), "_pid").withColumn(out, F.col("_off") + F.col("_li")).drop("_pid", "_li", "_off")


def unique_index(df: DataFrame, out: str = "idx", start: int = 0) -> DataFrame:
    """A dense index (from ``start``) in no particular order: rows are numbered where they are,
    without a shuffle of the rows."""
    s = _numbered(_stamped(df), out, start)
    return s.select(*df.columns, out)


def dense_index(df: DataFrame, order_cols: list[str], out: str = "idx", start: int = 0) -> DataFrame:
    """A dense 0-based (+start) index in ``order_cols`` order without a single-partition window.

    For narrow rows whose rank matters: range-partition and sort by the key, stamp each row with (partition, position), then add per-partition offsets.
    """
    s = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    return _numbered(_stamped(s), out, start).select(*df.columns, out)
