"""S1 and the snapshot store behind W5/R3 for small tables.

Parquet has no MERGE or DELETE, so a table is a sequence of immutable snapshot versions under one root
(a shared folder on a cluster), listed by a commit log (``sources.log``):

    <root>/_log/00000001
    <root>/v=<unique>/created_date=2024-01-05/part-....parquet

* a write never touches the version being read (no read/overwrite race);
* a version counts only once its log entry exists, and entries are created atomically: of two
  writers only one gets the next number, the other derives its version anew (``update``);
* the entry names the batch, so replaying a micro-batch is a no-op (exactly-once with ``foreachBatch``);
* partitioning by creation date lets retention prune whole partitions.

Every version is the whole table. A knowledge base that grows is kept in a
:class:`~kbspark.sources.buckets.BucketStore` instead, which writes only what a batch touches.
Listing goes through the Hadoop FileSystem of the session, so the same code works on HDFS, object
stores and local disk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.schema import KB, KB_COLUMNS
from kbspark.session import delete_folder
from kbspark.sources.log import VersionLog, new_folder

PARTITION_COL = "created_date"


class CommitConflict(RuntimeError):
    """Another writer has committed since the version that a commit was derived from."""


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType = KB,
                 partition_by: str | None = PARTITION_COL):
        self.spark, self.root, self.schema, self.partition_by = spark, root.rstrip("/"), schema, partition_by
        self.log = VersionLog(spark, self.root)

    # -- listing --------------------------------------------------------------
    def versions(self) -> list[tuple[int, str | None]]:
        """(number, batch) of every version."""
        return [(e["version"], e["key"]) for e in self.log.entries()]

    def latest_path(self) -> str | None:
        entries = self.log.entries()
        return f"{self.root}/{entries[-1]['data']}" if entries else None

    def has_batch(self, batch_id) -> bool:
        return any(e["key"] == str(batch_id) for e in self.log.entries())

    # -- read / write ------------------------------------------------------------
    def read(self) -> DataFrame:
        """Scan of the current snapshot (empty KB when none exists)."""
        p = self.latest_path()
        if p is None:
            return self.spark.createDataFrame([], self.schema)
        df = self.spark.read.option("basePath", p).parquet(p)
        cols = [c for c in (f.name for f in self.schema.fields)]
        return df.select(*cols)

    def commit(self, df: DataFrame, batch_id=None, after: int | None = None) -> bool:
        """Write ``df`` as the next version; False (and no write) if ``batch_id`` is committed.

        ``after`` is the version ``df`` was derived from (default: the latest one now). If another
        writer commits in the meantime, ``CommitConflict`` is raised and nothing is lost."""
        entries = self.log.entries()
        if batch_id is not None and any(e["key"] == str(batch_id) for e in entries):
            return False
        latest = entries[-1]["version"] if entries else 0
        if after is not None and latest != after:
            raise CommitConflict(f"version {latest} follows version {after}")
        out = df.select(*[f.name for f in self.schema.fields])
        w = out
        if self.partition_by:
            # Few files per day: rows are clustered by day, and large days split by size.
            w = out.withColumn(self.partition_by, F.to_date("created_at")).hint("rebalance", self.partition_by)
        data = new_folder()
        writer = w.write
        if self.partition_by:
            writer = writer.partitionBy(self.partition_by)
        writer.parquet(f"{self.root}/{data}")
        if self.log.claim(latest + 1, {"key": None if batch_id is None else str(batch_id), "data": data}):
            return True
        delete_folder(self.spark, f"{self.root}/{data}")
        raise CommitConflict(f"version {latest + 1} is another writer's")

    def update(self, plan: Callable[[DataFrame], DataFrame], batch_id=None) -> bool:
        """Commit ``plan(current rows)``, planned again for as long as other writers come first."""
        while True:
            entries = self.log.entries()
            if batch_id is not None and any(e["key"] == str(batch_id) for e in entries):
                return False
            try:
                return self.commit(plan(self.read()), batch_id, after=entries[-1]["version"] if entries else 0)
            except CommitConflict:
                continue

    def upsert(self, batch, now: Column | None = None, batch_id=None, dim: int | None = None) -> bool:
        """W1 in a whole new version. ``batch`` may be a function of the latest time stamp in the
        ids (see ``BucketStore.upsert``)."""
        from kbspark.operators.store import latest_nanos, latest_rows, merge_documents
        latest = None if callable(batch) else latest_rows(batch, dim=dim)

        def plan(base):
            rows = latest
            if rows is None:
                rows = latest_rows(batch(base.agg(latest_nanos().alias("n")).first()["n"]), dim=dim)
            return merge_documents(base, rows, now)
        return self.update(plan, batch_id)

    def retain(self, now, days: int, batch_id=None) -> int:
        """W5 on the stored snapshot: commit the survivors of a retention delete; the number of
        deleted rows (0 without a snapshot or for a batch that is committed already).

        A redundant predicate on the partition column (``created_date`` NULL or on/after
        the boundary day) lets the scan skip whole expired days; the exact predicate on
        ``created_at`` then decides the boundary day row by row."""
        from kbspark.operators.store import retention_counts, retention_survivors
        while True:
            entries = self.log.entries()
            if not entries:
                return 0
            p = f"{self.root}/{entries[-1]['data']}"
            boundary = now - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days))
            df = self.spark.read.option("basePath", p).parquet(p)
            deleted = int(retention_counts(df, now, days).first()["deleted"] or 0)
            if self.partition_by is not None:
                df = df.filter(F.col(self.partition_by).isNull() | (F.col(self.partition_by) >= F.to_date(boundary)))
            # Reads version N, writes version N + 1: never the path being read.
            try:
                return deleted if self.commit(retention_survivors(df, now, days), batch_id, after=entries[-1]["version"]) else 0
            except CommitConflict:
                continue


def scan_kb(spark: SparkSession, path: str) -> DataFrame:
    """The six knowledge-base columns of a snapshot directory, schema enforced."""
    df = spark.read.option("basePath", path).parquet(path)
    return df.select(*[F.col(c).cast(KB[c].dataType).alias(c) for c in KB_COLUMNS])
