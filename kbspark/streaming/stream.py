"""Periodic feeds as Structured Streaming micro-batches.

The reference reruns a whole batch on a timer (24 h updates, 15 min source
checks).  Here the landed files are a streaming source and every micro-batch
runs the batch plan inside ``foreachBatch``:

* the state is the knowledge base itself (R3), kept in a stored table - best a
  :class:`~kbspark.sources.buckets.BucketStore`, of which a micro-batch rewrites only the buckets
  it touches; each micro-batch commits one new version named after its stream and batch
  id, so a replayed batch (after a driver or executor failure) is a no-op, while several
  streams, or a stream with a new checkpoint, write to one store without losing batches;
* with ``accounting`` each micro-batch of R2 also leaves its report (A6), one folder per batch;
* what a micro-batch stored on the way to its commit is deleted after it;
* the stream checkpoint lives in the shared checkpoint folder;
* ``trigger(availableNow=True)`` drains what has landed (tests, backfills),
  ``trigger(processingTime=...)`` runs it live on the reference's period.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.session import scratch_scope
from kbspark.sources.buckets import BucketStore
from kbspark.sources.snapshot import SnapshotStore

Store = BucketStore | SnapshotStore

# Fixed periods of the reference (update feed, source check).
UPDATE_PERIOD = "24 hours"
SOURCE_CHECK_PERIOD = "15 minutes"


def run_stream(stream: DataFrame, apply_batch: Callable[[DataFrame, int], None], checkpoint: str,
               available_now: bool = True, period: str = UPDATE_PERIOD):
    """Start ``stream`` -> ``foreachBatch(apply_batch)``; block until drained when available_now."""
    w = stream.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=period)
    # Timers of keyed state ask for batches without data for ever; a drain ends with the last data instead.
    conf, empty_batches = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(empty_batches)
    try:
        if available_now:
            conf.set(empty_batches, "false")
        q = w.start()
    finally:
        conf.set(empty_batches, before)
    if available_now:
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    return q


def batch_key(batch: DataFrame, batch_id: int) -> str:
    """A name for a micro-batch that no other stream has: the query's id (kept in its checkpoint, so
    a restart goes on under the same one) and the batch id. Outside a stream, the batch id alone."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{query}.{batch_id}" if query else str(batch_id)


def kb_update_sink(store: Store, ready: Callable[[DataFrame], DataFrame], now: Column | None = None):
    """foreachBatch function: the rows of ``ready(micro-batch)`` upserted into the store; idempotent."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        key = batch_key(batch, batch_id)
        if not store.has_batch(key):
            with scratch_scope(batch.sparkSession):
                store.upsert(ready(batch), now=now, batch_id=key)
    return apply


def stream_updates(spark: SparkSession, updates_stream: DataFrame, store: Store, checkpoint: str,
                   embedder=None, now: Column | None = None, available_now: bool = True):
    """The scheduled-update feed (P3) applied micro-batch by micro-batch."""
    from kbspark.plans.ingest import ready_updates

    def ready(batch):
        return ready_updates(batch, embedder)
    return run_stream(updates_stream, kb_update_sink(store, ready, now), checkpoint, available_now, UPDATE_PERIOD)


def stream_sources(spark: SparkSession, landed_stream: DataFrame, registry: DataFrame, store: Store,
                   registry_store: SnapshotStore, checkpoint: str, embedder=None, now: Column | None = None,
                   available_now: bool = True, to_landed: Callable[[DataFrame], DataFrame] | None = None,
                   accounting: str | None = None):
    """R2: landed bodies ingested (P2) per micro-batch; the touched registry is committed too.

    ``accounting`` is a folder that gets the report of each micro-batch (``read_accounting``)."""
    from kbspark.operators.registry import touch_sources
    from kbspark.plans.ingest import ingest_report, ingest_sources

    def apply(batch: DataFrame, batch_id: int) -> None:
        key = batch_key(batch, batch_id)
        if store.has_batch(key) and registry_store.has_batch(key):
            return                                 # a batch that failed in between is finished by its replay
        with scratch_scope(batch.sparkSession):
            landed = to_landed(batch) if to_landed else batch
            reg = registry_store.read() if registry_store.latest_path() else registry
            run = ingest_sources(reg, landed, embedder=embedder, now=now)
            # The items are numbered past the latest time stamp in the table, again if another writer came first.
            store.upsert(run.added_after, now=run.now, batch_id=key)
            if accounting:
                # Written again as a whole if the batch is replayed.
                ingest_report(run, reg).withColumn("batch", F.lit(key)).write.mode("overwrite").parquet(f"{accounting}/{key}")
            registry_store.update(lambda r: touch_sources(r if registry_store.latest_path() else registry, run.fetched_ok, run.now), key)
    return run_stream(landed_stream, apply, checkpoint, available_now, SOURCE_CHECK_PERIOD)


def read_accounting(spark: SparkSession, folder: str) -> DataFrame:
    """The reports of all micro-batches: the columns of ``ingest_report`` and ``batch``."""
    return spark.read.parquet(f"{folder}/*")
