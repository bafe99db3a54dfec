"""Ingestion plans: P3 (scheduled updates) and the shared embed-and-upsert tail.

P3: updates -> skip blank (F4) -> embed (M1; a failed row is skipped) ->
``doc_<source>_<unix seconds>`` (X3) -> keyed upsert (W1), last write wins in
feed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.ids import update_doc_id
from kbspark.functions.text import has_text
from kbspark.operators.embed import HashingEmbedder
from kbspark.operators.store import batch_errors, latest_nanos, upsert_documents
from kbspark.schema import KB


def empty_kb(spark) -> DataFrame:
    return spark.createDataFrame([], KB)


def prepare_updates(updates: DataFrame, embedder=None, seq: str = "seq") -> DataFrame:
    """Update rows ready to upsert: ``(doc_id, content, embedding, seq, status)``.

    status: ``skipped_blank``, ``failed_embed``, ``failed_insert`` or ``ready``.
    """
    from kbspark.functions.parallel import spread
    embedder = embedder or HashingEmbedder()
    u = spread(updates).withColumn("_blank", ~has_text(F.col("content")))
    # The text is nulled before the model, which runs on every row it is given.
    u = u.withColumn("embedding", embedder.embed(F.when(~F.col("_blank"), F.col("content"))))
    u = u.select(update_doc_id(F.col("source"), F.col("updated_at")).alias("doc_id"), "content",
                 "embedding", F.col(seq).alias("seq"), "source", "_blank")
    status = (F.when(F.col("_blank"), F.lit("skipped_blank"))
              .when(F.col("embedding").isNull(), F.lit("failed_embed"))
              .when(batch_errors("seq").isNotNull(), F.lit("failed_insert")).otherwise(F.lit("ready")))
    return u.withColumn("status", status).drop("_blank")


def update_report(prepared: DataFrame) -> DataFrame:
    """A6 for the scheduled run: per source, rows seen, skipped, failed and added."""
    return prepared.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_seen"),
        *[F.count_if(F.col("status") == s).alias(n) for n, s in (
            ("n_skipped_blank", "skipped_blank"), ("n_failed_embed", "failed_embed"),
            ("n_failed_insert", "failed_insert"), ("n_added", "ready"))])


def ingest_updates(updates: DataFrame, base: DataFrame | None = None, embedder=None,
                   now: Column | None = None, seq: str = "seq") -> DataFrame:
    """P3 in batch form: the knowledge base after applying the update feed."""
    base = base if base is not None else empty_kb(updates.sparkSession)
    return upsert_documents(base, ready_updates(updates, embedder, seq), now=now)


def ready_updates(updates: DataFrame, embedder=None, seq: str = "seq") -> DataFrame:
    """The rows of an update feed that W1 takes."""
    ready = prepare_updates(updates, embedder, seq).filter(F.col("status") == "ready")
    return ready.select("doc_id", "content", "embedding", "seq")


# ---------------------------------------------------------------------------
# Source ingestion run
# ---------------------------------------------------------------------------

from kbspark.functions.ids import unique_index, unix_nanos  # noqa: E402
from kbspark.operators.registry import active_sources, dispatch, touch_sources  # noqa: E402
from kbspark.schema import MAX_DOC_ID_CHARS  # noqa: E402


class SourceRun:
    """Results of one source-ingestion run.  Dispatch runs up front; the embedded
    items and the upserted knowledge base are built on first use, so callers that
    need only the touched registry or the rejects do not pay for embedding."""

    def __init__(self, registry, content, rejects, fetched_ok, base, embedder, now):
        self.rejects, self.fetched_ok, self.now = rejects, fetched_ok, now
        self._content, self._base, self._embedder = content, base, embedder
        self._items = self._kb = self._numbered = None
        self._past: int | None = None
        self.registry = touch_sources(registry, fetched_ok, now)

    def items_after(self, past: int | None) -> DataFrame:
        """source_id, doc_id, content, embedding, seq, status (embedded and stored once). The clock of the
        ids never stands still: a run starts at ``now`` or one past ``past``, the latest nanosecond
        in the knowledge base, so runs and micro-batches never collide."""
        if self._numbered is None:
            named = self._content.select("source_id", "text")
            self._numbered = unique_index(named.withColumn("embedding", self._embedder.embed(F.col("text"))), out="seq")
        start = unix_nanos(self.now)
        start = start if past is None else F.greatest(start, F.lit(past + 1))
        c = self._numbered.withColumn("doc_id", F.concat("source_id", F.lit("-"), (start + F.col("seq")).cast("string")))
        status = (F.when(F.char_length("doc_id") > MAX_DOC_ID_CHARS, F.lit("failed_insert"))
                  .when(F.col("embedding").isNull() & has_text(F.col("text")), F.lit("failed_embed"))
                  .otherwise(F.lit("added")))
        self._items = c.select("source_id", "doc_id", F.col("text").alias("content"), "embedding", "seq", status.alias("status"))
        return self._items

    def added_after(self, past: int | None) -> DataFrame:
        """The items that W1 takes, numbered past ``past``."""
        return self.items_after(past).filter(F.col("status") == "added").select("doc_id", "content", "embedding", "seq")

    @property
    def items(self) -> DataFrame:
        if self._items is None:
            self.items_after(self._base.agg(latest_nanos().alias("n")).first()["n"])
        return self._items

    @property
    def kb(self) -> DataFrame:
        """The knowledge base after W1 (items with status ``added`` upserted into the base)."""
        if self._kb is None:
            added = self.items.filter(F.col("status") == "added").select("doc_id", "content", "embedding", "seq")
            self._kb = upsert_documents(self._base, added, now=self.now)
        return self._kb


def ingest_sources(registry: DataFrame, landed: DataFrame, base: DataFrame | None = None,
                   embedder=None, now: Column | None = None) -> SourceRun:
    """Active sources -> dispatch -> per-item doc id (X4) -> embed (M1) -> upsert
    -> touch sources (W4).  Failures are rows with a status, never exceptions:
    a failed fetch is a reject row; a failed embedding or insert skips its item
    only; a source is touched when a fetch succeeded, whatever its items did."""
    spark = registry.sparkSession
    embedder = embedder or HashingEmbedder()
    now = now if now is not None else F.current_timestamp()
    base = base if base is not None else empty_kb(spark)
    content, rejects, fetched_ok = dispatch(registry, landed, now)
    return SourceRun(registry, content, rejects, fetched_ok, base, embedder, now)


def ingest_report(run: SourceRun, registry: DataFrame) -> DataFrame:
    """Per active source - fetched?, items, added, blank (no embedding), failures, rejects."""
    act = active_sources(registry).select(F.col("id").alias("source_id"), "type")
    it = run.items.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("status") == "added").alias("n_added"),
        F.count_if(F.col("embedding").isNull()).alias("n_no_embedding"),
        F.count_if(F.col("status") == "failed_embed").alias("n_failed_embed"),
        F.count_if(F.col("status") == "failed_insert").alias("n_failed_insert"))
    rj = run.rejects.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_rejected"))
    ok = run.fetched_ok.select("source_id", F.lit(True).alias("fetched"))
    r = act.join(it, "source_id", "left").join(rj, "source_id", "left").join(ok, "source_id", "left")
    counts = ["n_items", "n_added", "n_no_embedding", "n_failed_embed", "n_failed_insert", "n_rejected"]
    return r.select("source_id", "type", F.coalesce("fetched", F.lit(False)).alias("fetched"),
                    *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts])
