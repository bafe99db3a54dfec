"""Knowledge-base maintenance: W1 upsert, W2 vector upsert, W5 retention,
F2 point lookup, A1 count, K1 constraint audit.

Parquet has no MERGE/DELETE, so every write produces a new snapshot
DataFrame (see ``kbspark.sources.snapshot`` for the versioned store).
All keyed work is hash-aggregate or equi-join on the key:

* rows that the table's constraints forbid never reach a write: ``batch_errors``
  names the reason, ``upsert_rejects`` returns them;
* the batch is de-duplicated over its keys, sequence and row numbers alone, aggregated map-side
  first, so a key repeated in a third of the batch is pre-combined before the shuffle;
* the merge is one equi-join on ``doc_id``: left-outer against a broadcast batch,
  or full-outer sort-merge (AQE splits skewed partitions). Both give the same rows;
* new keys get dense surrogate ids from ``dense_index`` over the narrow keys (no global window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.ids import dense_index
from kbspark.schema import KB_COLUMNS, MAX_DOC_ID_CHARS
from kbspark.session import scratch_dir, stored as written


def dedupe_last(batch: DataFrame, key: str, seq: str, cols: list[str]) -> DataFrame:
    """Last write wins per key (largest ``seq``, ties by a hash of the values, so that the
    winner does not depend on partitioning); ``_first_seq`` keeps arrival order."""
    order = F.struct(F.col(seq).alias("s"), F.xxhash64(*cols).alias("h"))
    return (batch.groupBy(key)
            .agg(F.max_by(F.struct(*cols), order).alias("_v"), F.min(seq).alias("_first_seq"))
            .select(key, "_first_seq", *[F.col(f"_v.{c}").alias(c) for c in cols]))


def batch_errors(seq: str = "seq", dim: int | None = None) -> Column:
    """Why a batch row may not be written (NULL: it may): the constraints of the table."""
    doc = F.col("doc_id")
    reason = (F.when(doc.isNull(), "NULL doc_id").when(F.char_length(doc) > MAX_DOC_ID_CHARS, "doc_id too long")
              .when(F.col("content").isNull(), "NULL content").when(F.col(seq).isNull(), "NULL sequence"))
    if dim is not None:
        reason = reason.when(F.col("embedding").isNotNull() & (F.size("embedding") != dim), "wrong dimension")
    return reason


def upsert_rejects(batch: DataFrame, seq: str = "seq", dim: int | None = None) -> DataFrame:
    """The rows that ``upsert_documents`` leaves out, with their ``reason``."""
    return batch.withColumn("reason", batch_errors(seq, dim)).filter(F.col("reason").isNotNull())


def _batch_bytes(latest: DataFrame) -> int:
    """Size estimate of a de-duplicated batch: text bytes + 4 bytes per vector element."""
    r = latest.agg(F.coalesce(F.sum(F.octet_length("content") + 64
                                    + 4 * F.coalesce(F.size("embedding"), F.lit(0))), F.lit(0))
                   .alias("b")).first()
    return int(r["b"])


def upsert_documents(base: DataFrame, batch: DataFrame, now: Column | None = None,
                     seq: str = "seq", max_broadcast_bytes: int = 256 * 1024 * 1024,
                     dim: int | None = None) -> DataFrame:
    """INSERT .. ON CONFLICT (doc_id) DO UPDATE for a whole batch.

    New key: both timestamps = now.  Conflict: content and embedding replaced,
    ``updated_at`` = now; ``id`` and ``created_at`` kept.  Returns the new snapshot.
    Rows with a ``batch_errors`` reason are left out (see ``upsert_rejects``); every base
    row is kept, whatever its columns hold.

    A batch whose measured size is within ``max_broadcast_bytes`` is broadcast and
    the base is streamed through a left-outer hash join (the base is never
    shuffled); a larger batch takes a full-outer sort-merge join on ``doc_id``.
    """
    return merge_documents(base, latest_rows(batch, seq, dim), now, max_broadcast_bytes)


def latest_rows(batch: DataFrame, seq: str = "seq", dim: int | None = None) -> DataFrame:
    """The valid rows of a batch, the last write of each key, stored once (embeddings included): they feed
    the size check, the merge and the new-key ids.

    The winners are picked over (key, sequence, row) alone; contents and vectors are not aggregated, and they are
    copied once more only if more than ``KEY_BROADCAST_ROWS`` keys occur twice. Ties of the sequence go by a hash of the values, so that
    the winner does not depend on partitioning."""
    base = scratch_dir(batch.sparkSession, "batch")

    def stored(df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{base}/{name}")
    cols = ["doc_id", "content", "embedding"]
    rows = stored(batch.filter(batch_errors(seq, dim).isNull())
                  .select(*cols, F.col(seq).alias("_seq"), F.xxhash64("content", "embedding").alias("_hash"), F.monotonically_increasing_id().alias("_row")), "rows")
    best = stored(rows.groupBy("doc_id").agg(F.max_by("_row", F.struct("_seq", "_hash")).alias("_row"), F.min("_seq").alias("_first_seq"),
                                             F.count(F.lit(1)).alias("n")), "winners")
    again = best.filter("n > 1").select("doc_id", F.col("_row").alias("_last"), "_first_seq")
    n = again.count()
    if n == 0:
        return rows.select(*cols, F.col("_seq").alias("_first_seq"))
    if n <= KEY_BROADCAST_ROWS:                                # the contents are neither shuffled nor copied
        kept = rows.join(F.broadcast(again), "doc_id", "left").filter("_last is null or _last = _row")
        return kept.select(*cols, F.coalesce("_first_seq", "_seq").alias("_first_seq"))
    return stored(rows.join(best.select("_row", "_first_seq"), "_row").select(*cols, "_first_seq"), "latest")


def latest_nanos() -> Column:
    """The latest nanosecond time stamp in the ids of ingested items (``<source>-<nanos>``)."""
    return F.max(F.regexp_extract("doc_id", "-(\\d{1,18}|[1-8]\\d{18})$", 1).try_cast("long"))


def merge_documents(base: DataFrame, latest: DataFrame, now: Column | None = None,
                    max_broadcast_bytes: int = 256 * 1024 * 1024, start: int | None = None) -> DataFrame:
    """The base after the rows of ``latest_rows``; new keys are numbered from ``start`` (default: one
    past the base's largest id, by a scan of that column)."""
    now = now if now is not None else F.current_timestamp()
    if start is None:
        start = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"] + 1
    o = base.select(*KB_COLUMNS, F.lit(True).alias("_old")).alias("o")
    small = _batch_bytes(latest) <= max_broadcast_bytes
    # Keys already present: a doc_id-only (column-pruned) scan of the base.
    matched = base.select("doc_id")
    if small:
        matched = matched.join(F.broadcast(latest.select("doc_id")), "doc_id")
    new = latest.join(matched, "doc_id", "left_anti")
    # Ids follow arrival: only (key, sequence) is sorted, not the contents.
    ids = dense_index(new.select("doc_id", "_first_seq"), ["_first_seq", "doc_id"], out="id", start=int(start)).select("doc_id", "id")
    # A large batch gets its new ids on the way into the merge, so that its contents are shuffled once.
    numbered = latest.withColumn("id", F.lit(None).cast("long")) if small else latest.join(ids, "doc_id", "left")
    n = (F.broadcast(numbered) if small else numbered).alias("n")
    j = o.join(n, F.col("o.doc_id") == F.col("n.doc_id"), "left_outer" if small else "full_outer")
    hit, old = F.col("n.doc_id").isNotNull(), F.col("o._old")
    merged = j.select(
        # An existing row keeps its id and its created_at (even NULL); only an insert is numbered and stamped now.
        F.when(old, F.col("o.id")).otherwise(F.col("n.id")).alias("id"),
        F.coalesce(F.col("o.doc_id"), F.col("n.doc_id")).alias("doc_id"),
        F.when(hit, F.col("n.content")).otherwise(F.col("o.content")).alias("content"),
        F.when(hit, F.col("n.embedding")).otherwise(F.col("o.embedding")).alias("embedding"),
        F.when(old, F.col("o.created_at")).otherwise(now).alias("created_at"),
        F.when(hit, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
    ).select(*KB_COLUMNS)
    if not small:
        return merged
    added = new.drop("_first_seq").join(ids, "doc_id").withColumn("created_at", now).withColumn("updated_at", now)
    return merged.unionByName(added.select(*KB_COLUMNS))


def new_documents(latest: DataFrame, now: Column | None = None, start: int = 1) -> DataFrame:
    """The rows of ``latest_rows`` as new rows of a table that has none of their keys, numbered from ``start`` in order
    of arrival."""
    now = now if now is not None else F.current_timestamp()
    ids = dense_index(latest.select("doc_id", "_first_seq"), ["_first_seq", "doc_id"], out="id", start=int(start)).select("doc_id", "id")
    return latest.join(ids, "doc_id").withColumns({"created_at": now, "updated_at": now}).select(*KB_COLUMNS)


# Key sets up to this many rows are broadcast, so the large side streams without a shuffle.
KEY_BROADCAST_ROWS = 5_000_000


def _keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys, broadcast when their counted number is within KEY_BROADCAST_ROWS."""
    k = df.select(key).distinct()
    return F.broadcast(k) if k.count() <= KEY_BROADCAST_ROWS else k


def vector_upsert(index: DataFrame, batch: DataFrame, key: str = "vec_id", seq: str | None = None) -> DataFrame:
    """(id, values) upsert: replace values of existing ids, insert new ones.

    The index streams through an anti-join against the (size-checked, broadcast)
    batch keys; the batch is appended. A batch with repeated ids needs ``seq`` to say
    which one is last (``ValueError`` without it); NULL ids are not written."""
    batch = batch.filter(F.col(key).isNotNull())
    if seq is not None:
        batch = dedupe_last(batch.filter(F.col(seq).isNotNull()), key, seq, ["embedding"])
    elif not batch.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"repeated {key} in a vector batch: name the sequence column")
    batch = batch.select(key, "embedding")
    return index.select(key, "embedding").join(_keys(batch, key), key, "left_anti").unionByName(batch)


def retention_predicate(created_at: Column, now: Column, days: int) -> Column:
    """strictly older than ``now - days`` calendar days; NULL is never old."""
    return F.coalesce(created_at < now - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days)),
                      F.lit(False))


def retention_survivors(kb: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """The snapshot after ``DELETE .. WHERE created_at < now - days``.

    Written as ``created_at IS NULL OR created_at >= boundary`` (the same rows as
    ``NOT coalesce(created_at < boundary, false)``) so that parquet can push it down."""
    boundary = now - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days))
    c = F.col("created_at")
    return kb.filter(c.isNull() | (c >= boundary))


def retention_counts(kb: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """A2: deleted / kept counts in one pass (conditional sums, partial aggregation)."""
    old = retention_predicate(F.col("created_at"), now, days)
    return kb.agg(F.sum(F.when(old, 1).otherwise(0)).cast("long").alias("deleted"),
                  F.sum(F.when(old, 0).otherwise(1)).cast("long").alias("kept"),
                  F.count(F.lit(1)).alias("total"))


def get_documents(kb: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """F2 for many ids: one row per requested id with ``found``; a missing id is
    reported (found = false), not silently dropped."""
    # The knowledge base streams through an inner join with the (size-checked, broadcast)
    # requested keys; only the matches meet the id list in the final small left join.
    wanted = _keys(ids.select(F.col(key).alias("doc_id")), "doc_id")
    hit = kb.select(*KB_COLUMNS).join(wanted, "doc_id").withColumn("_hit", F.lit(True))
    return ids.join(hit, ids[key] == hit["doc_id"], "left").select(
        ids[key].alias("lookup_id"), F.coalesce(F.col("_hit"), F.lit(False)).alias("found"),
        *[hit[c] for c in KB_COLUMNS if c != "doc_id"])


def get_document(kb: DataFrame, doc_id: str):
    """F2 for one id, as the reference's point lookup: the row, or ``KeyError`` when missing.

    Pushed down to the scan as ``doc_id = <literal>`` (parquet min/max and
    dictionary filtering); at most two rows reach the driver (to detect duplicates)."""
    rows = kb.filter(F.col("doc_id") == F.lit(doc_id)).select(*KB_COLUMNS).limit(2).collect()
    if not rows:
        raise KeyError(f"document not found: {doc_id}")
    if len(rows) > 1:
        raise ValueError(f"duplicate doc_id: {doc_id}")
    return rows[0]


def count_documents(kb: DataFrame) -> DataFrame:
    """A1: SELECT COUNT(*) (partial + final hash aggregate)."""
    return kb.agg(F.count(F.lit(1)).alias("n_documents"))


def kb_constraints(kb: DataFrame, dim: int) -> DataFrame:
    """K1: constraint audit of a KB table in two chained aggregates.

    doc_id UNIQUE NOT NULL, content NOT NULL, char_length(doc_id) <= 255,
    size(embedding) = dim.  One grouping by key (a partial aggregate, so a hot
    key is pre-counted map-side), then one global aggregate of the groups.
    """
    per_key = kb.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("c"),
        F.count_if(F.col("content").isNull()).alias("nc"),
        F.count_if(F.char_length("doc_id") > MAX_DOC_ID_CHARS).alias("nl"),
        F.count_if(F.col("embedding").isNotNull() & (F.size("embedding") != dim)).alias("nw"),
        F.count_if(F.col("embedding").isNull()).alias("ne"),
    )
    keyed = F.col("doc_id").isNotNull()
    out = per_key.agg(
        F.sum("c").alias("n_rows"),
        F.sum(F.when(~keyed, F.col("c")).otherwise(0)).alias("null_doc_id"),
        F.sum("nc").alias("null_content"),
        F.sum("nl").alias("long_doc_id"),
        F.sum("nw").alias("wrong_dim"),
        F.sum("ne").alias("null_embedding"),
        F.count_if(keyed & (F.col("c") > 1)).alias("dup_keys"),
        F.sum(F.when(keyed & (F.col("c") > 1), F.col("c")).otherwise(0)).alias("dup_rows"),
    )
    return out.select(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in out.columns])


def source_constraints(registry: DataFrame) -> DataFrame:
    """K1 for the source registry: id UNIQUE NOT NULL; type, url and schedule NOT NULL."""
    per_key = registry.groupBy("id").agg(
        F.count(F.lit(1)).alias("c"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("type", "url", "schedule")])
    keyed = F.col("id").isNotNull()
    out = per_key.agg(
        F.sum("c").alias("n_rows"), F.sum(F.when(~keyed, F.col("c")).otherwise(0)).alias("null_id"),
        *[F.sum(f"null_{c}").alias(f"null_{c}") for c in ("type", "url", "schedule")],
        F.count_if(keyed & (F.col("c") > 1)).alias("dup_ids"),
        F.sum(F.when(keyed & (F.col("c") > 1), F.col("c")).otherwise(0)).alias("dup_rows"))
    return out.select(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in out.columns])
