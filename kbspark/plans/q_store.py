"""Registered queries of the store operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import store as ST
from kbspark.plans import tables as TB
from kbspark.plans.catalog import n_dims
from kbspark.plans.catalog import DIM, _embedder, fmt_ts, register
from kbspark.session import scratch_dir
from kbspark.sources.buckets import BucketStore
from kbspark.sources.snapshot import SnapshotStore, scan_kb

#: Buckets of the registered queries' stores (a production store has thousands).
BUCKETS = 8

# SQL twin of ``documents_kb``: created on day (doc_id mod 30) of January 2024.
_DOCS_KB = f"""
  SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS doc_id, text AS content,
         CAST(CASE WHEN regexp_matches(text, '[^\\t\\n\\x0B\\f\\r ]') THEN {DIM} END AS BIGINT) AS n_dims,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER)) AS created_at
  FROM documents"""

_TS = "'%Y-%m-%d %H:%M:%S'"


@register("kb_scan", f"""
SELECT id, doc_id, md5(content) AS content_md5, n_dims,
       strftime(created_at, {_TS}) AS created_at, strftime(created_at, {_TS}) AS updated_at
FROM ({_DOCS_KB})
""")
def q_kb_scan(spark, sf_dir):
    """Write the KB as a date-partitioned snapshot, scan its six columns back."""
    store = SnapshotStore(spark, scratch_dir(spark, "kb"))
    store.commit(TB.documents_kb(spark, sf_dir, _embedder()))
    kb = scan_kb(spark, store.latest_path())
    return kb.select("id", "doc_id", F.md5("content").alias("content_md5"),
                     n_dims("embedding").alias("n_dims"),
                     fmt_ts("created_at").alias("created_at"), fmt_ts("updated_at").alias("updated_at"))


@register("count_documents", "SELECT count(*) AS n_documents FROM documents")
def q_count_documents(spark, sf_dir):
    """A1: SELECT COUNT(*) over the knowledge base."""
    return ST.count_documents(TB.documents_kb_text(spark, sf_dir, for_embedding=False))


@register("get_documents", f"""
WITH ids AS (
  SELECT CAST(doc_id AS VARCHAR) AS lookup_id FROM labels
  UNION ALL SELECT 'retired-' || CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)
SELECT ids.lookup_id, kb.doc_id IS NOT NULL AS found, kb.id, md5(kb.content) AS content_md5
FROM ids LEFT JOIN ({_DOCS_KB}) kb ON kb.doc_id = ids.lookup_id
""")
def q_get_documents(spark, sf_dir):
    """F2 for a table of ids: every labelled document, plus retired ids that must report not-found."""
    lab = TB.read(spark, sf_dir, "labels")
    ids = lab.select(F.col("doc_id").cast("string").alias("doc_id")).unionByName(
        lab.filter(F.col("toxic") == 1).select(
            F.concat(F.lit("retired-"), F.col("doc_id").cast("string")).alias("doc_id")))
    kb = TB.documents_kb_text(spark, sf_dir, for_embedding=False) \
        .withColumn("embedding", F.lit(None).cast("array<float>")) \
        .withColumn("created_at", TB.base_time_lit()).withColumn("updated_at", TB.base_time_lit())
    r = ST.get_documents(kb, ids)
    return r.select("lookup_id", "found", "id", F.md5("content").alias("content_md5"))


@register("lookup_in_place", """
WITH ids AS (
  SELECT CAST(doc_id AS VARCHAR) AS lookup_id FROM labels WHERE toxic = 1
  UNION ALL SELECT 'retired-' || CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)
SELECT ids.lookup_id, d.doc_id IS NOT NULL AS found, d.doc_id AS id, md5(d.text) AS content_md5
FROM ids LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = ids.lookup_id
""")
def q_lookup_in_place(spark, sf_dir):
    """F2 on a stored table: the documents labelled toxic, and as many retired ids; only the buckets of the ids are read."""
    store = BucketStore(spark, scratch_dir(spark, "in-place"), n_buckets=BUCKETS)
    store.replace(TB.documents_kb_text(spark, sf_dir, for_embedding=False)
                  .withColumn("embedding", F.lit(None).cast("array<float>"))
                  .withColumn("created_at", TB.base_time_lit()).withColumn("updated_at", TB.base_time_lit()))
    key = F.col("doc_id").cast("string")
    toxic = TB.read(spark, sf_dir, "labels").filter(F.col("toxic") == 1)
    ids = toxic.select(key.alias("doc_id")).unionByName(toxic.select(F.concat(F.lit("retired-"), key).alias("doc_id")))
    return store.lookup(ids).select("lookup_id", "found", "id", F.md5("content").alias("content_md5"))


def _upsert_inputs(spark, sf_dir):
    d = TB.read_spread(spark, sf_dir, "documents")
    base_t = TB.base_time_lit()
    emb = _embedder()
    base = d.filter(F.col("doc_id") % 2 == 0).select(
        F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("doc_id"),
        F.col("text").alias("content"), emb.embed(F.col("text")).alias("embedding"),
        base_t.alias("created_at"), base_t.alias("updated_at"))
    # Every document takes part: even ids are the base, odd ids arrive as inserts (rev1),
    # multiples of 3 arrive as updates or inserts (rev1), multiples of 9 twice (rev2 wins).
    rev1 = d.filter((F.col("doc_id") % 3 == 0) | (F.col("doc_id") % 2 == 1)).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("rev1 "), "text").alias("content"),
        (F.col("doc_id") * 2).alias("seq"))
    rev2 = d.filter(F.col("doc_id") % 9 == 0).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("rev2 "), "text").alias("content"),
        (F.col("doc_id") * 2 + 1).alias("seq"))
    batch = rev1.unionByName(rev2).withColumn("embedding", emb.embed(F.col("content")))
    # Every tenth document also arrives once as a row that the constraints forbid.
    bad = d.filter(F.col("doc_id") % 10 == 0).select("doc_id", "text")
    kind = F.floor(F.col("doc_id") / 10) % 5
    key = F.col("doc_id").cast("string")
    bad = bad.select(
        F.when(kind == 0, F.lit(None).cast("string")).when(kind == 1, F.concat(key, F.repeat(F.lit("x"), 256))).otherwise(key).alias("doc_id"),
        F.when(kind == 2, F.lit(None).cast("string")).otherwise(F.concat(F.lit("bad "), "text")).alias("content"),
        F.when(kind == 3, F.lit(None).cast("long")).otherwise(F.lit(1 << 40)).alias("seq"),
        F.when(kind == 4, F.array(F.lit(1.0))).cast("array<float>").alias("embedding"))
    return base, batch.unionByName(bad)


_UPSERT = f"""
WITH base AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content,
                     TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
              FROM documents WHERE doc_id % 2 = 0),
batch AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'rev1 ' || text AS content, doc_id * 2 AS seq
          FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 1
          UNION ALL
          SELECT CAST(doc_id AS VARCHAR), 'rev2 ' || text, doc_id * 2 + 1 FROM documents WHERE doc_id % 9 = 0),
latest AS (SELECT doc_id, arg_max(content, seq) AS content FROM batch GROUP BY doc_id)
SELECT coalesce(b.doc_id, l.doc_id) AS doc_id,
       md5(CASE WHEN l.doc_id IS NOT NULL THEN l.content ELSE b.content END) AS content_md5,
       strftime(coalesce(b.created_at, {TB.NOW_SQL}), {_TS}) AS created_at,
       strftime(CASE WHEN l.doc_id IS NOT NULL THEN {TB.NOW_SQL} ELSE b.updated_at END, {_TS}) AS updated_at,
       CAST({DIM} AS BIGINT) AS n_dims
FROM base b FULL OUTER JOIN latest l ON b.doc_id = l.doc_id
"""


@register("upsert_documents", _UPSERT)
def q_upsert_documents(spark, sf_dir):
    """W1 + J2: batch upsert (last write wins inside the batch) into the base snapshot."""
    base, batch = _upsert_inputs(spark, sf_dir)
    return _upserted(ST.upsert_documents(base, batch, now=TB.now_lit(), dim=DIM))


def _upserted(r):
    return r.select("doc_id", F.md5("content").alias("content_md5"), fmt_ts("created_at").alias("created_at"),
                    fmt_ts("updated_at").alias("updated_at"), n_dims("embedding").alias("n_dims"))


@register("upsert_documents_sort_merge", _UPSERT)
def q_upsert_documents_sort_merge(spark, sf_dir):
    """W1 + J2 as for a batch too large to broadcast: the same rows."""
    base, batch = _upsert_inputs(spark, sf_dir)
    return _upserted(ST.upsert_documents(base, batch, now=TB.now_lit(), dim=DIM, max_broadcast_bytes=0))


@register("upsert_in_place", _UPSERT)
def q_upsert_in_place(spark, sf_dir):
    """W1 + R3 on a stored table: the batch rewrites the buckets of its keys; the same rows."""
    base, batch = _upsert_inputs(spark, sf_dir)
    store = BucketStore(spark, scratch_dir(spark, "in-place"), n_buckets=BUCKETS)
    store.replace(base)
    store.upsert(batch, now=TB.now_lit(), dim=DIM)
    return _upserted(store.read())


@register("upsert_rejects", """
SELECT reason, count(*) AS n FROM (
  SELECT ['NULL doc_id', 'doc_id too long', 'NULL content', 'NULL sequence', 'wrong dimension'][doc_id // 10 % 5 + 1] AS reason
  FROM documents WHERE doc_id % 10 = 0) GROUP BY reason
""")
def q_upsert_rejects(spark, sf_dir):
    """The batch rows that the table's constraints forbid, by reason."""
    _base, batch = _upsert_inputs(spark, sf_dir)
    return ST.upsert_rejects(batch, dim=DIM).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("vector_upsert", """
WITH base AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 2 = 0),
batch AS (SELECT vec_id, list_reverse(embedding) AS embedding FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 2 = 1),
u AS (SELECT * FROM base WHERE vec_id NOT IN (SELECT vec_id FROM batch) UNION ALL SELECT * FROM batch)
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n_dims, embedding[1]::DOUBLE AS first_value FROM u
""")
def q_vector_upsert(spark, sf_dir):
    """(id, values) upsert into a vector index: anti join + union."""
    e = TB.read(spark, sf_dir, "embeddings")
    base = e.filter(F.col("vec_id") % 2 == 0).select("vec_id", "embedding")
    # Every vector takes part: even ids are the index, odd ids are inserted, multiples of 3 replaced.
    batch = e.filter((F.col("vec_id") % 3 == 0) | (F.col("vec_id") % 2 == 1)) \
        .select("vec_id", F.reverse("embedding").alias("embedding"))
    r = ST.vector_upsert(base, batch)
    return r.select("vec_id", n_dims("embedding").alias("n_dims"),
                    F.element_at("embedding", 1).cast("double").alias("first_value"))


RETENTION_DAYS = 15


@register("retention_survivors", f"""
SELECT 'evt-' || CAST(event_id AS VARCHAR) AS doc_id, strftime(ts, {_TS}) AS created_at
FROM events WHERE ts IS NULL OR NOT (ts < {TB.NOW_SQL} - INTERVAL {RETENTION_DAYS} DAY)
""")
def q_retention_survivors(spark, sf_dir):
    """W5 + F5: the snapshot after the retention delete (created_at, strict, NULL kept)."""
    r = ST.retention_survivors(TB.events_kb(spark, sf_dir), TB.now_lit(), RETENTION_DAYS)
    return r.select("doc_id", fmt_ts("created_at").alias("created_at"))


@register("retention_in_place", f"""
SELECT 'evt-' || CAST(event_id AS VARCHAR) AS doc_id, strftime(ts, {_TS}) AS created_at,
       (SELECT count(*) FROM events WHERE ts < {TB.NOW_SQL} - INTERVAL {RETENTION_DAYS} DAY) AS n_deleted
FROM events WHERE ts IS NULL OR NOT (ts < {TB.NOW_SQL} - INTERVAL {RETENTION_DAYS} DAY)
""")
def q_retention_in_place(spark, sf_dir):
    """W5 + A2 on a stored table: expired days are dropped whole, the boundary day is rewritten."""
    store = BucketStore(spark, scratch_dir(spark, "in-place"), n_buckets=2)
    store.replace(TB.events_kb(spark, sf_dir))
    deleted = store.retain(TB.now_lit(), RETENTION_DAYS)
    return store.read().select("doc_id", fmt_ts("created_at").alias("created_at"), F.lit(deleted).cast("long").alias("n_deleted"))


@register("retention_deleted_count", f"""
SELECT CAST(sum(CASE WHEN ts < {TB.NOW_SQL} - INTERVAL {RETENTION_DAYS} DAY THEN 1 ELSE 0 END) AS BIGINT) AS deleted,
       CAST(sum(CASE WHEN ts < {TB.NOW_SQL} - INTERVAL {RETENTION_DAYS} DAY THEN 0 ELSE 1 END) AS BIGINT) AS kept,
       count(*) AS total
FROM events
""")
def q_retention_deleted_count(spark, sf_dir):
    """A2: affected-row count of the retention delete, in the same single pass."""
    return ST.retention_counts(TB.events_kb(spark, sf_dir), TB.now_lit(), RETENTION_DAYS)


def _audit_table(spark, sf_dir):
    """One pass: every 50th document is emitted twice (copy 2 is a plain duplicate key);
    copy 1 carries the injected violations."""
    kb = TB.documents_kb(spark, sf_dir, _embedder())
    i = F.col("id")
    x = kb.withColumn("_copy", F.explode(F.when(i % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    first = F.col("_copy") == 1
    return x.select(
        "id",
        F.when(first & (i % 101 == 0), F.concat(F.col("doc_id"), F.repeat(F.lit("x"), 256)))
        .otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(first & (i % 97 == 0), F.lit(None).cast("string")).otherwise(F.col("content")).alias("content"),
        F.when(first & (i % 103 == 0), F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("embedding"),
        "created_at", "updated_at")


@register("kb_constraints", f"""
WITH kb AS ({_DOCS_KB}),
bad AS (
  SELECT CASE WHEN id % 101 = 0 THEN doc_id || repeat('x', 256) ELSE doc_id END AS doc_id,
         CASE WHEN id % 97 = 0 THEN NULL ELSE content END AS content,
         CASE WHEN id % 103 = 0 AND n_dims IS NOT NULL THEN 3 ELSE n_dims END AS n_dims
  FROM kb
  UNION ALL SELECT doc_id, content, n_dims FROM kb WHERE id % 50 = 0),
per_key AS (SELECT doc_id, count(*) AS c FROM bad GROUP BY doc_id)
SELECT count(*) AS n_rows,
       count(*) FILTER (WHERE doc_id IS NULL) AS null_doc_id,
       count(*) FILTER (WHERE content IS NULL) AS null_content,
       count(*) FILTER (WHERE length(doc_id) > 255) AS long_doc_id,
       count(*) FILTER (WHERE n_dims IS NOT NULL AND n_dims <> {DIM}) AS wrong_dim,
       count(*) FILTER (WHERE n_dims IS NULL) AS null_embedding,
       (SELECT count(*) FROM per_key WHERE doc_id IS NOT NULL AND c > 1) AS dup_keys,
       (SELECT coalesce(sum(c), 0) FROM per_key WHERE doc_id IS NOT NULL AND c > 1)::BIGINT AS dup_rows
FROM bad
""")
def q_kb_constraints(spark, sf_dir):
    """K1: audit of a KB with injected duplicate keys, NULL contents, over-long ids, short vectors."""
    return ST.kb_constraints(_audit_table(spark, sf_dir), DIM)
