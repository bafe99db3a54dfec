"""Registered queries of the streaming operators (R1-R3) and approximate top-k (T4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.operators.ann import StoredIndex, ann_topk, assign_ivf
from kbspark.operators.coded import CodedIndex
from kbspark.plans import landing as L
from kbspark.plans import oracle_sql as O
from kbspark.plans import tables as TB
from kbspark.plans.catalog import _VEC_PAIRS, REGISTRY, VEC_K, VEC_T, _embedder, fmt_ts, register
from kbspark.plans.q_ingest import _UPD, NOW_TXT
from kbspark.plans.q_store import BUCKETS
from kbspark.plans.q_registry import _DISPATCH, INGESTED, REPORT, failing_run, ingested
from kbspark.schema import DISPATCHABLE_TYPES, SOURCE
from kbspark.session import scratch_dir
from kbspark.sources.buckets import BucketStore
from kbspark.sources.snapshot import SnapshotStore
from kbspark.sources.pages import stitch_pages
from kbspark.streaming.pages import assemble_pages
from kbspark.streaming.stream import read_accounting, run_stream, stream_sources, stream_updates

def _read_stream(spark, sf_dir: str, name: str) -> DataFrame:
    """A streaming scan of one landed table (the file is the landing zone)."""
    TB.read(spark, sf_dir, name)  # pins the session time zone
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    for f in schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            s = s.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return s


@register("stream_updates", f"""
WITH {_UPD}
SELECT doc_id, md5(arg_max(content, seq)) AS content_md5, {NOW_TXT} AS created_at, {NOW_TXT} AS updated_at
FROM d GROUP BY doc_id
""")
def q_stream_updates(spark, sf_dir):
    """R1 + R3: the update feed as a stream; each micro-batch upserts into a versioned snapshot."""
    root = scratch_dir(spark, "stream-updates")
    store = BucketStore(spark, f"{root}/kb", n_buckets=BUCKETS)
    updates = L.update_feed(spark, sf_dir, orders=_read_stream(spark, sf_dir, "orders"))
    stream_updates(spark, updates, store, f"{root}/checkpoint", embedder=_embedder(), now=TB.now_lit())
    kb = store.read()
    return kb.select("doc_id", F.md5("content").alias("content_md5"), fmt_ts("created_at").alias("created_at"),
                     fmt_ts("updated_at").alias("updated_at"))


@register("stream_sources", f"WITH {_DISPATCH} {INGESTED}")
def q_stream_sources(spark, sf_dir):
    """R2: landed bodies of all types arrive as a stream of several micro-batches, each of which
    runs source ingestion (P2); the same rows as one batch run."""
    root = scratch_dir(spark, "stream-sources")
    store = BucketStore(spark, f"{root}/kb", n_buckets=BUCKETS)
    reg_store = SnapshotStore(spark, f"{root}/registry", schema=SOURCE, partition_by=None)
    reg = L.registry(spark, sf_dir)
    pages, single = L.landed_parts(spark, sf_dir, reg)
    stream = L.land(spark, sf_dir, pages, f"{root}/landed", batches=2, least=4, single=single)
    stream_sources(spark, stream, reg, store, reg_store, f"{root}/checkpoint", embedder=_embedder(), now=TB.now_lit())
    return ingested(store.read())


@register("stream_two_writers", f"""
WITH {_DISPATCH}, {_UPD}
SELECT 'update' AS kind, md5(arg_max(content, seq)) AS content_md5, {NOW_TXT} AS created_at, true AS unique_id FROM d GROUP BY doc_id
UNION ALL SELECT 'item' AS kind, md5(text) AS content_md5, {NOW_TXT} AS created_at, true AS unique_id FROM content
""")
def q_stream_two_writers(spark, sf_dir):
    """R1 + R2 into one store at the same time: neither loses a batch of the other."""
    from threading import Thread
    root = scratch_dir(spark, "two-writers")
    reg = L.registry(spark, sf_dir)
    pages, single = L.landed_parts(spark, sf_dir, reg)
    stream = L.land(spark, sf_dir, pages, f"{root}/landed", batches=1, least=2, single=single)
    failed: list[Exception] = []

    def updates():
        feed = L.update_feed(spark, sf_dir, orders=_read_stream(spark, sf_dir, "orders"))
        stream_updates(spark, feed, BucketStore(spark, f"{root}/kb", n_buckets=BUCKETS), f"{root}/updates", embedder=_embedder(), now=TB.now_lit())

    def sources():
        stream_sources(spark, stream, reg, BucketStore(spark, f"{root}/kb", n_buckets=BUCKETS), SnapshotStore(spark, f"{root}/registry", schema=SOURCE, partition_by=None),
                       f"{root}/sources", embedder=_embedder(), now=TB.now_lit())

    def guarded(work):
        try:
            work()
        except Exception as e:  # noqa: BLE001 - raised below, in the caller's thread
            failed.append(e)
    threads = [Thread(target=guarded, args=(f,)) for f in (updates, sources)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]
    kb = BucketStore(spark, f"{root}/kb", n_buckets=BUCKETS).read()
    ids = kb.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.startswith("doc_id", F.lit("doc_")), F.lit("update")).otherwise(F.lit("item"))
    return (kb.join(ids, "id").select(kind.alias("kind"), F.md5("content").alias("content_md5"),
                                      fmt_ts("created_at").alias("created_at"), (F.col("n") == 1).alias("unique_id")))


@register("stream_pages", REGISTRY["stitch_pages"][1])
def q_stream_pages(spark, sf_dir):
    """R2 with S5: the pages of each document are dealt out over three micro-batches; the same documents
    as from whole ones."""
    root = scratch_dir(spark, "stream-pages")
    p = L.pdf_pages(spark, sf_dir)
    p = p.join(p.groupBy("url").agg(F.count(F.lit(1)).alias("page_count")), "url").drop("key")
    for i in range(3):
        p.filter(F.pmod("page_no", F.lit(3)) == i).coalesce(1).write.parquet(f"{root}/in/{i}")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
    run_stream(assemble_pages(stream), lambda batch, i: batch.write.mode("overwrite").parquet(f"{root}/out/{i}"), f"{root}/checkpoint")
    done = spark.read.parquet(f"{root}/out/*").select(F.col("url").alias("path"), "page_no", F.col("body").alias("text"))
    c = stitch_pages(done, now=TB.now_lit())
    return c.select("title", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("text_len"),
                    fmt_ts("published_at").alias("published_at"))


@register("stream_accounting", REPORT)
def q_stream_accounting(spark, sf_dir):
    """A6 in R2: the reports of all micro-batches add up to the report of one run, failures included."""
    root = scratch_dir(spark, "accounting")
    reg, embedder = failing_run(spark, sf_dir)
    pages, single = L.landed_parts(spark, sf_dir, reg)
    stream = L.land(spark, sf_dir, pages, f"{root}/landed", batches=2, least=2, single=single)
    stream_sources(spark, stream, reg, BucketStore(spark, f"{root}/kb", n_buckets=BUCKETS), SnapshotStore(spark, f"{root}/registry", schema=SOURCE, partition_by=None),
                   f"{root}/checkpoint", embedder=embedder, now=TB.now_lit(), accounting=f"{root}/accounting")
    reports, batches = read_accounting(spark, f"{root}/accounting"), F.countDistinct("batch")
    # A source without a processor is rejected in each run.
    unknown = F.when(F.max("known"), F.sum("n_rejected")).otherwise(F.sum("n_rejected") / batches)
    known = F.col("type").isin(*DISPATCHABLE_TYPES)
    counts = ["n_items", "n_added", "n_no_embedding", "n_failed_embed", "n_failed_insert"]
    return (reports.withColumn("known", known).groupBy("source_id", "type")
            .agg(F.max("fetched").alias("fetched"), *[F.sum(c).alias(c) for c in counts], unknown.cast("long").alias("n_rejected")))


ANN_K, ANN_PROBE = 10, 3
# Given centroids: the first vector of each label. Cells and probes go by the rounded similarity key.
_IVF = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
cent AS (SELECT row_number() OVER (ORDER BY f) - 1 AS c, e FROM
         (SELECT min(vec_id) AS f FROM embeddings GROUP BY label) JOIN v ON v.vec_id = f),
near AS (SELECT v.vec_id, cent.c, row_number() OVER (PARTITION BY v.vec_id ORDER BY
                {O.key_of("list_cosine_similarity(v.e, cent.e)")} DESC, cent.c) AS r FROM v CROSS JOIN cent),
s AS (SELECT q.vec_id AS query_id, CAST(d.vec_id AS VARCHAR) AS vec_id, {O.key_of("list_cosine_similarity(qv.e, dv.e)")} AS sim_key
      FROM near q JOIN near d ON d.c = q.c AND d.r = 1 AND q.r <= %d JOIN v qv ON qv.vec_id = q.vec_id JOIN v dv ON dv.vec_id = d.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim_key DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, sim_key / 1e9 AS score, rank FROM t WHERE rank <= {ANN_K}
"""


def _ann(spark, sf_dir, n_probe):
    return _searched(spark, sf_dir, assign_ivf(TB.vector_index(spark, sf_dir), _centroids(spark, sf_dir)), n_probe)


def _centroids(spark, sf_dir):
    e = TB.read(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return first.join(e.select("vec_id", "embedding"), "vec_id").orderBy("vec_id").select("embedding")


def _searched(spark, sf_dir, idx, n_probe):
    r = ann_topk(TB.vector_queries(spark, sf_dir), idx, k=ANN_K, n_probe=n_probe or idx.n_lists)
    return r.select("query_id", F.col("doc_id").alias("vec_id"), F.col("similarity").alias("score"),
                    F.col("rank").cast("long").alias("rank"))


@register("ann_topk", _IVF.replace("%d", str(ANN_PROBE)))
def q_ann_topk(spark, sf_dir):
    """T4: IVF top-k over given centroids, n_probe of the cells probed."""
    return _ann(spark, sf_dir, ANN_PROBE)


@register("ann_topk_maintained", _IVF.replace("%d", str(ANN_PROBE)))
def q_ann_topk_maintained(spark, sf_dir):
    """T4 under W1 and W5: the index is built on an old state (some vectors missing, some others, some
    retired), then an upsert and a delete bring it to the current one; the same rows as ``ann_topk``."""
    now, n = TB.vector_index(spark, sf_dir).select("id", "doc_id", "embedding"), F.col("id")
    old = now.filter(n % 4 != 2).withColumn("embedding", F.when(n % 4 == 1, F.reverse("embedding")).otherwise(F.col("embedding")))
    retired = now.filter(n % 5 == 0).withColumn("doc_id", F.concat(F.lit("retired-"), "doc_id"))
    idx = StoredIndex(spark, scratch_dir(spark, "index"), _centroids(spark, sf_dir))
    idx.build(old.unionByName(retired))
    idx.upsert(now.filter((n % 4).isin(1, 2)))
    idx.keep_only(now)
    return _searched(spark, sf_dir, idx.index(), ANN_PROBE)


@register("ann_topk_full_probe", """
SELECT query_id, doc_id AS vec_id, sim_key / 1e9 AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim_key DESC, doc_id) AS rank FROM (%s)) WHERE rank <= 10
""" % _VEC_PAIRS)
def q_ann_topk_full_probe(spark, sf_dir):
    """T4 with every cell probed: equal to the exact search."""
    return _ann(spark, sf_dir, None)


@register("similar_documents_two_phase", REGISTRY["similar_documents_batch"][1])
def q_similar_documents_two_phase(spark, sf_dir):
    """T1 / T3 over a stored index: 8-bit codes first, exact scores of what can matter; the same rows as
    ``similar_documents_batch``."""
    idx = CodedIndex(spark, scratch_dir(spark, "coded"), dim=64, n_buckets=BUCKETS)
    idx.build(TB.vector_index(spark, sf_dir))
    r = idx.top_k(TB.vector_queries(spark, sf_dir), k=VEC_K, threshold=VEC_T)
    return r.select("query_id", "doc_id", "sim_key", "similarity", F.col("rank").cast("long").alias("rank"))
