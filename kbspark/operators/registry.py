"""Source registry operators: S2 active scan, W3 register, W4 touch, S9 dispatch.

The registry is small next to the content (one row per source), but nothing
here assumes it fits anywhere: joins against it are broadcast only when its
measured row count is within ``REGISTRY_BROADCAST_ROWS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.ids import source_id, unique_index
from kbspark.schema import CONTENT_COLUMNS, DISPATCHABLE_TYPES, SOURCE_COLUMNS
from kbspark.sources.api import parse_api
from kbspark.sources.feed import parse_feeds
from kbspark.sources.pages import stitch_pages
from kbspark.sources.video import parse_videos
from kbspark.sources.web import parse_pages

REGISTRY_BROADCAST_ROWS = 1_000_000


def maybe_broadcast(df: DataFrame, max_rows: int = REGISTRY_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if its counted size is within ``max_rows``."""
    n = df.count()
    return F.broadcast(df) if n <= max_rows else df


def register_sources(requests: DataFrame, now: Column | None = None, ordinal: str | None = None) -> DataFrame:
    """``INSERT INTO knowledge_sources (id, type, url, schedule)`` for a batch.

    id = ``<type>-<unix nanos>`` (nanos of ``now`` + a dense ordinal per request);
    ``active`` defaults to true, ``created_at`` to now, ``last_updated`` is NULL.
    Type, url and schedule are not validated (as in the reference).
    """
    now = now if now is not None else F.current_timestamp()
    if ordinal is None:
        requests = unique_index(requests, out="_ord")      # numbered where they are: repeated requests stay spread
        ordinal = "_ord"
    active = F.col("active") if "active" in requests.columns else F.lit(True)
    return requests.select(
        source_id(F.col("type"), now, F.col(ordinal)).alias("id"),
        F.col("type"), F.col("url"), F.col("schedule"),
        F.lit(None).cast("timestamp").alias("last_updated"),
        active.cast("boolean").alias("active"),
        now.alias("created_at"))


def active_sources(registry: DataFrame) -> DataFrame:
    """``WHERE active = true`` (NULL is not active)."""
    return registry.filter(F.col("active") == F.lit(True))


def touch_sources(registry: DataFrame, fetched_ids: DataFrame, now: Column | None = None) -> DataFrame:
    """``last_updated = now`` for every source id in ``fetched_ids``."""
    now = now if now is not None else F.current_timestamp()
    hit = fetched_ids.select(F.col("source_id").alias("_sid")).distinct().withColumn("_hit", F.lit(True))
    j = registry.join(hit, registry["id"] == hit["_sid"], "left")
    return j.select(*[F.when(F.col("_hit"), now).otherwise(F.col("last_updated")).alias("last_updated")
                      if c == "last_updated" else F.col(c) for c in SOURCE_COLUMNS])


def dispatch(registry: DataFrame, landed: DataFrame, now: Column | None = None, scratch: str | None = None):
    """Route landed bodies of active sources to the processor of their type.

    Returns ``(content, rejects, fetched_ok)``:
    * content: ``source_id`` + Content columns, one row per item;
    * rejects: ``(source_id, url, reason)`` - one per failed fetch, and one per
      active source whose type has no processor (including ``text``);
    * fetched_ok: ids of sources with at least one successful fetch (for W4).

    Plan: the bodies of active sources are routed once - landed as parquet
    partitioned by ``type`` in the shared scratch folder - so each processor
    reads only its own partition (partition pruning), never the whole landing.
    Every processor runs once into one outcome table (items and failures
    together), which is stored; the three results are filters of it. Bodies
    carry an id of their own, so a source counts as fetched if any of its bodies
    did not fail, whatever their urls. The routed copy is deleted at the end.
    """
    from kbspark.session import delete_folder, scratch_dir, shuffles_deleted, stored as written
    spark = registry.sparkSession
    now = now if now is not None else F.current_timestamp()
    act = active_sources(registry).select(F.col("id").alias("source_id"), "type")
    routed = landed.join(maybe_broadcast(act), "source_id").filter(F.col("type").isin(*DISPATCHABLE_TYPES))
    path = scratch or scratch_dir(spark, "dispatch")
    # Clustered by type and split by size, so that a task writes few files.
    routed = routed.withColumn("body_id", F.monotonically_increasing_id())
    with shuffles_deleted(routed.sparkSession):
        routed.hint("rebalance", "type").write.mode("errorifexists").option("compression", "zstd").partitionBy("type").parquet(path)
    stored = spark.read.schema(routed.schema).parquet(path)        # nothing may have been routed
    by = {t: stored.filter(F.col("type") == t).drop("type") for t in DISPATCHABLE_TYPES}

    cols = ["source_id"] + CONTENT_COLUMNS
    nul = F.lit(None).cast("string")
    body = ("body_id",)

    def items(df):
        return df.select(*cols, F.lit("item").alias("kind"), nul.alias("reason"), F.lit(None).cast("long").alias("body_id"))

    api = parse_api(by["api"], now, keep=body)
    web = parse_pages(by["link"], now, keep=body)
    pdf = stitch_pages(by["pdf"].select("source_id", F.col("url").alias("path"), "page_no",
                                        F.col("body").alias("text")), now, keys=["source_id"])
    vid = parse_videos(by["youtube"], now, keep=body)
    rss = parse_feeds(by["rss"], now, keep=body)
    # Bodies that produced nothing but did not fail (e.g. a feed without items) still count as fetched.
    fetched = stored.select(
        "source_id", *[nul.alias(c) for c in ("title", "text", "source")], "url",
        F.lit(None).cast("timestamp").alias("published_at"), F.lit("fetch").alias("kind"), nul.alias("reason"), "body_id")

    def checked(df):
        return df.select(*cols, F.when(F.col("error").isNull(), "item").otherwise("reject").alias("kind"),
                         F.col("error").alias("reason"), "body_id")

    outcome = (checked(api).unionByName(checked(web)).unionByName(items(pdf))
               .unionByName(checked(vid)).unionByName(checked(rss)).unionByName(fetched))
    outcome = written(outcome, scratch_dir(spark, "outcome"))
    if scratch is None:
        delete_folder(spark, path)

    # A NULL type is unknown too.
    unknown = act.filter(~F.coalesce(F.col("type").isin(*DISPATCHABLE_TYPES), F.lit(False))).select(
        "source_id", nul.alias("url"), F.concat(F.lit("unknown source type: "), F.coalesce("type", F.lit(""))).alias("reason"))
    content = outcome.filter(F.col("kind") == "item").select(*cols)
    body_rejects = outcome.filter(F.col("kind") == "reject").select("source_id", "url", "reason")
    rejects = body_rejects.unionByName(unknown)
    failed = outcome.filter(F.col("kind") == "reject").select("body_id")
    fetched_ok = (outcome.filter(F.col("kind") == "fetch").select("source_id", "body_id")
                  .join(failed, "body_id", "left_anti").select("source_id").distinct())
    return content, rejects, fetched_ok
