"""Landed inputs derived from the driver tables (what fetchers would have landed).

Each function turns a whole given table into landed bodies
``(url, body, fetched_at, key)``; ``key`` is used to spread the bodies over
the registered sources of a type.  No grouping is unbounded: an RSS body
holds the items of one source within one block of ``FEED_BLOCK`` doc ids.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions.parallel import estimated_bytes
from kbspark.functions.text import xml_escape
from kbspark.session import shuffles_deleted
from kbspark.plans import tables as TB

FEED_BLOCK = 64
API_URL = "https://api.example.com/events/"


def api_bodies(spark, sf_dir) -> DataFrame:
    """``events.props`` as API responses; ``error`` events landed a JSON array (rejected)."""
    e = TB.read(spark, sf_dir, "events")
    body = F.when(F.col("event_type") == "error", F.concat(F.lit("["), F.col("props"), F.lit("]"))) \
        .otherwise(F.col("props"))
    return e.select(F.concat(F.lit(API_URL), F.col("event_id").cast("string")).alias("url"),
                    body.alias("body"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("key"),
                    F.concat(F.lit("api-"), F.col("user_id").cast("string")).alias("source_id"))


def page_bodies(spark, sf_dir, pages: DataFrame | None = None) -> DataFrame:
    p = pages if pages is not None else TB.read(spark, sf_dir, "pages")
    host = F.regexp_extract(F.col("url"), "^[a-z]+://([^/:?#]+)", 1)
    return p.select("url", F.col("html").alias("body"), TB.now_lit().alias("fetched_at"),
                    F.col("page_id").alias("key"), F.concat(F.lit("link-"), host).alias("source_id"))


def pdf_pages(spark, sf_dir) -> DataFrame:
    """``conversations`` as paged documents: path per conversation, page = turn + 1;
    every fifth page has no text, and conversations 7, 57, ... have none at all."""
    c = TB.read(spark, sf_dir, "conversations")
    null_page = (F.col("turn") % 5 == 4) | (F.col("conv_id") % 50 == 7)
    return c.select(F.concat(F.lit("docs/conv-"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("url"),
                    (F.col("turn") + 1).alias("page_no"),
                    F.when(null_page, F.lit(None).cast("string")).otherwise(F.col("text")).alias("body"),
                    TB.now_lit().alias("fetched_at"), F.col("conv_id").alias("key"),
                    F.lit("pdf-local").alias("source_id"))


def video_bodies(spark, sf_dir) -> DataFrame:
    """Video-list responses from ``conversations``: no items when turn % 7 = 6, a
    second (ignored) item when turn % 3 = 1."""
    c = TB.read(spark, sf_dir, "conversations")
    vid = F.concat(F.lit("v"), F.col("conv_id").cast("string"), F.lit("t"), F.col("turn").cast("string"))
    first = F.struct(vid.alias("id"), F.struct(
        F.concat_ws(" ", F.col("role"), F.col("conv_id").cast("string")).alias("title"),
        F.col("text").alias("description")).alias("snippet"))
    second = F.struct(F.concat(vid, F.lit("b")).alias("id"), F.struct(
        F.lit("other").alias("title"), F.lit("ignored").alias("description")).alias("snippet"))
    items = (F.when(F.col("turn") % 7 == 6, F.array().cast(
        "array<struct<id:string,snippet:struct<title:string,description:string>>>"))
        .when(F.col("turn") % 3 == 1, F.array(first, second)).otherwise(F.array(first)))
    return c.select(vid.alias("url"), F.to_json(F.struct(items.alias("items"))).alias("body"),
                    TB.now_lit().alias("fetched_at"), F.col("conv_id").alias("key"),
                    F.lit("youtube-api").alias("source_id"))


def feed_items(spark, sf_dir) -> DataFrame:
    """One RSS item per document (the SQL twin reads ``documents`` directly)."""
    d = TB.read_spread(spark, sf_dir, "documents")
    pub = F.timestamp_add("MINUTE", F.col("doc_id"), TB.base_time_lit())
    link = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/doc/"), F.col("doc_id").cast("string"))
    desc = F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(
        F.concat(F.lit("<description>"), xml_escape(F.col("text")), F.lit("</description>")))
    date = F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit("<pubDate>"), F.date_format(pub, "EEE, dd MMM yyyy HH:mm:ss Z"), F.lit("</pubDate>")))
    item = F.concat(F.lit("<item><title>doc "), F.col("doc_id").cast("string"), F.lit("</title><link>"),
                    xml_escape(link), F.lit("</link>"), desc, date, F.lit("</item>"))
    return d.select("source", (F.floor(F.col("doc_id") / FEED_BLOCK)).alias("blk"), "doc_id", item.alias("item"))


def feed_bodies(spark, sf_dir) -> DataFrame:
    """RSS 2.0 bodies, one per (source, block of FEED_BLOCK doc ids): bounded item lists."""
    it = feed_items(spark, sf_dir)
    g = it.groupBy("source", "blk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "item"))), lambda s: s["item"]),
                     "").alias("items"))
    body = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>'),
                    xml_escape(F.col("source")), F.lit("</title>"), F.col("items"), F.lit("</channel></rss>"))
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/feed/"), F.col("blk").cast("string"))
    return g.select(url.alias("url"), body.alias("body"), TB.now_lit().alias("fetched_at"),
                    F.col("blk").alias("key"), F.concat(F.lit("rss-"), F.col("source")).alias("source_id"))


def text_bodies(spark, sf_dir) -> DataFrame:
    d = TB.read(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("text://"), F.col("doc_id").cast("string")).alias("url"),
                    F.col("text").alias("body"), TB.now_lit().alias("fetched_at"),
                    F.col("doc_id").alias("key"), F.lit("text-local").alias("source_id"))


def update_feed(spark, sf_dir, orders: DataFrame | None = None) -> DataFrame:
    """Scheduled updates from ``orders``: source = priority, updated_at = order date,
    sequence = order key; keys 0..4 mod 50 carry blank content (empty, spaces, tab,
    newline, NBSP)."""
    o = orders if orders is not None else TB.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 50
    text = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of customer "),
                    F.col("o_custkey").cast("string"), F.lit(" is "), F.col("o_orderstatus"))
    content = (F.when(k == 0, F.lit("")).when(k == 1, F.lit("   ")).when(k == 2, F.lit("\t"))
               .when(k == 3, F.lit("\n")).when(k == 4, F.lit("\u00a0")).otherwise(text))
    from kbspark.sources.updates import normalise
    return normalise(o.select(content.alias("content"), F.col("o_orderpriority").alias("source"),
                              F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("seq")),
                     extra=["seq"])


UPDATE_CONTENT_SQL = """CASE o_orderkey % 50 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN chr(9)
  WHEN 3 THEN chr(10) WHEN 4 THEN chr(160)
  ELSE 'Order ' || CAST(o_orderkey AS VARCHAR) || ' of customer ' || CAST(o_custkey AS VARCHAR) || ' is ' || o_orderstatus END"""


# ---------------------------------------------------------------------------
# Source registry fixture and landed bodies per registered source
# ---------------------------------------------------------------------------

# Fixed cycle of declared source types (the reference's constants, in order).
TYPE_CYCLE = ("api", "link", "pdf", "youtube", "rss", "text")
UNKNOWN_TYPE_AT, UNKNOWN_TYPE = 7, "ftp"
NULL_ACTIVE_AT = 5
SCHEDULE = "*/15 * * * *"


def source_requests(spark, sf_dir) -> DataFrame:
    """One registration request per distinct ``documents.source`` (index i in name order):
    type cycles through TYPE_CYCLE (one unknown type), active unless i % 4 = 0 (one NULL)."""
    from kbspark.functions.ids import dense_index
    d = TB.read(spark, sf_dir, "documents").select("source").distinct()
    s = dense_index(d, ["source"], out="i")
    typ = F.when(F.col("i") == UNKNOWN_TYPE_AT, F.lit(UNKNOWN_TYPE)).otherwise(
        F.element_at(F.array(*[F.lit(t) for t in TYPE_CYCLE]), (F.col("i") % len(TYPE_CYCLE) + 1).cast("int")))
    active = F.when(F.col("i") == NULL_ACTIVE_AT, F.lit(None).cast("boolean")).otherwise(F.col("i") % 4 != 0)
    return s.select("i", "source", typ.alias("type"),
                    F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/feed")).alias("url"),
                    F.lit(SCHEDULE).alias("schedule"), active.alias("active"))


def registry(spark, sf_dir, requests: DataFrame | None = None) -> DataFrame:
    """The registry as registered on BASE_TIME (W3), with the request index kept as ``i``."""
    from kbspark.functions.ids import source_id
    from kbspark.operators.registry import register_sources
    req = requests if requests is not None else source_requests(spark, sf_dir)
    reg = register_sources(req, now=TB.base_time_lit(), ordinal="i")
    return reg.join(req.select("i", source_id(F.col("type"), TB.base_time_lit(), F.col("i")).alias("id")), "id")


def body_assigner(reg: DataFrame):
    """``assign(bodies, t)``: landed bodies of natural type index t, attached to their source."""
    from kbspark.operators.registry import maybe_broadcast
    n_types = len(TYPE_CYCLE)
    counts = {r["t"]: r["n"] for r in reg.groupBy((F.col("i") % n_types).alias("t"))
              .agg(F.count(F.lit(1)).alias("n")).collect()}          # <= 6 rows
    idx = maybe_broadcast(reg.select("i", F.col("id").alias("source_id")))
    cols = ["source_id", "url", "body", "fetched_at", "page_no"]

    def assign(bodies: DataFrame, t: int) -> DataFrame:
        n = counts.get(t, 0)
        if "page_no" not in bodies.columns:
            bodies = bodies.withColumn("page_no", F.lit(None).cast("long"))
        b = bodies.drop("source_id").withColumn("i", F.pmod(F.col("key"), F.lit(max(n, 1))) * n_types + t)
        return b.join(idx, "i").select(*cols)
    return assign


def landed_for_registry(spark, sf_dir, reg: DataFrame) -> DataFrame:
    """Landed bodies of every table, spread over the sources of the matching natural type:
    a row with key k goes to source i = (k mod n_t) * 6 + t."""
    pages, single = landed_parts(spark, sf_dir, reg)
    return single.unionByName(pages)


def landed_parts(spark, sf_dir, reg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``landed_for_registry`` as (pages of documents, bodies that each stand for themselves)."""
    assign = body_assigner(reg)
    single = [assign(api_bodies(spark, sf_dir), 0), assign(page_bodies(spark, sf_dir), 1),
              assign(video_bodies(spark, sf_dir), 3), assign(feed_bodies(spark, sf_dir), 4), assign(text_bodies(spark, sf_dir), 5)]
    return assign(pdf_pages(spark, sf_dir), 2), reduce(DataFrame.unionByName, single)


#: Input bytes whose bodies one landed file holds (bodies take up to about twice as much).
LANDED_BYTES = 32 << 20
#: Bodies in one landed file of ``single`` ones.
LANDED_ROWS = 200_000
#: Landed files and bytes that a micro-batch takes at most.
BATCH_FILES, BATCH_BYTES = 32, 512 << 20


def land(spark, sf_dir, landed: DataFrame, path: str, batches: int, least: int, single: DataFrame | None = None) -> DataFrame:
    """The bodies landed in files, ``least`` or as many as the tables' sizes ask for, as a stream of ``batches``
    micro-batches, or more if these would hold too much at once. The rows of one url of ``landed`` (the pages of a document) land in one file;
    ``single`` bodies land where they are read, without a shuffle."""
    tables = ("conversations",) if single is not None else ("events", "pages", "conversations", "documents")
    size = sum(estimated_bytes(TB.read(spark, sf_dir, t)) * (2 if t in ("conversations", "documents") else 1) for t in tables)
    with shuffles_deleted(landed.sparkSession):
        landed.repartition(max(least, math.ceil(size / LANDED_BYTES)), "source_id", "url").write.option("compression", "zstd").parquet(path)
        if single is not None:
            single.select(*landed.columns).write.mode("append").option("compression", "zstd").option("maxRecordsPerFile", LANDED_ROWS).parquet(path)
    files = len(spark.read.schema(landed.schema).parquet(path).inputFiles())
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    a_batch = min(math.ceil(files / batches), BATCH_FILES, math.ceil(files * BATCH_BYTES / max(1, held)))
    return spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", max(1, a_batch)).parquet(path)
