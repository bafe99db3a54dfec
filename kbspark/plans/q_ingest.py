"""Registered queries of the ingest operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions.ids import content_doc_id, dense_index, update_doc_id
from kbspark.functions.sql import register_sql
from kbspark.plans import landing as L
from kbspark.plans import oracle_sql as O
from kbspark.plans import tables as TB
from kbspark.plans.catalog import _embedder, fmt_ts, register
from kbspark.plans.ingest import ingest_updates, prepare_updates, update_report
from kbspark.sources.api import parse_api
from kbspark.sources.feed import parse_feeds
from kbspark.sources.pages import stitch_pages
from kbspark.sources.video import parse_videos
from kbspark.sources.web import parse_pages

_TS = "'%Y-%m-%d %H:%M:%S'"
NOW_TXT = "'2024-01-31 00:00:00'"


def _decode(x: str) -> str:
    return O.decode_entities(x)


@register("ingest_web", f"""
SELECT url, {_decode("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title,
       md5({_decode("regexp_replace(regexp_extract(html, '<article[^>]*>(.*?)</article>', 1, 's'), '<[^>]*>', '', 'g')")}) AS text_md5,
       length({_decode("regexp_replace(regexp_extract(html, '<article[^>]*>(.*?)</article>', 1, 's'), '<[^>]*>', '', 'g')")}) AS text_len,
       url AS source, {NOW_TXT} AS published_at
FROM pages
""")
def q_ingest_web(spark, sf_dir):
    """S4 + X13: selector text and title of every landed page."""
    c = parse_pages(L.page_bodies(spark, sf_dir), now=TB.now_lit())
    return c.select("url", "title", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("text_len"),
                    "source", fmt_ts("published_at").alias("published_at"))


@register("ingest_api", f"""
SELECT '{L.API_URL}' || CAST(event_id AS VARCHAR) AS url,
       'API Data from ' || '{L.API_URL}' || CAST(event_id AS VARCHAR) AS title,
       'map[' || array_to_string(list_transform(list_sort(json_keys(props)),
            lambda k: k || ':' || json_extract_string(props, '$."' || k || '"')), ' ') || ']' AS text,
       '{L.API_URL}' || CAST(event_id AS VARCHAR) AS source, {NOW_TXT} AS published_at
FROM events WHERE event_type <> 'error'
UNION ALL
SELECT u, 'API Data from ' || u, text, u, {NOW_TXT} FROM (
  SELECT '{L.API_URL}deep' || CAST(event_id AS VARCHAR) AS u, 'map[d:' || repeat('[', 1000) || repeat(']', 1000) || ']' AS text
  FROM events WHERE event_id % 500 = 0
  UNION ALL SELECT '{L.API_URL}lone' || CAST(event_id AS VARCHAR), 'map[s:x' || chr(65533) || 'y]' FROM events WHERE event_id % 500 = 0)
""")
def q_ingest_api(spark, sf_dir):
    """S3 + X6 + X7 + X12: JSON object bodies to Content; array bodies are rejected. Every 500th event
    also lands a body of 1,000 levels and one with half a surrogate pair."""
    bodies = L.api_bodies(spark, sf_dir)
    odd = bodies.filter(F.col("key") % 500 == 0).withColumn("kind", F.explode(F.array(F.lit("deep"), F.lit("lone"))))
    text = F.when(F.col("kind") == "deep", F.concat(F.lit('{"d":'), F.repeat(F.lit("["), 1000), F.repeat(F.lit("]"), 1000), F.lit("}"))) \
        .otherwise(F.lit('{"s":"x\\ud800y"}'))
    url = F.concat(F.lit(L.API_URL), "kind", F.col("key").cast("string"))
    c = parse_api(bodies.unionByName(odd.withColumn("url", url).withColumn("body", text).drop("kind")), now=TB.now_lit())
    return c.filter(F.col("error").isNull()).select("url", "title", "text", "source",
                                                     fmt_ts("published_at").alias("published_at"))


@register("ingest_feed", f"""
SELECT 'doc ' || CAST(doc_id AS VARCHAR) AS title,
       md5(CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END) AS text_md5,
       source,
       'https://' || source || '.example.com/doc/' || CAST(doc_id AS VARCHAR) AS url,
       strftime(CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP {NOW_TXT}
                     ELSE TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) END, {_TS}) AS published_at
FROM documents
""")
def q_ingest_feed(spark, sf_dir):
    """S7 + X10: RSS bodies (built from documents, XML-escaped) parsed back, one row per item."""
    c = parse_feeds(L.feed_bodies(spark, sf_dir), now=TB.now_lit()).filter(F.col("error").isNull())
    return c.select("title", F.md5("text").alias("text_md5"), "source", "url",
                    fmt_ts("published_at").alias("published_at"))


@register("stitch_pages", f"""
SELECT 'docs/conv-' || CAST(conv_id AS VARCHAR) || '.pdf' AS title,
       md5(coalesce(string_agg(CASE WHEN turn % 5 = 4 OR conv_id % 50 = 7 THEN NULL ELSE text END, ''
                               ORDER BY turn), '')) AS text_md5,
       length(coalesce(string_agg(CASE WHEN turn % 5 = 4 OR conv_id % 50 = 7 THEN NULL ELSE text END, ''
                               ORDER BY turn), '')) AS text_len,
       {NOW_TXT} AS published_at
FROM conversations GROUP BY conv_id
""")
def q_stitch_pages(spark, sf_dir):
    """S5 + A3 + T5: page texts joined in page order per document, NULL pages skipped."""
    p = L.pdf_pages(spark, sf_dir).select(F.col("url").alias("path"), "page_no", F.col("body").alias("text"))
    c = stitch_pages(p, now=TB.now_lit())
    return c.select("title", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("text_len"),
                    fmt_ts("published_at").alias("published_at"))


@register("ingest_video", f"""
SELECT role || ' ' || CAST(conv_id AS VARCHAR) AS title, md5(text) AS text_md5, 'youtube' AS source,
       'https://youtube.com/watch?v=v' || CAST(conv_id AS VARCHAR) || 't' || CAST(turn AS VARCHAR) AS url,
       {NOW_TXT} AS published_at
FROM conversations WHERE turn % 7 <> 6
""")
def q_ingest_video(spark, sf_dir):
    """First item of each video-list response; empty lists rejected."""
    c = parse_videos(L.video_bodies(spark, sf_dir), now=TB.now_lit()).filter(F.col("error").isNull())
    return c.select("title", F.md5("text").alias("text_md5"), "source", "url",
                    fmt_ts("published_at").alias("published_at"))


_WS = "[^\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_UPD = f"""
u AS (SELECT {L.UPDATE_CONTENT_SQL} AS content, o_orderpriority AS source, o_orderdate AS updated_at,
             o_orderkey AS seq FROM orders),
d AS (SELECT 'doc_' || source || '_' || CAST(floor(epoch(updated_at)) AS BIGINT) AS doc_id, content, seq
      FROM u WHERE regexp_matches(content, '{_WS}'))"""


@register("ingest_updates", f"""
WITH {_UPD}
SELECT doc_id, md5(arg_max(content, seq)) AS content_md5, {NOW_TXT} AS created_at, {NOW_TXT} AS updated_at
FROM d GROUP BY doc_id
""")
def q_ingest_updates(spark, sf_dir):
    """P3 + S8 + F4 + X9: scheduled updates, blanks skipped, embedded, upserted (last wins)."""
    kb = ingest_updates(L.update_feed(spark, sf_dir), embedder=_embedder(), now=TB.now_lit())
    return kb.select("doc_id", F.md5("content").alias("content_md5"), fmt_ts("created_at").alias("created_at"),
                     fmt_ts("updated_at").alias("updated_at"))


@register("update_doc_ids", """
SELECT o_orderkey, 'doc_' || o_orderpriority || '_' || CAST(floor(epoch(o_orderdate)) AS BIGINT) AS doc_id
FROM orders
""")
def q_update_doc_ids(spark, sf_dir):
    """doc_<source>_<unix seconds> (floored), collisions kept."""
    o = TB.read(spark, sf_dir, "orders")
    return o.select("o_orderkey", update_doc_id(F.col("o_orderpriority"), F.col("o_orderdate")).alias("doc_id"))


@register("content_doc_ids", """
WITH p AS (SELECT 'link-' || regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS source_id, url FROM pages)
SELECT url, source_id || '-' || CAST(epoch_us(TIMESTAMP '2024-01-31 00:00:00') * 1000
       + row_number() OVER (ORDER BY source_id, url) - 1 AS VARCHAR) AS doc_id
FROM p
""")
def q_content_doc_ids(spark, sf_dir):
    """<source id>-<unix nanos>, made unique per row by a distributed dense ordinal."""
    p = L.page_bodies(spark, sf_dir).select("source_id", "url")
    p = dense_index(p, ["source_id", "url"], out="ordinal")
    return p.select("url", content_doc_id(F.col("source_id"), TB.now_lit(), F.col("ordinal")).alias("doc_id"))


class _FailingEmbedder:
    """The default embedder, failing on the rows that a test feed marks."""

    def __init__(self, inner, marker: str):
        self.inner, self.marker = inner, marker

    def embed(self, text):
        return self.inner.embed(F.when(~F.contains(text, F.lit(self.marker)), text))


@register("update_report", f"""
WITH {_UPD},
r AS (SELECT CASE WHEN seq % 41 = 0 THEN source || repeat('x', 256) ELSE source END AS source, content, seq FROM u)
SELECT source, count(*) AS n_seen,
       count(*) FILTER (WHERE NOT regexp_matches(content, '{_WS}')) AS n_skipped_blank,
       count(*) FILTER (WHERE regexp_matches(content, '{_WS}') AND contains(content, ' is F')) AS n_failed_embed,
       count(*) FILTER (WHERE regexp_matches(content, '{_WS}') AND NOT contains(content, ' is F') AND length(source) > 255) AS n_failed_insert,
       count(*) FILTER (WHERE regexp_matches(content, '{_WS}') AND NOT contains(content, ' is F') AND length(source) <= 255) AS n_added
FROM r GROUP BY source
""")
def q_update_report(spark, sf_dir):
    """A6 on P3: the scheduled run's accounting, with failing embeddings and over-long ids injected."""
    u = L.update_feed(spark, sf_dir)
    long_id = F.concat("source", F.repeat(F.lit("x"), 256))
    u = u.withColumn("source", F.when(F.col("seq") % 41 == 0, long_id).otherwise(F.col("source")))
    return update_report(prepare_updates(u, _FailingEmbedder(_embedder(), " is F")))


@register("sql_functions", f"""
SELECT a.vec_id AS vec_id, {O.key_of("list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])")} AS sim_key,
       'doc_' || CAST(a.label AS VARCHAR) || '_' || CAST(a.vec_id AS VARCHAR) AS doc_id, a.label % 2 = 0 AS has_text,
       md5('Use the following information to answer the question:' || chr(10) || chr(10) || 'Context:' || chr(10) || 'a' || chr(10) || chr(10) || CAST(b.vec_id AS VARCHAR)
           || chr(10) || chr(10) || 'Question: 100%?' || chr(10) || chr(10) || 'Answer:') AS prompt_md5
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def q_sql_functions(spark, sf_dir):
    """X1, X2, X3, X8, X9 as functions of SQL text."""
    register_sql(spark)
    return spark.sql("""
        SELECT a.vec_id, sim_key(cosine_similarity(a.embedding, b.embedding)) AS sim_key,
               update_doc_id(CAST(a.label AS STRING), timestamp_seconds(a.vec_id)) AS doc_id,
               has_text(CASE WHEN a.label % 2 = 0 THEN 'x' ELSE '\u00a0 \t' END) AS has_text,
               md5(build_prompt(array('a', CAST(b.vec_id AS STRING)), '100%?')) AS prompt_md5
        FROM {e} a JOIN {e} b ON b.vec_id = a.vec_id + 1""", e=TB.read(spark, sf_dir, "embeddings"))


@register("sql_top_rows", f"""
WITH s AS (SELECT a.label, a.vec_id, {O.key_of("list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])")} AS sim_key
           FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT label, vec_id, sim_key, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim_key DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""")
def q_sql_top_rows(spark, sf_dir):
    """T2 / T3 as a table function of SQL text: the five best-scoring vectors of each label."""
    register_sql(spark)
    return spark.sql("""
        WITH s AS (SELECT a.label, a.vec_id, sim_key(cosine_similarity(a.embedding, b.embedding)) AS sim_key
                   FROM {e} a JOIN {e} b ON b.vec_id = a.vec_id + 1)
        SELECT label, vec_id, sim_key, rank FROM top_rows(TABLE(s) PARTITION BY label ORDER BY (sim_key DESC, vec_id), 5)""",
                     e=TB.read(spark, sf_dir, "embeddings"))


@register("sql_stitch_pages", """
SELECT 'docs/conv-' || CAST(conv_id AS VARCHAR) || '.pdf' AS path,
       md5(coalesce(string_agg(CASE WHEN turn % 5 = 4 OR conv_id % 50 = 7 THEN NULL ELSE text END, '' ORDER BY turn), '')) AS text_md5
FROM conversations GROUP BY conv_id
""")
def q_sql_stitch_pages(spark, sf_dir):
    """S5 as a table function of SQL text."""
    register_sql(spark)
    return spark.sql("""
        WITH p AS (SELECT url AS path, page_no, body AS text FROM {pages})
        SELECT path, md5(text) AS text_md5 FROM stitch_pages(TABLE(p) PARTITION BY path ORDER BY page_no)""", pages=L.pdf_pages(spark, sf_dir))
