"""Registered queries of the registry and source-ingestion operators
(S2, F3, W3, W4, S9, J3, U1, P2, A6)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kbspark.plans import landing as L
from kbspark.plans import oracle_sql as O
from kbspark.plans import tables as TB
from kbspark.plans.catalog import n_dims
from kbspark.plans.catalog import DIM, _embedder, fmt_ts, register  # noqa: F401
from kbspark.plans.ingest import ingest_report, ingest_sources
from kbspark.operators.registry import active_sources

NOW_TXT = "'2024-01-31 00:00:00'"
BASE_TXT = "'2024-01-01 00:00:00'"
_TYPES = ", ".join(f"'{t}'" for t in L.TYPE_CYCLE)
_DISPATCHABLE = "'api', 'link', 'pdf', 'youtube', 'rss'"
_TOKENS = "[^\\t\\n\\x0B\\f\\r ]"


def _decode(x: str) -> str:
    return O.decode_entities(x)


_ARTICLE = _decode("regexp_replace(regexp_extract(p.html, '<article[^>]*>(.*?)</article>', 1, 's'), "
                   "'<[^>]*>', '', 'g')")
_TITLE = _decode("regexp_extract(p.html, '<title>(.*?)</title>', 1, 's')")

# SQL twin of the registry fixture and of the landed-body assignment.
_REG = f"""
src AS (SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS BIGINT) AS i
        FROM (SELECT DISTINCT source FROM documents)),
reg AS (SELECT i, source,
               CASE WHEN i = {L.UNKNOWN_TYPE_AT} THEN '{L.UNKNOWN_TYPE}' ELSE [{_TYPES}][i % 6 + 1] END AS type,
               CASE WHEN i = {L.NULL_ACTIVE_AT} THEN NULL ELSE i % 4 <> 0 END AS active,
               'https://' || source || '.example.com/feed' AS url
        FROM src),
reg2 AS (SELECT *, type || '-' || CAST(epoch_us(TIMESTAMP {BASE_TXT}) * 1000 + i AS VARCHAR) AS id FROM reg),
ns AS (SELECT i % 6 AS ti, count(*) AS n FROM reg2 GROUP BY 1)"""

_DISPATCH = _REG + f""",
ev AS (SELECT *, '{L.API_URL}' || CAST(event_id AS VARCHAR) AS u FROM events),
c_api AS (SELECT r.id AS source_id, e.u AS url, 'API Data from ' || e.u AS title,
                 'map[' || array_to_string(list_transform(list_sort(json_keys(e.props)),
                     lambda k: k || ':' || json_extract_string(e.props, '$."' || k || '"')), ' ') || ']' AS text
          FROM ev e JOIN ns ON ns.ti = 0 JOIN reg2 r ON r.i = (e.event_id % ns.n) * 6
          WHERE r.active AND r.type = 'api' AND e.event_type <> 'error'),
j_api AS (SELECT r.id AS source_id, e.u AS url, 'JSON body is not an object' AS reason
          FROM ev e JOIN ns ON ns.ti = 0 JOIN reg2 r ON r.i = (e.event_id % ns.n) * 6
          WHERE r.active AND r.type = 'api' AND e.event_type = 'error'),
c_link AS (SELECT r.id AS source_id, p.url, {_TITLE} AS title, {_ARTICLE} AS text
           FROM pages p JOIN ns ON ns.ti = 1 JOIN reg2 r ON r.i = (p.page_id % ns.n) * 6 + 1
           WHERE r.active AND r.type = 'link'),
c_pdf AS (SELECT r.id AS source_id, 'docs/conv-' || CAST(c.conv_id AS VARCHAR) || '.pdf' AS url,
                 'docs/conv-' || CAST(c.conv_id AS VARCHAR) || '.pdf' AS title,
                 coalesce(string_agg(CASE WHEN c.turn % 5 = 4 OR c.conv_id % 50 = 7 THEN NULL ELSE c.text END, ''
                                     ORDER BY c.turn), '') AS text
          FROM conversations c JOIN ns ON ns.ti = 2 JOIN reg2 r ON r.i = (c.conv_id % ns.n) * 6 + 2
          WHERE r.active AND r.type = 'pdf' GROUP BY r.id, c.conv_id),
c_vid AS (SELECT r.id AS source_id,
                 'https://youtube.com/watch?v=v' || CAST(c.conv_id AS VARCHAR) || 't' || CAST(c.turn AS VARCHAR) AS url,
                 c.role || ' ' || CAST(c.conv_id AS VARCHAR) AS title, c.text
          FROM conversations c JOIN ns ON ns.ti = 3 JOIN reg2 r ON r.i = (c.conv_id % ns.n) * 6 + 3
          WHERE r.active AND r.type = 'youtube' AND c.turn % 7 <> 6),
j_vid AS (SELECT r.id AS source_id, 'v' || CAST(c.conv_id AS VARCHAR) || 't' || CAST(c.turn AS VARCHAR) AS url,
                 'video not found' AS reason
          FROM conversations c JOIN ns ON ns.ti = 3 JOIN reg2 r ON r.i = (c.conv_id % ns.n) * 6 + 3
          WHERE r.active AND r.type = 'youtube' AND c.turn % 7 = 6),
c_rss AS (SELECT r.id AS source_id,
                 'https://' || d.source || '.example.com/doc/' || CAST(d.doc_id AS VARCHAR) AS url,
                 'doc ' || CAST(d.doc_id AS VARCHAR) AS title,
                 CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE d.text END AS text
          FROM documents d JOIN ns ON ns.ti = 4 JOIN reg2 r ON r.i = ((d.doc_id // {L.FEED_BLOCK}) % ns.n) * 6 + 4
          WHERE r.active AND r.type = 'rss'),
j_unknown AS (SELECT id AS source_id, CAST(NULL AS VARCHAR) AS url, 'unknown source type: ' || type AS reason
              FROM reg2 WHERE active AND type NOT IN ({_DISPATCHABLE})),
content AS (SELECT * FROM c_api UNION ALL SELECT * FROM c_link UNION ALL SELECT * FROM c_pdf
            UNION ALL SELECT * FROM c_vid UNION ALL SELECT * FROM c_rss),
rejects AS (SELECT * FROM j_api UNION ALL SELECT * FROM j_vid UNION ALL SELECT * FROM j_unknown)"""


def _run(spark, sf_dir):
    reg = L.registry(spark, sf_dir)
    landed = L.landed_for_registry(spark, sf_dir, reg)
    return reg, ingest_sources(reg, landed, embedder=_embedder(), now=TB.now_lit())


@register("register_sources", f"""
WITH {_REG}
SELECT id, type, url, '{L.SCHEDULE}' AS schedule, active, {BASE_TXT} AS created_at,
       CAST(NULL AS VARCHAR) AS last_updated
FROM reg2
""")
def q_register_sources(spark, sf_dir):
    """W3 + X5: register one source per distinct documents.source; ids <type>-<unix nanos>."""
    reg = L.registry(spark, sf_dir)
    return reg.select("id", "type", "url", "schedule", "active", fmt_ts("created_at").alias("created_at"),
                      fmt_ts("last_updated").alias("last_updated"))


@register("active_sources", f"""
WITH {_REG}
SELECT id, type, url FROM reg2 WHERE active
""")
def q_active_sources(spark, sf_dir):
    """S2 + F3: SELECT * FROM knowledge_sources WHERE active = true (NULL is not active)."""
    return active_sources(L.registry(spark, sf_dir)).select("id", "type", "url")


@register("dispatch_sources", f"""
WITH {_DISPATCH}
SELECT source_id, 'content' AS kind, url, title, md5(text) AS text_md5, CAST(NULL AS VARCHAR) AS reason
FROM content
UNION ALL
SELECT source_id, 'reject' AS kind, url, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS text_md5, reason
FROM rejects
UNION ALL
SELECT id || '-untyped', 'reject', NULL, NULL, NULL, 'unknown source type: ' FROM reg2 WHERE active
""")
def q_dispatch_sources(spark, sf_dir):
    """S9 + J3 + U1: landed bodies of active sources routed by type; failures and unknown types rejected.
    Every source also has a twin without a type."""
    from kbspark.operators.registry import dispatch
    reg = L.registry(spark, sf_dir)
    untyped = reg.withColumn("id", F.concat("id", F.lit("-untyped"))).withColumn("type", F.lit(None).cast("string"))
    content, rejects, _ok = dispatch(reg.unionByName(untyped), L.landed_for_registry(spark, sf_dir, reg), TB.now_lit())
    c = content.select("source_id", F.lit("content").alias("kind"), "url", "title",
                       F.md5("text").alias("text_md5"), F.lit(None).cast("string").alias("reason"))
    r = rejects.select("source_id", F.lit("reject").alias("kind"), "url", F.lit(None).cast("string").alias("title"),
                       F.lit(None).cast("string").alias("text_md5"), "reason")
    return c.unionByName(r)


@register("touch_sources", f"""
WITH {_DISPATCH}
SELECT r.id, r.type, r.active,
       CASE WHEN f.source_id IS NOT NULL THEN {NOW_TXT} END AS last_updated
FROM reg2 r LEFT JOIN (SELECT DISTINCT source_id FROM content) f ON f.source_id = r.id
""")
def q_touch_sources(spark, sf_dir):
    """last_updated = now for sources with a successful fetch; others untouched."""
    _reg, run = _run(spark, sf_dir)
    return run.registry.select("id", "type", "active", fmt_ts("last_updated").alias("last_updated"))


# Ids are only required to be unique and to name their source; which item gets which is free.
INGESTED = f"""
SELECT source_id, md5(text) AS content_md5,
       CAST(CASE WHEN regexp_matches(text, '{_TOKENS}') THEN {DIM} END AS BIGINT) AS n_dims,
       {NOW_TXT} AS created_at, true AS own_id, CAST(1 AS BIGINT) AS id_rows
FROM content
"""


def ingested(kb):
    """The knowledge-base rows of an ingestion run, with checks of their ids."""
    source = F.regexp_extract("doc_id", "^(.*)-\\d+$", 1)
    nanos = F.regexp_extract("doc_id", "-(\\d+)$", 1).cast("long")
    per_id = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return kb.select(source.alias("source_id"), F.md5("content").alias("content_md5"), n_dims("embedding").alias("n_dims"),
                     fmt_ts("created_at").alias("created_at"), (nanos >= F.unix_micros(TB.now_lit()) * 1000).alias("own_id"),
                     per_id.alias("id_rows"))


@register("source_ingestion", f"WITH {_DISPATCH} {INGESTED}")
def q_source_ingestion(spark, sf_dir):
    """P2 + U1: all active sources ingested into the knowledge base in one run."""
    _reg, run = _run(spark, sf_dir)
    return ingested(run.kb)


@register("source_constraints", f"""
WITH {_REG},
bad AS (SELECT CASE WHEN i % 11 = 4 THEN NULL ELSE id END AS id, CASE WHEN i % 3 = 0 THEN NULL ELSE type END AS type,
               CASE WHEN i % 5 = 0 THEN NULL ELSE url END AS url, CASE WHEN i % 7 = 0 THEN NULL ELSE '{L.SCHEDULE}' END AS schedule
        FROM reg2 UNION ALL SELECT id, type, url, '{L.SCHEDULE}' FROM reg2 WHERE i % 4 = 1),
per_key AS (SELECT id, count(*) AS c FROM bad GROUP BY id)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE id IS NULL) AS null_id, count(*) FILTER (WHERE type IS NULL) AS null_type,
       count(*) FILTER (WHERE url IS NULL) AS null_url, count(*) FILTER (WHERE schedule IS NULL) AS null_schedule,
       (SELECT count(*) FROM per_key WHERE id IS NOT NULL AND c > 1) AS dup_ids,
       (SELECT coalesce(sum(c), 0) FROM per_key WHERE id IS NOT NULL AND c > 1)::BIGINT AS dup_rows
FROM bad
""")
def q_source_constraints(spark, sf_dir):
    """K1 for the source registry, with injected violations."""
    from kbspark.operators.store import source_constraints
    reg = L.registry(spark, sf_dir)

    def unless(cond, c):
        return F.when(cond, F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
    i = F.col("i")
    bad = reg.select(unless(i % 11 == 4, "id"), unless(i % 3 == 0, "type"), unless(i % 5 == 0, "url"), unless(i % 7 == 0, "schedule"))
    return source_constraints(bad.unionByName(reg.filter(i % 4 == 1).select("id", "type", "url", "schedule")))


# Items that fail: embeddings of texts with the marker, and inserts whose id is too long (ids of
# video sources are prolonged).
FAIL_MARK, LONG_TYPE = "k:1", "youtube"
REPORT = f"""
WITH {_DISPATCH},
it AS (SELECT c.source_id, r.type = '{LONG_TYPE}' AS too_long, regexp_matches(c.text, '{_TOKENS}') AS has_text,
              contains(c.text, '{FAIL_MARK}') AS fails FROM content c JOIN reg2 r ON r.id = c.source_id),
ci AS (SELECT source_id, count(*) AS n_items, count(*) FILTER (WHERE NOT has_text OR fails) AS n_no_embedding,
              count(*) FILTER (WHERE has_text AND fails AND NOT too_long) AS n_failed_embed,
              count(*) FILTER (WHERE too_long) AS n_failed_insert
       FROM it GROUP BY source_id),
rj AS (SELECT source_id, count(*) AS n_rejected FROM rejects GROUP BY source_id)
SELECT r.id || CASE WHEN r.type = '{LONG_TYPE}' THEN repeat('x', 256) ELSE '' END AS source_id, r.type, ci.source_id IS NOT NULL AS fetched,
       coalesce(ci.n_items, 0) AS n_items, coalesce(ci.n_items - ci.n_failed_embed - ci.n_failed_insert, 0) AS n_added,
       coalesce(ci.n_no_embedding, 0) AS n_no_embedding, coalesce(ci.n_failed_embed, 0) AS n_failed_embed,
       coalesce(ci.n_failed_insert, 0) AS n_failed_insert, coalesce(rj.n_rejected, 0) AS n_rejected
FROM reg2 r LEFT JOIN ci ON ci.source_id = r.id LEFT JOIN rj ON rj.source_id = r.id
WHERE r.active
"""


def failing_run(spark, sf_dir):
    """(registry, embedder) of a run in which items fail."""
    from kbspark.plans.q_ingest import _FailingEmbedder
    reg = L.registry(spark, sf_dir)
    longer = F.when(F.col("type") == LONG_TYPE, F.concat("id", F.repeat(F.lit("x"), 256))).otherwise(F.col("id"))
    reg = reg.withColumn("id", longer)
    return reg, _FailingEmbedder(_embedder(), FAIL_MARK)


@register("ingest_report", REPORT)
def q_ingest_report(spark, sf_dir):
    """Per-source accounting of one ingestion run, with failing embeddings and inserts."""
    reg, embedder = failing_run(spark, sf_dir)
    return ingest_report(ingest_sources(reg, L.landed_for_registry(spark, sf_dir, reg), embedder=embedder, now=TB.now_lit()), reg)
