"""Engine schemas (the fixed data model of the knowledge base)."""

from __future__ import annotations

from pyspark.sql import types as T

KB = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
])

SOURCE = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("schedule", T.StringType(), False),
    T.StructField("last_updated", T.TimestampType(), True),
    T.StructField("active", T.BooleanType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])

CONTENT = T.StructType([
    T.StructField("title", T.StringType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("published_at", T.TimestampType(), True),
])

UPDATE = T.StructType([
    T.StructField("content", T.StringType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
])

LANDED = T.StructType([
    T.StructField("source_id", T.StringType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("body", T.StringType(), True),
    T.StructField("fetched_at", T.TimestampType(), True),
])

PAGE_TEXT = T.StructType([
    T.StructField("path", T.StringType(), True),
    T.StructField("page_no", T.LongType(), True),
    T.StructField("text", T.StringType(), True),
])

CONTENT_COLUMNS = [f.name for f in CONTENT.fields]
KB_COLUMNS = [f.name for f in KB.fields]
SOURCE_COLUMNS = [f.name for f in SOURCE.fields]

# Fixed values of the reference's data model.
SOURCE_TYPES = ("api", "link", "pdf", "youtube", "rss", "text")
# Types the dispatcher can route; "text" is declared but has no processor.
DISPATCHABLE_TYPES = ("api", "link", "pdf", "youtube", "rss")
DEFAULT_DIM = 1536
DEFAULT_TOP_K = 10
DEFAULT_THRESHOLD = 0.5
DEFAULT_RETENTION_DAYS = 30
MAX_DOC_ID_CHARS = 255
