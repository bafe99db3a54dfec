"""Load the driver tables and derive the engine's inputs from them.

Every derivation is a Spark transformation of a whole given table, so work
grows with the table; nothing is sampled or capped.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.parallel import spread
from kbspark.session import ship_package

# Fixed reference time of the registered queries ("now"), so results can be checked.
NOW = _dt.datetime(2024, 1, 31, 0, 0, 0)
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
# Creation time of the base snapshot used by the upsert fixtures.
BASE_TIME = _dt.datetime(2024, 1, 1, 0, 0, 0)


def now_lit():
    return F.to_timestamp(F.lit(NOW.strftime("%Y-%m-%d %H:%M:%S")))


# Row key of each driver table, used to spread a small scan over the cores.
TABLE_KEYS = {"documents": "doc_id", "pages": "page_id", "events": "event_id", "orders": "o_orderkey",
              "conversations": "conv_id", "embeddings": "vec_id", "labels": "doc_id"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Unix-time ids and day arithmetic are defined in UTC (the reference stores timestamptz).
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Test parquet holds timestamp_ntz; the engine works in UTC timestamps.
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``read`` for inputs of CPU-heavy per-row stages (embedding, parsing): spread over
    the cores when the scan is too coarse (a no-op on large, many-split inputs)."""
    return spread(read(spark, sf_dir, name), TABLE_KEYS.get(name))


def vector_index(spark, sf_dir) -> DataFrame:
    """``embeddings`` as a vector index / knowledge base: doc_id = vec_id as text."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("vec_id").cast("string").alias("doc_id"),
                    F.concat(F.lit("label "), F.col("label").cast("string")).alias("content"),
                    F.col("embedding"))


def vector_queries(spark, sf_dir) -> DataFrame:
    """Every stored vector is also a query (all-vs-all nearest neighbours)."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding"))


def documents_kb_text(spark, sf_dir, for_embedding: bool = True) -> DataFrame:
    """``documents`` as knowledge-base rows before embedding."""
    d = read_spread(spark, sf_dir, "documents") if for_embedding else read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("doc_id"),
                    F.col("text").alias("content"))


def chat_queries(spark, sf_dir) -> DataFrame:
    """Every user turn of ``conversations`` is a chat query, named ``<conversation>-<turn>``."""
    c = read(spark, sf_dir, "conversations")
    return (c.filter(F.col("role") == "user")
            .select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
                    F.col("text").alias("query")))


def base_time_lit():
    return F.to_timestamp(F.lit(BASE_TIME.strftime("%Y-%m-%d %H:%M:%S")))


def documents_kb(spark, sf_dir, embedder) -> DataFrame:
    """``documents`` as a knowledge base: created on one of 30 days of January 2024."""
    d = documents_kb_text(spark, sf_dir)
    created = F.timestamp_add("DAY", F.pmod(F.col("id"), F.lit(30)), base_time_lit())
    return d.select("id", "doc_id", "content", embedder.embed(F.col("content")).alias("embedding"),
                    created.alias("created_at"), created.alias("updated_at"))


def events_kb(spark, sf_dir) -> DataFrame:
    """``events`` as a knowledge base whose rows were created at ``ts`` (retention input)."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("evt-"), F.col("event_id")).alias("doc_id"),
                    F.concat_ws(" ", "event_type", "props").alias("content"),
                    F.lit(None).cast("array<float>").alias("embedding"),
                    F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
