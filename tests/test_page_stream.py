"""Documents whose pages arrive in several micro-batches."""

import datetime as dt
import time

from pyspark.sql import functions as F

from kbspark.operators.registry import register_sources
from kbspark.schema import SOURCE
from kbspark.sources.buckets import BucketStore
from kbspark.sources.snapshot import SnapshotStore
from kbspark.streaming.pages import assemble_pages
from kbspark.streaming.stream import run_stream, stream_sources

SCHEMA = "source_id string, url string, body string, page_no long, page_count long, fetched_at timestamp"
T = dt.datetime(2024, 1, 1)


def land(spark, root, batches):
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{root}/in/{b}")
        time.sleep(1.1)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")


def run(stream, root, **options):
    run_stream(assemble_pages(stream, **options), lambda b, i: b.write.mode("append").parquet(f"{root}/out"), f"{root}/c")


def test_pages_of_three_batches_give_one_document(spark, tmp_root):
    pages = [[("s", "d1", "a", 1, 3, T), ("s", "d2", "only", 1, 1, T), ("s", "web", "<p>", None, None, T)],
             [("s", "d1", "c", 3, 3, None), ("s", "d3", "x", 2, 2, T), ("t", "d1", "other source", 1, 1, T)],
             [("s", "d1", "b", 2, 3, dt.datetime(2024, 1, 3)), ("s", "d3", None, 1, 2, T), ("s", "d3", "y", 2, 2, T)]]
    stream = land(spark, tmp_root, pages)
    run(stream, tmp_root)
    out = sorted((r.source_id, r.url, r.body, r.page_no, r.fetched_at) for r in spark.read.parquet(f"{tmp_root}/out").fillna(0, ["page_no"]).collect())
    assert out == [("s", "d1", "abc", 1, dt.datetime(2024, 1, 3)), ("s", "d2", "only", 1, T), ("s", "d3", "y", 1, T),
                   ("s", "web", "<p>", 0, T), ("t", "d1", "other source", 1, T)]


def test_a_document_that_stays_incomplete_goes_by_the_timer(spark, tmp_root):
    stream = land(spark, tmp_root, [[("s", "d1", "a", 1, None, T), ("s", "d2", "p", 1, 2, T)], [("s", "other", "z", 1, 1, T)]])
    run(stream, tmp_root, timeout=1)
    spark.createDataFrame([("s", "late", "l", 1, 1, T)], SCHEMA).coalesce(1).write.parquet(f"{tmp_root}/in/9")
    run(stream, tmp_root, timeout=1)
    out = sorted((r.url, r.body) for r in spark.read.parquet(f"{tmp_root}/out").collect())
    assert out == [("d1", "a"), ("d2", "p"), ("late", "l"), ("other", "z")]


def test_assembled_documents_reach_the_knowledge_base_once(spark, tmp_root):
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    reg = register_sources(spark.createDataFrame([("pdf", "u", "x"), ("link", "v", "x")], "type string, url string, schedule string"), now=now).cache()
    ids = {r.type: r.id for r in reg.collect()}
    stream = land(spark, tmp_root, [[(ids["pdf"], "d", "one ", 1, 2, T), (ids["link"], "w", "<article>web</article>", None, None, T)],
                                    [(ids["pdf"], "d", "two", 2, 2, T)]])
    kb = BucketStore(spark, f"{tmp_root}/kb", n_buckets=2)
    stream_sources(spark, assemble_pages(stream), reg, kb, SnapshotStore(spark, f"{tmp_root}/reg", schema=SOURCE, partition_by=None), f"{tmp_root}/c", now=now)
    assert sorted(r.content for r in kb.read().collect()) == ["one two", "web"]
