"""What a run leaves on disk, and how often it writes a row, stays bounded."""

import datetime as dt
import glob
import os
from threading import Thread

import pytest
from pyspark.sql import functions as F

import kbspark.plans.landing as L
import kbspark.sources.buckets as B
from kbspark.functions.ids import dense_index, unique_index
from kbspark.operators import store as ST
from kbspark.operators.registry import register_sources
from kbspark.schema import KB, SOURCE
from kbspark.session import ensure_checkpoint_dir, scratch_dir, scratch_scope, shuffles_deleted, stored
from kbspark.sources.buckets import BucketStore
from kbspark.sources.snapshot import SnapshotStore
from kbspark.streaming.stream import read_accounting, run_stream, stream_sources, stream_updates

BATCH = "doc_id string, content string, embedding array<float>, seq long"
BODIES = "source_id string, url string, body string, fetched_at timestamp, page_no long"


def now():
    return F.to_timestamp(F.lit("2024-01-31 00:00:00"))


def folders(spark):
    return set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file://")))


def rows(df):
    return sorted((r.doc_id, r.content, r.created_at, r.updated_at) for r in df.collect())


def test_a_batch_of_new_keys_is_added_and_nothing_is_written_again(spark, tmp_root, monkeypatch):
    monkeypatch.setattr(B, "MOST_FOLDERS", 3)
    st, want = BucketStore(spark, tmp_root, n_buckets=2), spark.createDataFrame([], KB)

    def upsert(keys, content):
        batch = spark.createDataFrame([(k, content, None, i) for i, k in enumerate(keys)], BATCH)
        before = st.state().parts
        st.upsert(batch, now=now(), batch_id=content)
        return before, st.state().parts, batch
    for n in range(3):
        before, after, batch = upsert([f"{n}-{i}" for i in range(20)], f"batch {n}")
        want = ST.upsert_documents(want, batch, now=now())
        assert rows(st.read()) == rows(want)
        assert all(len(d) == n + 1 and d[:n] == before.get(p, ()) for p, d in after.items()) and len(after) == 2
    # Ids go on in order of arrival; a known key, or one folder too many, writes its buckets anew.
    assert [r.doc_id for r in st.read().orderBy("id").collect()] == [f"{n}-{i}" for n in range(3) for i in range(20)]
    _, after, batch = upsert([f"more-{i}" for i in range(20)], "more")
    want = ST.upsert_documents(want, batch, now=now())
    assert rows(st.read()) == rows(want) and {len(d) for d in after.values()} == {1}
    upsert([f"late-{i}" for i in range(20)], "late")
    _, after, batch = upsert([f"0-{i}" for i in range(20)], "again")
    assert {len(d) for d in after.values()} == {1} and st.read().count() == 100
    assert st.read().select("id").distinct().count() == 100 and st.read().filter("content = 'again'").count() == 20
    # Retention takes all folders of a day.
    assert st.retain(F.to_timestamp(F.lit("2024-03-31 00:00:00")), 30) == 100 and st.read().count() == 0


def test_a_micro_batch_leaves_only_what_it_commits(spark, tmp_root):
    reg = register_sources(spark.createDataFrame([("link", "u", "x"), ("pdf", "u", "x")], "type string, url string, schedule string"), now=now()).cache()
    ids = {r.type: r.id for r in reg.collect()}
    bodies = [(ids["link"], f"p{i}", f"<article>text {i}</article>", None, None) for i in range(9)]
    bodies += [(ids["pdf"], "d", f"page {i}", None, i) for i in range(3)]
    spark.createDataFrame(bodies[:6], BODIES).coalesce(1).write.parquet(f"{tmp_root}/in/0")
    spark.createDataFrame(bodies[6:], BODIES).coalesce(1).write.parquet(f"{tmp_root}/in/1")
    stream = spark.readStream.schema(BODIES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_root}/in/*")
    kb = BucketStore(spark, f"{tmp_root}/kb", n_buckets=2)
    before, cached = folders(spark), spark.sparkContext._jsc.getPersistentRDDs().size()
    stream_sources(spark, stream, reg, kb, SnapshotStore(spark, f"{tmp_root}/reg", schema=SOURCE, partition_by=None), f"{tmp_root}/c",
                   now=now(), accounting=f"{tmp_root}/acc")
    assert folders(spark) == before and spark.sparkContext._jsc.getPersistentRDDs().size() == cached
    assert kb.read().count() == 10 and len(kb.versions()) == 2
    assert kb.read().filter("content = 'page 0page 1page 2'").count() == 1
    feed = "content string, source string, updated_at timestamp, seq long"
    spark.createDataFrame([("one", "a", dt.datetime(2024, 1, 1), 1)], feed).coalesce(1).write.parquet(f"{tmp_root}/feed")
    stream_updates(spark, spark.readStream.schema(feed).parquet(f"{tmp_root}/feed"), kb, f"{tmp_root}/cu", now=now())
    assert folders(spark) == before and kb.read().count() == 11


def test_single_bodies_land_without_a_shuffle_in_bounded_batches(spark, tmp_root, monkeypatch):
    spark.createDataFrame([(i, "x") for i in range(20)], "key long, text string").write.parquet(f"{tmp_root}/conversations.parquet")
    monkeypatch.setattr(L, "LANDED_ROWS", 10)
    monkeypatch.setattr(L, "BATCH_FILES", 4)
    pages = spark.createDataFrame([("pdf", f"d{i % 5}", f"page {i}", None, None if i % 3 else i) for i in range(40)], BODIES).repartition(6)
    single = spark.createDataFrame([("link", f"u{i}", "body", None, None) for i in range(95)], BODIES).coalesce(2)
    s = L.land(spark, tmp_root, pages, f"{tmp_root}/landed", batches=2, least=3, single=single)
    assert 11 <= len(glob.glob(f"{tmp_root}/landed/*.parquet")) <= 14
    done = []
    run_stream(s, lambda b, i: done.append([(r.source_id, r.url, r.body, r.page_no) for r in b.collect()]), f"{tmp_root}/checkpoint")
    want = [(r.source_id, r.url, r.body, r.page_no) for r in pages.unionByName(single).collect()]
    assert sorted(map(str, sum(done, []))) == sorted(map(str, want))
    assert len(done) > 2 and max(map(len, done)) <= 4 * 40
    for i in range(5):                              # the pages of a document, also those without a number, come together
        assert sum(any(r[1] == f"d{i}" for r in b) for b in done) == 1


def test_scratch_of_a_scope_is_deleted_and_shuffles_with_their_query(spark):
    before = folders(spark)
    with scratch_scope(spark):
        a = unique_index(spark.range(50).repartition(3), out="i")
        assert sorted(r.i for r in a.collect()) == list(range(50)) and len(folders(spark)) == len(before) + 1
    assert folders(spark) == before
    kept = scratch_dir(spark, "kept")
    spark.range(3).write.parquet(kept)
    assert os.path.isdir(kept)
    with pytest.raises(ZeroDivisionError), scratch_scope(spark):
        spark.range(3).write.parquet(scratch_dir(spark))
        raise ZeroDivisionError
    assert folders(spark) - before == {os.path.basename(kept)}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    with shuffles_deleted(spark), shuffles_deleted(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == was
    files = lambda: sum(len(f) for _, _, f in os.walk(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()))
    n = files()
    kept = stored(spark.range(1000).repartition(5, "id"), scratch_dir(spark))
    assert files() <= n and kept.count() == 1000
    # A column without a type cannot be stored; it is numbered all the same.
    void = dense_index(spark.sql("select id, null as nothing from range(9)"), ["id"], out="i")
    assert [r.i for r in void.orderBy("id").collect()] == list(range(9))


def test_two_streams_into_one_store_leave_only_the_store(spark, tmp_root):
    reg = register_sources(spark.createDataFrame([("link", "u", "x")], "type string, url string, schedule string"), now=now()).cache()
    link = reg.first().id
    spark.createDataFrame([(link, f"p{i}", f"<article>text {i}</article>", None, None) for i in range(9)], BODIES).coalesce(1).write.parquet(f"{tmp_root}/in")
    feed = "content string, source string, updated_at timestamp, seq long"
    spark.createDataFrame([(f"order {i}", "a", dt.datetime(2024, 1, 1 + i), i) for i in range(5)], feed).coalesce(1).write.parquet(f"{tmp_root}/feed")
    before, failed = folders(spark), []

    def run(work):
        try:
            work()
        except Exception as e:  # noqa: BLE001
            failed.append(e)
    bodies, updates = spark.readStream.schema(BODIES).parquet(f"{tmp_root}/in"), spark.readStream.schema(feed).parquet(f"{tmp_root}/feed")
    work = [lambda: stream_sources(spark, bodies, reg, BucketStore(spark, f"{tmp_root}/kb", n_buckets=2), SnapshotStore(spark, f"{tmp_root}/reg", schema=SOURCE, partition_by=None),
                                   f"{tmp_root}/c", now=now()),
            lambda: stream_updates(spark, updates, BucketStore(spark, f"{tmp_root}/kb", n_buckets=2), f"{tmp_root}/cu", now=now())]
    threads = [Thread(target=run, args=(w,)) for w in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    kb = BucketStore(spark, f"{tmp_root}/kb", n_buckets=2)
    assert not failed and folders(spark) == before
    assert kb.read().count() == kb.read().select("id").distinct().count() == 14 and len(kb.versions()) == 2
    # Both only added: each partition lies in a folder of either writer.
    assert {len(d) for d in kb.state().parts.values()} <= {1, 2} and {d for f in kb.state().parts.values() for d in f} == {e["data"] for e in kb.log.entries()}


def test_reports_of_bounded_micro_batches_add_up(spark, tmp_root, monkeypatch):
    reg = register_sources(spark.createDataFrame([("link", "u", "x"), ("pdf", "u", "x")], "type string, url string, schedule string"), now=now()).cache()
    ids = {r.type: r.id for r in reg.collect()}
    spark.createDataFrame([(1, "x")], "key long, text string").write.parquet(f"{tmp_root}/conversations.parquet")
    monkeypatch.setattr(L, "LANDED_ROWS", 5)
    monkeypatch.setattr(L, "BATCH_FILES", 2)
    pages = spark.createDataFrame([(ids["pdf"], f"d{i % 3}", f"page {i}", None, i) for i in range(12)], BODIES)
    single = spark.createDataFrame([(ids["link"], f"u{i}", None if i % 4 == 0 else f"<article>text {i}</article>", None, None) for i in range(20)], BODIES).coalesce(1)
    s = L.land(spark, tmp_root, pages, f"{tmp_root}/landed", batches=1, least=2, single=single)
    before = folders(spark)
    stream_sources(spark, s, reg, BucketStore(spark, f"{tmp_root}/kb", n_buckets=2), SnapshotStore(spark, f"{tmp_root}/reg", schema=SOURCE, partition_by=None),
                   f"{tmp_root}/c", now=now(), accounting=f"{tmp_root}/acc")
    reports = read_accounting(spark, f"{tmp_root}/acc")
    assert reports.select("batch").distinct().count() >= 3 and folders(spark) == before
    got = {r.type: (r.items, r.added, r.rejected, r.fetched) for r in reports.groupBy("type").agg(
        F.sum("n_items").alias("items"), F.sum("n_added").alias("added"), F.sum("n_rejected").alias("rejected"), F.max("fetched").alias("fetched")).collect()}
    assert got == {"link": (15, 15, 5, True), "pdf": (3, 3, 0, True)}
