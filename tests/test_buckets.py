"""The stored table that rewrites only what a batch touches; several writers; accounting."""

import datetime as dt
import os
from threading import Thread

import pytest
from pyspark.sql import functions as F

from kbspark.operators import store as ST
from kbspark.schema import KB, SOURCE
from kbspark.sources.buckets import BucketStore
from kbspark.sources.log import VersionLog
from kbspark.sources.snapshot import CommitConflict, SnapshotStore
from kbspark.streaming.stream import read_accounting, stream_sources, stream_updates

BATCH = "doc_id string, content string, embedding array<float>, seq long"


def now():
    return F.to_timestamp(F.lit("2024-01-31 00:00:00"))


def base(spark, n, day=lambda i: dt.datetime(2024, 1, 1)):
    return spark.createDataFrame([(i, f"d{i}", f"old {i}", [float(i)], day(i), None) for i in range(1, n + 1)], KB)


def rows(df):
    return sorted((r.doc_id, r.content, r.embedding, r.created_at, r.updated_at) for r in df.collect())


def test_upsert_in_place_equals_the_batch_form(spark, tmp_root):
    b = base(spark, 400)
    st = BucketStore(spark, tmp_root, n_buckets=64)
    assert st.read().count() == 0 and st.replace(b)
    before = st.state()
    batch = spark.createDataFrame([("d7", "new", [1.0], 1), ("d7", "newer", [2.0], 2), ("x", "in", None, 3), (None, "bad", None, 4)], BATCH)
    assert st.upsert(batch, now=now(), batch_id="a")
    want = ST.upsert_documents(b, batch, now=now())
    assert rows(st.read()) == rows(want)
    ids = [r.id for r in st.read().select("id").collect()]
    assert sorted(ids) == list(range(1, 402))
    # Only the buckets of the two keys were written.
    after, touched = st.state(), set(st.buckets_of(batch.filter("doc_id is not null")))
    assert {p for p, d in after.parts.items() if before.parts.get(p) != d} == {p for p in after.parts if p[0] in touched}
    assert 1 <= len(touched) <= 2
    # A replay, also by another object, writes nothing; another batch goes on with the ids.
    n = len(st.versions())
    assert not st.upsert(batch, now=now(), batch_id="a")
    again = BucketStore(spark, tmp_root, n_buckets=64)
    assert not again.upsert(batch, now=now(), batch_id="a") and len(again.versions()) == n
    again.upsert(spark.createDataFrame([("y", "in", None, 1)], BATCH), now=now(), batch_id="b")
    assert again.read().filter("doc_id = 'y'").first().id == 402
    assert again.upsert(batch.limit(0), now=now(), batch_id="c") and again.has_batch("c") and again.read().count() == 402


def test_a_small_batch_rewrites_few_buckets(spark, tmp_root):
    st = BucketStore(spark, tmp_root, n_buckets=256)
    st.replace(base(spark, 500))
    old = st.state()
    one_percent = spark.createDataFrame([(f"d{i}", "new", None, i) for i in range(1, 501, 100)], BATCH)
    st.upsert(one_percent, now=now())
    changed = [p for p, d in st.state().parts.items() if old.parts.get(p) != d]
    assert len(changed) == len(st.buckets_of(one_percent)) <= 5 < len(old.parts) / 10


def test_what_a_crashed_write_left_is_not_read(spark, tmp_root):
    st = BucketStore(spark, tmp_root, n_buckets=4)
    st.replace(base(spark, 20))
    data, parts = st._write(base(spark, 5))
    assert parts and st.read().count() == 20
    with pytest.raises(ValueError):
        BucketStore(spark, tmp_root, n_buckets=5)


def test_retention_in_place(spark, tmp_root):
    b = base(spark, 60, lambda i: None if i == 60 else dt.datetime(2024, 1, 1 + i % 30, i % 24))
    st = BucketStore(spark, tmp_root, n_buckets=2)
    st.replace(b)
    old = st.state()
    # Boundary inside a day: 2024-01-16 12:00.
    at = F.to_timestamp(F.lit("2024-01-31 12:00:00"))
    want = ST.retention_survivors(b, at, 15)
    assert st.retain(at, 15, batch_id="r") == 60 - want.count()
    assert rows(st.read()) == rows(want)
    assert {p[1] for p, d in st.state().parts.items() if old.parts.get(p) != d} <= {"2024-01-16"}
    assert st.retain(at, 15, batch_id="r") == 0 and st.retain(at, 15) == 0
    st.upsert(spark.createDataFrame([("d60", "kept without a day", None, 1)], BATCH), now=now())
    assert st.read().filter("doc_id = 'd60'").first().created_at is None


def test_lookup_reads_only_the_buckets_of_the_ids(spark, tmp_root):
    st = BucketStore(spark, tmp_root, n_buckets=64)
    st.replace(base(spark, 640))
    ids = spark.createDataFrame([("d5",), ("d5",), ("nope",), ("d600",)], "doc_id string")
    out = {(r.lookup_id, r.found, r.content) for r in st.lookup(ids).collect()}
    assert out == {("d5", True, "old 5"), ("nope", False, None), ("d600", True, "old 600")}
    read = st.read(st.buckets_of(ids))
    assert len(read.inputFiles()) <= 3 and len(st.read().inputFiles()) >= 60
    assert read.count() < 60


@pytest.mark.parametrize("links", [True, False])
def test_a_version_number_goes_to_one_writer(spark, tmp_root, links):
    logs = [VersionLog(spark, tmp_root) for _ in range(2)]
    for log in logs:
        log.links = links
    assert logs[0].claim(1, {"key": "a"}) and not logs[1].claim(1, {"key": "b"})
    assert logs[1].claim(2, {"key": "b"}) and [e["key"] for e in logs[0].entries()] == ["a", "b"]


def test_concurrent_commits_lose_nothing(spark, tmp_root):
    errors = []

    def write(kind, w):
        try:
            for b in range(3):
                batch = spark.createDataFrame([(f"{w}-{b}-{i}", "x", None, i) for i in range(5)] + [("shared", f"{w}-{b}", None, 9)], BATCH)
                st = BucketStore(spark, f"{tmp_root}/b", n_buckets=4) if kind == "b" else SnapshotStore(spark, f"{tmp_root}/s")
                assert st.upsert(batch, now=now(), batch_id=f"{w}.{b}")
        except Exception as e:  # noqa: BLE001
            errors.append(e)
    for kind in "bs":
        ts = [Thread(target=write, args=(kind, w)) for w in range(2)]
        for t in ts:
            t.start()
        for t in ts:
            t.join()
        st = BucketStore(spark, f"{tmp_root}/b", n_buckets=4) if kind == "b" else SnapshotStore(spark, f"{tmp_root}/s")
        got = st.read().collect()
        assert not errors and len(got) == len({r.doc_id for r in got}) == len({r.id for r in got}) == 31
        assert len(st.versions()) == 6


def test_a_commit_on_an_old_version_is_refused(spark, tmp_root):
    st = SnapshotStore(spark, tmp_root)
    st.commit(base(spark, 2))
    with pytest.raises(CommitConflict):
        st.commit(base(spark, 3), after=0)
    assert st.commit(base(spark, 3), after=1) and st.read().count() == 3


def _feed(spark, folder, rows_):
    schema = "content string, source string, updated_at timestamp, seq long"
    spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


@pytest.mark.parametrize("kind", ["bucket", "snapshot"])
def test_streams_and_new_checkpoints_share_a_store(spark, tmp_root, kind):
    def store():
        return BucketStore(spark, f"{tmp_root}/kb", n_buckets=4) if kind == "bucket" else SnapshotStore(spark, f"{tmp_root}/kb")
    t = dt.datetime(2024, 1, 1)
    a = _feed(spark, f"{tmp_root}/a", [("one", "a", t, 1)])
    b = _feed(spark, f"{tmp_root}/b", [("two", "b", t, 1)])
    stream_updates(spark, a, store(), f"{tmp_root}/ca", now=now())
    stream_updates(spark, b, store(), f"{tmp_root}/cb", now=now())
    assert sorted(r.content for r in store().read().collect()) == ["one", "two"]
    # The same checkpoint has nothing new; a new checkpoint applies its batch 0 again.
    n = len(store().versions())
    stream_updates(spark, a, store(), f"{tmp_root}/ca", now=now())
    assert len(store().versions()) == n
    c = _feed(spark, f"{tmp_root}/c", [("three", "a", t, 1), ("four", "c", t, 2)])
    stream_updates(spark, c, store(), f"{tmp_root}/cc", now=now())
    assert sorted(r.content for r in store().read().collect()) == ["four", "three", "two"]


def test_accounting_of_a_stream(spark, tmp_root):
    from kbspark.operators.registry import register_sources
    reg = register_sources(spark.createDataFrame([("link", "u", "x")], "type string, url string, schedule string"), now=now()).cache()
    link = reg.first().id
    schema = "source_id string, url string, body string, page_no long, fetched_at timestamp"
    for b, bodies in enumerate((["<article>a</article>", None], ["<article> </article>"])):
        spark.createDataFrame([(link, f"p{b}{i}", x, None, None) for i, x in enumerate(bodies)], schema).coalesce(1).write.parquet(f"{tmp_root}/in/{b}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_root}/in/*")
    kb = BucketStore(spark, f"{tmp_root}/kb", n_buckets=2)
    stream_sources(spark, stream, reg, kb, SnapshotStore(spark, f"{tmp_root}/reg", schema=SOURCE, partition_by=None),
                   f"{tmp_root}/c", now=now(), accounting=f"{tmp_root}/acc")
    rep = sorted((r.n_items, r.n_added, r.n_no_embedding, r.n_rejected, r.fetched) for r in read_accounting(spark, f"{tmp_root}/acc").collect())
    assert rep == [(1, 1, 0, 1, True), (1, 1, 1, 0, True)] and kb.read().count() == 2
    assert len(os.listdir(f"{tmp_root}/acc")) == 2
