"""Upsert (W1), vector upsert (W2), retention (W5, A2), lookup (F2), audit (K1), snapshots, ids."""

import datetime as dt

from pyspark.sql import functions as F

from kbspark.functions.ids import dense_index
from kbspark.operators import store as ST
from kbspark.schema import KB
from kbspark.sources.snapshot import SnapshotStore

T0 = dt.datetime(2024, 1, 1)
NOW = dt.datetime(2024, 1, 31)


def _base(spark):
    return spark.createDataFrame([(1, "a", "A0", [1.0], T0, T0), (2, "b", "B0", [1.0], T0, T0)], KB)


def _now():
    return F.to_timestamp(F.lit("2024-01-31 00:00:00"))


def test_upsert_semantics(spark):
    batch = spark.createDataFrame(
        [("b", "B1", [2.0], 1), ("c", "C1", [3.0], 2), ("c", "C2", [4.0], 3), ("b", "B2", [5.0], 4)],
        "doc_id string, content string, embedding array<float>, seq long")
    out = {r.doc_id: r for r in ST.upsert_documents(_base(spark), batch, now=_now()).collect()}
    assert set(out) == {"a", "b", "c"}
    assert out["a"].content == "A0" and out["a"].updated_at == T0
    assert out["b"].id == 2 and out["b"].content == "B2" and out["b"].created_at == T0 and out["b"].updated_at == NOW
    assert out["c"].id == 3 and out["c"].content == "C2" and out["c"].embedding == [4.0]
    assert out["c"].created_at == NOW


def test_upsert_large_batch_path_equals_broadcast_path(spark):
    batch = spark.createDataFrame([(f"k{i}", f"v{i}", [float(i)], i) for i in range(30)] + [("a", "A9", [9.0], 99)],
                                  "doc_id string, content string, embedding array<float>, seq long")
    small = ST.upsert_documents(_base(spark), batch, now=_now()).collect()
    big = ST.upsert_documents(_base(spark), batch, now=_now(), max_broadcast_bytes=0).collect()
    key = lambda r: (r.doc_id, r.content, r.created_at, r.updated_at)
    assert sorted(map(key, small)) == sorted(map(key, big))
    ids = sorted(r.id for r in small)
    assert ids == list(range(1, 33))        # dense, unique, after the base ids


def test_upsert_keeps_null_created_at(spark):
    base = spark.createDataFrame([(1, "a", "A0", [1.0], None, None)], KB)
    batch = spark.createDataFrame([("a", "A1", [2.0], 1)],
                                  "doc_id string, content string, embedding array<float>, seq long")
    for limit in (256 * 1024 * 1024, 0):          # broadcast and sort-merge paths
        r = ST.upsert_documents(base, batch, now=_now(), max_broadcast_bytes=limit).first()
        assert (r.content, r.created_at, r.updated_at) == ("A1", None, NOW)


def test_upsert_twice_is_once(spark):
    batch = spark.createDataFrame([("b", "B1", [2.0], 1), ("x", "X", [1.0], 2)],
                                  "doc_id string, content string, embedding array<float>, seq long")
    once = ST.upsert_documents(_base(spark), batch, now=_now())
    twice = ST.upsert_documents(once.checkpoint(), batch, now=_now())
    key = lambda r: (r.id, r.doc_id, r.content, r.created_at)
    assert sorted(map(key, once.collect())) == sorted(map(key, twice.collect()))


def test_vector_upsert(spark):
    idx = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    b = spark.createDataFrame([(2, [20.0]), (3, [30.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, ST.vector_upsert(idx, b).collect())) == [(1, [1.0]), (2, [20.0]), (3, [30.0])]


def test_retention_boundary(spark):
    rows = [(1, "old", "x", None, dt.datetime(2024, 1, 15, 23, 59, 59), None),
            (2, "edge", "x", None, dt.datetime(2024, 1, 16), None),
            (3, "new", "x", None, dt.datetime(2024, 1, 30), None),
            (4, "null", "x", None, None, None)]
    kb = spark.createDataFrame(rows, KB)
    kept = sorted(r.doc_id for r in ST.retention_survivors(kb, _now(), 15).collect())
    assert kept == ["edge", "new", "null"]
    c = ST.retention_counts(kb, _now(), 15).first()
    assert (c.deleted, c.kept, c.total) == (1, 3, 4)


def test_get_documents_reports_missing(spark):
    ids = spark.createDataFrame([("a",), ("zz",)], "doc_id string")
    got = {r.lookup_id: r.found for r in ST.get_documents(_base(spark), ids).collect()}
    assert got == {"a": True, "zz": False}


def test_get_document_point_lookup(spark):
    import pytest
    assert ST.get_document(_base(spark), "b").content == "B0"
    with pytest.raises(KeyError):
        ST.get_document(_base(spark), "nope")


def test_constraint_audit(spark):
    rows = [(1, "a", "x", [1.0, 2.0], None, None), (2, "a", "y", [1.0], None, None),
            (3, "l" * 256, None, None, None, None), (4, None, "z", [1.0, 2.0], None, None)]
    schema = KB.fromJson({**KB.jsonValue(), "fields": [dict(f, nullable=True) for f in KB.jsonValue()["fields"]]})
    r = ST.kb_constraints(spark.createDataFrame(rows, schema), dim=2).first()
    assert (r.n_rows, r.dup_keys, r.dup_rows, r.null_doc_id, r.null_content, r.long_doc_id, r.wrong_dim,
            r.null_embedding) == (4, 1, 2, 1, 1, 1, 1, 1)


def test_dense_index(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(9)
    out = dense_index(df, ["k"], out="i", start=5).collect()
    assert sorted(r.i for r in out) == list(range(5, 1005))
    assert all(r.i == r.k + 5 for r in out)


def test_dense_index_independent_of_partitioning(spark):
    base = spark.range(0, 500).select((F.col("id") * 13 % 500).cast("string").alias("k"))
    a = {r.k: r.i for r in dense_index(base.repartition(3), ["k"], out="i").collect()}
    b = {r.k: r.i for r in dense_index(base.repartition(11), ["k"], out="i").collect()}
    assert a == b and sorted(a.values()) == list(range(500))


def test_snapshot_store_idempotent(spark, tmp_root):
    st = SnapshotStore(spark, tmp_root)
    assert st.read().count() == 0
    assert st.commit(_base(spark), batch_id=0)
    assert not st.commit(_base(spark).limit(1), batch_id=0)      # replay: no-op
    assert st.read().count() == 2
    assert st.commit(_base(spark).limit(1), batch_id=1)
    assert st.read().count() == 1 and len(st.versions()) == 2


def test_snapshot_retention_prunes_days(spark, tmp_root):
    rows = [(i, f"d{i}", "x", None, dt.datetime(2024, 1, 1 + i % 30, 12), None) for i in range(60)]
    rows.append((99, "nul", "x", None, None, None))
    st = SnapshotStore(spark, tmp_root)
    st.commit(spark.createDataFrame(rows, KB))
    p = st.latest_path()
    df = spark.read.option("basePath", p).parquet(p)
    boundary = _now() - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(15))
    plan = df.filter(F.col("created_date") >= F.to_date(boundary))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan
    from kbspark.operators.store import retention_survivors
    pushed = retention_survivors(st.read(), _now(), 15)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(created_at),GreaterThanOrEqual(created_at" in pushed, pushed
    assert st.retain(_now(), 15)
    kept = sorted(r.doc_id for r in st.read().collect())
    want = sorted([f"d{i}" for i in range(60) if dt.datetime(2024, 1, 1 + i % 30, 12) >= dt.datetime(2024, 1, 16)]
                  + ["nul"])
    assert kept == want


def test_id_functions(spark):
    from kbspark.functions.ids import content_doc_id, source_id, update_doc_id
    df = spark.createDataFrame([("s", dt.datetime(1969, 12, 31, 23, 59, 59, 500000)),
                                ("s", dt.datetime(2024, 1, 1, 0, 0, 0, 900000))], "src string, ts timestamp")
    ids = [r.i for r in df.select(update_doc_id("src", "ts").alias("i")).collect()]
    assert ids == ["doc_s_-1", "doc_s_1704067200"]          # floored seconds, like Unix()
    r = df.select(content_doc_id(F.lit("api-1"), F.col("ts"), F.lit(3)).alias("c"),
                  source_id(F.lit("rss"), F.col("ts"), F.lit(0)).alias("s")).collect()[1]
    assert r.c == "api-1-1704067200900000003" and r.s == "rss-1704067200900000000"


BATCH = "doc_id string, content string, embedding array<float>, seq long"


def test_bad_rows_give_the_same_result_on_both_paths(spark):
    schema = KB.fromJson({**KB.jsonValue(), "fields": [dict(f, nullable=True) for f in KB.jsonValue()["fields"]]})
    base = spark.createDataFrame([(1, "a", "A0", [1.0], T0, T0), (None, "b", "B0", [1.0], T0, T0), (3, None, "N0", None, T0, T0)], schema)
    batch = spark.createDataFrame([(None, "x", [1.0], 1), ("c", None, [1.0], 2), ("a", "late", [1.0], None), ("l" * 256, "x", [1.0], 3),
                                   ("a", "wrong", [1.0, 2.0], 9), ("d", "D", [1.0], 4)], BATCH)
    for limit in (1 << 28, 0):
        out = ST.upsert_documents(base, batch, now=_now(), max_broadcast_bytes=limit, dim=1).collect()
        assert sorted(((r.id, r.doc_id, r.content, r.updated_at) for r in out), key=str) == sorted(
            [(1, "a", "A0", T0), (None, "b", "B0", T0), (3, None, "N0", T0), (4, "d", "D", NOW)], key=str)
    reasons = sorted(r.reason for r in ST.upsert_rejects(batch, dim=1).collect())
    assert reasons == ["NULL content", "NULL doc_id", "NULL sequence", "doc_id too long", "wrong dimension"]


def test_equal_sequences_have_one_winner_whatever_the_partitioning(spark):
    rows = [("k", f"v{i}", [float(i)], 7) for i in range(40)]
    got = {ST.upsert_documents(_base(spark), spark.createDataFrame(rows[::s], BATCH).repartition(n), now=_now())
           .filter("doc_id = 'k'").first().content for n, s in ((1, 1), (5, -1), (9, 1))}
    assert len(got) == 1


def test_vector_upsert_never_repeats_ids(spark):
    import pytest
    idx = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    b = spark.createDataFrame([(2, [2.0], 1), (2, [3.0], 2), (None, [4.0], 3)], "vec_id long, embedding array<float>, seq long")
    with pytest.raises(ValueError):
        ST.vector_upsert(idx, b)
    assert sorted(map(tuple, ST.vector_upsert(idx, b, seq="seq").collect())) == [(1, [1.0]), (2, [3.0])]


def test_replay_over_a_half_written_version(spark, tmp_root):
    import os
    st = SnapshotStore(spark, tmp_root)
    st.commit(_base(spark), batch_id=0)
    half = os.path.join(tmp_root, "v=00000002_b=1")
    _base(spark).write.parquet(half)
    os.remove(os.path.join(half, "_SUCCESS"))
    assert len(st.versions()) == 1
    assert st.commit(_base(spark).limit(1), batch_id=1)
    assert st.read().count() == 1 and len(st.versions()) == 2


def test_retention_reports_the_deleted_rows(spark, tmp_root):
    rows = [(i, f"d{i}", "x", None, dt.datetime(2024, 1, 1 + i, 12), None) for i in range(30)]
    for part in ("created_date", None):
        st = SnapshotStore(spark, f"{tmp_root}/{part}", partition_by=part)
        assert st.retain(_now(), 15) == 0
        st.commit(spark.createDataFrame(rows, KB))
        assert st.retain(_now(), 15, batch_id=4) == 15 and st.read().count() == 15
        assert st.retain(_now(), 15, batch_id=4) == 0


def test_checkpoint_folder_is_required_off_local(spark, monkeypatch):
    import pytest
    from kbspark import session

    class Conf:
        def get(self, *a):
            return None

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Fake())


def test_source_constraints(spark):
    rows = [("a", "t", "u", "s"), ("a", None, "u", "s"), (None, "t", None, None)]
    r = ST.source_constraints(spark.createDataFrame(rows, "id string, type string, url string, schedule string")).first()
    assert (r.n_rows, r.null_id, r.null_type, r.null_url, r.null_schedule, r.dup_ids, r.dup_rows) == (3, 1, 1, 1, 1, 1, 2)


def test_unique_index_numbers_rows_in_place(spark):
    from kbspark.functions.ids import unique_index
    out = unique_index(spark.range(0, 777).repartition(7), out="i", start=3)
    assert sorted(r.i for r in out.collect()) == list(range(3, 780)) and out.columns == ["id", "i"]
    assert unique_index(spark.range(0), out="i").count() == 0
