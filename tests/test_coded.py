"""Two-phase search: codes bound the scores, results equal the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.operators.coded import CodedIndex, encode
from kbspark.operators.retrieve import top_k_batch
from test_grid import brute, clusters, table, triples


def test_codes_are_within_their_error():
    rng = np.random.default_rng(1)
    u = np.concatenate([rng.normal(size=(500, 17)), np.eye(17), rng.normal(size=(50, 17)) ** 9])
    u /= np.linalg.norm(u, axis=1)[:, None]
    codes, step, err = encode(u)
    q = rng.normal(size=(40, 17))
    q /= np.linalg.norm(q, axis=1)[:, None]
    assert (np.abs(q @ u.T - q @ (codes * step[:, None]).T) <= err).all() and err.max() < 0.05


@pytest.mark.parametrize("threshold", [None, 0.97])
def test_two_phases_equal_brute_force(spark, tmp_root, threshold):
    v = clusters(500, hot=170, dim=16)             # a third of the rows is one vector
    idx = CodedIndex(spark, tmp_root, 16, n_buckets=8)
    idx.build(table(spark, v, kind="string"))
    got = triples(idx.top_k(table(spark, v[150:300], "query_id"), k=6, threshold=threshold))
    want = [(q, f"{d:04d}", r) for q, d, r in brute(v[150:300], v, 6, threshold)]
    assert got == want
    seen = spark.sparkContext.broadcast(v[150:300] / np.linalg.norm(v[150:300], axis=1)[:, None])
    per_query = idx.candidates(seen, 6).groupBy("q").count().agg(F.avg("count")).first()[0]
    assert per_query < 60                          # of 500
    assert triples(idx.top_k(table(spark, v[150:300], "query_id"), k=6, threshold=threshold, max_broadcast_bytes=0)) == want


def test_one_query_reads_codes_then_few_rows(spark, tmp_root):
    v = np.random.default_rng(3).normal(size=(400, 16)).astype(np.float32)
    kb = table(spark, v, kind="string")
    idx = CodedIndex(spark, tmp_root, 16, n_buckets=32)
    idx.build(kb)
    out = idx.similar(v[7].tolist(), k=3, threshold=None)
    want = top_k_batch(table(spark, v[7:8], "query_id"), kb, k=3).orderBy("rank").collect()
    assert [(r.doc_id, r.sim_key) for r in out.orderBy("rank").collect()] == [(r.doc_id, r.sim_key) for r in want]
    plan = idx.candidates(spark.sparkContext.broadcast(v[:1]), 3)._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan[plan.index("ReadSchema"):]
    assert len(out.inputFiles()) < 16              # the second phase, of 32 buckets
    assert idx.similar(v[7].tolist(), k=3, threshold=0.9999).count() == 1


def test_coded_index_under_writes_and_odd_rows(spark, tmp_root):
    v = [[1, 0], None, [0, 0], [float("nan"), 1], [0, 1], [1, 1]]
    idx = CodedIndex(spark, tmp_root, 2, n_buckets=4)
    assert idx.similar([1, 0]).count() == 0
    idx.build(table(spark, v, kind="string").unionByName(spark.createDataFrame([(None, [1.0, 1.0])], "doc_id string, embedding array<float>")))
    assert [r.doc_id for r in idx.similar([1, 0], k=9, threshold=None).orderBy("rank").collect()] == ["0000", "0005", "0004"]
    up = spark.createDataFrame([("0000", [-1.0, 0.0]), ("0005", None), ("new", [2.0, 0.0])], "doc_id string, embedding array<float>")
    assert idx.upsert(up, batch_id="u") and not idx.upsert(up, batch_id="u")
    assert [r.doc_id for r in idx.similar([1, 0], k=9, threshold=None).orderBy("rank").collect()] == ["new", "0004", "0000"]
    idx.delete(spark.createDataFrame([("new",)], "doc_id string"))
    assert [r.doc_id for r in idx.similar([1, 0], k=1, threshold=None).collect()] == ["0004"]
    assert idx.similar([0, 0], k=1, threshold=None).count() == 0
    with pytest.raises(Exception, match="different vector dimensions"):
        idx.similar([1, 0, 0]).collect()
