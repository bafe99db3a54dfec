"""Top-k of large query tables: the shuffled grid, its bounds, 64-bit ids, the maintained index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import kbspark.operators.grid as G
import kbspark.operators.retrieve as R
from kbspark.operators.ann import ann_topk, assign_ivf
from kbspark.operators.retrieve import top_k_batch

BIG = 9007199254740993


def table(spark, vecs, name="doc_id", kind="long", start=0):
    return spark.createDataFrame([(start + i if kind == "long" else f"{i:04d}", None if v is None else [float(x) for x in v]) for i, v in enumerate(vecs)],
                                 f"{name} {kind}, embedding array<float>")


def brute(qs, ds, k, threshold=None, start=0):
    d = ds.astype(np.float32).astype(np.float64)
    d /= np.linalg.norm(d, axis=1)[:, None]
    out = []
    for i, q in enumerate(qs.astype(np.float32).astype(np.float64)):
        keys = np.floor(d @ (q / np.linalg.norm(q)) * 1e9 + 0.5).astype(np.int64)
        order = [int(j) for j in np.lexsort((np.arange(len(d)), -keys)) if threshold is None or keys[j] >= threshold * 1e9]
        out += [(i, start + j, r + 1) for r, j in enumerate(order[:k])]
    return sorted(out)


def triples(df):
    return sorted((r.query_id, r.doc_id, r.rank) for r in df.collect())


@pytest.fixture
def no_collect(monkeypatch):
    def refuse(*a):
        raise AssertionError("query rows went through the driver")
    monkeypatch.setattr(R, "_query_chunk", refuse)


@pytest.fixture(params=["one cell", "cells"])
def grid(request, monkeypatch, no_collect):
    """Both forms of the grid."""
    if request.param == "cells":
        monkeypatch.setattr(R, "SMALL_PAIRS", 0)
    return {"strategy": "grid"}


def clusters(n, seed=3, dim=8, spread=0.05, hot=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    v = centers[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim))
    v[:hot] = v[0]
    return v


@pytest.mark.parametrize("threshold", [None, 0.95])
def test_grid_equals_brute_force(spark, grid, monkeypatch, threshold):
    v = clusters(600, hot=200)                     # a third of the rows is one vector
    monkeypatch.setattr(G, "DOC_BLOCK_BYTES", 64 * 8 * 8)
    monkeypatch.setattr(G, "QUERY_BLOCK_BYTES", 50 * 8 * 8)
    out = top_k_batch(table(spark, v, "query_id"), table(spark, v), k=5, threshold=threshold, **grid)
    assert triples(out) == brute(v, v, 5, threshold)


def test_cells_that_cannot_matter_are_not_scored(spark):
    v = clusters(800)
    kb, qs = table(spark, v), table(spark, v, "query_id")
    cand, others = G.exact_top_k(qs, kb, 5, None, "query_id", "embedding", "doc_id", "embedding", 8, 800, n_cells=40)
    assert triples(R._ranked(cand, 5, "query_id", "doc_id")) == brute(v, v, 5)
    visited = others.agg(F.avg("others")).first()[0]
    assert visited < 10                            # of 39 other cells


def test_spread_out_vectors_and_few_documents(spark, grid):
    v = np.random.default_rng(5).normal(size=(90, 6))
    for n in (90, 3):
        got = triples(top_k_batch(table(spark, v, "query_id"), table(spark, v[:n]), k=4, **grid))
        assert got == brute(v, v[:n], 4)
    assert top_k_batch(table(spark, v, "query_id"), table(spark, v).limit(0), k=4, **grid).count() == 0
    assert top_k_batch(table(spark, v, "query_id").limit(0), table(spark, v), k=4, **grid).count() == 0


def test_unusable_vectors_never_match(spark, grid):
    v = [[1, 0], None, [0, 0], [float("nan"), 1], [0, 1]]
    assert triples(top_k_batch(table(spark, v, "query_id"), table(spark, v), k=9, **grid)) == [(0, 0, 1), (0, 4, 2), (4, 0, 2), (4, 4, 1)]


@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
def test_large_ids_are_exact_beside_nulls(spark, strategy):
    v = np.random.default_rng(6).normal(size=(40, 4))
    kb = table(spark, v, start=BIG).unionByName(spark.createDataFrame([(None, [0.1, 0.2, 0.3, 0.4])], "doc_id long, embedding array<float>"))
    qs = table(spark, v, "query_id", start=BIG).unionByName(spark.createDataFrame([(None, None)], "query_id long, embedding array<float>"))
    out = top_k_batch(qs, kb.coalesce(1), k=1, strategy=strategy).collect()
    assert sorted((r.query_id, r.doc_id) for r in out) == [(BIG + i, BIG + i) for i in range(40)]


def test_index_keeps_large_ids(spark):
    v = np.random.default_rng(6).normal(size=(40, 4))
    kb = table(spark, v, start=BIG).unionByName(spark.createDataFrame([(None, [0.1, 0.2, 0.3, 0.4])], "doc_id long, embedding array<float>"))
    idx = assign_ivf(kb.coalesce(1), table(spark, v[:3]).coalesce(1))
    assert sorted(r.doc_id for r in idx.data.collect() if r.doc_id is not None) == [BIG + i for i in range(40)]


def test_probing_by_grid_equals_probing_by_broadcast(spark, monkeypatch):
    v = clusters(300)
    idx = assign_ivf(table(spark, v), table(spark, v[:7]).coalesce(1))
    qs = table(spark, v, "query_id")
    want = triples(ann_topk(qs, idx, k=5, n_probe=2, strategy="broadcast"))
    for pairs in (R.SMALL_PAIRS, 0):
        monkeypatch.setattr(R, "SMALL_PAIRS", pairs)
        assert triples(ann_topk(qs, idx, k=5, n_probe=2, strategy="grid")) == want
    assert triples(ann_topk(qs, idx, k=5, n_probe=7, strategy="grid")) == brute(v, v, 5)


def test_stored_index_follows_upserts_and_deletes(spark, tmp_root):
    from kbspark.operators.ann import StoredIndex
    rng = np.random.default_rng(9)
    cent = rng.normal(size=(6, 5))
    v = np.repeat(cent, 30, axis=0) + 0.1 * rng.normal(size=(180, 5))
    kb = table(spark, v, kind="string")
    idx = StoredIndex(spark, tmp_root, table(spark, cent).coalesce(1))
    idx.build(kb)

    def rows(df):
        return sorted((r.doc_id, r.cell, tuple(r.embedding)) for r in df.collect())
    assert rows(idx.index().data) == rows(assign_ivf(kb, idx.centroids).data)
    before = idx.store.state()
    # One vector moves from cell 0 to cell 3, one goes (no usable vector), one is new in cell 3, NULL ids are nothing.
    batch = spark.createDataFrame([("0000", cent[3].tolist()), ("0001", None), ("new", cent[3].tolist()), (None, cent[5].tolist())],
                                  "doc_id string, embedding array<float>")
    assert idx.upsert(batch, batch_id=1) and not idx.upsert(batch, batch_id=1)
    now = kb.filter("doc_id not in ('0000', '0001')").unionByName(batch.filter("doc_id is not null"))
    again = StoredIndex(spark, tmp_root)
    assert rows(again.index().data) == rows(assign_ivf(now, again.centroids).data)
    after = again.store.state()
    assert {p[0] for p, d in after.parts.items() if before.parts[p] != d} == {0, 3}
    again.keep_only(now.filter("doc_id < '0150' or doc_id = 'new'"))          # cell 5 goes whole
    last = idx.store.state()
    assert rows(idx.index().data) == rows(assign_ivf(now.filter("doc_id < '0150' or doc_id = 'new'"), idx.centroids).data)
    assert {p[0] for p, d in last.parts.items() if after.parts.get(p) != d} == set() and (5, "__HIVE_DEFAULT_PARTITION__") not in last.parts
    idx.delete(spark.createDataFrame([("nobody",)], "doc_id string"))
    assert idx.store.state().parts == last.parts
    qs = table(spark, v[:20], "query_id")
    a = triples(ann_topk(qs, idx.index(), k=3, n_probe=2, strategy="grid"))
    assert a == triples(ann_topk(qs, idx.index(), k=3, n_probe=2, strategy="broadcast")) and len(a) == 60
