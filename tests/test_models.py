"""Randomised model checks: Spark operators against plain-Python models of the semantics."""

import datetime as dt
import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbspark.operators.retrieve import top_k_batch
from kbspark.operators.store import upsert_documents
from kbspark.schema import KB

T0 = dt.datetime(2024, 1, 1)
NOW = dt.datetime(2024, 1, 31)
KEYS = list("abcdefgh")


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.sampled_from(KEYS)), st.lists(st.tuples(st.sampled_from(KEYS), st.text("xyz", max_size=3)),
                                                 min_size=1, max_size=12))
def test_upsert_matches_model(spark, base_keys, batch):
    base_rows = [(i + 1, k, f"base-{k}", [1.0], T0, T0) for i, k in enumerate(sorted(base_keys))]
    batch_rows = [(k, c, [2.0], seq) for seq, (k, c) in enumerate(batch)]
    base = spark.createDataFrame(base_rows, KB)
    b = spark.createDataFrame(batch_rows, "doc_id string, content string, embedding array<float>, seq long")
    got = {r.doc_id: (r.id, r.content, r.created_at, r.updated_at)
           for r in upsert_documents(base, b, now=F.to_timestamp(F.lit("2024-01-31 00:00:00"))).collect()}
    # model: sequential INSERT .. ON CONFLICT DO UPDATE in seq order
    model = {k: [i, c, cr, up] for i, k, c, _e, cr, up in base_rows}
    nxt = len(base_rows) + 1
    first_seq = {}
    for seq, (k, c) in enumerate(batch):
        first_seq.setdefault(k, seq)
    for k in sorted((k for k in first_seq if k not in model), key=lambda k: (first_seq[k], k)):
        model[k] = [nxt, None, NOW, NOW]
        nxt += 1
    for k, c in batch:
        model[k][1] = c
        model[k][3] = NOW
    assert got == {k: tuple(v) for k, v in model.items()}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(5, 60), st.integers(1, 6), st.integers(1, 7), st.sampled_from([None, 0.0, 0.3]),
       st.integers(0, 2**31))
def test_batch_topk_matches_brute_force(spark, n, q, k, threshold, seed):
    rng = np.random.default_rng(seed)
    vecs = rng.integers(-2, 3, size=(n, 4)).astype(np.float32)      # small ints: many exact ties
    vecs[rng.random(n) < 0.2] = vecs[0]                               # forced duplicates
    kb = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(vecs)],
                               "doc_id string, embedding array<float>").repartition(3)
    qv = rng.integers(-2, 3, size=(q, 4)).astype(np.float32)
    qs = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(qv)], "query_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.doc_id) for r in top_k_batch(qs, kb, k=k, threshold=threshold).collect())
    want = []
    for j, v in enumerate(qv.astype(np.float64)):
        if not np.linalg.norm(v):
            continue
        cands = []
        for i, d in enumerate(vecs.astype(np.float64)):
            if not np.linalg.norm(d):
                continue
            key = math.floor(d @ v / (np.linalg.norm(d) * np.linalg.norm(v)) * 1e9 + 0.5)
            if threshold is None or key >= round(threshold * 1e9):
                cands.append((-key, f"{i:03d}"))
        want += [(j, r + 1, d) for r, (_, d) in enumerate(sorted(cands)[:k])]
    assert got == sorted(want)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["p", "q", "r"]), st.integers(1, 40),
                          st.one_of(st.none(), st.text("abc", max_size=3))), max_size=40),
       st.integers(1, 6))
def test_two_level_stitch_equals_ordered_concat(spark, pages, block):
    from kbspark.sources.pages import stitch_pages
    uniq = {}
    for path, no, text in pages:              # one text per (path, page)
        uniq.setdefault((path, no), text)
    rows = [(p, n, t) for (p, n), t in uniq.items()]
    df = spark.createDataFrame(rows, "path string, page_no long, text string")
    got = {r.title: r.text for r in stitch_pages(df, block_pages=block).collect()}
    want = {}
    for (p, n), t in sorted(uniq.items()):
        want[p] = want.get(p, "") + (t or "")
    assert got == want
