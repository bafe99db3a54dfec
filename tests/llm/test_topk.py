import math
import random

import numpy as np

from kbspark.llm.norm_buckets import integer_vectors, top_products

VEC = "vec_id long, embedding array<float>, x string, score string"


def brute(rows, k, every=50):
    ints = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    asks = {}
    for i, v in ints:
        if i % every == 0:
            asks[i] = min(asks.get(i, v), v)
    out = []
    for q, x in asks.items():
        def score(v):
            return max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x, v))))
        s = sorted((-score(v), i) for i, v in ints if i != q and len(v) == len(x))[:k]
        out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


def check(spark, rows, k=5, **kw):
    v = integer_vectors(spark.createDataFrame([(i, x, "c", "c") for i, x in rows], VEC))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_products(v, v.filter("vec_id % 50 = 0"), k=k, **kw).collect())
    assert got == brute(rows, k)


def test_against_brute_force_with_spread_lengths_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        x = rng.standard_normal(8) * rng.choice([0.01, 0.3, 1, 5], p=[0.2, 0.3, 0.3, 0.2])
        rows.append((i, np.round(x, 1).tolist() if i % 3 else x.tolist()))
    rows += [(1000 + i, rows[i % 7][1]) for i in range(40)]             # ties
    check(spark, rows, block=64)
    check(spark, rows, block=5000)


def test_unit_vectors_and_clusters(spark):
    rng = np.random.default_rng(2)
    c = rng.standard_normal((5, 16))
    x = c[rng.integers(0, 5, 700)] + 0.1 * rng.standard_normal((700, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    check(spark, list(enumerate(x.tolist())), block=100)


def test_edge_cases(spark):
    r = random.Random(3)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -1.0]), (50, [0.0, 0.0]), (100, None), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, [None, 1.0]), (300, []), (350, [1.0, 2.0, 3.0]),
            (None, [1.0, 1.0]), (1, [-1e-20, 1e-20]), (2, [-0.5, 0.25]), (2, [-0.5, 0.25]), (3, [1.0, 2.0, 4.0]), (50, [0.1, 0.1]), (400, [-3.0, -3.0]),
            (450, [3e20, -3e20]), (4, [3e20, 1.0]), (5, [1e6, 1e6])]
    rows += [(10 + i, [r.uniform(-1, 1), r.uniform(-1, 1)]) for i in range(30)]
    check(spark, rows)
    check(spark, [(0, [1.0]), (1, [2.0])])                              # fewer candidates than k
    check(spark, [(0, [1.0])])
    check(spark, [(7, [1.0])])
    check(spark, [])
