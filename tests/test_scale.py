"""What a task holds, reads and copies stays bounded while inputs grow."""

import glob

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import kbspark.operators.coded as C
import kbspark.operators.grid as G
import kbspark.operators.retrieve as R
from kbspark.functions.parallel import per_row
from kbspark.operators import store as ST
from kbspark.operators.retrieve import top_k_batch
from test_grid import brute, clusters, table, triples


@pytest.mark.parametrize("floor", [None, 950_000_000])
def test_running_top_k_equals_sorting_and_holds_little(floor):
    rng = np.random.default_rng(5)
    d, q = rng.normal(size=(9000, 12)), rng.normal(size=(300, 12))
    d[::3] = d[0]                                  # a third of the rows is one vector
    q[:100] = d[0]
    d, q = (x / np.linalg.norm(x, axis=1)[:, None] for x in (d, q))
    best, most = G.TopK(q, 5, floor), 0
    for lo in range(0, len(d), 1500):
        best.add(d[lo:lo + 1500], pa.array(np.arange(lo, lo + 1500)))
        most = max(most, best.held)
    t = best.best()
    keys = G.keys_of(q @ d.T).astype(np.int64)
    want = []
    for i in range(len(q)):
        order = [int(j) for j in np.lexsort((np.arange(len(d)), -keys[i]))[:5] if floor is None or keys[i, j] >= floor]
        want += [(i, j, int(keys[i, j])) for j in order]
    got = list(zip(t.column("q").to_pylist(), t.column("doc_id").to_pylist(), t.column("sim_key").to_pylist()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert max(abs(g[2] - w[2]) for g, w in zip(got, want)) <= 1
    assert most < 2 * (1 << 16)                    # of 2.7 million pairs


def test_running_top_k_puts_ids_together(monkeypatch):
    d = np.ones((4000, 3)) / np.sqrt(3)
    d[:, 0] += np.arange(4000) * 1e-13             # different vectors with one key: all are ties
    best = G.TopK(d[:50], 4)
    for lo in range(3000, -1, -1000):
        best.add(d[lo:lo + 1000], pa.array([f"{i:05d}" for i in range(lo, lo + 1000)]))
        best._prune()
    assert best.held <= 2 * 4 * 50 and best.best().column("doc_id").to_pylist() == [f"{i:05d}" for i in range(4)] * 50


def test_many_best_rows_go_to_the_grid(spark, monkeypatch):
    v = clusters(300)
    monkeypatch.setattr(R, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(R, "BROADCAST_RATIO", 0)

    def refuse(*a):
        raise AssertionError("the queries were broadcast")
    monkeypatch.setattr(R, "_query_chunk", refuse)
    assert triples(top_k_batch(table(spark, v[:60], "query_id"), table(spark, v), k=5)) == brute(v[:60], v, 5)


def test_whole_blocks_meet_where_bounds_leave_out_little(spark, monkeypatch):
    v = np.random.default_rng(1).normal(size=(700, 24))        # no clusters: nearly every cell can matter
    asked = []
    meet = G._meet
    monkeypatch.setattr(G, "_meet", lambda d, q, sizes, *a: asked.append(sizes) or meet(d, q, sizes, *a))
    monkeypatch.setattr(R, "SMALL_PAIRS", 0)
    got = top_k_batch(table(spark, v[:200], "query_id"), table(spark, v), k=5, strategy="grid")
    assert triples(got) == brute(v[:200], v, 5) and len(asked[0]) > 1 and len(asked[1]) == 1


def test_blocks_are_cut_for_all_tasks():
    assert G._sizes({0: 100_000}, {0: 100_000}, 64, 12)[0][0] * G._sizes({0: 100_000}, {0: 100_000}, 64, 12)[0][1] >= 96


def test_two_phases_take_queries_in_parts(spark, tmp_root, monkeypatch):
    v = clusters(300, hot=90, dim=16)
    idx = C.CodedIndex(spark, tmp_root, 16, n_buckets=4)
    idx.build(table(spark, v, kind="string"))
    monkeypatch.setattr(C, "QUERY_ROWS", 40)
    seen, search = [], idx.candidates
    monkeypatch.setattr(idx, "candidates", lambda q, *a: seen.append(len(q.value)) or search(q, *a))
    got = triples(idx.top_k(table(spark, v[50:150], "query_id"), k=4))
    assert got == [(q, f"{d:04d}", r) for q, d, r in brute(v[50:150], v, 4)]
    assert sum(seen) == 100 and max(seen) < 60


def test_landed_files_grow_with_the_input_and_micro_batches_do_not(spark, tmp_root, monkeypatch):
    import kbspark.plans.landing as L
    schema = "key long, props string"
    for t in ("events", "pages", "conversations", "documents"):
        spark.createDataFrame([(i, "x" * 50) for i in range(200)], schema).write.parquet(f"{tmp_root}/{t}.parquet")
    rows = [(f"s{i % 7}", f"u{i % 90}", "body", None, i) for i in range(500)]
    landed = spark.createDataFrame(rows, "source_id string, url string, body string, fetched_at timestamp, page_no long")
    monkeypatch.setattr(L, "LANDED_BYTES", 1000)
    s = L.land(spark, tmp_root, landed, f"{tmp_root}/landed", batches=2, least=2)
    assert len(glob.glob(f"{tmp_root}/landed/*.parquet")) > 4
    done = []
    from kbspark.streaming.stream import run_stream
    run_stream(s, lambda b, i: done.append({(r.source_id, r.url) for r in b.collect()}), f"{tmp_root}/checkpoint")
    assert len(done) == 2 and not done[0] & done[1] and len(done[0] | done[1]) == len({r[:2] for r in rows})


def test_repeated_keys_of_a_batch_are_not_copied(spark, monkeypatch):
    copies = []
    monkeypatch.setattr(ST, "scratch_dir", lambda s, name, f=ST.scratch_dir: copies.append(f(s, name)) or copies[-1])
    schema = "doc_id string, content string, embedding array<float>, seq long"
    batch = spark.createDataFrame([(f"k{i % 30}", f"v{i}", [float(i)], i) for i in range(50)], schema)
    got = {r.doc_id: (r.content, r._first_seq) for r in ST.latest_rows(batch).collect()}
    assert got == {f"k{i}": (f"v{i + 30}" if i < 20 else f"v{i}", i) for i in range(30)}
    assert not glob.glob(f"{copies[0]}/latest")
    monkeypatch.setattr(ST, "KEY_BROADCAST_ROWS", 0)
    assert {r.doc_id: (r.content, r._first_seq) for r in ST.latest_rows(batch).collect()} == got


def test_per_row_holds_few_values(monkeypatch):
    out = per_row(lambda v: (v and v.upper(), None if v else "empty"), pa.array(["a", None, "b"] * 400), ("text", "error"))
    assert out.to_pylist() == [{"text": "A", "error": None}, {"text": None, "error": "empty"}, {"text": "B", "error": None}] * 400
    assert len(per_row(len, pa.array([], pa.string()), ("text", "error"))) == 0
