import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm.chosen_path import drop_near_duplicates, near_duplicates
from kbspark.llm.components import connected_components
from kbspark.llm.hyperplanes import embedding_duplicates

DOC = "doc_id long, text string, cls string, label string, component_id string"


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in linked:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute(rows, n, percent=80):
    sets = [shingles(t, n) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
              and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = groups(len(rows), linked)
    low = {}
    for (d, _), g in zip(rows, root):
        low[g] = min(low.get(g, d), d)
    return sorted((d, len(s), low[g], d == low[g]) for (d, _), s, g in zip(rows, sets, root))


def check(spark, rows, n, **kw):
    df = spark.createDataFrame([(d, t, "c", "l", "x") for d, t in rows], DOC)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, words=n, **kw).collect())
    assert got == brute(rows, n)


def corpus(seed, n_base, copies, size=60, change=0.04):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n_base):
        base = [r.choice(words) for _ in range(size)]
        for _ in range(r.randint(1, copies)):
            rows.append(" ".join(r.choice(words) if r.random() < change else w for w in base))
    r.shuffle(rows)
    return list(enumerate(rows))


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  Two"), (8, "é É"), (9, "É é"), (10, "a " * 30000)]
    check(spark, rows, 2)
    check(spark, rows, 5)


@pytest.mark.parametrize("words", [2, 5])
def test_against_brute_force(spark, words):
    check(spark, corpus(words, 40, 6), words)


def test_large_group_of_near_copies_branches_and_closes(spark):
    # small nodes forced: leaders, labels, deep branching and bottom blocks all take part
    rows = corpus(9, 3, 1) + []
    r = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    rows += [(1000 + k, " ".join(f"x{r.random()}" if r.random() < 0.04 else w for w in base)) for k in range(120)] + [(999, " ".join(base))]
    check(spark, rows, 2, small=6, trees=12)


def test_groups_larger_than_tiny_nodes(spark, monkeypatch):
    # a star, a chain of small steps and a crowd of texts that share much without being linked
    from kbspark.llm import chosen_path as m
    r = random.Random(8)
    base = [f"b{i}" for i in range(90)]
    rows = [(1000 + k, " ".join(f"x{r.random()}" if r.random() < 0.03 else w for w in base)) for k in range(90)]
    rows += [(2000 + k, " ".join(f"c{i}" for i in range(2 * k, 2 * k + 80))) for k in range(50)]
    core = [f"k{i}" for i in range(100)]
    rows += [(3000 + k, " ".join([*core, *(f"o{k}-{i}" for i in range(30))])) for k in range(60)]
    rows += [(4000 + k, " ".join([*core, *(f"o{k}-{i}" for i in range(26))])) for k in range(0, 60, 5)]
    check(spark, rows, 2)
    monkeypatch.setattr(m, "SET_ITEMS", 100)                       # the way of heavy nodes: pairs
    check(spark, rows, 2)


def test_nodes_are_whole_whatever_the_batches():
    import pyarrow as pa
    from kbspark.llm.chosen_path import _whole_nodes
    r = random.Random(3)
    parts = sorted(r.randint(0, 12) for _ in range(100))
    for cut in (1, 3, 7, 100):
        batches = [pa.record_batch({"part": pa.array(parts[k:k + cut]), "x": pa.array(range(k, min(100, k + cut)))}) for k in range(0, 100, cut)]
        got = list(_whole_nodes(iter(batches)))
        assert [x for b in got for x in b.column("x").to_pylist()] == list(range(100))
        ends = [set(b.column("part").to_pylist()) for b in got]
        assert all(not (a & b) for n, a in enumerate(ends) for b in ends[:n])
    assert list(_whole_nodes(iter([]))) == []


def test_linked_pairs_inside_a_large_group_of_shared_text_stay_together(spark):
    # every document shares 130 of 165 words (pairwise 0.65); the planted pairs are at 0.80 to 0.82
    from kbspark.llm import chosen_path as m
    r = random.Random(11)
    core = [f"c{i}" for i in range(130)]
    rows = [(i, [*core, *(f"o{i}-{k}" for k in range(35))]) for i in range(300)]
    rows += [(1000 + i, [*rows[i][1][n:], *(f"p{i}-{k}" for k in range(n))]) for i in range(0, 300, 4) for n in [r.choice((16, 17, 18))]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    sigs = m._signatures(df, 1).localCheckpoint()
    wide = sigs.select("cls", F.substring("sketch", 4 * m.COORDS + 1, m.WIDE // 2).alias("wide"))
    nodes = m._roots(sigs, 20, 3).withColumn("label", F.col("cls"))
    for level in range(1, 11):
        nodes = m._branch(nodes.join(F.broadcast(wide), "cls"), level, 0.8).localCheckpoint()
    at = nodes.join(F.broadcast(sigs.select("cls", "doc_id")), "cls").select("node", "doc_id").filter("doc_id % 4 = 0")
    other = at.select("node", F.col("doc_id").alias("other"))
    together = at.join(other, "node").filter("other = doc_id + 1000").select("doc_id").distinct().count()
    assert together == 75


def test_computed_miss_stays_low_at_every_level():
    from kbspark.llm.chosen_path import COORDS, miss
    assert all(miss(0.8, 20, 3, levels) < 1e-4 for levels in range(COORDS - 3 + 1))


def test_blocks_and_minorities_compare_all_pairs_of_different_labels(spark):
    from kbspark.llm.chosen_path import _Join
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    join = _Join(docs, 2, 80, 3, 3, 4)
    r = random.Random(6)
    bits = [r.getrandbits(63) for _ in range(3)]
    rows = [(0, 7, bytes([i]), bits[i % 3], bits[i % 3], bytes([i % 5])) for i in range(30)]           # one node, 5 labels of 6 rows
    rows += [(0, 8, bytes([100 + i]), bits[0], bits[0], bytes([0 if i < 20 else i])) for i in range(23)]  # 20 of one label, 3 others
    df = spark.createDataFrame(rows, "tree int, node long, cls binary, lo long, hi long, label binary")
    live = join.prune(df).withColumn("wide", F.lit(bytes(128)))
    join.minor = 3

    def want(rows):
        return sorted((bytes(a[2]), bytes(b[2])) for a in rows for b in rows if a[2] < b[2] and a[5] != b[5] and a[3] == b[3])
    got = sorted((bytes(x.a), bytes(x.b)) for x in join.all_pairs(live, True).distinct().collect())
    assert got == want(rows[:30])
    assert join.all_pairs(live, False).count() == 0
    got = sorted((bytes(x.a), bytes(x.b)) for x in join.minor_pairs(live).distinct().collect())
    assert got == want(rows[30:])
    assert {x.node for x in join.large(live).collect()} == {7}
    far = live.withColumn("wide", F.sha2(F.hex("cls"), 512)).withColumn("wide", F.encode("wide", "utf-8"))
    assert join.all_pairs(far, True).count() == 0 and join.minor_pairs(far).count() == 0       # the wide filter


def test_repeated_ids_nulls_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t"), (None, None)]
    df = spark.createDataFrame([(d, t, "", "", "") for d, t in rows], DOC)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df, words=2).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, False), (None, None, True), (None, None, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0
    kept = drop_near_duplicates(df, words=2)
    assert kept.columns == df.columns and sorted(str((r.doc_id, r.text)) for r in kept.collect()) == [
        "(1, 'a b c d e f')", "(None, 'q r s t')", "(None, None)"]


def test_dropping_judges_rows_not_ids(spark):
    rows = [(1, "a b c d e f"), (5, "A b c d e f"), (5, "a text of its own"), (5, None), (6, "a b c d e f"), (None, "a b c d e f"), (7, "q r s")]
    df = spark.createDataFrame([(d, t, "", "", "") for d, t in rows], DOC)
    kept = drop_near_duplicates(df, words=2)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((rows[i] for i in (0, 2, 3, 6)), key=str)


def test_rows_without_ids_and_repeats_leave_one_of_each_group(spark):
    # near copies without an id, equal texts under one id, and clashing columns
    base = [f"b{i}" for i in range(60)]
    near = " ".join([*base[:59], "z"])
    rows = ([(None, " ".join(base))] * 30 + [(None, near)] * 30 + [(9, "p q r s t u v")] * 20 + [(None, "p q r s t u v")] * 5
            + [(8, "P q r s t u v"), (None, ""), (None, None), (3, None), (3, None)])
    df = spark.createDataFrame([(d, t, "", "", "") for d, t in rows], DOC).withColumnRenamed("label", "Row_Key")
    kept = drop_near_duplicates(df, words=2)
    assert kept.columns == df.columns
    got = sorted(str((r.doc_id, r.text)) for r in kept.collect() if r.text not in (" ".join(base), near))
    assert got == sorted(map(str, [(8, "P q r s t u v"), (None, ""), (None, None), (3, None), (3, None)]))
    assert kept.filter(F.col("text").startswith("b0 ")).count() == 1
    none = drop_near_duplicates(df.filter("doc_id = 9").limit(0), words=2)
    assert none.count() == 0 and none.columns == df.columns


def test_components_of_chains_and_hubs(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(r.randint(2000, 2080), r.randint(2000, 2080)) for _ in range(50)]
    ids = sorted({v for e in edges if e[0] != e[1] for v in e})
    root = groups(len(ids), [(ids.index(a), ids.index(b)) for a, b in edges if a != b])
    got = {x.id: x.root for x in connected_components(spark.createDataFrame(edges + [(5, None), (7, 7)], "a long, b long")).collect()}
    assert sorted(got) == ids
    pairs = {}
    for i, g in zip(ids, root):
        pairs.setdefault(g, set()).add(got[i])
    assert all(len(v) == 1 for v in pairs.values()) and len({next(iter(v)) for v in pairs.values()}) == len(pairs)


VEC = "vec_id long, embedding array<float>, cls string, n string"


def vector_brute(rows, threshold=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    x = [np.array(v, np.float32).astype(float) if o else None for (_, v), o in zip(rows, ok)]
    linked = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and ok[i] and ok[j] and len(x[i]) == len(x[j])
              and x[i] @ x[j] / np.sqrt(x[i] @ x[i]) / np.sqrt(x[j] @ x[j]) >= threshold]
    root = groups(len(rows), linked)
    low = {}
    for (d, _), g in zip(rows, root):
        low[g] = min(low.get(g, d), d)
    n = [sum(a == i for a, _ in linked) for i in range(len(rows))]
    return sorted((d, k, low[g], d == low[g]) for (d, _), k, g in zip(rows, n, root))


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(30):
        base = rng.standard_normal(16)
        for _ in range(8):
            rows.append((base + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.3])).tolist())
    rows += [rows[0]] * 5 + [(np.array(rows[3]) * 7).tolist(), [0.0] * 16, None, [float("nan")] + [1.0] * 15, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0],
                             [1e-30] * 16, [1e30] * 16]
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, v, "c", "n") for i, v in rows], VEC)
    want = vector_brute(rows)
    for block, per_bucket in ((1024, 256), (16, 4)):
        got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in
                     embedding_duplicates(df, block=block, per_bucket=per_bucket, recall=0.99999).collect())
        assert got == want


def test_vectors_empty_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], "", ""), (3, [1.0, 0.0], "", ""), (3, [1.0, 0.0], "", ""), (None, [0.0, 1.0], "", "")], VEC)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (None, 0, None, True)], key=str)
    assert embedding_duplicates(df.limit(0)).count() == 0


def test_recall_of_sign_hashing_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):                       # pairs at a cosine just above 0.9
        a = rng.standard_normal(32)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(32)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.905 * a + np.sqrt(1 - 0.905 ** 2) * b).tolist())]
    df = spark.createDataFrame([(i, v, "", "") for i, v in rows], VEC)
    found = embedding_duplicates(df, per_bucket=8).agg(F.sum("n_links")).first()[0]
    assert found >= 0.97 * 300
