import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kbspark.llm.exact import drop_exact_duplicates, exact_duplicates
from kbspark.llm.periodic import find_runs, periodic_runs, run_digests
from kbspark.llm.phrases import collocations, quicksort_counts

DOC = "doc_id long, text string, lang string, h string, t string, row long, name string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", "clash", 7, "clash") for i, t, lang in rows], DOC)


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# ---- exact duplicates

TEXTS = [None, "", " ", "Abc", "aBC", "abc", "abc ", "ÄB", "äb", "Äb", "x" * 300_000, "X" * 300_000, "y", "K", "k", "K"]


def classes(rows, keep):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(low(t), []).append(i)
    pick = min if keep == "smallest" else max
    return sorted(((i, (ids := [x for x in groups[low(t)] if x is not None]) and pick(ids) or (0 if 0 in ids else None), len(groups[low(t)]),
                    hashlib.sha256(low(t).encode()).hexdigest()) for i, t, _ in rows), key=str)


def test_exact_groups_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, r.choice(TEXTS), "en") for i in range(200)]
    for keep in ("smallest", "largest"):
        out = exact_duplicates(docs(spark, rows), keep=keep, broadcast_bytes=(1 << 20) * (keep == "largest")).collect()
        assert sorted(((o.doc_id, o.keep_id, o.group_size, o.text_sha256) for o in out), key=str) == classes(rows, keep)
        assert all(o.kept == (o.doc_id == o.keep_id) for o in out)


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS * 3)]
    weak = lambda t: F.unhex(F.substring(F.md5(t), 1, 1))
    out = exact_duplicates(docs(spark, rows), keep="largest", content_hash=weak).collect()
    assert sorted(((o.doc_id, o.keep_id, o.group_size, o.text_sha256) for o in out), key=str) == classes(rows, "largest")
    assert sum(o.kept for o in out) == len({low(t) for t in TEXTS})


def test_exact_null_and_repeated_ids_keep_one_row(spark):
    rows = [(None, "a", None), (None, "A", None), (None, "b", None), (4, "b", None), (3, "b", None), (3, "b", None), (9, "c", None), (9, "c", None)]
    out = exact_duplicates(docs(spark, rows), keep="smallest").collect()
    by = {}
    for o in out:
        by.setdefault(o.text_sha256, []).append(o)
    assert sorted(len(v) for v in by.values()) == [2, 2, 4]
    assert all(sum(o.kept for o in v) == 1 and v[0].group_size == len(v) for v in by.values())
    assert {(o.doc_id, o.keep_id) for o in out if o.kept} == {(None, None), (3, 3), (9, 9)}
    left = drop_exact_duplicates(docs(spark, rows)).collect()
    assert sorted((str(x.doc_id), x.text.lower(), x.h, x.row) for x in left) == [("3", "b", "clash", 7), ("9", "c", "clash", 7), ("None", "a", "clash", 7)]
    assert exact_duplicates(docs(spark, rows).limit(0)).count() == 0 and drop_exact_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_exact_plan_is_native(spark):
    plan = exact_duplicates(docs(spark, [(1, "a", "x"), (2, "a", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


# ---- periodic runs

def brute_runs(w, least=6, exponent=4):
    found = []
    for q in range(1, len(w) // exponent + 1):
        s = 0
        while s + q < len(w):
            e = s + q
            while e < len(w) and w[e] == w[e - q]:
                e += 1
            if e - s >= max(least, exponent * q) and (s == 0 or w[s - 1] != w[s - 1 + q]):
                stretch = w[s:e]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.append((s, e - s, q))
            s = max(s + 1, e - q + 1) if e > s + q else s + 1
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def test_find_runs_against_brute_force():
    r = random.Random(2)
    for trial in range(600):
        n, a = r.randint(0, 60), r.choice([1, 2, 3, 5])
        w = [r.randrange(a) for _ in range(n)]
        if trial % 2:
            u = [r.randrange(3) for _ in range(r.randint(1, 9))]
            w[len(w) // 2:len(w) // 2] = (u * 9)[:r.randint(4, 60)]
        for least, exponent in ((6, 4), (2, 3), (10, 5)):
            got = [tuple(x) for x in find_runs(np.array(w, np.int64), len(w), least, exponent).tolist()]
            assert got == brute_runs(w, least, exponent), (w, least, exponent)


def digests(rows):
    out = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w and i is not None:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(len(w))]
        runs = brute_runs(w)
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        gone = {x for s_, n_, q_ in runs for x in range(s_ + q_, s_ + n_)}
        out.append((i, len(runs), s, n, q, 1000 * n // q if runs else None,
                    hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
                    hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_run_query_against_brute_force(spark):
    r = random.Random(8)
    rows = [(None, "a " * 20, None), (1, None, None), (2, "", None), (3, " \t\n", None), (3, "x\x1cy " * 9, "en"), (3, "x\x1cy " * 9, "en")]
    rows += [(i, r.choice([" ", "\t\n"]).join(r.choice("abC") * r.randint(1, 2) if r.random() < .8 else "é" for _ in range(r.randint(1, 90))), "en") for i in range(4, 160)]
    rows += [(200 + k, "say it again " * k + "end", "en") for k in range(9)]
    out = run_digests(docs(spark, rows)).collect()
    got = sorted(((o.doc_id, o.n_runs, o.start, o.length, o.period, o.exponent_milli, o.runs_sha256, o.collapsed_sha256) for o in out), key=str)
    assert got == digests(rows) and sum(o.n_runs for o in out) > 10
    assert run_digests(docs(spark, rows).limit(0)).count() == 0


def test_very_long_runs_are_found_whole(spark):
    text = "start " + "na " * 300_000 + "end " + " ".join(str(i % 40_001) for i in range(200_000))
    out = periodic_runs(docs(spark, [(1, text, "en"), (2, "short", "en")])).collect()
    runs = {o.doc_id: [(x.start, x.length, x.period) for x in o.runs] for o in out}
    assert runs == {1: [(1, 300_000, 1), (300_002, 200_000, 40_001)], 2: []}
    assert {o.doc_id: len(o.collapsed.split()) for o in out} == {1: 3 + 40_001, 2: 1}


# ---- phrases

def brute_phrases(rows, least, longest=5, top=2000, cover=100):
    n, f = Counter(), Counter()
    for _, t, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = []
    for (lang, *p), a in cand.items():
        inside = any(q[0] == lang and len(q) - 1 > len(p) and 100 * b >= cover * a and any(list(q[1 + i:1 + i + len(p)]) == p for i in range(len(q) - len(p)))
                     for q, b in cand.items())
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            out.append((lang, " ".join(p), a, f[(lang, *p[:k])], f[(lang, *p[k:])], n[lang], s))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranks = Counter()
    res = []
    for x in out:
        ranks[x[0]] += 1
        if ranks[x[0]] <= top:
            res.append((x[0], ranks[x[0]], *x[1:]))
    return res


def phrase_rows(seed=4, n=160):
    r = random.Random(seed)
    words = ["the", "of", "New", "York", "City", "é", "a\x1fb", "zz", "q"]
    rows = [(None, None, None), (1, "", "en"), (2, "  ..\n", None), (3, "The the THE the the the", None)]
    for i in range(n):
        t = "".join(r.choices(words, [9, 7, 2, 1, 1, 1, 1, 1, 1])[0] + r.choice([" ", " ", "\t", " ", ". ", "\n"]) for _ in range(r.randint(1, 50)))
        rows.append((i, t + r.choice(["", " in new york city now", " Hot line of the day"]), r.choice(["en", "en", "de", None, "und"])))
    return rows


def test_phrases_against_brute_force(spark):
    rows = phrase_rows()
    want = {}
    for options in ({}, {"dictionary_bytes": 0}, {"flush_suffixes": 50, "task_suffixes": 200}):
        for least, top, cover in ((8, 2000, 100), (20, 7, 80)):
            out = collocations(docs(spark, rows), min_count=least, top=top, cover_percent=cover, **options).collect()
            want.setdefault(least, brute_phrases(rows, least, top=top, cover=cover))
            got = sorted(((o.lang, o.rank, o.phrase, o.a, o.l, o.r, o.n, o.score) for o in out), key=lambda x: x[:2])
            assert got == want[least], (options, least)
    assert len(want[8]) > 50


def test_phrases_empty_table(spark):
    assert collocations(docs(spark, [(1, "a b", "en")])).count() == 0
    assert collocations(docs(spark, [(1, "a b", "en")]).limit(0)).count() == 0


def test_quicksort_counts_every_depth():
    r = np.random.default_rng(3)
    w = r.integers(0, 5, (3000, 4)).astype(np.int32)
    w[:, 0] += 1
    for k in range(1, 4):
        w[w[:, k - 1] == 0, k] = 0
    weight = r.integers(1, 4, len(w))
    f = Counter()
    for row, x in zip(w.tolist(), weight.tolist()):
        for m in range(2, 5):
            if 0 not in row[:m]:
                f[tuple(row[:m])] += x
    for complete, least in ((2, 60), (3, 60), (4, 60), (2, 1)):
        at, words, n = quicksort_counts(w, weight, complete, least)
        got = {tuple(w[i, :m].tolist()): c for i, m, c in zip(at, words, n)}
        assert len(got) == len(at)
        assert got == {p: c for p, c in f.items() if c >= least or len(p) < complete}
