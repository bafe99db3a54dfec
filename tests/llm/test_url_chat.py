import random

from pyspark.sql import functions as F

from kbspark.llm.snapshots import format_conversations
from kbspark.llm.url_rules import apply_url_rules

PAGE = "page_id long, url string, host string, extra string"
RULE = "host string, path string, action string"


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, a in rules:
        p = p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h) + len(p), len(h), h + p, a))
    return host, path, best[2] if best else None, best[3] if best else default


def test_rules_against_brute_force(spark):
    r = random.Random(3)
    hosts = ["net", "a.net", "b.a.net", "x.b.a.net", "ab.net", "a.net.org", "org", "A.NET", "-a.net", "a..net"]
    paths = ["", "/", "/e", "/en/", "/en/x", "/é/", "/en/x/y?q=/fr/", "#/en/", "?/en/"]
    urls = [None, "", "no scheme", "://", "http://", "http:///en/"] + [f"http://{h}{p}" for h in hosts for p in paths]
    rules = [(h.lower(), p, r.choice(["allow", "block"])) for h in hosts for p in ("", "/", "/en/", "/en/x") if r.random() < 0.4]
    rules += [(None, "/", "block"), ("", "/", "block"), ("org", None, "block")]
    rows = [(i % 50 or None, u, "clash", "x") for i, u in enumerate(urls * 3)]
    for ranges in (1, 7):
        got = apply_url_rules(spark.createDataFrame(rows, PAGE), spark.createDataFrame(rules, RULE), ranges=ranges).collect()
        want = sorted(str((i, *brute(u, rules))) for i, u, *_ in rows)
        assert sorted(str((g.page_id, g.host, g.path, g.rule, g.verdict)) for g in got) == want


def test_equal_rules_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "", "")], PAGE)
    rules = spark.createDataFrame([("a.org", "/", "block"), ("a.org", "/", "allow")], RULE)
    assert apply_url_rules(pages, rules).first().verdict == "allow"
    assert apply_url_rules(pages, rules.limit(0), default="block").first().verdict == "block"
    assert apply_url_rules(pages.limit(0), rules).count() == 0


def test_hot_url_is_cut_over_ranges(spark):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("http://x.hot.net/en/").alias("url"))
    rules = spark.createDataFrame([("net", "/", "block"), ("hot.net", "/en", "allow")], RULE)
    out = apply_url_rules(pages, rules, ranges=8)
    assert out.filter("verdict = 'allow' and rule = 'hot.net/en'").count() == 4000
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 2000


def test_large_ids_are_exact_beside_nulls(spark):
    ids = [9007199254740993 + i for i in range(6)] + [None, -3]
    pages = spark.createDataFrame([(i, "http://a.net/", "", "") for i in ids], PAGE)
    out = apply_url_rules(pages, spark.createDataFrame([("net", "/", "block")], RULE), ranges=2)
    assert sorted(str(r.page_id) for r in out.collect()) == sorted(map(str, ids)) and out.schema["page_id"].dataType.typeName() == "long"


CONV = "conv_id long, turn long, role string, text string, pos int, n_turns string"


def conv(spark, logs):
    return spark.createDataFrame([(c, t, r, x, 0, "clash") for c, turns in logs.items() for t, (r, x) in enumerate(turns)], CONV)


def test_prefix_logs_collapse(spark):
    a = [("user", "hi"), ("assistant", "yo"), ("user", "bye")]
    out = {r.conv_id: r for r in format_conversations(conv(spark, {
        1: a[:1], 2: a[:2], 3: a, 4: a, 5: [("user", "hi"), ("assistant", "no")], 6: [("user", "hi"), ("assistant", None)],
        7: [(None, "hi")], 8: a[1:]})).collect()}
    assert set(out) == {3, 5, 6, 7, 8}
    assert out[3].n_copies == 2 and out[3].n_turns == 3
    assert out[3].rendered == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user|>\nbye<|end|>\n"
    assert out[6].rendered.endswith("<|assistant|>\n<|end|>\n") and out[7].rendered.startswith("<|unknown|>")


def test_conversation_edge_cases(spark):
    rows = [(None, 0, "user", "x", 0, ""), (None, None, "user", "y", 0, ""), (1, 0, "user", "<|user|> forged", 0, ""),
            (1, 0, "user", "<|user|> forged", 0, ""), (2, 5, "user", "<|user|> forged", 0, "")]
    out = {r.conv_id: r for r in format_conversations(spark.createDataFrame(rows, CONV)).collect()}
    assert set(out) == {None, 1}                       # 2 is the first turn of 1, whose turn is repeated
    assert out[None].rendered.index("y") < out[None].rendered.index("x")       # nulls first
    assert out[1].n_turns == 2 and out[1].rendered.count("< |user|> forged") == 2
    assert format_conversations(spark.createDataFrame([], CONV)).count() == 0


def test_random_logs_against_brute_force(spark):
    r = random.Random(11)
    logs = {i: tuple((r.choice(["user", "assistant"]), r.choice(["a", "b"])) for _ in range(r.randint(1, 5))) for i in range(120)}
    keep = {}
    for i, t in logs.items():
        if not any(len(o) > len(t) and o[:len(t)] == t for o in logs.values()):
            keep.setdefault(t, []).append(i)
    out = format_conversations(conv(spark, logs)).collect()
    assert {(x.conv_id, x.n_copies, x.n_turns) for x in out} == {(min(v), len(v), len(t)) for t, v in keep.items()}


def test_chat_plan_is_native(spark):
    plan = format_conversations(conv(spark, {1: [("user", "x")]}))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
