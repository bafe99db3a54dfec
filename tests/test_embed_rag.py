"""Embedder (M1), prompt (X8), generator (M2) and batch RAG."""

import math

from pyspark.sql import functions as F

from kbspark.functions.text import build_prompt, has_text
from kbspark.operators.embed import BatchModelEmbedder, HashingEmbedder
from kbspark.operators.rag import rag


def test_hashing_embedder_unit_and_blank(spark):
    e = HashingEmbedder(16)
    df = spark.createDataFrame([(1, "Hello hello world"), (2, "   "), (3, ""), (4, None), (5, "\tHELLO\n")],
                               "i int, t string")
    got = {r.i: r.v for r in df.select("i", e.embed(F.col("t")).alias("v")).collect()}
    assert got[2] is None and got[3] is None and got[4] is None
    assert abs(math.sqrt(sum(x * x for x in got[1])) - 1) < 1e-6
    assert len(got[1]) == 16 and sum(1 for x in got[5] if x) == 1


def test_model_embedder_isolates_failures(spark):
    def fn(texts):
        if any(t == "boom" for t in texts):
            raise RuntimeError("model down")
        return [[1.0, float(len(t))] if t != "short" else [1.0] for t in texts]
    e = BatchModelEmbedder(fn, dim=2)
    df = spark.createDataFrame([("ok",), ("boom",), ("short",)], "t string").coalesce(1)
    got = {r.t: r.v for r in df.select("t", e.embed("t").alias("v")).collect()}
    assert got["ok"] == [1.0, 2.0] and got["boom"] is None and got["short"] is None


def test_model_generator_batches_and_isolation(spark):
    from kbspark.operators.generate import BatchModelGenerator
    calls = []

    def fn(prompts):
        calls.append(len(prompts))
        if "bad" in prompts:
            raise RuntimeError("x")
        return [p.upper() for p in prompts]
    g = BatchModelGenerator(fn, batch_size=2)
    df = spark.createDataFrame([("a",), ("b",), ("bad",), ("c",)], "p string").coalesce(1)
    got = [r.r for r in df.select(g.generate(F.col("p"), F.lit(None)).alias("r")).collect()]
    assert got == ["A", "B", None, "C"]


def test_embed_documents_error_column(spark):
    from kbspark.operators.embed import embed_documents

    def fn(texts):
        return [[1.0, 0.0] if t != "bad" else [] for t in texts]
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, " ")], "i int, content string")
    got = {r.i: r.embed_error for r in embed_documents(df, embedder=BatchModelEmbedder(fn, 2)).collect()}
    assert got == {1: None, 2: "embedding failed", 3: None}      # the model embeds blank text
    got = {r.i: r.embed_error for r in embed_documents(df, embedder=HashingEmbedder(8)).collect()}
    assert got == {1: None, 2: None, 3: "blank text"}


def test_blank_detection(spark):
    df = spark.createDataFrame([("",), (" ",), ("\t",), ("\n",), (" ",), (" x",)], "t string")
    assert [r.b for r in df.select(has_text("t").alias("b")).collect()] == [False] * 5 + [True]


def test_prompt_template_and_percent(spark):
    df = spark.createDataFrame([(["100% sure", "b"], "why %s?"), ([], "q")], "c array<string>, q string")
    p = [r.p for r in df.select(build_prompt("c", "q").alias("p")).collect()]
    assert p[0] == ("Use the following information to answer the question:\n\nContext:\n100% sure\n\nb"
                    "\n\nQuestion: why %s?\n\nAnswer:")
    assert p[1] == "Use the following information to answer the question:\n\nContext:\n\n\nQuestion: q\n\nAnswer:"


def test_rag_no_match_keeps_prompt(spark):
    e = HashingEmbedder(4096)
    kb = spark.createDataFrame([(1, "1", "alpha beta gamma"), (2, "2", "alpha beta"), (3, "3", "delta")],
                               "id long, doc_id string, content string").withColumn("embedding", e.embed("content"))
    qs = spark.createDataFrame([(10, "alpha beta"), (11, "zzz qqq")], "query_id long, query string")
    out = {r.query_id: r for r in rag(qs, kb, k=10, threshold=0.5, embedder=e).collect()}
    assert out[10].sources == ["2", "1"] and out[10].response == "alpha beta"
    assert out[11].sources is None and out[11].response == ""
    assert "Context:\n\n\nQuestion: zzz qqq" in out[11].prompt


def test_rag_query_groups_equal_single_group(spark, monkeypatch):
    import kbspark.operators.rag as R
    e = HashingEmbedder(64)
    kb = spark.createDataFrame([(i, str(i), f"w{i % 5} w{i % 3} common") for i in range(40)],
                               "id long, doc_id string, content string").withColumn("embedding", e.embed("content"))
    qs = spark.createDataFrame([(j, f"w{j % 5} common") for j in range(12)], "query_id long, query string")
    one = sorted((r.query_id, tuple(r.sources or ())) for r in R.rag(qs, kb, k=4, threshold=0.3, embedder=e).collect())
    monkeypatch.setattr(R, "MATCH_BROADCAST_ROWS", 10)            # forces 5 query groups
    many = sorted((r.query_id, tuple(r.sources or ())) for r in R.rag(qs, kb, k=4, threshold=0.3, embedder=e).collect())
    assert one == many and len(one) == 12
