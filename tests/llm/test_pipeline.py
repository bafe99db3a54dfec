import os
import random

from pyspark.sql import functions as F

import corpus_pipeline
from kbspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    import __spark_entry__ as e
    names = [n.split("_")[0] for n in QUERIES]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())


def test_stages_on_planted_cases(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(4)
    base = [f"{a}{b}" for a in ("the", "an", "re", "st") for b in ("ing", "er", "on", "at", "ed", "nd")]
    clean = " ".join(r.choice(base) for _ in range(120)) + "."
    near = clean.replace(clean.split()[60], "changed", 1)
    planted = [(900001, clean), (900002, clean), (900003, near), (900004, " ".join(r.choice(base) for _ in range(90)) + "."), (900005, None), (900006, "123 456")]
    extra = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in planted], docs.schema)
    docs = docs.unionByName(extra)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            kept[name] = {x.doc_id for x in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_duplicates", "packing"]
    assert {900001, 900002, 900003, 900004, 900005, 900006} <= kept["toxicity"]
    assert {900001, 900002, 900003, 900004} <= kept["language_id"] and not {900005, 900006} & kept["language_id"]
    assert {900001, 900004} <= kept["near_duplicates"] and not {900002, 900003} & kept["near_duplicates"]
    packed = docs.select(F.explode("doc_ids").alias("d"), "n_tokens", "capacity")
    assert {x.d for x in packed.collect()} == kept["near_duplicates"] and packed.filter("n_tokens > capacity").count() == 0


def test_run_and_empty_table(spark, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"bin_id", "capacity", "doc_ids", "text"} <= set(out.columns)
    d = str(tmp_path / "sf")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(os.path.join(d, f"{t}.parquet"))
    assert corpus_pipeline.run(spark, d).count() == 0
