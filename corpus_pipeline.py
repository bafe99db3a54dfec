"""Corpus pipeline: toxicity filter, language ID, near-duplicates, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``; the last returns one row per packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kbspark.llm import bins, chosen_path, langid, toxicity
from kbspark.session import scratch_dir, ship_package

#: SQL cannot express the learnt stages; tests hold the stages against brute force.
ORACLE_SQL = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic (at least 0.5) go. Learnt from the table ``labels``."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go."""
    ship_package(spark)
    return langid.drop_unidentified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8 or more."""
    ship_package(spark)
    return chosen_path.drop_near_duplicates(docs, words=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of the permitted lengths."""
    ship_package(spark)
    return bins.pack_documents(docs)


STAGES = [("toxicity", toxicity_filter), ("language_id", language_filter), ("near_duplicates", near_duplicates), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_dir(spark, "pipeline")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return docs
