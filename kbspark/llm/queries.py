"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kbspark.llm import (backoff_lm, bins, chosen_path, exact, hyperplanes, langid, norm_buckets, periodic, phrases, piece_bpe, snapshots, toxicity,
                         url_rules)
from kbspark.session import ship_package

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_url_filters", url_rules.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, action string")
    return url_rules.apply_url_rules(table(spark, sf_dir, "pages"), rules)


@register("op2_minhash_near_dedup", chosen_path.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@register("op3_embedding_near_dedup", hyperplanes.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperplanes.embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


@register("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return piece_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op5_exact_topk", norm_buckets.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = norm_buckets.integer_vectors(table(spark, sf_dir, "embeddings"))
    return norm_buckets.top_products(v, v.filter("vec_id % 50 = 0"), k=5)


@register("op6_lm_scoring", backoff_lm.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score_documents(table(spark, sf_dir, "documents"))


@register("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op8_chat_formatting", snapshots.ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.format_conversations(table(spark, sf_dir, "conversations"))


@register("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.packed_pieces(table(spark, sf_dir, "documents"))


@register("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_query(table(spark, sf_dir, "documents"))


@register("op11_exact_dedup", exact.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


@register("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents"))


@register("op13_phrase_collocations", phrases.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), min_count=100, max_words=5, top=2000)
