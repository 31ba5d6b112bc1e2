"""Queries of these operators for the driver, with production parameters over whole tables, and their SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, host_rules, minhash, nn_descent, packing, pseudo_likelihood, quality_bt, substring_dedup, token_store, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_store.read_store(token_store.write_store(docs, token_store.store_folder(docs), "word_bpe_49k.json", 2), digest=True)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 1, 2048, digest=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bt.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score(table(spark, sf_dir, "documents"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.apply_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_bpe, op2_toxicity, op3_substring_dedup, op4_token_store, op5_minhash, op6_nn_descent, op7_packing, op8_quality, op9_pseudo_likelihood, op10_host_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": substring_dedup.ORACLE_SQL, "op5_minhash": minhash.ORACLE_SQL, "op6_nn_descent": nn_descent.ORACLE_SQL, "op10_host_rules": host_rules.ORACLE_SQL}
