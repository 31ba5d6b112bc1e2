"""From raw documents to packed training sequences: STAGES in order, each on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import host_rules, minhash, packing, substring_dedup, toxicity
from traceloom.llm.shared import crc_of_id, dropped, free_names, scratch, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels, crc_of_id(F.col("doc_id")) % 4 == 2)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or a rule on a host of bad verdict, go."""
    return host_rules.without_failed(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.without_duplicates(docs)


def repeated_passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the text; n_chars, where there is one, follows."""
    counts = tuple(free_names(docs.columns, "n_words", "n_removed"))
    out = substring_dedup.remove_repeats(docs, counts=counts)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(counts[1]) > 0, length).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.pack(docs, "byte_bpe_50k.json", 1, 2048)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_rules_stage),
    ("near duplicates", near_duplicates_stage),
    ("repeated passages", repeated_passages_stage),
    ("packing", packing_stage),
]

#: No SQL for a trained model, a tokenizer or components; tests hold each stage on its own input against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), path := scratch(spark, "pipeline"))
        if before is not None:
            dropped(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
