"""A corpus pipeline of five operators: each stage works on what the last kept."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from verdikt.llm import decontaminate, jaccard, language, mixing, wavelet
from verdikt.llm.rows import row_key, without
from verdikt.llm.store import scratch, stored


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID learns from the labelled texts; what it rejects goes."""
    return language.recognised(docs, language.train(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose five-word shingles are alike by 0.8 and more: one stays."""
    return jaccard.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of which a twentieth or more is in benchmark windows go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.select(row_key("doc_id", "text").alias("key"), "text")
    found = decontaminate.contamination(keyed, items, id_col="key")
    return without(docs, found.where(decontaminate.is_contaminated()).withColumnRenamed("id", "key"), "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as often as the mix takes it."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; a row per document read back from them."""
    path = scratch(spark, "tokens")
    wavelet.write_tokens(docs, path, tokenizer_path("byte_bpe_50k.json"))
    shards = wavelet.read_shards(spark, path, docs.schema["doc_id"].dataType)
    return wavelet.token_digests(shards).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

#: Training a classifier and subword encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
