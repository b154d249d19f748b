"""Prompt corpora derived from the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.operators.contracts import TASKS
from verdikt.operators.corpus import messages_of
from verdikt.plans.completions import choice
from verdikt.plans.partitions import spread
from verdikt.sources.tables import table

SPLIT = "CASE WHEN {0} % 10 IN (0, 1) THEN 'val' WHEN {0} % 10 = 2 THEN 'test_real' WHEN {0} % 10 IN (3, 4) THEN 'test_gen' ELSE 'train' END"
KEY = ["conv_id", "turn"]


def chat_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per assistant turn: system text, preceding user turn, answer.

    Turns are paired by a join on (conversation, turn), so a hot conversation
    spreads over all tasks and no conversation is ever collected. Repeated rows
    of a turn all stay. The system text is one row per conversation; a join
    skewed by a hot conversation is split by adaptive execution.
    """
    turns = table(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'").select(*KEY, F.col("text").alias("answer"))
    users = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("user"))
    paired = answers.join(users, KEY, "left")
    system = turns.where("role = 'system'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("system"))
    return paired.join(system, "conv_id", "left").select(
        *KEY,
        F.expr(SPLIT.format("conv_id")).alias("split"),
        F.expr(choice("conv_id % 7", TASKS)).alias("task"),
        messages_of(F.col("system"), F.col("user"), F.col("answer")).alias("messages"),
    )


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its whole text is the target. Tasks are languages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return spread(docs, "doc_id").select(
        "doc_id",
        F.expr(SPLIT.format("doc_id")).alias("split"),
        F.col("lang").alias("task"),
        messages_of(
            F.concat(F.lit("Write in "), "lang"), F.concat(F.lit("A text like those of "), "source"), F.col("text")
        ).alias("messages"),
    )


def split(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name)
