"""Result tables, partitioned by run so that a run is replaced alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_runs(df: DataFrame, path: str, by: str = "run") -> None:
    """Write these runs over their own partitions, keep all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def raw_answers(completions: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Answers are kept whole, so that they can be scored again; ``max_chars``
    asks for a short form."""
    raw = F.col("raw") if max_chars is None else F.substring("raw", 1, max_chars)
    return completions.select(
        "run",
        "row_id",
        "task",
        "slice",
        raw.alias("raw"),
        "new_tokens",
        "cap",
        (F.col("new_tokens") >= F.col("cap") - 1).alias("hit_cap"),
    )


def write_raw(completions: DataFrame, path: str, max_chars: int | None = None) -> None:
    """A5: raw answers with slice, tokens and cap flag."""
    replace_runs(raw_answers(completions, max_chars), path)


def nested_results(tasks: DataFrame, overall: DataFrame, slices: DataFrame, modes: DataFrame) -> DataFrame:
    """One JSON document per run, from the roll-ups (a few rows per run each)."""
    metrics = ["n", "emit_rate", "schema", "enums", "rigor", "clean", "score"]

    def as_map(df: DataFrame, name: str, value, alias: str) -> DataFrame:
        entries = F.collect_list(F.struct(F.col(name), value))
        return df.groupBy("run").agg(F.map_from_entries(F.array_sort(entries)).alias(alias))

    cell = F.struct(*metrics)
    parts = (
        overall.select("run", cell.alias("overall"))
        .join(as_map(tasks, "task", cell, "tasks"), "run")
        .join(as_map(slices, "slice", cell, "by_slice"), "run")
        .join(as_map(modes, "extract", F.col("n"), "extract_modes"), "run")
    )
    document = F.struct("tasks", "overall", "extract_modes", "by_slice")
    return parts.select("run", F.to_json(F.map_from_arrays(F.array("run"), F.array(document))).alias("document"))


def results_documents(nested: DataFrame, modes: DataFrame, capped: DataFrame, conditions: DataFrame) -> DataFrame:
    """``nested_results`` with nothing left out: the answers that ran into
    their cap by task, and the conditions a run was made under."""

    def as_map(df: DataFrame, name: str, value, alias: str) -> DataFrame:
        entries = F.collect_list(F.struct(F.col(name), value))
        return df.groupBy("run").agg(F.map_from_entries(F.array_sort(entries)).alias(alias))

    caps = as_map(capped, "task", F.struct("hits", F.col("of")), "hit_cap")
    settings = conditions.select("run", F.struct("eval_dtype", "four_bit", "greedy", "cap_of", "n_rows").alias("conditions"))
    more = as_map(modes, "extract", F.col("n"), "extract_modes").join(settings, "run").join(caps, "run", "left")
    extra = F.to_json(F.struct("extract_modes", "hit_cap", "conditions"))
    return nested.join(more, "run").select("run", "document", extra.alias("more"))


def write_results(documents: DataFrame, path: str) -> None:
    """One line per run: its name, the scores' document, and the rest."""
    documents.select(F.to_json(F.struct("run", "document", "more")).alias("value")).write.text(path)
