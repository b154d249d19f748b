"""Roll-ups of scored answers.

One pass over the scored rows leaves sums and counts per run, slice and task,
combined before the shuffle; that table has a few rows per run, and every
roll-up below is derived from it. A hot task or slice therefore never lands in
one task as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.operators.score import METRICS

CELL = ["run", "slice", "task"]


def task_sums(scored: DataFrame, *more: str) -> DataFrame:
    """Row count and metric sums per run, slice, task and any further keys."""
    sums = [F.sum(F.col(m).cast("double")).alias(m) for m in METRICS]
    return scored.groupBy(*CELL, *more).agg(F.count(F.lit(1)).alias("n"), *sums)


def cell_sums(sums: DataFrame) -> DataFrame:
    """Sums per run, slice and task, from sums with further keys."""
    return sums.groupBy(*CELL).agg(F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in METRICS])


def mode_counts(sums: DataFrame) -> DataFrame:
    """B8 from sums that also have the extraction mode as a key."""
    return sums.groupBy("run", "extract").agg(F.sum("n").alias("n"))


def _means(sums: DataFrame, *keys: str) -> DataFrame:
    """Means per key from sums; ``emitted`` becomes the emit rate."""
    means = [(F.sum(m) / F.sum("n")).alias("emit_rate" if m == "emitted" else m) for m in METRICS]
    return sums.groupBy(*keys).agg(F.sum("n").alias("n"), *means)


RATES = ["emit_rate", "schema", "enums", "rigor", "clean", "score"]


def _macro(task_means: DataFrame, *keys: str) -> DataFrame:
    """Mean of task means, so that a task with many rows cannot dominate."""
    return task_means.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.avg(r).alias(r) for r in RATES])


def by_task(sums: DataFrame) -> DataFrame:
    """H1: rows and mean metrics per run and task."""
    return _means(sums, "run", "task")


def overall(sums: DataFrame) -> DataFrame:
    """H2: per run, the mean of its task means."""
    return _macro(by_task(sums), "run")


def by_slice(sums: DataFrame) -> DataFrame:
    """H3: the same inside each slice, over the tasks present in it."""
    return _macro(_means(sums, *CELL), "run", "slice")


def hit_cap(completions: DataFrame) -> DataFrame:
    """H4: per run and task with any, answers that ran into their token cap."""
    capped = F.count_if(F.col("new_tokens") >= F.col("cap") - 1)
    counts = completions.groupBy("run", "task").agg(capped.alias("hits"), F.count(F.lit(1)).alias("of"))
    return counts.where("hits > 0")


def run_table(sums: DataFrame) -> DataFrame:
    """H5: one row per run, with the real slice's score (NaN if absent).

    ``sums`` is used twice; materialize it if it is expensive.
    """
    slices = by_slice(sums)
    real = slices.groupBy("run").agg(F.max(F.when(F.col("slice") == "real", F.col("score"))).alias("real_score"))
    joined = overall(sums).join(real, "run", "left")
    return joined.withColumn("real_score", F.coalesce("real_score", F.lit(float("nan"))))


def compare_runs(means: DataFrame, before: str, after: str, on: str = "task") -> DataFrame:
    """H5: absolute gain and ratio of the score between two runs, where both exist.

    An aggregate over one pass instead of a self-join over two.
    """
    sides = {"before": before, "after": after}
    picked = means.groupBy(on).agg(
        *[F.max(F.when(F.col("run") == run, F.col("score"))).alias(side) for side, run in sides.items()]
    )
    return picked.where("before IS NOT NULL AND after IS NOT NULL").select(
        "*",
        (F.col("after") - F.col("before")).alias("gain"),
        (F.col("after") / F.greatest("before", F.lit(1e-9))).alias("ratio"),
    )


def exclude_smoke(df: DataFrame) -> DataFrame:
    """H6: without wiring checks, the runs named ``smoke_*``."""
    return df.where(~F.col("run").startswith("smoke_"))


def dead_runs(overalls: DataFrame) -> DataFrame:
    """H7: runs in which no answer parsed; a broken harness, not a bad model."""
    return overalls.where("emit_rate = 0").select("run", "n")


def task_matrix(means: DataFrame, runs: list[str]) -> DataFrame:
    """H8: the score of each task, one column per run."""
    return means.groupBy("task").pivot("run", runs).agg(F.first("score"))


CONDITIONS = ["eval_dtype", "four_bit", "greedy", "cap_of"]


def conditions(completions: DataFrame, settings: DataFrame) -> DataFrame:
    """H9: the conditions each run was made under, and its number of rows.

    ``settings`` holds one row per run: ``eval_dtype``, ``four_bit``,
    ``greedy``. The caps are read off the answers themselves.
    """
    caps = completions.groupBy("run", "task").agg(F.count(F.lit(1)).alias("n"), F.max("cap").alias("cap"))
    per_run = caps.groupBy("run").agg(
        F.sum("n").alias("n_rows"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("task", "cap"))),
                lambda x: F.concat(x["task"], F.lit("="), x["cap"].cast("string")),
            ),
            ",",
        ).alias("cap_of"),
    )
    return per_run.join(settings, "run")


def like_runs(run_conditions: DataFrame) -> DataFrame:
    """H9: runs grouped by equal conditions; only these may be compared."""
    grouped = run_conditions.groupBy(*CONDITIONS, "n_rows")
    return grouped.agg(F.count(F.lit(1)).alias("runs"), F.array_join(F.array_sort(F.collect_list("run")), ",").alias("names"))
