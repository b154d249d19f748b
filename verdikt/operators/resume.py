"""Score only what has not been scored yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.session import few

KEY = ["run", "row_id"]


def score_pending(completions: DataFrame, done: DataFrame, saved: DataFrame) -> DataFrame:
    """The answers whose key is not among the ``done`` keys.

    ``saved`` tells, per run, for how many rows the saved state was made; the
    state of a run that now has another number of rows is ignored.
    """
    now = completions.groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"))
    valid = saved.join(now, ["run", "n_rows"], "left_semi").select("run")
    # The join that moves rows is on the whole key; a run alone is a hot key.
    usable = done.select(*KEY).join(few(valid), "run", "left_semi")
    return completions.join(usable, KEY, "left_anti")


def resumed(completions: DataFrame, done: DataFrame, saved: DataFrame, score) -> DataFrame:
    """Every answer's scores, the ``done`` ones taken over, the rest scored.

    ``done`` holds scored rows; those that no longer fit are scored again.
    """
    fresh = score_pending(completions, done, saved)
    now = completions.groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"))
    valid = saved.join(now, ["run", "n_rows"], "left_semi").select("run")
    kept = done.join(few(valid), "run", "left_semi").join(completions.select(*KEY), KEY, "left_semi")
    return kept.unionByName(score(fresh).select(*kept.columns))
