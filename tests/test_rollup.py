import json
import math

import pytest
from pyspark.sql import functions as F

from verdikt.operators import rollup
from verdikt.operators.resume import score_pending
from verdikt.sources import jsonl, sinks

# Published scores per task of one run (rows, score) and its macro mean.
TASKS = {
    "bug": (8, 0.25), "custom": (8, 1.0), "dev": (8, 0.5703125), "devops": (8, 0.7769791666666667),
    "plan": (18, 0.8236111111111111), "qe": (16, 0.27165364583333335), "review": (8, 0.0),
}
OVERALL = 0.5275080605158731


def sums(spark, run="baseline", tasks=TASKS):
    rows = [(run, "real", t, n, *[n * s] * 6) for t, (n, s) in tasks.items()]
    return spark.createDataFrame(
        rows,
        "run string, slice string, task string, n bigint, emitted double, schema double, enums double, "
        "rigor double, clean double, score double",
    )


def test_overall_is_a_mean_of_task_means(spark):
    row = rollup.overall(sums(spark)).first()
    assert row.n == 74 and row.score == pytest.approx(OVERALL, abs=1e-12)
    assert rollup.by_slice(sums(spark)).first().score == pytest.approx(OVERALL, abs=1e-12)


def test_run_table_gains_and_dead_runs(spark):
    dead = {t: (n, 0.0) for t, (n, _) in TASKS.items()}
    both = sums(spark).unionByName(sums(spark, "smoke_x", dead).withColumn("slice", F.lit("gen")))
    table = {r.run: r for r in rollup.run_table(both).collect()}
    assert math.isnan(table["smoke_x"].real_score)
    assert [r.run for r in rollup.dead_runs(rollup.overall(both)).collect()] == ["smoke_x"]
    assert rollup.exclude_smoke(rollup.overall(both)).count() == 1
    gains = {r.task: r for r in rollup.compare_runs(rollup.by_task(both), "smoke_x", "baseline").collect()}
    assert gains["bug"].ratio == pytest.approx(0.25 / 1e-9)


def test_results_file(spark, tmp_path):
    cell = {"n": 8, "emit_rate": 0.25, "schema": 0.25, "enums": 0.25, "rigor": 0.25, "clean": 0.25, "score": 0.25}
    run = {"tasks": {"bug": cell}, "overall": cell, "extract_modes": {"clean": 2}, "by_slice": {"real": cell}, "elapsed_s": 7}
    path = tmp_path / "results.json"
    path.write_text(json.dumps({"baseline": run, "tuned": run}, indent=2))
    rows = jsonl.read_results(spark, str(path)).collect()
    assert len(rows) == 6 and {r.scope for r in rows} == {"task", "slice", "overall"}
    assert all(r.score == 0.25 and r.n == 8 for r in rows)


def test_replacing_one_run_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "runs")
    sinks.replace_runs(spark.createDataFrame([("a", 1), ("b", 2)], "run string, x int"), path)
    sinks.replace_runs(spark.createDataFrame([("b", 3)], "run string, x int"), path)
    assert sorted((r.run, r.x) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_raw_answers_are_cut_on_request(spark):
    df = spark.createDataFrame([("a", 1, "bug", "gen", "x" * 30_000, 99, 100)], "run string, row_id bigint, task string, slice string, raw string, new_tokens int, cap int")
    row = sinks.raw_answers(df, max_chars=24_000).first()
    assert len(row.raw) == 24_000 and row.hit_cap


def test_stale_saved_state_is_ignored(spark):
    answers = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "run string, row_id bigint")
    done = spark.createDataFrame([("a", 1), ("b", 1)], "run string, row_id bigint")
    saved = spark.createDataFrame([("a", 2), ("b", 9)], "run string, n_rows bigint")
    left = score_pending(answers, done, saved).collect()
    assert sorted((r.run, r.row_id) for r in left) == [("a", 2), ("b", 1)]
