"""Narrow rows are dealt evenly over tasks, whatever their files and keys."""

import pytest

from verdikt.plans import partitions
from verdikt.plans.completions import completions


@pytest.fixture
def unset(spark):
    """The session as a cluster has it: without a number of partitions asked for."""
    wanted = spark.conf.get(partitions.INPUT_PARTITIONS, None)
    spark.conf.unset(partitions.INPUT_PARTITIONS)
    yield
    if wanted:
        spark.conf.set(partitions.INPUT_PARTITIONS, wanted)


def test_answers_of_one_small_file_go_to_many_tasks(spark, tmp_path, monkeypatch, unset):
    monkeypatch.setattr(partitions, "ROWS", 100)
    orders = spark.range(1000, numPartitions=1).selectExpr(
        # Half of the keys are null, and no key may decide where its row goes.
        "IF(id % 2 = 0, null, id) o_orderkey", "id o_custkey", "id * 1.5D o_totalprice", "'1-URGENT' o_orderpriority", "'F' o_orderstatus"
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    answers = completions(spark, str(tmp_path)).select("run", "row_id", "new_tokens")
    sizes = answers.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 2000
    assert len(sizes) == 10 and max(sizes) <= 220


def test_few_rows_stay_where_they_are(spark, unset):
    few = spark.range(50, numPartitions=1)
    assert partitions.dealt(few).rdd.getNumPartitions() == 1


def test_tasks_are_bounded(spark, monkeypatch, unset):
    monkeypatch.setattr(partitions, "ROWS", 10)
    monkeypatch.setattr(partitions, "MOST", 7)
    assert partitions.dealt(spark.range(1000, numPartitions=1)).rdd.getNumPartitions() == 7


def test_rows_that_cannot_be_counted_are_dealt_by_their_number(spark, monkeypatch, unset):
    monkeypatch.setattr(partitions, "ROWS", 100)
    stream = spark.readStream.format("rate").load()
    plan = partitions.dealt(stream, rows=1000)._jdf.queryExecution().logical().toString()
    assert "Repartition 10, true" in plan
