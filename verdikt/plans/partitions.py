"""Partitioning of inputs that are too few for the work that follows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame

#: Unset by default. A session that reads small files in one partition (tests,
#: the bench) sets it to the number of partitions its inputs should have.
INPUT_PARTITIONS = "spark.verdikt.input.partitions"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows over as many partitions as the session asks for, if it does.

    Keys should be unique, so that no partition is hot. Without the setting the
    partitions of the source stay and nothing is shuffled.
    """
    wanted = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(wanted), *keys) if wanted else df


#: Rows a task takes where much work follows each: some seconds. Beyond ``MOST``
#: tasks each takes more, so that the blocks between them stay few.
ROWS, MOST = 25_000, 4_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Deal narrow rows, from each of which much follows, evenly over tasks.

    Files are split by their bytes and row groups: a small file of many rows
    leaves most cores idle, and two row groups in one split double the time.
    Rows are counted (of Parquet, from the footers) and dealt in turn, whatever
    their keys. A session that asks for a number of partitions gets that. Where
    rows cannot be counted, as a stream's, ``rows`` is their number.
    """
    if df.sparkSession.conf.get(INPUT_PARTITIONS, None):
        return spread(df, *keys)
    tasks = min(MOST, ceil((df.count() if rows is None else rows) / ROWS))
    return df.repartition(tasks) if tasks > 1 else df
