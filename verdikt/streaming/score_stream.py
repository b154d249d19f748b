"""Score a growing folder of answers, exactly once per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdikt.operators.resume import KEY
from verdikt.operators.score import score
from verdikt.streaming import sink

SCORED = (
    "run string, row_id bigint, task string, slice string, extract string, chars int, emitted int, "
    "schema double, enums double, rigor double, clean double, score double, notes array<string>, batch bigint"
)
INPUT = ["run", "row_id", "task", "slice", "raw"]


#: How long the stream itself remembers keys; the sink knows them for ever.
REMEMBERED = "1 hour"

#: The remembered keys lie in RocksDB, on disk: Spark's own store keeps every key
#: of the hour in the executors' heaps. All stores of an executor share one
#: budget of memory, and no rows are counted, which would look up each key again.
STORE = "spark.sql.streaming.stateStore"
KEY_STORE = {
    f"{STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{STORE}.rocksdb.maxMemoryUsageMB": "200",
    f"{STORE}.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def keys_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state by ``KEY_STORE``, but for what the
    session sets itself. A checkpoint that exists goes on with its own store."""
    ours = [name for name in KEY_STORE if spark.conf.get(name, None) is None]
    for name in ours:
        spark.conf.set(name, KEY_STORE[name])
    try:
        yield
    finally:
        for name in ours:
            spark.conf.unset(name)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return sink.rows_of(spark, path, SCORED)


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch scores the keys that the sink doesn't hold yet."""

    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        columns = [c.split()[0] for c in SCORED.split(", ")]

        def scored(new: DataFrame) -> DataFrame:
            return score(new).withColumn("batch", F.lit(batch_id).cast("bigint")).select(*columns)

        # The stream's state and sources are read once, not at each look-up.
        with sink.staged(batch, path, query) as held:
            # A batch without rows only moves the watermark.
            if rows := held.count():
                sink.commit(held, path, query, batch_id, scored, rows)

    return write


def score_stream(answers: DataFrame, path: str, checkpoint: str, remembered: str = REMEMBERED, **trigger) -> StreamingQuery:
    """Start scoring a stream of answers into the sink ``path``.

    A key is scored once, however often it comes. The stream's state drops keys
    after ``remembered``, by the time of their arrival; a repeat that comes later
    is found in the sink. Of two texts with the same key, one is scored: the
    earlier batch's, or any within a batch.
    """
    once = (
        answers.select(*INPUT)
        .withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", remembered)
        .dropDuplicatesWithinWatermark(KEY)
        .drop("_arrived")
    )
    with keys_on_disk(answers.sparkSession):
        return (
            once.writeStream.foreachBatch(write_batch(path))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
