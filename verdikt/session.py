"""Session settings the operators are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The scorer's row function is large; beyond this size the JVM would not
    # compile one fused method, so let Spark split it instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Call sites on every column expression cost more than planning itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Answers can be long; smaller Arrow batches keep Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("verdikt")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.verdikt.input.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a session without the setting (tests on one machine) gets a
    temporary folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="verdikt-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows of a side that may be sent to every task: some megabytes.
FEW = 100_000


def few(rows: DataFrame) -> DataFrame:
    """A side of a join: broadcast if it is counted to be small, else as it is."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def materialize(df: DataFrame) -> DataFrame:
    """Compute a small table once, in the shared folder, for several uses."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
