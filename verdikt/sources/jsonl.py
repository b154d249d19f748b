"""JSON-lines corpora and nested result files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "array<struct<role: string, content: string>>"
CORPUS = f"row_id bigint, split string, task string, messages {MESSAGES}"
METRICS = "n: bigint, emit_rate: double, schema: double, enums: double, rigor: double, clean: double, score: double"
RESULTS = (
    f"map<string, struct<tasks: map<string, struct<{METRICS}>>, overall: struct<{METRICS}>, "
    f"extract_modes: map<string, bigint>, by_slice: map<string, struct<{METRICS}>>>>"
)


def read_or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    """What ``read`` returns, or no rows if its path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_split(spark: SparkSession, folder: str, name: str, schema: str = CORPUS, layout: str = "{}.jsonl") -> DataFrame:
    """A1: a split of a corpus; a missing file is an empty split.

    Only the declared columns are parsed. A malformed line stops the read.
    ``layout`` tells where a split lies; ``write_splits`` uses ``PARTED``.
    """
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    read = read_or_empty(spark, lambda: reader.json(f"{folder}/{layout.format(name)}"), schema)
    return read.withColumn("split", F.lit(name)) if layout == PARTED else read


PARTED = "split={}"


def write_splits(df: DataFrame, folder: str) -> None:
    """All splits of a corpus as JSON lines, in one pass over it."""
    df.write.partitionBy("split").json(folder)


def explode_results(df: DataFrame, document: Column) -> DataFrame:
    """Nested results as rows: run, scope (task, slice, overall), name, metrics."""
    runs = df.select(F.explode(F.from_json(document, RESULTS)).alias("run", "r"))
    one = F.map_from_arrays(F.array(F.lit("all")), F.array(F.col("r.overall")))
    scopes = F.array(
        F.struct(F.lit("task").alias("scope"), F.col("r.tasks").alias("cells")),
        F.struct(F.lit("slice").alias("scope"), F.col("r.by_slice").alias("cells")),
        F.struct(F.lit("overall").alias("scope"), one.alias("cells")),
    )
    scoped = runs.select("run", F.inline(scopes))
    return scoped.select("run", "scope", F.explode("cells").alias("name", "m")).select("run", "scope", "name", "m.*")


MORE = (
    "extract_modes map<string, bigint>, hit_cap map<string, struct<hits: bigint, `of`: bigint>>, "
    "conditions struct<eval_dtype: string, four_bit: boolean, greedy: boolean, cap_of: string, n_rows: bigint>"
)


def read_whole_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files of ``sinks.write_results``, a line per run: the scores as rows,
    and ``run, part, name, value`` of the modes, the capped answers and the
    conditions. Only what is asked for is parsed."""
    lines = spark.read.schema("run string, document string, more string").option("mode", "FAILFAST").json(path)
    more = lines.select("run", F.from_json("more", MORE).alias("m")).select("run", "m.*")

    def rows(entries: Column, part: str) -> DataFrame:
        return more.select("run", F.lit(part).alias("part"), F.explode(entries).alias("name", "value"))

    modes = rows(F.transform_values("extract_modes", lambda k, n: n.cast("string")), "mode")
    caps = rows(F.transform_values("hit_cap", lambda k, c: F.concat_ws("/", c["hits"].cast("string"), c["of"].cast("string"))), "hit_cap")
    names = ["eval_dtype", "four_bit", "greedy", "cap_of", "n_rows"]
    values = F.array(*[F.col(f"conditions.{n}").cast("string") for n in names])
    settings = rows(F.map_from_arrays(F.array(*map(F.lit, names)), values), "condition")
    return explode_results(lines, F.col("document")), modes.unionByName(caps).unionByName(settings)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results file, one JSON document of a few kilobytes per run."""
    return explode_results(spark.read.text(path, wholetext=True), F.col("value"))
