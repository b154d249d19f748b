"""The weighted score of one answer: a single narrow stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.functions import filler
from verdikt.operators import checks, rigor
from verdikt.operators.contracts import TASK_PLACE, known_task, task_place
from verdikt.operators.extract import EMITTED, extract_json

# Fixed values.
WEIGHTS = {"schema": 0.30, "enums": 0.20, "rigor": 0.35, "clean": 0.15}
METRICS = ["emitted", "schema", "enums", "rigor", "clean", "score"]

COUNTS = ["schema_checks", "schema_passes", "enum_checks", "enum_passes"]
CHECKED = [*COUNTS, "schema_notes", "enum_notes", "rigor_value", "rigor_notes", "filler_marks"]


def examine(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Extract each answer and run every check.

    Adds ``extract``, ``chars`` and the columns named in ``CHECKED``. The notes
    cost nothing where they are not asked for.
    """
    kept = [c for c in df.columns if c != raw]
    df = df.withColumns({"chars": F.length(F.coalesce(F.col(raw), F.lit(""))), "task": known_task(F.col("task"))})
    df = extract_json(df, raw).withColumns({TASK_PLACE: task_place(), "_low_doc": F.lower("doc")})
    df = checks.inspect_answer(df)
    for step in rigor.rigor_inputs():
        df = df.withColumns(step)
    df = df.withColumns(checks.check_masks())
    value, notes = rigor.rigor_result()
    return df.select(
        *kept,
        "extract",
        "chars",
        *[count.alias(name) for name, count in checks.check_counts().items()],
        checks.schema_notes().alias("schema_notes"),
        checks.enum_notes().alias("enum_notes"),
        value.alias("rigor_value"),
        notes.alias("rigor_notes"),
        filler.marks_of("_strings").alias("filler_marks"),
    )


def score(df: DataFrame, raw: str = "raw", max_notes: int | None = None) -> DataFrame:
    """Score ``task``, ``raw`` rows; other columns but the text pass through.

    All notes are kept; ``max_notes`` asks for the first ones only.
    """
    df = examine(df, raw)
    emitted = F.col("extract").isin(EMITTED)

    def when_emitted(value):
        return F.when(emitted, value).otherwise(F.lit(0.0))

    parts = {
        "schema": checks.ratio(F.col("schema_passes"), F.col("schema_checks")),
        "enums": checks.ratio(F.col("enum_passes"), F.col("enum_checks")),
        "rigor": F.col("rigor_value"),
        "clean": checks.clean_score(F.col("filler_marks")),
    }
    found = F.struct(emitted.cast("int").alias("emitted"), *[when_emitted(v).alias(name) for name, v in parts.items()])
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.lit(weight) * F.col(name)
    # As in the extraction: a filter on a score stays above its making.
    df = df.select(*[c for c in df.columns if c not in METRICS], F.inline(F.array(found))).withColumn("score", total)
    notes = F.concat("schema_notes", "enum_notes", "rigor_notes", filler.labels_of("filler_marks"))
    missing = F.array(F.concat(F.lit("extract:"), F.col("extract")))
    notes = F.when(emitted, notes if max_notes is None else F.slice(notes, 1, max_notes)).otherwise(missing)
    return df.withColumn("notes", notes).drop(*CHECKED)
