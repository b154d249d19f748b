"""Eval sets and prompt corpora: ``task``, ``messages`` and key columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdikt.functions.text import WHITESPACE, word_count, words_with_gaps

# Fixed values.
PER_TASK = 8
MARKER = "\n\n... [context trimmed] ...\n\n"
LEAST_BUDGET = 128
WINDOWS = [12288, 10240, 8192, 6144, 4096, 3072, 2048]
CAP_FACTOR = 1.15


# Assembling


def messages_of(system: Column, user: Column, assistant: Column) -> Column:
    def message(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("content"))

    return F.array(message("system", system), message("user", user), message("assistant", assistant))


def first_k_per_task(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The first ``k`` rows of each task.

    Spark limits each group before the shuffle as well as after it, so a hot
    task sends at most ``k`` rows per partition.
    """
    rank = F.row_number().over(Window.partitionBy("task").orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def build_eval_set(real: DataFrame, gen: DataFrame, order: list[str], per_task: int = PER_TASK) -> DataFrame:
    """A2: every real row, then the first generated rows of each task."""
    sample = first_k_per_task(gen, per_task, order)
    return real.withColumn("slice", F.lit("real")).unionByName(sample.withColumn("slice", F.lit("gen")))


def first_per_task(df: DataFrame, order: list[str]) -> DataFrame:
    """A3: one row per task, the first in order; a plain mergeable aggregate."""
    rest = [c for c in df.columns if c != "task"]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy("task").agg(first).select("task", "row.*")


def split_manifest(df: DataFrame, fields: list[Column]) -> DataFrame:
    """A4: rows per split and task, with a mark of all their fields.

    The mark sums two parts of a hash per row, so it needs no order, equal rows
    do not cancel out, and no row leaves its partition whole. Each field goes
    into the hash with its length, so that fields cannot run into each other.
    """

    def told(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    row_hash = F.sha2(F.concat(*map(told, fields)), 256)
    parts = [F.sum(F.conv(F.substring(row_hash, at, 15), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 16)]
    return df.groupBy("split", "task").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", *parts).alias("mark"))


# Rendering and lengths


def render(messages: Column) -> Column:
    """A chat as one text, each message under its role."""
    parts = F.transform(
        messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("</s>\n"))
    )
    return F.array_join(parts, "")


def prompt_of(messages: Column) -> Column:
    """The first two messages, and the opening of the answer."""
    return F.concat(render(F.slice(messages, 1, 2)), F.lit("<|assistant|>\n"))


def content(messages: Column, i: int) -> Column:
    return messages[i]["content"]


def token_lengths(df: DataFrame) -> DataFrame:
    """Words of the whole chat, of the part that is never cut, of the target.

    A rendered message is its role tag, then its content with the closing tag
    stuck to the last word. So the lengths follow from one count per content,
    and the chat is not rendered.
    """
    columns = {"n_target": word_count(content(F.col("messages"), 2))}
    for i, name in enumerate(["_system", "_user"]):
        columns[name] = word_count(content(F.col("messages"), i))
    df = df.withColumns(columns)

    def rendered(words: str, i: int) -> Column:
        text = content(F.col("messages"), i)
        lone_tag = (text == "") | F.substring(text, -1, 1).isin(list(WHITESPACE))
        return 1 + F.col(words) + lone_tag.cast("int")

    fixed = rendered("_system", 0) + rendered("n_target", 2) + 2
    total = rendered("_system", 0) + rendered("n_target", 2) + rendered("_user", 1)
    return df.withColumns({"n_total": total, "n_fixed": fixed}).drop("_system", "_user")


def survives(window: int, least: int = LEAST_BUDGET) -> Column:
    return (F.col("n_total") <= window) | (window - F.col("n_fixed") >= least)


def fit_window(df: DataFrame, max_len: int, least: int = LEAST_BUDGET) -> DataFrame:
    """Keep, trim or drop; the target is never cut."""
    decision = (
        F.when(F.col("n_total") <= max_len, F.lit("keep"))
        .when(survives(max_len, least), F.lit("trim"))
        .otherwise(F.lit("drop"))
    )
    return df.withColumn("decision", decision).withColumn("budget", max_len - F.col("n_fixed"))


def trim_middle(df: DataFrame) -> DataFrame:
    """I4: cut the middle out of the user message of rows marked ``trim``."""
    mark_len = len(MARKER.split())
    head = F.floor((F.col("budget") - mark_len) / 2).cast("int")
    tail = F.col("budget") - mark_len - head
    body = content(F.col("messages"), 1)
    df = df.withColumn("_words", F.when(F.col("decision") == "trim", words_with_gaps(body)))
    words = F.col("_words")
    # Either end may ask for more words than there are.
    kept_tail = F.least(tail, F.size(words))
    cut = F.concat(
        F.array_join(F.slice(words, F.lit(1), head), ""),
        F.lit(MARKER),
        F.array_join(F.slice(words, F.size(words) - kept_tail + 1, kept_tail), ""),
    )
    user = F.when(F.col("decision") == "trim", cut).otherwise(body)
    messages = messages_of(content(F.col("messages"), 0), user, content(F.col("messages"), 2))
    return df.withColumn("messages", messages).drop("_words")


def fit_report(df: DataFrame) -> DataFrame:
    """Rows kept, trimmed and dropped per task."""
    return df.groupBy("task", "decision").agg(F.count(F.lit(1)).alias("n"))


def window_coverage(df: DataFrame, windows: list[int] = WINDOWS, least: int = LEAST_BUDGET) -> DataFrame:
    """Share of rows per task that survive each window.

    All windows are measured in one aggregate; no row is repeated.
    """
    shares = [F.avg(survives(w, least).cast("double")).alias(str(w)) for w in windows]
    wide = df.groupBy("task").agg(F.count(F.lit(1)).alias("n"), *shares)
    return wide.unpivot(["task", "n"], [str(w) for w in windows], "window", "share").withColumn(
        "window", F.col("window").cast("int")
    )


def generation_caps(df: DataFrame, factor: float = CAP_FACTOR) -> DataFrame:
    """A token cap per task, from its longest target."""
    longest = F.max("n_target")
    return df.groupBy("task").agg(longest.alias("longest"), F.ceil(factor * longest).alias("cap"))


def target_quantiles(df: DataFrame) -> DataFrame:
    """I8: exact median and 90th percentile of the target length per task.

    Lengths are counted first, so each task is left with one row per distinct
    length rather than one per answer.
    """
    lengths = df.groupBy("task", "n_target").agg(F.count(F.lit(1)).alias("n"))
    return lengths.groupBy("task").agg(
        F.percentile("n_target", 0.5, F.col("n")).alias("median"),
        F.percentile("n_target", 0.9, F.col("n")).alias("p90"),
    )


def longest_first(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The ``k`` rows with the most content, longest first."""
    chars = F.aggregate("messages", F.lit(0), lambda n, m: n + F.length(m["content"]))
    ranked = df.withColumn("chars", chars)
    return ranked.orderBy(F.desc("chars"), *order).limit(k)


def project_text(df: DataFrame) -> DataFrame:
    """Nothing but the rendered chat."""
    return df.select(render(F.col("messages")).alias("text"))
