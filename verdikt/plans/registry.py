"""Every registered query: ``name -> (spark, sf_dir) -> DataFrame``.

Doubles are rounded to nine places so that the order of additions cannot show.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.functions import filler
from verdikt.functions.variants import key_count
from verdikt.operators import chats, checks, corpus, quantize, rollup
from verdikt.operators.contracts import contract_table
from verdikt.operators.extract import answer_object, extract_json, extract_modes
from verdikt.operators.resume import resumed, score_pending
from verdikt.operators.score import examine, score
from verdikt.plans.completions import COLUMNS, RUNS, completions, derive
from verdikt.plans.corpora import KEY, chat_corpus, document_corpus, split
from verdikt.plans.partitions import dealt, spread
from verdikt.session import materialize, shared_dir
from verdikt.sources import jsonl, sinks
from verdikt.sources.tables import table
from verdikt.streaming.score_stream import read_scored, score_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
METRICS = ["schema", "enums", "rigor", "clean", "score"]
CHAT_WINDOW, CHAT_LEAST = 160, 32


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column."""
    cells: list[Column] = []
    for name, kind in df.dtypes:
        cells.append(F.round(name, 9).alias(name) if kind == "double" else F.col(name))
    return df.select(*cells)


def _examined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examine(completions(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(completions(spark, sf_dir))


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.task_sums(_scored(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents in the shape of scored rows: no JSON involved."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    quality = F.col("quality").cast("double")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.when(F.col("toxic") == 1, F.lit("toxic")).otherwise(F.lit("smoke_plain")).alias("run"),
        F.col("lang").alias("task"),
        F.col("source").alias("slice"),
        F.col("quality").alias("emitted"),
        *[quality.alias(m) for m in METRICS],
    )


def _label_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.task_sums(labelled(spark, sf_dir))


def _work(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/verdikt-{name}-{uuid.uuid4().hex}"


# Extraction


@query
def contract_rules(spark, sf_dir):
    """The rules that apply to each derived answer's task, counted per field."""
    tasks = completions(spark, sf_dir).groupBy("task").agg(F.count(F.lit(1)).alias("answers"))
    rules = contract_table(spark).withColumn("allowed", F.array_join("allowed", "|"))
    return tasks.join(F.broadcast(rules), "task")


@query
def extract_answers(spark, sf_dir):
    """Mode and number of keys found, per answer."""
    df = extract_json(completions(spark, sf_dir))
    return df.select("run", "row_id", "extract", key_count(answer_object()).alias("n_keys"))


@query
def modes_by_run(spark, sf_dir):
    """B8."""
    return extract_modes(extract_json(completions(spark, sf_dir)))


@query
def event_properties(spark, sf_dir):
    """B2 and C6 on ``events``: every property text is one JSON object."""
    events = spread(table(spark, sf_dir, "events").select("event_id", "event_type", F.col("props").alias("raw")), "event_id")
    k = F.try_variant_get("answer", "$[0].k", "bigint")
    return extract_json(events).groupBy("event_type", "extract").agg(
        F.count(F.lit(1)).alias("n"), F.sum(k).alias("sum_k")
    )


# Checks and scores


@query
def schema_checks(spark, sf_dir):
    """Passes and checks per answer."""
    df = _examined(spark, sf_dir).where("extract IN ('clean', 'fenced', 'embedded', 'tool-envelope')")
    return rounded(
        df.select(
            "run",
            "row_id",
            F.col("schema_checks").alias("checks"),
            F.array_join("schema_notes", "; ").alias("notes"),
            checks.ratio(F.col("schema_passes"), F.col("schema_checks")).alias("schema"),
        )
    )


@query
def enum_checks(spark, sf_dir):
    """C6-C8."""
    df = _examined(spark, sf_dir).where("extract IN ('clean', 'fenced', 'embedded', 'tool-envelope')")
    return rounded(
        df.select(
            "run",
            "row_id",
            F.col("enum_checks").alias("checks"),
            F.array_join("enum_notes", "; ").alias("notes"),
            checks.ratio(F.col("enum_passes"), F.col("enum_checks")).alias("enums"),
        )
    )


@query
def rigor_checks(spark, sf_dir):
    """F1-F8."""
    df = _examined(spark, sf_dir).where("extract IN ('clean', 'fenced', 'embedded', 'tool-envelope')")
    notes = F.array_join("rigor_notes", "; ")
    return rounded(df.select("run", "row_id", "task", F.col("rigor_value").alias("rigor"), notes.alias("notes")))


@query
def placeholder_checks(spark, sf_dir):
    """E1-E4."""
    hits = filler.labels_of("filler_marks")
    df = _examined(spark, sf_dir).where("extract IN ('clean', 'fenced', 'embedded', 'tool-envelope')")
    return rounded(
        df.select("run", "row_id", F.array_join(hits, "; ").alias("hits"), checks.clean_score(hits).alias("clean"))
    )


@query
def score_answers(spark, sf_dir):
    """The score row of every answer."""
    df = _scored(spark, sf_dir).drop("status", "new_tokens", "cap", "chars")
    return rounded(df.withColumn("notes", F.array_join("notes", "; ")))


# Placeholder text in plain tables. The tables hold none, so each text gets a
# marker appended by its row number.
MARKERS = ["", " TODO later", " {{user_name}}", " <insert name>", " fill in all fields", " coming  soon", " Lorem Ipsum", " TBD.", " <script>"]


def _marked(text: str, index: Column) -> Column:
    suffixes = F.array(*[F.lit(m) for m in MARKERS])
    return F.concat(text, F.element_at(suffixes, (index % len(MARKERS) + 1).cast("int")))


@query
def filler_in_documents(spark, sf_dir):
    """E5 over the whole text of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    docs = docs.select("lang", _marked("text", F.col("doc_id")).alias("text"))
    return checks.filler_scan(docs, "text").groupBy("lang", "rule", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def filler_in_conversations(spark, sf_dir):
    """E5 over every turn; beside some turns stands an exact padding value."""
    turns = table(spark, sf_dir, "conversations")
    whole = _marked("text", F.col("conv_id") + F.col("turn"))
    padded = F.when(F.col("turn") == 7, F.array(whole, F.lit(" N/A "))).otherwise(F.array(whole))
    return (
        checks.filler_scan(turns.select("role", F.explode(padded).alias("text")), "text")
        .groupBy("role", "rule", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# Roll-ups


@query
def scores_by_task(spark, sf_dir):
    """H1."""
    return rounded(rollup.by_task(_sums(spark, sf_dir)))


@query
def scores_overall(spark, sf_dir):
    """H2."""
    return rounded(rollup.overall(_sums(spark, sf_dir)))


@query
def scores_by_slice(spark, sf_dir):
    """H3."""
    return rounded(rollup.by_slice(_sums(spark, sf_dir)))


@query
def label_scores_by_task(spark, sf_dir):
    """H1 on labelled documents."""
    return rounded(rollup.by_task(_label_sums(spark, sf_dir)))


@query
def label_scores_overall(spark, sf_dir):
    """H2 on labelled documents."""
    return rounded(rollup.overall(_label_sums(spark, sf_dir)))


@query
def label_scores_by_slice(spark, sf_dir):
    """H3 on labelled documents."""
    return rounded(rollup.by_slice(_label_sums(spark, sf_dir)))


@query
def capped_answers(spark, sf_dir):
    """H4."""
    return rollup.hit_cap(completions(spark, sf_dir))


@query
def run_scores(spark, sf_dir):
    """H5: runs beside their score on the real slice."""
    return rounded(rollup.run_table(materialize(_sums(spark, sf_dir))))


@query
def overall_gain(spark, sf_dir):
    """H5: gain of the tuned run over all tasks."""
    overall = rollup.overall(_sums(spark, sf_dir)).withColumn("scope", F.lit("overall"))
    return rounded(rollup.compare_runs(overall, *RUNS, on="scope"))


@query
def run_gains(spark, sf_dir):
    """H5: gain of the tuned run per task."""
    return rounded(rollup.compare_runs(rollup.by_task(_sums(spark, sf_dir)), *RUNS))


@query
def reported_runs(spark, sf_dir):
    """H6 on labelled documents, whose larger run is named as a wiring check."""
    return rounded(rollup.overall(rollup.task_sums(rollup.exclude_smoke(labelled(spark, sf_dir)))))


@query
def dead_sources(spark, sf_dir):
    """H7: documents as runs by source and language; dead if none is labelled good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.concat_ws("/", "source", "lang").alias("run"),
        F.lit("all").alias("slice"),
        F.when(F.col("quality").isNull(), F.lit("unlabelled")).otherwise(F.lit("labelled")).alias("task"),
        (F.coalesce("quality", F.lit(0)) * F.coalesce("toxic", F.lit(0))).alias("emitted"),
        *[F.lit(0.0).alias(m) for m in METRICS],
    )
    return rollup.dead_runs(rollup.overall(rollup.task_sums(rows)))


@query
def task_run_matrix(spark, sf_dir):
    """H8."""
    return rounded(rollup.task_matrix(rollup.by_task(_sums(spark, sf_dir)), RUNS))


@query
def run_conditions(spark, sf_dir):
    """H9: runs that were made under equal conditions."""
    settings = spark.createDataFrame(
        [(run, "bfloat16", False, True) for run in RUNS], "run string, eval_dtype string, four_bit boolean, greedy boolean"
    )
    return rollup.like_runs(rollup.conditions(completions(spark, sf_dir), settings))


# Result files, resuming and streaming


@query
def results_roundtrip(spark, sf_dir):
    """Roll-ups nested into one document per run, and read back as rows."""
    cells = materialize(rollup.task_sums(_scored(spark, sf_dir), "extract"))
    sums, modes = rollup.cell_sums(cells), rollup.mode_counts(cells)
    nested = sinks.nested_results(rollup.by_task(sums), rollup.overall(sums), rollup.by_slice(sums), modes)
    return rounded(jsonl.explode_results(nested, F.col("document")))


#: Runs made under unequal conditions.
UNEQUAL = [(RUNS[0], "bfloat16", False, True), (RUNS[1], "float16", True, True)]


@query
def results_file(spark, sf_dir):
    """A results file written and read back, with modes, capped answers
    and conditions; every run's score on all tasks stands beside them."""
    path, answers = _work(spark, "results"), completions(spark, sf_dir)
    cells = materialize(rollup.task_sums(_scored(spark, sf_dir), "extract"))
    sums, modes = rollup.cell_sums(cells), rollup.mode_counts(cells)
    nested = sinks.nested_results(rollup.by_task(sums), rollup.overall(sums), rollup.by_slice(sums), modes)
    settings = spark.createDataFrame(UNEQUAL, "run string, eval_dtype string, four_bit boolean, greedy boolean")
    documents = sinks.results_documents(nested, modes, rollup.hit_cap(answers), rollup.conditions(answers, settings))
    sinks.write_results(documents, path)
    scores, more = jsonl.read_whole_results(spark, path)
    overall = scores.where("scope = 'overall'").select(
        "run", F.lit("overall").alias("part"), F.lit("n").alias("name"), F.col("n").cast("string").alias("value")
    )
    return more.unionByName(overall)


@query
def raw_sink(spark, sf_dir):
    """A5: raw answers written by run and read back."""
    path = _work(spark, "raw")
    sinks.write_raw(completions(spark, sf_dir), path)
    # What was stored is whole: it is extracted again as the answer was.
    written = extract_json(spark.read.parquet(path))
    return written.groupBy("run", "task", "slice", "extract", "hit_cap").agg(
        F.count(F.lit(1)).alias("n"), F.sum("new_tokens").alias("tokens")
    )


@query
def upserted_runs(spark, sf_dir):
    """One run written again replaces its own rows only."""
    path = _work(spark, "upsert")
    answers = completions(spark, sf_dir).select("run", "row_id", "task", "new_tokens")
    sinks.replace_runs(answers, path)
    again = answers.where(F.col("run") == RUNS[1]).withColumn("new_tokens", F.lit(-1))
    sinks.replace_runs(again, path)
    stored = spark.read.parquet(path)
    return stored.groupBy("run", "task").agg(F.count(F.lit(1)).alias("n"), F.sum("new_tokens").alias("tokens"))


@query
def pending_scores(spark, sf_dir):
    """Orders with status F are scored already; the tuned run's saved state is stale."""
    answers = completions(spark, sf_dir)
    done = answers.where("status = 'F'").select("run", "row_id")
    n_rows = answers.groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"))
    saved = n_rows.withColumn("n_rows", F.col("n_rows") - F.when(F.col("run") == RUNS[1], 1).otherwise(0))
    scored = score(score_pending(answers, done, saved))
    return rounded(scored.select("run", "row_id", "task", "extract", "score"))


@query
def resumed_scores(spark, sf_dir):
    """Saved scores, read back from their sink, beside newly made ones are all."""
    answers = completions(spark, sf_dir)
    columns = ["run", "row_id", "task", "extract", "score"]
    path = _work(spark, "saved")
    sinks.replace_runs(score(answers.where("status = 'F'")).select(*columns), path)
    n_rows = answers.groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"))
    saved = n_rows.withColumn("n_rows", F.col("n_rows") - F.when(F.col("run") == RUNS[1], 1).otherwise(0))
    done = spark.read.parquet(path).select(*columns)
    return rounded(resumed(answers, done, saved, lambda df: score(df)))


@query
def streamed_scores(spark, sf_dir):
    """The stream's result is the batch's result."""
    work = _work(spark, "stream")
    orders = table(spark, sf_dir, "orders")
    # A pattern, because a stream's plain path has to be a folder.
    source = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders.parque[t]")
    answers = derive(dealt(source.select(*COLUMNS), "o_orderkey", rows=orders.count()))
    score_stream(answers, f"{work}/scored", f"{work}/checkpoint").awaitTermination()
    df = read_scored(spark, f"{work}/scored").drop("batch", "chars")
    return rounded(df.withColumn("notes", F.array_join("notes", "; ")))


# Corpora


def _chat_lengths(spark, sf_dir):
    return corpus.token_lengths(chat_corpus(spark, sf_dir))


def _chat_fit(spark, sf_dir):
    return corpus.fit_window(_chat_lengths(spark, sf_dir), CHAT_WINDOW, CHAT_LEAST)


@query
def split_files(spark, sf_dir):
    """A1: a corpus written as JSON lines and read back, with a missing split."""
    folder = _work(spark, "corpus")
    df = chat_corpus(spark, sf_dir).withColumn("teacher", F.lit("none"))
    schema = f"conv_id bigint, turn bigint, split string, task string, messages {jsonl.MESSAGES}"
    jsonl.write_splits(df, folder)
    names = ["train", "val", "test_real", "test_gen", "absent"]
    parts = [jsonl.read_split(spark, folder, name, schema, jsonl.PARTED) for name in names]
    read = reduce(DataFrame.unionByName, parts)
    target = F.sum(F.length(corpus.content(F.col("messages"), 2)))
    return read.groupBy("split", "task").agg(F.count(F.lit(1)).alias("n"), target.alias("target_chars"))


@query
def eval_set(spark, sf_dir):
    """A2."""
    df = chat_corpus(spark, sf_dir)
    picked = corpus.build_eval_set(split(df, "test_real"), split(df, "test_gen"), KEY)
    return picked.select(*KEY, "task", "slice", corpus.content(F.col("messages"), 2).alias("target"))


@query
def smoke_set(spark, sf_dir):
    """A3."""
    df = chat_corpus(spark, sf_dir).select(*KEY, "task", corpus.content(F.col("messages"), 2).alias("target"))
    return corpus.first_per_task(df, KEY)


@query
def corpus_manifest(spark, sf_dir):
    """A4."""
    fields = [F.col(c) for c in KEY] + [corpus.content(F.col("messages"), i) for i in range(3)]
    return corpus.split_manifest(chat_corpus(spark, sf_dir), fields)


@query
def rendered_chats(spark, sf_dir):
    """I1."""
    df = chat_corpus(spark, sf_dir)
    return df.select(
        *KEY,
        F.md5(corpus.render(F.col("messages"))).alias("text_md5"),
        F.md5(corpus.prompt_of(F.col("messages"))).alias("prompt_md5"),
    )


#: Bytes of a segment of ``whole_chats``.
CHAT_SEGMENT = 4096


@query
def whole_chats(spark, sf_dir):
    """I1 over every turn of every conversation, the unanswered ones included."""
    df = chats.chat_segments(table(spark, sf_dir, "conversations"), size=CHAT_SEGMENT)
    return df.select(
        "conv_id", "segment", "n_turns", "n_user", "n_open", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5")
    )


@query
def chat_lengths(spark, sf_dir):
    """I2."""
    return _chat_lengths(spark, sf_dir).select(*KEY, "n_total", "n_fixed", "n_target")


@query
def document_lengths(spark, sf_dir):
    """I2 over whole documents."""
    return corpus.token_lengths(document_corpus(spark, sf_dir)).select("doc_id", "n_total", "n_fixed", "n_target")


@query
def fitted_chats(spark, sf_dir):
    """I3."""
    return _chat_fit(spark, sf_dir).select(*KEY, "decision", "budget")


@query
def trimmed_chats(spark, sf_dir):
    """I4: the user message as it is trained on."""
    df = corpus.trim_middle(_chat_fit(spark, sf_dir).where("decision <> 'drop'"))
    return df.select(*KEY, corpus.content(F.col("messages"), 1).alias("user"))


@query
def chat_fit_report(spark, sf_dir):
    """I5."""
    return corpus.fit_report(_chat_fit(spark, sf_dir))


@query
def document_window_coverage(spark, sf_dir):
    """I6."""
    lengths = corpus.token_lengths(document_corpus(spark, sf_dir))
    return rounded(corpus.window_coverage(lengths))


@query
def document_generation_caps(spark, sf_dir):
    """I7."""
    return corpus.generation_caps(corpus.token_lengths(document_corpus(spark, sf_dir)))


@query
def document_target_quantiles(spark, sf_dir):
    """I8."""
    return rounded(corpus.target_quantiles(corpus.token_lengths(document_corpus(spark, sf_dir))))


@query
def longest_documents(spark, sf_dir):
    """The eight longest rows of the training split."""
    df = split(document_corpus(spark, sf_dir), "train")
    return corpus.longest_first(df, 8, ["doc_id"]).select("doc_id", "chars")


@query
def training_text(spark, sf_dir):
    """I10."""
    return corpus.project_text(split(chat_corpus(spark, sf_dir), "train"))


# Quantization


def _blocks(spark, sf_dir, size: int = quantize.BLOCK):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return quantize.blocks(spread(vectors, "vec_id"), "embedding", size)


@query
def vector_blocks(spark, sf_dir):
    """J1, J2, with blocks of 24 so that the last one is short."""
    df = _blocks(spark, sf_dir, 24)
    return rounded(df.select("vec_id", "block", F.size("w").alias("n"), quantize.absmax(F.col("w")).alias("absmax")))


@query
def vector_codes(spark, sf_dir):
    """J3."""
    df = quantize.quantized(_blocks(spark, sf_dir), quantize.NF4)
    return df.select("vec_id", "block", F.array_join("codes", ",").alias("codes"))


@query
def vector_block_errors(spark, sf_dir):
    """J4, J5."""
    df = quantize.block_error(quantize.quantized(_blocks(spark, sf_dir), quantize.INT4))
    return rounded(df.select("vec_id", "block", "mae", "max_err", "rmse"))


@query
def pooled_vector_errors(spark, sf_dir):
    """J6."""
    return rounded(quantize.blockwise_error(_blocks(spark, sf_dir)))


@query
def code_book_comparison(spark, sf_dir):
    """J7."""
    return rounded(quantize.compare_codebooks(_blocks(spark, sf_dir)).select("n", "rmse_improvement_pct"))


@query
def affine_codes(spark, sf_dir):
    """How often each int8 code occurs, and its errors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    df = quantize.affine_roundtrip(vectors, "x")
    return rounded(
        df.groupBy("q").agg(
            F.count(F.lit(1)).alias("n"), F.max("x_hat").alias("x_hat"), F.max("abs_err").alias("max_err")
        )
    )


@query
def vector_code_occupancy(spark, sf_dir):
    """J10."""
    return rounded(quantize.code_occupancy(_blocks(spark, sf_dir)))


@query
def vector_footprint(spark, sf_dir):
    """J11, J12."""
    return rounded(quantize.footprint(table(spark, sf_dir, "embeddings"), "embedding"))
