from pyspark.sql import functions as F

from verdikt.operators import corpus
from verdikt.plans.corpora import chat_corpus
from verdikt.sources import jsonl
from verdikt.streaming.score_stream import read_scored, score_stream


def chats(spark, rows):
    df = spark.createDataFrame(rows, "row_id bigint, task string, s string, u string, a string")
    return df.select("row_id", "task", corpus.messages_of(F.col("s"), F.col("u"), F.col("a")).alias("messages"))


def test_lengths_agree_with_the_rendered_text(spark):
    texts = ["", "one", "two words", "ends with blank ", "\u00a0 odd\u2003gaps\n", "\n"]
    df = corpus.token_lengths(chats(spark, [(i, "t", texts[i], texts[-i], texts[i - 2]) for i in range(len(texts))]))
    rows = df.withColumn("text", corpus.render(F.col("messages"))).collect()
    for r in rows:
        assert r.n_total == len(r.text.split())
        body = r.messages[1].content
        assert r.n_fixed == len(r.text.replace(f"<|user|>\n{body}</s>", "<|user|>\n</s>", 1).split())
        assert r.n_target == len(r.messages[2].content.split())


def test_trimming_keeps_both_ends_and_the_target(spark):
    user = " ".join(f"w{i}" for i in range(500))
    df = chats(spark, [(1, "t", "sys", user, "target words"), (2, "t", "sys", "short", "x"), (3, "t", "s", user, "y " * 400)])
    fitted = corpus.fit_window(corpus.token_lengths(df), 200)
    rows = {r.row_id: r for r in corpus.trim_middle(fitted).collect()}
    assert {i: r.decision for i, r in rows.items()} == {1: "trim", 2: "keep", 3: "drop"}
    body = rows[1].messages[1].content
    head, tail = body.split(corpus.MARKER)
    budget = rows[1].budget
    assert len(head.split()) == (budget - 4) // 2 and len(head.split()) + len(tail.split()) + 4 == budget
    assert user.startswith(head) and user.endswith(tail)
    assert rows[1].messages[2].content == "target words" and rows[2].messages[1].content == "short"


def test_eval_set_and_missing_split(spark, tmp_path):
    rows = [(i, t, "s", "u", "a") for i, t in enumerate(["plan", "bug"] * 15)]
    df = chats(spark, rows).withColumn("split", F.lit("test_gen"))
    df.coalesce(1).write.json(str(tmp_path / "test_gen.jsonl"))
    gen = jsonl.read_split(spark, str(tmp_path), "test_gen")
    real = jsonl.read_split(spark, str(tmp_path), "test_real")
    assert real.count() == 0
    picked = corpus.build_eval_set(real, gen, ["row_id"], per_task=3)
    assert sorted(r.row_id for r in picked.collect()) == [0, 1, 2, 3, 4, 5]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert sorted(r.row_id for r in corpus.first_per_task(gen, ["row_id"]).collect()) == [0, 1]


def test_stream_equals_batch_and_rescoring_is_idempotent(spark, tmp_path):
    from verdikt.operators.score import score

    schema = "run string, row_id bigint, task string, slice string, raw string"
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    first = spark.createDataFrame([("a", i, "bug", "gen", '{"title":"t"}') for i in range(5)], schema)
    more = spark.createDataFrame([("a", i, "plan", "gen", "x" * i) for i in range(3, 9)], schema)
    for batch in (first, more):
        batch.write.mode("append").parquet(source)
        score_stream(spark.readStream.schema(schema).parquet(source), sink, mark).awaitTermination()
    got = read_scored(spark, sink)
    assert got.groupBy("row_id").count().where("count > 1").count() == 0
    expected = first.unionByName(more.where("row_id > 4"))
    columns = ["row_id", "task", "extract", "score", "chars"]
    assert sorted(got.select(*columns).collect()) == sorted(score(expected).select(*columns).collect())


def test_manifest_marks_whole_rows(spark):
    def marks(rows):
        df = chats(spark, rows).withColumn("split", F.lit("train"))
        fields = [F.col("row_id")] + [corpus.content(F.col("messages"), i) for i in range(3)]
        return [(r.n, r.mark) for r in corpus.split_manifest(df, fields).collect()]

    base = [(1, "plan", "s", "u", "a"), (2, "plan", "s", "v", "b")]
    assert marks(base) == marks(base[::-1])
    assert marks(base) != marks([(1, "plan", "s", "other", "a"), base[1]])
    assert marks([(1, "plan", "s", "u", "a")]) != marks([(1, "plan", "su", "", "a")])
    assert marks(base + base[:1] * 2)[0][1] not in {marks(base)[0][1], "0-0"}


def test_raw_answers_are_kept_whole(spark):
    from verdikt.sources import sinks

    row = ("a", 1, "bug", "gen", "x" * 30000, 10, 20)
    df = spark.createDataFrame([row], "run string, row_id bigint, task string, slice string, raw string, new_tokens int, cap int")
    assert len(sinks.raw_answers(df).first().raw) == 30000
    assert len(sinks.raw_answers(df, max_chars=24).first().raw) == 24


def test_chats_keep_repeated_rows_of_a_turn(spark, tmp_path):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 2, "assistant", "b"), (1, 2, "assistant", "b")]
    turns += [(2, 1, "user", "q"), (2, 1, "user", "r"), (2, 2, "assistant", "a"), (3, 4, "assistant", None), (4, 1, "user", "open")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = chat_corpus(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, *[m.content for m in r.messages]) for r in rows) == [
        (1, "s", "q", "a"), (1, "s", "q", "b"), (1, "s", "q", "b"), (2, "", "q", "a"), (2, "", "r", "a"), (3, "", "", ""),
    ]
