import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdikt.llm import lm, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs):
    """The same models with words in place of their hashes."""
    tables = []
    for marked in (True, False):
        uni, first, pair = Counter(), Counter(), Counter()
        for _, text, good in docs:
            if not marked or good:
                w = words(text)
                uni.update(w)
                first.update([None, *w][: len(w)])
                pair.update(zip([None, *w], w))
        tables.append((uni, first, pair))
    out = {}
    for key, text, _ in docs:
        w, losses = words(text), []
        for uni, first, pair in tables:
            total = sum(uni.values())
            loss = 0.0
            for v, x in zip([None, *w], w):
                own = (uni[x] + 1) / (total + lm.WORDS)
                both = pair[v, x] / first[v] if first[v] else own
                loss -= math.log(lm.MIX * both + (1 - lm.MIX) * own)
            losses.append(loss / len(w) if w else None)
        out[key] = (len(w), losses)
    return out


def test_same_as_words(spark):
    r = random.Random(4)
    vocabulary = [f"wörd{k}" for k in range(12)]
    docs = [(k, " ".join(r.choices(vocabulary[: 5 + k % 8], k=r.randint(1, 60))), k % 4 == 0) for k in range(50)]
    docs += [(100, None, True), (101, "", False), (102, "!? ", None), (103, "ONE one", None), (104, " ".join(r.choices(vocabulary, k=20000)), True)]
    df = spark.createDataFrame([(*d, 3, "s") for d in docs], "doc_id long, text string, good boolean, block int, score string").repartition(5)
    models = lm.count(df, F.col("good"))
    want = brute(docs)
    for found in (lm.score(df, models), lm.scored(df, F.col("good"))):
        rows = found.collect()
        assert sorted(r.id for r in rows) == sorted(want)
        for row in rows:
            n, (target, background) = want[row.id]
            assert row.n_tokens == n
            if not n:
                assert row.target_loss is row.background_loss is row.score is None
            else:
                assert row.target_loss == pytest.approx(target, rel=1e-6) and row.background_loss == pytest.approx(background, rel=1e-6)
                assert row.score == pytest.approx(target - background, abs=1e-6)


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", True)] * 3 + [(2, "c", False)], "doc_id int, text string, good boolean")
    models = lm.count(df, F.col("good"))
    assert models.words.sum(1).tolist() == [6, 7] and models.pairs.sum(1).tolist() == [6, 7]
    none = lm.count(df.limit(0), F.col("good"))
    assert none.words.sum() == 0
    scores = {r.id: r.score for r in lm.score(df, lm.count(df, F.lit(False))).collect()}
    assert scores[1] > 0 and lm.score(df.limit(0), none).collect() == []
    assert {r.id: r.score for r in lm.scored(df, F.lit(False)).collect()} == scores
    assert lm.scored(df.limit(0), F.col("good")).collect() == []


def test_query(spark, sf_dir):
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality == 1}
    rows = queries.op9_lm_scores(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len(words(t)) for k, t in texts.items()}
    mean = lambda own: sum(own) / len(own)
    assert mean([r.score for r in rows if r.score is not None and r.doc_id in good]) < mean([r.score for r in rows if r.score is not None and r.doc_id not in good])


def check_against(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, good boolean").repartition(5)
    models = lm.count(df, F.col("good"))
    want = brute(docs)
    for found in (lm.score(df, models), lm.scored(df, F.col("good"))):
        rows = found.collect()
        assert sorted(r.id for r in rows) == sorted(d[0] for d in docs)
        for row in rows:
            n, (target, background) = want[row.id]
            assert row.n_tokens == n
            assert row.target_loss == pytest.approx(target, rel=1e-9) and row.background_loss == pytest.approx(background, rel=1e-9)


def test_every_word_has_its_own_counts(spark):
    """40,000 words and 120,000 pairs: with 65,536 shared numbers a third of them met."""
    r = random.Random(5)
    docs = [(k, " ".join(f"w{r.randrange(40000)}" for _ in range(300)), k % 3 == 0) for k in range(400)]
    check_against(spark, docs)


def test_vocabulary_grows(spark, monkeypatch):
    """More different words than WORDS: the vocabulary is all of them."""
    docs = [(k, " ".join(f"w{k * 500 + i}" for i in range(1000)), k % 2 == 0) for k in range(160)]
    df = spark.createDataFrame(docs, "doc_id long, text string, good boolean")
    models = lm.count(df, F.col("good"))
    assert models.vocabulary == 80500
    rows = lm.score(df, models).collect()
    monkeypatch.setattr(lm, "WORDS", 80500)
    want = brute(docs)
    assert all([row.target_loss, row.background_loss] == pytest.approx(want[row.id][1], rel=1e-9) for row in rows)


def test_many_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 500)
    r = random.Random(6)
    check_against(spark, [(k, " ".join(["the", *(f"w{r.randrange(300)}" for _ in range(40)), "the", "of"]), k % 3 == 0) for k in range(150)])


def test_a_block_read_by_several_tasks(spark, monkeypatch, tmp_path):
    """Answers belong to what one task read of a block, wherever it was cut."""
    whole = lm.stored

    def cut(df, name, *rest):
        table = whole(df, name, *rest)
        return table.repartitionByRange(7, "block", "row").sortWithinPartitions("block", "row") if name == "blocks" else table

    monkeypatch.setattr(lm, "stored", cut)
    r = random.Random(8)
    docs = [(k, " ".join(f"w{r.randrange(200)}" for _ in range(k % 30)) or "w0", k % 3 == 0) for k in range(150)]
    df = spark.createDataFrame([*docs, *[(k, None, True) for k in range(150, 160)]], "doc_id long, text string, good boolean")
    want = {r.id: r.score or 0.0 for r in lm.score(df, lm.count(df, F.col("good"))).collect()}
    got = {r.id: r.score or 0.0 for r in lm.scored(df, F.col("good")).collect()}
    assert got == pytest.approx(want, rel=1e-9) and len(want) == 160


def test_uncounted_words(spark):
    counted = spark.createDataFrame([(1, "a b a b", True), (2, "a c", False)], "doc_id int, text string, good boolean")
    other = spark.createDataFrame([(None, "x y"), (3, "a b"), (3, "a b"), (4, None)], "doc_id int, text string")
    rows = lm.score(other, lm.count(counted, F.col("good"))).collect()
    assert sorted((r.id or 0, r.n_tokens) for r in rows) == [(0, 2), (3, 2), (3, 2), (4, 0)]
    own = -math.log(1 / (6 + lm.WORDS))
    first = -math.log((1 - lm.MIX) / (6 + lm.WORDS))  # two texts begin, neither with x
    assert next(r for r in rows if r.id is None).background_loss == pytest.approx((own + first) / 2)
