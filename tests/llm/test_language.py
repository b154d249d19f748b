import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdikt.llm import language, queries

SOUNDS = {"xx": ["ba", "lo", "mi", "ter"], "yy": ["ñu", "sé", "ach", "ung"], "zz": ["жи", "ра", "ко", "сть"]}


def text(lang, words, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices(SOUNDS[lang], k=r.randint(1, 4))) for _ in range(words))


def table(spark, n=90):
    rows = [(k, text(lang, 3 + k % 40, k), lang) for k, lang in zip(range(n), ["xx", "xx", "yy", "zz"] * n)]
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "12 !! 3", "zz"), (1003, text("xx", 30, 5), None), (1004, "ж", None), (1005, "BALOMI", None)]
    rows += [rows[0]] * 3 + [(1006, text("yy", 30000, 1), None)]
    return spark.createDataFrame([(*r, 1.0, "q") for r in rows], "doc_id long, text string, lang string, score double, rejected string").repartition(3)


def test_languages(spark):
    docs = table(spark)
    model = language.train(docs)
    assert model.languages == ["xx", "yy", "zz"]
    rows = language.identify(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.lang:
            assert r.lang_pred == r.lang and not r.rejected
    found = {r.doc_id: r.lang_pred for r in rows}
    assert (found[1003], found[1004], found[1005], found[1006]) == ("xx", "zz", "xx", "yy")
    again = language.identify(docs.repartition(5), language.train(docs.repartition(2))).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_folded_table_is_the_average():
    model = language.Model(["a", "b"], np.random.default_rng(1).standard_normal((language.BUCKETS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    texts = pa.array(["one two", "x", "", None, "été  12 Z", "word " * 500])
    z, letter = model.logits(texts)
    assert letter.tolist() == [True, True, False, False, True, True]
    for k, (bucket, share) in enumerate(language.features(texts)):
        assert np.allclose(z[k], share @ model.table[bucket].astype(float) if len(bucket) else 0, atol=1e-6)


def test_nothing_to_learn_from(spark):
    docs = table(spark, 8)
    none = language.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    one = language.train(docs.where("lang = 'xx'"))
    got = {(r.lang_pred, r.score) for r in language.identify(docs, one).where("doc_id < 1000").collect()}
    assert got == {("xx", 1.0)}
    assert language.identify(docs.limit(0), one).count() == 0 and language.train(docs.limit(0)).languages == []


def test_held_out(spark):
    rows = spark.createDataFrame([(k,) for k in range(50)], "doc_id long").select("doc_id", language.held_out("doc_id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_query(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op10_language_id(spark, sf_dir).collect()
    assert len(rows) == len(truth)
    out = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.95
    assert not any(r.rejected for r in rows if r.lang_pred == truth[r.doc_id])
