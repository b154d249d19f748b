from collections import Counter
from fractions import Fraction

import corpus_pipeline
from tests.llm import test_decontaminate, test_jaccard, test_mixing, test_wavelet
from verdikt.llm import jaccard

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())


def test_stages(spark, sf_dir):
    """Each stage against a plain version of it on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5
    known = stages[0](spark, docs, sf_dir).cache()
    assert known.columns == docs.columns
    gone = rows(docs) - rows(known)
    assert sum(gone.values()) <= 0.01 * docs.count() and not rows(known) - rows(docs)

    one = stages[1](spark, known, sf_dir).cache()
    assert one.columns == docs.columns
    groups = test_jaccard.brute([(r.doc_id, r.text) for r in known.collect()], 5, Fraction(4, 5))
    assert Counter(r.doc_id for r in one.collect()) == Counter({c: 1 for _, _, c in groups})

    clean = stages[2](spark, one, sf_dir).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    judged = test_decontaminate.brute([(r.doc_id, r.text) for r in one.collect()], items)
    assert {r.doc_id for r in clean.collect()} == {k for k, n, h, _ in judged if not (h and 20 * h >= n)}

    mixed = stages[3](spark, clean, sf_dir).cache()
    assert mixed.columns == docs.columns and not set(rows(mixed)) - set(rows(clean))
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in clean.collect():
        sizes[r.source] += test_mixing.size(r.text)
        longest[r.source] = max(longest[r.source], test_mixing.size(r.text))
    for r in mixed.collect():
        taken[r.source] += test_mixing.size(r.text)
    want = test_mixing.wanted(sizes)
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)

    tokens = stages[4](spark, mixed, sf_dir).collect()
    texts = sorted((r.doc_id, r.text) for r in mixed.collect())
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens) == test_wavelet.expected(texts)


def test_odd_rows(spark, sf_dir):
    base = " ".join(f"wort{k}" for k in range(40))
    docs = [(1, base, "de", None, 1), (1, base, "de", None, 1), (1, base + " ende", "de", "a", None), (2, base, None, "a", 3), (3, None, "en", "b", 0)]
    docs += [(4, "", "en", None, 0), (5, "the only clean text here", "en", "b", 9), (None, "another text that has no id", "en", "b", 9)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long, class string, n int")
    one = jaccard.representatives(df).collect()
    assert Counter(r.doc_id for r in one) == Counter([1, 3, 4, 5, None])
    for frame in (df, df.limit(0)):
        kept = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, sf_dir)
            assert kept.columns == df.columns
        out = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
        assert out.count() == kept.count()


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
