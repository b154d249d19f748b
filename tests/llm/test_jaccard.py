import random
import re
from fractions import Fraction

import pytest

from verdikt.llm import jaccard, queries
from verdikt.llm.components import components

SPACES = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = [x for x in SPACES.split((text or "").translate(LOWER)) if x]
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, size, share):
    """All pairs, through an index of shingles; id -> (set size, least id)."""
    sets = [shingles(t, size) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for k, s in enumerate(sets):
        both = {}
        for g in s:
            for j in index.setdefault(g, []):
                both[j] = both.get(j, 0) + 1
            index[g].append(k)
        for j, n in both.items():
            if n * share.denominator >= (len(s) + len(sets[j]) - n) * share.numerator:
                up[root(k)] = root(j)
    least = {}
    for k, (key, _) in enumerate(docs):
        least[root(k)] = min(key, least.get(root(k), key))
    return sorted((key, len(sets[k]), least[root(k)]) for k, (key, _) in enumerate(docs))


def got(df):
    return sorted((r.id, r.n, r.component) for r in df.collect())


def cases(seed=5):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    line = " ".join(r.choices(vocabulary, k=30))
    texts = [None, "", " \n", "one", "ONE", "one two", "One  two", "one two three", "a\x85b c d"]
    for _ in range(12):
        base = r.choices(vocabulary, k=r.choice([5, 12, 60, 120]))
        texts.append(" ".join(base))
        for _ in range(r.choice([1, 4, 9])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
            if r.random() < 0.4:
                texts.append(line + " " + " ".join(copy))
    texts.append(" ".join(r.choices(vocabulary, k=20000)))
    texts += texts[20:30]
    ids = r.sample(range(10000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(
    "size,share,block,common", [(3, Fraction(9, 10), 256, 200), (5, Fraction(4, 5), 256, 200), (1, Fraction(4, 5), 3, 4), (3, Fraction(4, 5), 2, 3), (3, Fraction(9, 10), 4, 2)]
)
def test_same_as_all_pairs(spark, monkeypatch, size, share, block, common):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "COMMON", common)
    docs = cases(size + block)
    df = spark.createDataFrame([(*x, 7, "t") for x in docs], "doc_id long, text string, n long, tokens string").repartition(3)
    assert got(jaccard.similar(df, "doc_id", "text", size, share)) == brute(docs, size, share)


def test_repeated_ids_and_empty(spark):
    text = " ".join(f"x{k}" for k in range(30))
    docs = [(1, text), (1, text), (1, "other words here"), (2, text + " more"), (3, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(jaccard.similar(df, "doc_id", "text", 3, Fraction(9, 10))) == [(1, 1, 1), (1, 28, 1), (1, 28, 1), (2, 29, 1), (3, 0, 3)]
    assert got(jaccard.similar(df.limit(0), "doc_id", "text")) == []


def test_rows_without_an_id(spark):
    """A null id stands between two others, and among more like it."""
    words = [f"x{k}" for k in range(40)]
    docs = [(7, " ".join(words[4:])), (None, " ".join(words)), (5, " ".join(words[:-4]))]
    docs += [(None, "p q r"), (None, "p q r"), (None, "other"), (None, None), (9, "alone")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = sorted(((r.id, r.n, r.component) for r in jaccard.similar(df, "doc_id", "text", 1, Fraction(9, 10)).collect()), key=str)
    assert found == sorted([(7, 36, 5), (None, 40, 5), (5, 36, 5), (None, 3, None), (None, 3, None), (None, 1, None), (None, 0, None), (9, 1, 9)], key=str)


def test_components(spark):
    links = [(1, 2), (3, 2), (4, 4), (5, 6), (7, 6), (8, 7), (9, 8), (9, 5), (3, 1), *((k, k + 1) for k in range(20, 60))]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {1: 1, 2: 1, 3: 1, **{k: 5 for k in range(5, 10)}, **{k: 20 for k in range(20, 61)}}


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op7_ngram_jaccard_join(spark, sf_dir).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, rows)) == brute(docs, 3, Fraction(9, 10))
