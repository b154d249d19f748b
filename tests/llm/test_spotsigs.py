import random
import re
from bisect import bisect_left
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from verdikt.llm import neighbours, queries, spotsigs

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
COMMON = {w.encode() for words in spotsigs.COMMON.values() for w in words}


def chains(text):
    """The set of signatures, each as the words it is made of."""
    w = [x.lower() for x in WORD.findall((text or "").encode())]
    common = [x in COMMON for x in w]
    if all(common):
        common = [False] * len(w)
    content = [k for k, c in enumerate(common) if not c]
    begins, last = [(b"", 0)] if w else [], -1
    for k, word in enumerate(w):
        last = k if common[k] else last
        if (k - last) % spotsigs.GAP == 0:
            begins.append((word if common[k] else b"", k + 1))
    found = set()
    for own, first in begins:
        at = bisect_left(content, first)
        chain = [w[k] for k in content[at : at + spotsigs.CHAIN]]
        if chain:
            found.add((own, *chain))
    return found


def brute(docs):
    order = sorted(docs, key=lambda d: d[0], reverse=True)
    out = []
    for k, (key, text) in enumerate(order):
        text, other = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        after = text[: len(text) - cut] + other[:cut]
        a, b, c = chains(text), chains(after), chains(other)
        near = [round(len(a & x) / len(a | x), 12) if a | x else 1.0 for x in (b, c)]
        out.append((key, len(text), sha256(after.encode()).hexdigest(), len(a), len(b), *near))
    return Counter(out)


def got(df):
    rows = df.collect()
    return Counter(
        (r.doc_id, r.n_chars, r.edited_sha256, len(r.fingerprint) // 8, len(r.edited_fingerprint) // 8, round(r.near_edited, 12), round(r.near_next, 12))
        for r in rows
    )


def run(spark, tmp_path, docs, schema="doc_id long, text string"):
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op13_spot_signatures(spark, str(tmp_path))


@pytest.mark.parametrize("size", [neighbours.RANGE, 4096])
def test_against_a_plain_scan(spark, sf_dir, monkeypatch, size):
    """Whole tables, in one range and in many."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(neighbours.beside_the_one_before, "__defaults__", (size,))
    monkeypatch.setattr(neighbours, "CHUNK", 20_000)
    found = queries.op13_spot_signatures(spark, sf_dir)
    assert got(found) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_texts(spark, tmp_path):
    texts = [None, "", "?!", "the of and", "Von.", "word", "one two three four", "the one THE one the one", "漢字 の文 と", "É à la île"]
    texts += ["word " * 100_000, " ".join(f"w{k}" for k in range(100)), "| a | b |\n" * 30, "word"]
    docs = [(3 * k, t, "x", 1, True) for k, t in enumerate(texts)]
    random.Random(1).shuffle(docs)
    found = run(spark, tmp_path, docs, "doc_id long, text string, fingerprint string, range int, own boolean")
    assert got(found) == brute([d[:2] for d in docs])
    prints = {r.doc_id: r.fingerprint for r in found.collect()}
    assert prints[15] == prints[39] and prints[0] == prints[3] == prints[6] == "" and prints[9] and prints[12]


def test_repeated_and_missing_ids(spark, tmp_path):
    docs = [(7, "the first text of all")] * 40 + [(7, "another text with it"), (None, "no id here"), (None, "no id here"), (-(1 << 63), "least")]
    rows = run(spark, tmp_path, docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(k for k, _ in docs)
    assert len({(r.fingerprint, r.n_chars) for r in rows}) == 4


@pytest.mark.parametrize("docs", [[], [(5, "the only text that there is")]])
def test_few_rows(spark, tmp_path, docs):
    found = run(spark, tmp_path, docs)
    assert got(found) == brute(docs)


def test_fingerprints(spark):
    docs = spark.createDataFrame([("a", "the cat sat on the mat"), ("b", "The cat, sat on the mat!"), ("c", None)], "id string, body string")
    rows = {r.id: (r.fingerprint, r.signatures) for r in spotsigs.fingerprints(docs, "id", "body").collect()}
    assert rows["a"] == rows["b"] and rows["c"] == ("", 0) and rows["a"][1] == len(chains("the cat sat on the mat"))


def test_pruning_loses_nothing():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(12)] + ["the", "of", "and"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(200)]
    texts += [t + " the end" for t in texts[:100]]
    sigs, offsets = spotsigs.signatures(pa.array(texts))
    a, b = np.repeat(np.arange(300), 300), np.tile(np.arange(300), 300)
    whole = spotsigs.likeness(sigs, offsets, a, b)
    for least in (0.3, 0.8, 1.0):
        assert np.array_equal(spotsigs.likeness(sigs, offsets, a, b, least), np.where(whole >= least, whole, 0.0))


def test_ranges():
    last = [(1, 5), (3, -2), (3, 9), (8, 0)]
    keys = [(0, 7), (1, 5), (1, 6), (2, 0), (3, -3), (3, -2), (3, -1), (3, 9), (3, 10), (8, -1), (8, 0)]
    found = neighbours.ranges_of(np.array([k for k, _ in keys]), np.array([m for _, m in keys]), last)
    assert found.tolist() == [min(k for k, e in enumerate(last) if key <= e) for key in keys]
