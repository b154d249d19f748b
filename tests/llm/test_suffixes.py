import hashlib
import random

import pytest

from verdikt.llm import queries, suffixes


def brute(docs, length):
    seen = {}
    for _, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            g = b[k : k + length]
            seen[g] = seen.get(g, 0) + 1
    out = []
    for key, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans, kept = [], bytes(x for x, g in zip(b, gone) if not g)
        for k, g in enumerate(gone):
            if g and (k == 0 or not gone[k - 1]):
                spans.append([k, k])
            if g:
                spans[-1][1] = k + 1
        out.append((key, len(b), str(spans), kept))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.id, r.n_bytes, str(r.spans), bytes(r.kept)) for r in df.collect()), key=str)


def cases(seed):
    r = random.Random(seed)
    letters = "abcdé \n"
    text = lambda n: "".join(r.choices(letters, k=n))
    shared = [text(r.randint(20, 150)) for _ in range(6)]
    docs = [(0, None), (1, ""), (2, "short"), (3, "a" * 300), (4, "ab" * 200), (5, "x" + "a" * 90 + "y"), (6, text(30000))]
    for k in range(7, 50):
        base = r.choice(shared)
        if r.random() < 0.5:
            at = r.randrange(len(base))
            base = base[:at] + r.choice("XYZ") + base[at + 1 :]
        docs.append((k, text(r.randint(0, 60)) + base + text(r.randint(0, 60)) + (base if r.random() < 0.2 else "")))
    return docs + docs[20:24] + [(10, text(90) + shared[0])]


@pytest.mark.parametrize("length,gram,span,chunk", [(40, 8, 4 << 20, 2 << 20), (30, 10, 64, 500), (41, 16, 333, 100), (12, 3, 4 << 20, 2000)])
def test_same_as_all_strings(spark, monkeypatch, length, gram, span, chunk):
    monkeypatch.setattr(suffixes, "SPAN", span)
    monkeypatch.setattr(suffixes.tx.chunks, "__defaults__", (chunk,))
    docs = cases(length)
    df = spark.createDataFrame([(*x, 1, "g") for x in docs], "doc_id long, text string, mark int, gram string").repartition(3)
    assert got(suffixes.without_repeats(df, length=length, gram=gram)) == brute(docs, length)


def test_rows_without_an_id(spark):
    """A null id is an id: such rows lose their repeats as their copies do."""
    r = random.Random(8)
    shared = ["".join(r.choices("abcdé", k=90)) for _ in range(3)]
    docs = [(None, "x" + shared[0]), (1, "y" + shared[0]), (None, shared[1] + "p" + shared[2]), (None, "q" + shared[1]), (2, shared[2] + "w")]
    docs += [(None, "alone " * 3), (None, None), (None, "q" + shared[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(suffixes.without_repeats(df, length=40, gram=8)) == brute(docs, 40)


def test_empty(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    assert got(suffixes.without_repeats(df.limit(0))) == []
    assert got(suffixes.without_repeats(df)) == [(1, 1, "[]", b"a")]


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_repeated_bytes(spark, sf_dir).collect()]
    expected = [(k, n, n - len(left), s.count("[") - 1, hashlib.sha256(left).hexdigest()) for k, n, s, left in brute(docs, 400)]
    assert sorted(rows) == sorted(expected)
    assert any(r[2] for r in rows)
