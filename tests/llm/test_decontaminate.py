import hashlib
import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from verdikt.llm import decontaminate as d
from verdikt.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width=13):
    """What a plain scan of every window finds: id -> words, hits, items."""
    grams = {}
    for key, text in items:
        w = words(text)
        for k in range(max(len(w) - width + 1, 1) if w else 0):
            grams.setdefault(tuple(w[k : k + width]), set()).add(key)
    sizes = {len(g) for g in grams}
    out = []
    for key, text in docs:
        w, hit, seen = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    seen |= found
        out.append((key, len(w), len(hit), tuple(sorted(seen))))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in df.collect()), key=str)


def cases():
    r = random.Random(3)
    vocabulary = ["the", "of", "a", "Zed", "ßeta", "x9", "rare", "more"]
    items = [(k, " ".join(r.choices(vocabulary, k=r.choice([1, 2, 5, 13, 14, 30])))) for k in range(25)]
    items += [(90, None), (91, ""), (92, "--- ,,"), (93, items[3][1]), (3, items[3][1])]
    docs = [(0, None), (1, ""), (2, "?!"), (3, "THE"), (4, " ".join(r.choices(vocabulary, k=20000)))]
    for k in range(5, 60):
        text = " ".join(r.choices(vocabulary, k=r.randint(0, 40)))
        if k % 3 == 0:
            text += ", " + items[k % 25][1].upper() + ". " + text
        docs.append((k, text))
    return docs + docs[-3:], items


@pytest.mark.parametrize("block_words", [1 << 20, 40])
def test_same_as_a_scan(spark, block_words):
    docs, items = cases()
    left = spark.createDataFrame([(*x, "s", 1) for x in docs], "doc_id long, text string, items string, spans int").repartition(3)
    right = spark.createDataFrame(items, "item_id int, text string")
    assert got(d.contamination(left, right, block_words=block_words)) == brute(docs, items)


@pytest.mark.parametrize("block_words", [1 << 20, 8])
def test_items_without_an_id(spark, block_words):
    """A null item id meets another item's in one document."""
    left = spark.createDataFrame([(1, "one two three four, five six"), (2, "five six"), (3, "none")], "doc_id long, text string")
    items = [(None, "one two"), (8, "three four"), (None, "five six"), (3, "two three")]
    found = d.contamination(left, spark.createDataFrame(items, "item_id int, text string"), block_words=block_words)
    assert sorted((r.id, r.n_hit, r["items"]) for r in found.collect()) == [(1, 6, [3, 8, None]), (2, 2, [None]), (3, 0, [])]


def test_chunks_do_not_matter(spark, monkeypatch):
    docs, items = cases()
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    right = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(d.tx.chunks, "__defaults__", (50,))
    assert got(d.contamination(left, right)) == brute(docs, items)


def judged(docs, items, slop=0):
    """The same without Spark: one segment, one block of windows."""
    ids, texts = zip(*docs, strict=True)
    row = d._segment(pa.array(texts, pa.string()), None) | {"ids": list(ids)}
    keys, parts = zip(*items, strict=True)
    windows = d.Windows(list(keys), pa.array(parts, pa.string()), d.WINDOW)
    return sorted(((k, n, h, tuple(sorted(x))) for k, n, h, _, x in d._judged(row, windows, slop)), key=str)


@pytest.mark.parametrize("postings", [1, 7, 1 << 20])
def test_slices_do_not_matter(monkeypatch, postings):
    docs, items = cases()
    monkeypatch.setattr(d, "SLICE", postings)
    docs = [(k, t if k != 4 else t[:600]) for k, t in docs]
    assert judged(docs, items) == brute(docs, items)


def test_repeated_words_in_bounded_memory():
    """A text of two million bytes and an item of one word each."""
    n = 1_000_000
    tracemalloc.start()
    found = judged([(1, "a " * n), (2, "a " * 12), (3, "b")], [(k, "a " * 400) for k in range(3)] + [(9, "A b " * 200)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(1, n, n, (0, 1, 2)), (2, 12, 0, ()), (3, 1, 0, ())]
    assert peak < 500e6


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id string, text string")
    assert got(d.contamination(docs, items.limit(0))) == [(1, 2, 0, ())]
    assert got(d.contamination(docs.limit(0), items)) == []
    assert got(d.contamination(docs, items)) == [(1, 2, 2, ("1",))]


def test_proximity(spark):
    docs = [(1, "x a b c y"), (2, "a q b c"), (3, "a q q q b c"), (4, "c b")]
    left = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    right = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert {r.id for r in d.contamination(left, right).collect() if r.n_hit} == {1}
    near = {r.id: r.spans for r in d.contamination(left, right, slop=1).collect() if r.n_hit}
    assert near == {1: [[1, 4]], 2: [[0, 4]]}


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    expected = [
        (k, n, h, len(x), hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest(), h > 0 and 20 * h >= n)
        for k, n, h, x in brute(docs, items)
    ]
    rows = queries.op6_decontamination(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(expected)
    assert any(r.contaminated for r in rows)
