import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdikt.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size int, key string"


def size(text):
    return len(WORD.findall(text or ""))


def wanted(sizes):
    """Targets by resharing the excess until none is over its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        made = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if made[s] > 3 * sizes[s]}
        if not over:
            return {**{s: 3.0 * sizes[s] for s in capped}, **made}
        capped |= over


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA).repartition(4)


def cases(seed, n=3000):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        source = r.choice(["a"] * 10 + ["b", "B", "é", "", None, "zz"])
        length = r.choice([0, 1, 5, 20, 60, 300]) if k % 500 else 4000
        rows.append((k, " \n".join("w" * r.randint(1, 3) for _ in range(length)) if length else r.choice([None, "", "\t "]), source))
    return rows + rows[100:110] * 3 + [(None, "no id here", "a")]


def test_word_count(spark):
    texts = [None, "", " ", "a", " a", "a ", "\x0b a\x0c b\x1c\n", "a\xa0b c", "é\r\nß", "x" * 500, "\x85 \U0001f600 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.word_count(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == {t: size(t) for t in texts}


@pytest.mark.parametrize("leaf,fan", [(64, 64), (3, 2)])
def test_mix(spark, monkeypatch, leaf, fan):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    monkeypatch.setattr(mixing, "FAN", fan)
    monkeypatch.setattr(mixing, "ROOM", leaf / 4)
    rows = cases(leaf)
    docs = table(spark, rows)
    got = mixing.copies(docs).collect()
    assert Counter((r.id, r.size) for r in got for _ in range(r.rows)) == Counter((k, size(t)) for k, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = wanted(sizes)
    key = {("n" if s is None else "s" + s): s for s in sizes}
    taken = Counter()
    for r in got:
        s = key[r.key]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        assert 0 <= r.copies <= 3
        ratio = r.target / r.source_size if r.source_size else 0
        assert int(ratio) <= r.copies <= -(-ratio // 1) + 1e-9
        taken[s] += r.copies * r.size * r.rows
    for s in sizes:
        assert abs(taken[s] - want[s]) <= (300 if leaf == 64 else 4000), s
    again = mixing.copies(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_unbiased(spark):
    rows = [(k, "w " * (1 + k % 7), "ab"[k % 2]) for k in range(40)]
    docs = table(spark, rows)
    total = Counter()
    for seed in range(8):
        for r in mixing.copies(docs, seed=seed).collect():
            total[r.id] += r.copies
    got = {k: total[k] / 8 for k, _, _ in rows}
    for source in (0, 1):
        own = [got[k] for k, _, _ in rows if k % 2 == source]
        ratio = [r.target / r.source_size for r in mixing.copies(docs).collect() if r.id % 2 == source][0]
        assert all(abs(x - ratio) <= 1 for x in own)
        assert abs(sum(own) / len(own) - ratio) < 0.15


def test_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, "c", "y"), (3, None, None), (4, "d e f", "y"), (None, "q", "x")]
    docs = table(spark, rows)
    made = mixing.mixed(docs)
    assert made.columns == docs.columns
    copies = {(r.id, r.size): r.copies for r in mixing.copies(docs).collect()}
    assert Counter((r.doc_id, size(r.text)) for r in made.collect()) == Counter(
        {k: n for k, n in (((k, size(t)), copies[k, size(t)] * [r[:2] for r in rows].count((k, t))) for k, t, _ in rows) if n}
    )
    assert mixing.copies(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []
    assert [r.copies for r in mixing.copies(docs.where("doc_id = 3")).collect()] == [0]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    sizes, taken, longest = Counter(), Counter(), Counter()
    for d in docs:
        sizes[d.source] += size(d.text)
    want, source = wanted(sizes), {d.doc_id: d.source for d in docs}
    rows = queries.op3_source_mix(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((d.doc_id, size(d.text)) for d in docs)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * want[s] and r.taken <= 3 * r.size
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
