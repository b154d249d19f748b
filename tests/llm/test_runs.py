import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from verdikt.llm import queries, runs

SPACE = " \t\n\r\x0b\x0c"


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def plain_runs(w, least=12):
    """Maximal stretches of every period, one period after the other."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def changed(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(docs):
    out = Counter()
    for doc_id, text in docs:
        w = changed(doc_id, words_of(text))
        found = plain_runs(w)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(((-n, s, q) for s, n, q in found), default=None)
        top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        out[(doc_id, len(found), *top, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))] += 1
    return out


def got(df):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return Counter(tuple(r[c] for c in names) for r in df.select(*names).collect())


def test_query_against_a_plain_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = expected([(r.doc_id, r.text) for r in docs])
    assert got(queries.op11_periodic_runs(spark, sf_dir)) == want
    assert sum(1 for row in want if row[1]) >= 10


def found(texts, least=12):
    """Runs of texts of words that share one grammar."""
    flat = np.array([hash(w) & (1 << 62) - 1 for t in texts for w in t], np.uint64)
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])]
    doc, start, stop, q = runs.find(flat, bounds, least)
    out = [[] for _ in texts]
    for d, s, e, p in zip(doc.tolist(), start.tolist(), stop.tolist(), q.tolist(), strict=True):
        out[d].append((s - int(bounds[d]), e - s, p))
    return out


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("least", [9, 12])
def test_small_alphabets(seed, least):
    """Words of few letters are full of runs, nested and overlapping ones."""
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        letters = "abcde"[: rng.randint(1, 4)]
        base = rng.choices(letters, k=rng.randint(0, 50))
        if rng.random() < 0.5 and base:
            p = rng.randint(1, len(base))
            base += (base[-p:] * 9)[: rng.randint(0, 80)] + rng.choices(letters, k=rng.randint(0, 9))
        texts.append(base)
    assert found(texts, least) == [plain_runs(t, least) for t in texts]


def test_long_repetitions():
    fibonacci = ["a", "a b"]
    while len(fibonacci[-1]) < 2000:
        fibonacci.append(fibonacci[-1] + " " + fibonacci[-2])
    block = [f"w{k}" for k in range(37)]
    texts = [["x"] * 4000, ["x", "y"] * 700 + ["x"], fibonacci[-1].split(), block * 20 + ["z"] + block * 20, [f"u{k}" for k in range(3000)]]
    assert found(texts) == [plain_runs(t) for t in texts]


def test_a_repeated_word_has_few_symbols():
    grammar = runs.Grammar(np.zeros(1 << 17, np.int64), np.array([0, 1 << 17]))
    assert len(grammar.left) <= 20 and len(grammar.top) <= 2


def test_symbols_stand_for_the_words():
    rng = random.Random(5)
    ids = np.array(rng.choices(range(30), k=4000))
    bounds = np.array([0, 1000, 1000, 1003, 4000])
    grammar = runs.Grammar(ids, bounds)

    def spelled(symbol):
        if symbol < grammar.words:
            return [symbol]
        return spelled(grammar.left[symbol - grammar.words]) + spelled(grammar.right[symbol - grammar.words])

    assert [x for s in grammar.top.tolist() for x in spelled(s)] == ids.tolist()
    assert not set(grammar.place.tolist()) - set(range(4000)) and set(bounds[:-1].tolist()) <= set(grammar.place.tolist())
    for k, at in enumerate(grammar.at.tolist()):
        s = spelled(grammar.words + k)
        assert ids[at : at + len(s)].tolist() == s
    free = ~grammar.last[:-1]
    pairs = Counter(zip(grammar.top[:-1][free].tolist(), grammar.top[1:][free].tolist(), strict=True))
    assert max(pairs.values()) == 1 or all(a == b for (a, b), n in pairs.items() if n > 1)


def test_odd_rows(spark, tmp_path):
    line = " ".join(f"w{k}" for k in range(9))
    texts = [None, "", " \t\n", "one", "a " * 12, "a " * 11, "ä ö " * 20, f"{line}\n" * 4 + "end", "x" * 100_000, "a b\x0b\x0c c " * 5, f"{line} " * 1500]
    docs = [(k, t, 1, "z") for k, t in enumerate(texts)] + [(None, "b " * 30, 1, "z"), (3, "a " * 12, 1, "z"), (3, "a " * 12, 1, "z")]
    docs += [(k, line + " " + line, 1, "z") for k in range(100, 160)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, runs int, collapsed string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert got(queries.op11_periodic_runs(spark, str(tmp_path))) == expected([d[:2] for d in docs])
    kept = {r.id: r.collapsed for r in runs.repeated(frame.where("doc_id in (4, 7)")).collect()}
    assert kept == {4: "a", 7: line + " end"}
    frame.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_periodic_runs(spark, f"{tmp_path}/none").count() == 0
