import numpy as np

from verdikt.llm import ann, queries


def exact(rows, queries_, k):
    """Query id -> ranked (distance, id) of all usable rows."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q in queries_:
            far = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good if i != q and len(w) == len(v))
            out[q] = far[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.id))
        assert r.rank == len(out[r.query_id])
    return out


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.standard_normal(4).tolist()) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(30)]  # many equal vectors: ties by id
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 1.0, 1.0]), (204, [float("nan")] * 4), (205, [float("inf")] * 4)]
    rows += [(300, [1.0, 2.0]), (301, [1.0, 3.0]), (302, [5.0]), (None, [1.0] * 4), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, "q") for r in rows], "vec_id long, embedding array<double>, query string").repartition(3)
    asked = {0, 1, 200, 202, 203, 300, 302}
    got = found(ann.neighbours(df, df.where(df.vec_id.isin(*asked))))
    want = exact(rows, asked, 10)
    assert got == {q: v for q, v in want.items() if v}
    assert [i for _, i in got[0]] == list(range(100, 110))
    assert len(got[300]) == 1
    assert found(ann.neighbours(df.limit(0), df)) == {}


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 700)
    monkeypatch.setattr(ann, "QUERIES", 20)
    rng = np.random.default_rng(2)
    rows = [(k, rng.standard_normal(32).tolist()) for k in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.neighbours(df, df.where("vec_id % 50 = 0")))
    want = exact(rows, {k for k, _ in rows if k % 50 == 0}, 10)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.97 * sum(map(len, want.values()))


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = found(queries.op1_nearest_vectors(spark, sf_dir).withColumnRenamed("vec_id", "id"))
    want = exact(rows, {k for k, _ in rows if k % 100 == 0}, 10)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.95 * 10 * len(want)
    every = dict(rows)
    for q, near in got.items():
        assert all(abs(d - np.linalg.norm(np.array(every[q], float) - np.array(every[i], float))) < 1e-9 for d, i in near)
