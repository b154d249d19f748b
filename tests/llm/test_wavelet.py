import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from verdikt.llm import queries, wavelet
from verdikt.llm.pieces import Pieces
from verdikt.llm.store import scratch

BPE = path("byte_bpe_50k.json")
ODD = list(" \n\t'strevmlld a9,.éß—中あ\U0001f600Ω͸") + ["'s", "'ll", "'re", " '", "  ", "<|endoftext|>"]


def plain(texts):
    library = Tokenizer.from_file(BPE)
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pieces_are_the_librarys():
    r = random.Random(1)
    texts = ["".join(r.choices(ODD, k=r.randint(0, 40))) for _ in range(2000)]
    texts += [None, "", " ", "'", "a'", "'s", "  a", "a  ", "a\n\n b"]
    pieces = Pieces(open(BPE).read())
    for group in (texts, texts[::-1]):
        ids, bounds = pieces.encode(pa.array(group))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == plain(group)
    assert pieces.encode(pa.array([], pa.string()))[1].tolist() == [0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_go_whole(name):
    texts = ["One two", None, "three's"]
    ids, bounds = Pieces(open(path(name)).read()).encode(pa.array(texts))
    library = Tokenizer.from_file(path(name))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [
        library.encode(t or "", add_special_tokens=False).ids for t in texts
    ]


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (9, 2), (5000, 3), (9000, 50257), (4096, 70000)])
def test_wavelet_matrix(n, top):
    x = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    wm = wavelet.WaveletMatrix.of(x)
    assert wm.decode().tolist() == x.tolist()
    for i in range(0, n, 97):
        assert wm.access(i) == x[i]
    for token in [0, 1, *x[:3].tolist(), 99999]:
        at = np.flatnonzero(x == token)
        assert wm.count(token) == len(at)
        assert wm.count(token, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
        assert wm.occurrences(token)[:50] == at.tolist()[:50] if len(at) < 500 else wm.select(token, 7) == at[7]
    with pytest.raises(IndexError):
        wm.access(n)


def expected(rows):
    start, out = 0, []
    for (key, _), ids in zip(rows, plain([t for _, t in rows]), strict=True):
        ids = [*ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("part", [1 << 24, 3])
def test_files(spark, part, monkeypatch):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "the cat"), (7, "It's here"), (8, "word " * 3000), (9, "the")]
    monkeypatch.setattr(wavelet, "PART_TOKENS", part)
    made = scratch(spark, "t")
    docs = spark.createDataFrame([(*x, 5, "b") for x in rows[::-1]], "doc_id long, text string, n int, planes string")
    wavelet.write_tokens(docs.repartition(3), made, BPE, shard_bytes=64)
    shards = wavelet.read_shards(spark, made)
    got = [tuple(r) for r in wavelet.token_digests(shards).orderBy("start").collect()]
    assert got == expected(rows)
    back = {r.id: r.tokens for r in wavelet.read_tokens(shards).collect()}
    assert back[3] == [*plain(["the cat"])[0], 2]
    the = plain([" word"])[0][0]
    stream = [t for r in wavelet.read_tokens(shards).orderBy("start").collect() for t in r.tokens]
    assert sorted(r.position for r in wavelet.occurrences(shards, the).collect()) == [i for i, t in enumerate(stream) if t == the]


def test_repeats_and_empty(spark):
    docs = spark.createDataFrame([(5, "a b")] * 40 + [(4, "c")], "doc_id int, text string")
    made = scratch(spark, "t")
    wavelet.write_tokens(docs, made, BPE, shard_bytes=16)
    got = wavelet.token_digests(wavelet.read_shards(spark, made)).orderBy("start").collect()
    assert [r.id for r in got] == [4] + [5] * 40
    assert [r.start for r in got] == [0, *range(2, 2 + 3 * 40, 3)]
    made = scratch(spark, "t")
    wavelet.write_tokens(docs.limit(0), made, BPE)
    assert wavelet.token_digests(wavelet.read_shards(spark, made)).collect() == []


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_token_files(spark, sf_dir).collect()]
    assert sorted(got) == expected(rows)
