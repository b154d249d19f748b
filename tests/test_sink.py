"""The stream's sink: keys once, whatever comes again, and few files."""

import glob

import pytest

from verdikt.operators.score import score
from verdikt.streaming import sink
from verdikt.streaming.score_stream import STORE, keys_on_disk, read_scored, score_stream

SCHEMA = "run string, row_id bigint, task string, slice string, raw string"


def answers(spark, ids, run="a", raw='{"title":"t"}'):
    return spark.createDataFrame([(run, i, "bug", "gen", raw) for i in ids], SCHEMA)


def keep(df):
    return df


def test_filters_miss_nothing(spark, tmp_path):
    path = str(tmp_path)
    name, bitmaps = sink._add(answers(spark, range(6000)), path)
    assert bitmaps == 2
    filters = sink._read(spark, f"{path}/filters", [name])
    found = {r.row_id for r in sink.maybe_there(answers(spark, range(0, 12_000)).select("run", "row_id"), filters, [(name, bitmaps)]).collect()}
    assert found >= set(range(6000)) and len(found) < 6000 + 600


def test_repeats_restarts_and_rewriting(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "FOLDERS", 3)
    path = str(tmp_path)
    for n in range(6):
        sink.commit(answers(spark, range(n * 10, n * 10 + 15), raw=str(n)), path, "q", n, keep)
    # The last batch again, with other rows: it is committed and stays as it is.
    sink.commit(answers(spark, range(500, 520)), path, "q", 5, keep)
    # A new checkpoint begins at batch 0 again; its keys are in the sink.
    sink.commit(answers(spark, range(0, 70)), path, "other", 0, keep)
    rows = sink.rows_of(spark, path, SCHEMA).collect()
    assert sorted(r.row_id for r in rows) == list(range(70))
    assert {r.raw for r in rows if r.row_id < 65} == set("012345")
    assert len(sink.manifest(spark, path).where("folder is not null").collect()) <= 3
    files = [f for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)]
    assert len(files) <= sink.BUCKETS * (2 * 3 + 2)
    assert len(glob.glob(f"{path}/manifest/version=*")) <= 3 + 2


def test_what_fails_before_its_commit_is_not_there(spark, tmp_path):
    path = str(tmp_path)
    sink.commit(answers(spark, range(5)), path, "q", 0, keep)

    def broken(df):
        sink._add(df, path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        sink.commit(answers(spark, range(3, 9)), path, "q", 1, broken)
    assert sink.rows_of(spark, path, SCHEMA).count() == 5
    sink.commit(answers(spark, range(3, 9)), path, "q", 1, keep)
    assert sorted(r.row_id for r in sink.rows_of(spark, path, SCHEMA).collect()) == list(range(9))


def test_a_late_repeat_after_the_state_has_gone(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    for ids, mark in (((0, 4), "mark"), ((2, 7), "mark"), ((1, 9), "fresh")):
        answers(spark, range(*ids)).coalesce(1).write.mode("append").parquet(source)
        score_stream(stream(), path, str(tmp_path / mark), remembered="1 second").awaitTermination()
    got = read_scored(spark, path)
    want = score(answers(spark, range(9)))
    columns = ["row_id", "extract", "score"]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())


def test_the_streams_keys_lie_on_disk(spark, tmp_path):
    source, mark = str(tmp_path / "in"), tmp_path / "mark"
    answers(spark, range(20)).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    score_stream(stream, str(tmp_path / "out"), str(mark)).awaitTermination()
    # RocksDB's snapshots or changes; a store in the heap would leave deltas.
    kept = {f.suffix for f in (mark / "state" / "0").rglob("*") if f.is_file()}
    assert kept & {".zip", ".changelog"} and ".delta" not in kept
    assert spark.conf.get(f"{STORE}.providerClass", None) is None
    assert read_scored(spark, str(tmp_path / "out")).count() == 20
    assert not list((tmp_path / "out" / "staged").glob("*"))


def test_a_session_keeps_the_store_it_sets(spark):
    name = f"{STORE}.rocksdb.maxMemoryUsageMB"
    spark.conf.set(name, "77")
    try:
        with keys_on_disk(spark):
            assert spark.conf.get(name) == "77"
            assert spark.conf.get(f"{STORE}.rocksdb.boundedMemoryUsage") == "true"
        assert spark.conf.get(name) == "77"
    finally:
        spark.conf.unset(name)


def test_a_large_batch_is_dealt_over_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "FILE_ROWS", 200)
    monkeypatch.setattr(sink, "FILE_BITMAPS", 1)
    path, rows = str(tmp_path), 12_800
    sink.commit(answers(spark, range(rows)), path, "q", 0, keep, rows)
    name, bitmaps = next((r.folder, r.bitmaps) for r in sink.manifest(spark, path).collect() if r.folder)
    files = glob.glob(f"{path}/data/folder={name}/bucket=*/*.parquet")
    sizes = [spark.read.parquet(f).count() for f in files]
    assert len(files) == 4 * sink.BUCKETS and sum(sizes) == rows and max(sizes) < 2 * sink.FILE_ROWS
    assert bitmaps == 4 and len(glob.glob(f"{path}/filters/folder={name}/*.parquet")) > 1
    again = answers(spark, range(rows - 50, rows + 50))
    assert sorted(r.row_id for r in sink.unseen(again, path, [(name, bitmaps)]).collect()) == list(range(rows, rows + 50))
