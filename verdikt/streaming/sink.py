"""A sink of scored answers that holds each key once and few files.

Every batch adds one folder of rows, dealt over buckets of the key's hash, and
then commits it: a manifest version lists the folders that count and the last
batch of each query, and is one file that Spark's committer moves into place. A
batch that runs again after its commit changes nothing; what one left behind
before its commit is in no manifest. Readers take the folders of the last
version.

Beside its rows each folder has a Bloom filter: bitmaps of 32,768 bits, a key's
bits all in one of them, and as many bitmaps as the folder's keys ask for. A
batch looks its keys up in the filters, a bitmap per key and folder, and only
keys that may be there are looked for in the rows of their buckets. After
``FOLDERS`` batches the folders are rewritten as one, so the number of files and
of filters does not grow with the number of batches.

However large a batch is, no task holds much of it: a batch lies in compressed
files while it is looked up and scored, a bucket has a file for each
``FILE_ROWS`` rows, and filters are made by ranges of bitmaps.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.operators.resume import KEY
from verdikt.session import few
from verdikt.sources.jsonl import read_or_empty

#: Buckets of keys, and folders before they become one.
BUCKETS, FOLDERS = 16, 8
#: Bits of one bitmap (fixed by Spark's bitmap functions), bits per key that
#: the filter has, and bits that a key sets.
BITMAP, BITS_PER_KEY, HASHES = 32768, 10, 5
#: Rows of a file, bitmaps of a filter's file, and bytes a Parquet writer holds.
FILE_ROWS, FILE_BITMAPS, WRITER_BYTES = 250_000, 256, 16 << 20

KEYED = "run string, row_id bigint, bucket int"
MANIFEST = "folder string, bitmaps int, query string, batch bigint, version bigint"


def bucket_of() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last version: a row per folder, and one per query with its batch."""
    kept = read_or_empty(spark, lambda: spark.read.schema(MANIFEST).parquet(f"{path}/manifest"), MANIFEST)
    last = kept.agg(F.max("version")).first()[0]
    return kept.where(F.col("version") == F.lit(last).cast("bigint"))


def rows_of(spark: SparkSession, path: str, schema: str, folders: list[str] | None = None) -> DataFrame:
    """All rows that are committed."""
    if folders is None:
        folders = [r.folder for r in manifest(spark, path).where("folder is not null").collect()]
    if not folders:
        return spark.createDataFrame([], schema)
    rows = _read(spark, f"{path}/data", folders, schema)
    return rows.select(*spark.createDataFrame([], schema).columns)


def _read(spark: SparkSession, path: str, folders: list[str], schema: str | None = None) -> DataFrame:
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).parquet(*[f"{path}/folder={f}" for f in folders])


def _bits(bitmaps: Column) -> tuple[Column, list[Column]]:
    """A key's bitmap, from 0, and its bits in it, from 1."""
    bits = [F.pmod(F.xxhash64(*KEY, F.lit(k)), F.lit(BITMAP)) + 1 for k in range(HASHES)]
    return F.pmod(F.xxhash64(*KEY, F.lit("bitmap")), bitmaps), bits


def bloom_filter(keys: DataFrame, bitmaps: int) -> DataFrame:
    """``bitmap, bits`` of a filter over the keys."""
    place, bits = _bits(F.lit(bitmaps))
    # A bitmap's keys meet in one task before anything is set: made in parts,
    # there would be as many copies of the filter as tasks.
    met = keys.select(*KEY, place.alias("bitmap")).repartition(-(-bitmaps // FILE_BITMAPS), "bitmap")
    set_by = [F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias(f"by_{k}") for k, bit in enumerate(bits)]
    each = met.groupBy("bitmap").agg(*set_by).select("bitmap", F.explode(F.array(*[f"by_{k}" for k in range(HASHES)])).alias("bits"))
    return each.groupBy("bitmap").agg(F.bitmap_or_agg("bits").alias("bits"))


def maybe_there(keys: DataFrame, filters: DataFrame, folders: list[tuple[str, int]]) -> DataFrame:
    """The keys that one of the folders may hold; no key of them is missed."""
    sizes = F.array(*[F.struct(F.lit(f).alias("folder"), F.lit(n).alias("bitmaps")) for f, n in folders])
    asked = keys.select(*KEY, F.inline(sizes))
    place, bits = _bits(F.col("bitmaps"))
    met = asked.withColumn("bitmap", place).join(filters, ["folder", "bitmap"])

    def is_set(bit: Column) -> Column:
        byte = F.substring("bits", (F.floor((bit - 1) / 8) + 1).cast("int"), F.lit(1))
        return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), ((bit - 1) % 8).cast("int")) == 1

    hit = is_set(bits[0])
    for bit in bits[1:]:
        hit = hit & is_set(bit)
    return met.where(hit).select(*KEY).distinct()


def _listed(spark: SparkSession, path: str) -> list[str]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _write(df: DataFrame, path: str, mode: str = "error", by: list[str] | None = None) -> None:
    df.write.mode(mode).option("parquet.block.size", WRITER_BYTES).parquet(path, partitionBy=by)


@contextmanager
def staged(batch: DataFrame, path: str, query: str) -> Iterator[DataFrame]:
    """A batch, computed once, in files beside the sink's own for as long as it
    is needed. What a run that broke off left there is written over."""
    spark, place = batch.sparkSession, f"{path}/staged/query={query}"
    _write(batch, place, "overwrite")
    try:
        yield spark.read.schema(batch.schema).parquet(place)
    finally:
        _delete(spark, place)


def _add(df: DataFrame, path: str, rows: int = 0) -> tuple[str, int]:
    """Write rows, some ``rows`` of them, and their filter as a new folder."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    files = -(-rows // (BUCKETS * FILE_ROWS)) or 1
    place = F.col("bucket") * files + F.pmod(F.xxhash64(*KEY, F.lit("file")), F.lit(files)).cast("int")
    dealt = df.withColumn("bucket", bucket_of()).repartitionById(BUCKETS * files, place)
    _write(dealt, f"{path}/data/folder={name}", by=["bucket"])
    kept = rows_of(spark, path, KEYED, [name])
    bitmaps = -(-kept.count() * BITS_PER_KEY // BITMAP) or 1
    _write(bloom_filter(kept, bitmaps), f"{path}/filters/folder={name}")
    return name, bitmaps


def unseen(batch: DataFrame, path: str, folders: list[tuple[str, int]]) -> DataFrame:
    """The rows of a batch whose keys no folder holds."""
    if not folders:
        return batch
    spark = batch.sparkSession
    filters = _read(spark, f"{path}/filters", [f for f, _ in folders])
    maybe = maybe_there(batch.select(*KEY), filters, folders).withColumn("bucket", bucket_of())
    buckets = [r.bucket for r in maybe.select("bucket").distinct().collect()]
    if not buckets:
        return batch
    kept = rows_of(spark, path, KEYED, [f for f, _ in folders]).where(F.col("bucket").isin(buckets))
    return batch.join(kept.join(few(maybe.drop("bucket")), KEY, "left_semi").select(*KEY), KEY, "left_anti")


def commit(batch: DataFrame, path: str, query: str, number: int, prepare, rows: int = 0) -> None:
    """Add what is new in a batch, as ``prepare`` makes it, exactly once.

    ``query`` and ``number`` name the batch; one that is committed is left out.
    The stream's state sees to it that no key stands twice in a batch. ``rows``
    is the number of its rows, by which they are dealt over files.
    """
    spark = batch.sparkSession
    known = manifest(spark, path).collect()
    done = {r.query: r.batch for r in known if r.query is not None}
    if done.get(query, -1) >= number:
        return
    folders = [(r.folder, r.bitmaps) for r in known if r.folder is not None]
    version = max((r.version for r in known), default=-1) + 1
    old: list[str] = []
    added = _add(prepare(unseen(batch, path, folders)), path, rows)
    folders.append(added)
    if len(folders) > FOLDERS:
        old = [f for f, _ in folders]
        whole = _read(spark, f"{path}/data", old).drop("bucket", "folder")
        folders = [_add(whole, path, whole.count())]
    done[query] = number
    entries = [(f, n, None, None, version) for f, n in folders] + [(None, None, q, b, version) for q, b in done.items()]
    spark.createDataFrame(entries, MANIFEST).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    # Readers of the version before may still be under way: its folders go when
    # the next rewriting is committed, and with them what no version lists.
    if old:
        _tidy(spark, path, {f for f, _ in folders} | set(old), version)


def _tidy(spark: SparkSession, path: str, kept: set[str], version: int) -> None:
    """Remove folders and manifests that neither of the last versions needs."""
    for name in ("data", "filters"):
        for entry in _listed(spark, f"{path}/{name}"):
            if entry.removeprefix("folder=") not in kept:
                _delete(spark, f"{path}/{name}/{entry}")
    for entry in _listed(spark, f"{path}/manifest"):
        if entry.startswith("version=") and int(entry.split("=")[1]) < version - 1:
            _delete(spark, f"{path}/manifest/{entry}")
