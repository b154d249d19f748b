"""Token ids written as wavelet matrices, a compressed shard per file.

``write_tokens`` deals documents over shards in ascending order of their id,
encodes each text, and stores the ids of a shard as bit planes: plane after
plane from the highest bit, the sequence is split stably by that bit. With
counts of ones at every ``STEP`` bits a plane answers rank and select, so that
the file itself gives single tokens, counts and occurrences of an id without
being decoded. The table is written by Spark's own committer: a lost executor
repeats its shards, and a half-written shard is never seen.

File format (a Parquet row per shard, normally one in a file): ``shard, part``
its place in the order, ``ids`` the documents in order, ``lengths`` their token
counts (little-endian unsigned 32-bit), ``n`` tokens, ``bits`` planes, ``zeros``
per plane, ``planes`` (bits from low to high, each plane padded to a byte),
``ranks`` (unsigned 32-bit, ones before each ``STEP`` bits, plane by plane).

Defined results: null and empty texts hold the end id only; documents with a
null id come first; repeated ids stay side by side, each with its own tokens;
an empty table gives an empty file set. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from verdikt.llm import text as tx
from verdikt.llm.pieces import encoder

STEP = 4096
SHARD_BYTES = 16 << 20
#: Bytes of text that are encoded together.
CHUNK = 1 << 20
#: A shard that its range made larger is written in parts of so many tokens.
PART_TOKENS = 1 << 22
#: Ones in a byte.
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint32)


class WaveletMatrix:
    """A sequence of ids as bit planes with rank and select."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: np.ndarray, ranks: np.ndarray) -> None:
        self.n, self.bits, self.zeros = n, bits, zeros
        self.planes, self.ranks = planes.reshape(bits, -1), ranks.reshape(bits, -1)

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        bits = max(1, int(ids.max()).bit_length()) if n else 1
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for bit in range(bits - 1, -1, -1):
            ones = ((x >> bit) & 1).astype(bool)
            plane = np.packbits(ones, bitorder="little")
            planes.append(plane)
            blocks = np.r_[plane, np.zeros(-len(plane) % (STEP // 8), np.uint8)].reshape(-1, STEP // 8)
            ranks.append(np.r_[0, np.cumsum(ONES[blocks].sum(1))].astype(np.uint32))
            low = x[~ones]
            zeros.append(len(low))
            x = np.concatenate([low, x[ones]])
        return cls(n, bits, zeros, np.concatenate(planes), np.concatenate(ranks))

    def decode(self) -> np.ndarray:
        """The whole sequence: the splits undone from the lowest bit up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, kind)
            z = self.zeros[level]
            up[~ones] = x[:z]
            up[ones] = x[z:] | kind(1 << (self.bits - 1 - level))
            x = up
        return x

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, byte = i // STEP, i // 8
        seen = int(self.ranks[level, block]) + int(ONES[self.planes[level, block * (STEP // 8) : byte]].sum())
        return seen + int(ONES[self.planes[level, byte] & ((1 << (i % 8)) - 1)]) if i % 8 else seen

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = int(self.planes[level, i // 8]) >> (i % 8) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._ones(level, low), self._ones(level, high)
            if token >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often ``token`` stands in positions low to high, high excluded."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that kind in a plane."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * STEP - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        first = block * (STEP // 8)
        plane = np.unpackbits(self.planes[level, first : first + STEP // 8], bitorder="little")
        return block * STEP + int(np.flatnonzero(plane == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def _schema(id_type: T.DataType) -> T.StructType:
    return (
        T.StructType()
        .add("shard", T.IntegerType())
        .add("part", T.IntegerType())
        .add("ids", T.ArrayType(id_type))
        .add("lengths", T.BinaryType())
        .add("n", T.LongType())
        .add("bits", T.IntegerType())
        .add("zeros", T.ArrayType(T.LongType()))
        .add("planes", T.BinaryType())
        .add("ranks", T.BinaryType())
    )


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])


def _row(schema: pa.Schema, shard: int, part: int, ids: pa.Array, lengths: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
    wm = WaveletMatrix.of(tokens)
    values = [shard, part, None, lengths.astype("<u4").tobytes(), wm.n, wm.bits, wm.zeros, wm.planes.tobytes(), wm.ranks.tobytes()]
    columns = [pa.array([v], f.type) for v, f in zip(values, schema, strict=True)]
    columns[2] = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(schema.field("ids").type)
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    shard_bytes: int = SHARD_BYTES,
) -> None:
    """Write the tokens of all documents under ``path``.

    ``tokenizer`` names a ``tokenizers`` JSON file on the driver; its text, of
    fixed size, is sent to the tasks.
    """
    spark = docs.sparkSession
    made = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    schema = _schema(chosen.schema["id"].dataType)
    arrow = _arrow(schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        pieces, shard = encoder(made.value), TaskContext.get().partitionId()
        ids, lengths, tokens, held, part = [], [], [], 0, 0

        def flushed() -> pa.RecordBatch:
            return _row(arrow, shard, part, pa.concat_arrays(ids), np.concatenate(lengths), np.concatenate(tokens))

        for batch in tx.chunks(batches, "text", CHUNK):
            codes, bounds = pieces.encode(batch.column("text"))
            ids.append(batch.column("id"))
            lengths.append(np.diff(bounds) + 1)
            tokens.append(np.insert(codes, bounds[1:], end_id).astype(np.uint16 if codes.max(initial=end_id) < 1 << 16 else np.uint32))
            held += len(tokens[-1])
            if held >= PART_TOKENS:
                yield flushed()
                ids, lengths, tokens, held, part = [], [], [], 0, part + 1
        if ids:
            yield flushed()
            ids, lengths, tokens = [], [], []
        tx.release()

    # The row number splits an id that a large share of the rows has.
    ordered = chosen.withColumn("_row", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(max(1, -(-total // shard_bytes)), "id", "_row")
    ordered = ordered.sortWithinPartitions("id", "_row").drop("_row")
    ordered.mapInArrow(encode, schema).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """The shards as written."""
    return spark.read.schema(_schema(id_type or T.LongType())).parquet(path)


def _placed(rows: DataFrame, shards: DataFrame, column: str) -> DataFrame:
    """Adds to a place inside its shard the tokens of all shards before."""
    # One row per shard of some megabytes: this order is over the shards alone.
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(starts, ["shard", "part"])
    return placed.withColumn(column, F.col(column) + F.col("_before")).drop("shard", "part", "_before")


def _wavelet(row: dict) -> WaveletMatrix:
    return WaveletMatrix(
        row["n"], row["bits"], row["zeros"], np.frombuffer(row["planes"], np.uint8), np.frombuffer(row["ranks"], np.uint32)
    )


def per_shard(shards: DataFrame, make: Callable[[dict, WaveletMatrix], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """Rows that ``make`` reads out of each shard's wavelet matrix; ``shard``
    and ``part`` stand before them."""
    schema = T.StructType([shards.schema["shard"], shards.schema["part"], *schema.fields])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                rows = [(row["shard"], row["part"], *x) for x in make(row, _wavelet(row))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return shards.mapInArrow(run, schema)


def _bounds(row: dict) -> np.ndarray:
    return np.r_[0, np.cumsum(np.frombuffer(row["lengths"], "<u4").astype(np.int64))]


def read_tokens(shards: DataFrame) -> DataFrame:
    """Each document with its first token's place and all its ids."""
    kind = shards.schema["ids"].dataType.elementType
    schema = T.StructType().add("id", kind).add("start", T.LongType()).add("tokens", T.ArrayType(T.IntegerType()))

    def make(row: dict, wm: WaveletMatrix) -> Iterator[tuple]:
        ids, bounds = wm.decode(), _bounds(row)
        for k, doc in enumerate(row["ids"]):
            yield doc, int(bounds[k]), ids[bounds[k] : bounds[k + 1]].astype(np.int32)

    return _placed(per_shard(shards, make, schema), shards, "start")


def token_digests(shards: DataFrame) -> DataFrame:
    """Each document's first place, number of tokens and checksum of its ids."""
    kind = shards.schema["ids"].dataType.elementType
    schema = T.StructType().add("id", kind).add("start", T.LongType()).add("n_tokens", T.LongType()).add("ids_crc32", T.LongType())

    def make(row: dict, wm: WaveletMatrix) -> Iterator[tuple]:
        ids, bounds = memoryview(wm.decode().astype("<u4")).cast("B"), _bounds(row)
        for k, doc in enumerate(row["ids"]):
            a, b = int(bounds[k]), int(bounds[k + 1])
            yield doc, a, b - a, zlib.crc32(ids[4 * a : 4 * b])

    return _placed(per_shard(shards, make, schema), shards, "start")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """Where ``token`` stands, found by select on each shard's planes."""
    schema = T.StructType().add("position", T.LongType())

    def make(row: dict, wm: WaveletMatrix) -> Iterator[tuple]:
        return ((at,) for at in wm.occurrences(token))

    return _placed(per_shard(shards, make, schema), shards, "position")
