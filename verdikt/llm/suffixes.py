"""Exact removal of byte strings that stand more than once.

A byte is removed if a string of ``length`` bytes that covers it also starts
anywhere else, in the same text or in another. Prefix doubling would sort a
rank pair for every byte position at each of the offsets 1, 2, 4 ... up to the
length; at this threshold almost all of that work is spent on positions whose
first bytes are already unique. Here the positions are thinned first, without
losing one, and the doubling runs on what is left:

1. Each start belongs to an anchor: of the ``GRAM``-byte strings inside its
   window, the one with the least hash. The choice depends on the window's
   bytes alone, so equal windows have equal anchors at equal places. The starts
   of one anchor are consecutive and make one row, a run.
2. Rank at ``GRAM`` bytes: runs are grouped by the anchor's string; a run whose
   string is unique is unique and goes.
3. Rank pairs past the threshold: the string's rank is paired with the rank of
   the whole that the run's windows cover. Runs with equal pairs form a class;
   of two and more in a class every start repeats.
4. Rank pairs at the threshold: where different classes of one string remain,
   one run of each sends the rank of each start's full length, and equal ranks
   are counted.

Ranks are 64-bit fingerprints, brought together by Spark's shuffles and sorts,
so equal strings meet without a global order. Only runs travel; text is moved
twice, compressed and by its id.

Defined results: null text is empty; a null id is an id like any other; a text shorter than the length keeps every
byte; repeated rows repeat each other's bytes, so both lose what is long
enough. Removal is judged on the input. The kept bytes may no longer be valid
UTF-8 and are returned as binary. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from verdikt.llm import text as tx
from verdikt.llm.pieces import expanded
from verdikt.llm.store import stored

LENGTH = 400
GRAM = 232
#: Starts of one very long text that are looked at together.
SPAN = 4 << 20
_PLACE = np.uint64(28)  # bits of a place inside a span


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbouring keys (block prefix and suffix minima)."""
    n = len(keys)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = keys
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class _Runs:
    """The runs of a span of texts, places counted in the span."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> None:
        self.prefix = prefix = tx.prefix_hash(data)
        places = np.arange(len(data) - gram + 1)
        grams = tx.span_hash(prefix, places, places + gram)
        keys = (grams >> _PLACE << _PLACE) | places.astype(np.uint64)
        anchors = (_least(keys, length - gram + 1) & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
        many = np.maximum(np.diff(offsets) - length + 1, 0)
        starts = expanded(offsets[:-1], many)
        text = np.repeat(np.arange(len(many)), many)
        anchor = anchors[starts]
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]) if len(starts) else np.empty(0, np.int64)
        self.text, self.anchor = text[first], anchor[first]
        self.low = starts[first]
        self.high = starts[np.r_[first[1:], len(starts)] - 1] if len(first) else first
        self.gram = grams[self.anchor]
        self.whole = tx.span_hash(prefix, self.low, self.high + length)
        self.begin, self.end = offsets[self.text], offsets[self.text + 1]


def _spans(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes and offsets of a batch; a very long text in overlapping spans,
    with the place of the span in its text."""
    data, offsets = tx.utf8(batch.column("text"))
    if len(data) <= SPAN + length or len(offsets) > 2:
        if len(data) >= length:
            yield data, offsets, 0
        return
    for k in range(0, len(data) - length + 1, SPAN):
        piece = data[k : k + SPAN + length - 1]
        yield piece, np.array([0, len(piece)]), k


def _chosen(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, mark, text``; the mark tells texts with the same id apart (all rows
    without an id have the same, so theirs is longer)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mark = F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.hash(text))
    return docs.select(F.col(id_col).alias("id"), mark.alias("mark"), text.alias("text"))


def _met(texts: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """``texts`` with what was found for their id and mark; ids may be null."""
    found = found.withColumnsRenamed({"id": "_id", "mark": "_mark"})
    return texts.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), how).drop("_id", "_mark")


def _packed(source: DataFrame) -> DataFrame:
    """``id, mark, packed``: the text compressed, to be moved."""
    kind = source.schema["id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ZstdCompressor(level=1)
        for batch in tx.chunks(batches, "text"):
            packed = [codec.compress(t.as_buffer()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(packed, pa.binary())], names=["id", "mark", "packed"])

    return source.mapInArrow(make, f"id {kind}, mark long, packed binary")


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _grams(source: DataFrame, length: int, gram: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches, "text"):
            for data, offsets, _ in _spans(batch, length):
                yield pa.RecordBatch.from_arrays([_i64(_Runs(data, offsets, length, gram).gram)], names=["gram"])

    return source.select("text").mapInArrow(make, "gram long")


def _runs(source: DataFrame, length: int, gram: int) -> DataFrame:
    kind = source.schema["id"].dataType.simpleString()
    names = ["id", "mark", "gram", "whole", "low", "high"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches, "text"):
            for data, offsets, at in _spans(batch, length):
                runs = _Runs(data, offsets, length, gram)
                own = batch.select(["id", "mark"]).take(pa.array(runs.text))
                back = at - runs.begin
                columns = [*own.columns, _i64(runs.gram), _i64(runs.whole), _i64(runs.low + back), _i64(runs.high + back)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(make, f"id {kind}, mark long, gram long, whole long, low long, high long")


def _ranks(texts: DataFrame, length: int) -> DataFrame:
    """The rank at full length of each start in ``opens``."""
    kind = texts.schema["id"].dataType.simpleString()
    names = ["id", "mark", "start", "rank", "weight"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                data = np.frombuffer(codec.decompress(batch.column("packed")[row].as_buffer()), np.uint8)
                opens = np.array([(o["low"], o["high"], o["weight"]) for o in batch.column("opens")[row].as_py()]).reshape(-1, 3)
                for k in range(0, len(data), SPAN):  # bounded also for one very long text
                    inside = opens[(opens[:, 0] < k + SPAN) & (opens[:, 1] >= k)]
                    low, high = np.maximum(inside[:, 0], k), np.minimum(inside[:, 1], k + SPAN - 1)
                    starts = expanded(low, high - low + 1)
                    if not len(starts):
                        continue
                    prefix = tx.prefix_hash(data[k : k + SPAN + length])
                    rank = tx.span_hash(prefix, starts - k, starts - k + length)
                    weight = np.repeat(inside[:, 2], high - low + 1)
                    own = batch.select(["id", "mark"]).take(pa.array(np.full(len(starts), row)))
                    yield pa.RecordBatch.from_arrays([*own.columns, _i64(starts), _i64(rank), pa.array(weight.astype(np.int32))], names=names)

    return texts.select("id", "mark", "packed", "opens").mapInArrow(make, f"id {kind}, mark long, start long, rank long, weight int")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``id, mark, low, high``: starts, low to high, whose strings repeat."""
    source = _chosen(docs, id_col, text_col)
    shared = _grams(source, length, gram).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    runs = stored(_runs(source, length, gram).join(stored(shared, "grams"), "gram"), "runs")

    # Equal whole windows: one class, of which any run stands for all.
    one = [F.first(c).alias(c) for c in ("id", "mark", "low", "high")]
    classes = stored(runs.groupBy("gram", "whole").agg(F.count("*").alias("n"), *one), "classes")
    same = runs.join(classes.where("n > 1").select("gram", "whole"), ["gram", "whole"], "left_semi")

    # Of strings with several classes, the starts of one run of each.
    several = classes.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram")
    opens = classes.join(several, "gram", "left_semi").groupBy("id", "mark")
    opens = opens.agg(F.collect_set(F.struct("low", "high", F.least("n", F.lit(2)).cast("int").alias("weight"))).alias("opens"))
    ranks = _ranks(_met(_packed(source), opens), length)
    # A start of a repeated row is sent by each copy, but such rows have no
    # class of one run: its weight is 2 already.
    found = ranks.withColumn("total", F.sum("weight").over(Window.partitionBy("rank"))).where("total > 1 and weight = 1")
    found = found.select("id", "mark", F.col("start").alias("low"), F.col("start").alias("high"))
    return same.select("id", "mark", "low", "high").unionByName(found)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``id, n_bytes, spans, kept``: each text's removed spans (maximal, first
    byte and the one behind the last) and its remaining bytes."""
    source = _chosen(docs, id_col, text_col)
    found = repeats(docs, id_col, text_col, length, gram)
    covers = found.groupBy("id", "mark").agg(F.collect_set(F.struct("low", "high")).alias("covers"))
    kind = source.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ZstdDecompressor()
        for batch in tx.chunks(batches, "packed"):
            sizes, spans, kept = [], [], []
            for packed, covers in zip(batch.column("packed"), batch.column("covers").to_pylist(), strict=True):
                data = codec.decompress(packed.as_buffer())
                own = sorted((c["low"], c["high"] + length) for c in covers or ())
                joined: list[list[int]] = []
                for a, b in own:
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b])
                at, left = 0, []
                for a, b in joined:
                    left.append(data[at:a])
                    at = b
                left.append(data[at:])
                sizes.append(len(data))
                spans.append(joined)
                kept.append(b"".join(left))
            columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "spans", "kept"])

    joined = _met(_packed(source), covers, "left").select("id", "packed", "covers")
    return joined.mapInArrow(cut, f"id {kind}, n_bytes long, spans array<array<long>>, kept binary")
