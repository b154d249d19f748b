"""Cross-entropy difference: texts scored by a target and a background model.

Both are bigram models of words over one vocabulary, interpolated with their
unigrams: the background counts every document, the target those that the
caller marks. Every different word and bigram has its own counts, in a table
that grows with the corpus. A row of it is a bucket: the sorted keys of one
range, and their counts. A key is a 62-bit hash and its kind: a word, a pair
(with the word before, 0 at the beginning) or an end (the last word of a text;
a word is a context as often as it stands anywhere else). Two of 10^9 keys are
expected to meet less than once.

Counts are summed in each block of texts, then by bucket. To be scored, texts
are dealt to blocks of some megabytes; a block asks each bucket for its
different keys once, and the answers meet its texts again. So a very common
word or bigram is one key per block, a task holds a bucket or a block's
answers, and their size does not grow with the corpus. Where the texts to be
scored are those that are counted (``scored``), a block's counts are its
question as well: the bucket that sums them answers at once, without keys, for
the block finds the same sorted keys in its texts again; an answer is a bit a
key, and the counts of those keys that stand elsewhere or in the target. A document's score is
its mean loss per word under the target model less that under the background
model: below 0 it is more like the target.

Defined results: null text and text without words have no tokens and null
losses and score; repeated rows count as often as they stand there; without any
target document the target model is even over the vocabulary. The vocabulary
has as many words as were counted, ``WORDS`` at least. Nulls in the mark
count as false. Other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.llm import text as tx
from verdikt.llm.store import stored

#: Least size of the vocabulary; room for words that were not counted.
WORDS = 1 << 16
#: Bytes of text in a block, and bytes of the corpus for each bucket.
BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 4 << 20
#: Weight of the pair's share against the word's own.
MIX = 0.5

#: Kinds of keys, in their lowest bits.
WORD, PAIR, END = (np.uint64(k) for k in range(3))
_KIND = np.uint64(3)
_HALF = np.uint64(32)
_LAST = np.uint64(0x5851F42D4C957F2D)


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offsets of each text's."""
    data, offsets = tx.utf8(column)
    data = tx.LOWER[data]
    starts, ends, bounds = tx.words(data, offsets, tx.ALNUM)
    return tx.span_hash(tx.prefix_hash(data), starts, ends), bounds


def _before(hashed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The word before each; 0 stands for the beginning."""
    before = np.zeros(len(hashed), np.uint64)
    before[1:] = hashed[:-1]
    before[bounds[:-1][bounds[:-1] < bounds[1:]]] = 0
    return before


def _words(hashed: np.ndarray) -> np.ndarray:
    return hashed & ~_KIND | WORD


def _pairs(before: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    return tx.mixed(before * np.uint64(tx.MULTIPLIER) + hashed) & ~_KIND | PAIR


def _ends(hashed: np.ndarray) -> np.ndarray:
    return tx.mixed(hashed * np.uint64(tx.MULTIPLIER) + _LAST) & ~_KIND | END


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, without the high bytes that all lack."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T
    width = max((k + 1 for k in range(8) if planes[k].any()), default=1)
    return bytes([width]) + planes[:width].tobytes()


def _unpacked(data: pa.Scalar) -> np.ndarray:
    flat = np.frombuffer(data.as_buffer(), np.uint8)
    planes = flat[1:].reshape(flat[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their distances."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: pa.Scalar) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def _parts(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets of sorted keys, and where each bucket's keys are."""
    bucket = (keys >> _HALF) * np.uint64(buckets) >> _HALF
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for first, last in zip(np.r_[0, edges], np.r_[edges, len(keys)], strict=True):
        if first < last:
            yield int(bucket[first]), slice(first, last)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, with the sums of their 2 x n counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
    return keys[first], np.add.reduceat(counts[:, order], first, axis=1)


def _rare(values: np.ndarray, usual: int) -> tuple[bytes, bytes]:
    """Which values are not the usual one, a bit each, and those values."""
    other = values != usual
    return np.packbits(other).tobytes(), _packed(values[other])


def _whole(bits: pa.Scalar, others: pa.Scalar, n: int, usual: int) -> np.ndarray:
    values = np.full(n, usual, np.int64)
    other = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=n).view(bool)
    if other.any():
        values[other] = _unpacked(others)
    return values


def _different(keys: np.ndarray) -> np.ndarray:
    """Different keys, sorted; faster than the hash table of ``np.unique``."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def _by_bucket(rows: DataFrame, buckets: int, *order: Column) -> DataFrame:
    """A few buckets to a task, one after the other."""
    return rows.repartition(-(-buckets // 2), "bucket").sortWithinPartitions("bucket", *order)


def _runs(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of consecutive rows with one value; a value may go on in the next."""
    for batch in batches:
        values = batch.column(column).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(values[1:] != values[:-1]) + 1
        for first, last in zip(np.r_[0, edges], np.r_[edges, len(values)], strict=True):
            if first < last:
                yield int(values[first]), batch.slice(first, last - first)


def _table(rows: list[tuple], **types: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


@dataclass
class Models:
    """Counts of both models as a table ``bucket, keys, target, background``,
    and their sums (2 x 1 each)."""

    table: DataFrame
    buckets: int
    words: np.ndarray
    pairs: np.ndarray
    texts: np.ndarray
    vocabulary: int


def count(docs: DataFrame, target: Column, text_col: str = "text") -> Models:
    """Both models, from all documents and from those where ``target`` holds."""
    source = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    size = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets, limit = -(-size // BUCKET_BYTES) or 1, BLOCK_BYTES

    def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        every, marked = (np.concatenate(own) for own in zip(*held, strict=True))
        keys, many = np.unique(every, return_counts=True)
        good, own = np.unique(marked, return_counts=True)
        counts = np.zeros((2, len(keys)), np.int64)
        counts[0, np.searchsorted(keys, good)], counts[1] = own, many
        rows = [(b, _packed_keys(keys[at]), _packed(counts[0, at]), _packed(counts[1, at])) for b, at in _parts(keys, buckets)]
        if rows:
            yield _table(rows, bucket=pa.int64(), keys=pa.binary(), target=pa.binary(), background=pa.binary())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in tx.chunks(batches, "text"):
            hashed, bounds = _hashes(batch.column("text"))
            mark = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            full = bounds[:-1] < bounds[1:]
            own = np.repeat(mark, np.diff(bounds))
            kinds = [_words(hashed), _pairs(_before(hashed, bounds), hashed), _ends(hashed[bounds[1:][full] - 1])]
            held.append((np.concatenate(kinds), np.concatenate([k[m] for k, m in zip(kinds, (own, own, mark[full]), strict=True)])))
            size += batch.column("text").nbytes
            if size >= limit:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)

    def total(bucket: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = [r for batch in held for r in zip(*(batch.column(c) for c in ("keys", "target", "background")), strict=True)]
        keys = np.concatenate([_unpacked_keys(r[0]) for r in rows])
        keys, counts = _summed(keys, np.stack([np.concatenate([_unpacked(r[k]) for r in rows]) for k in (1, 2)]).astype(np.int64))
        sums = [int(n) for kind in (WORD, PAIR, END) for n in counts[:, keys & _KIND == kind].sum(1)]
        row = (bucket, _packed_keys(keys), _packed(counts[0]), _packed(counts[1]), [*sums, int(np.sum(keys & _KIND == WORD))])
        return _table([row], bucket=pa.int64(), keys=pa.binary(), target=pa.binary(), background=pa.binary(), sums=pa.list_(pa.int64()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for bucket, rows in _runs(batches, "bucket"):
            if held and bucket != at:
                yield total(at, held)
                held = []
            at = bucket
            held.append(rows)
        if held:
            yield total(at, held)

    schema = "bucket long, keys binary, target binary, background binary"
    parts = _by_bucket(source.mapInArrow(make, schema), buckets)
    table = stored(parts.mapInArrow(add, f"{schema}, sums array<long>"), "counts")
    sums = table.agg(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(7)]).first()
    words, pairs, texts = np.array(sums[:6], np.int64).reshape(3, 2, 1)
    return Models(table.drop("sums"), buckets, words, pairs, texts, sums[6])


def _losses(column: pa.Array, keys: np.ndarray, counts: np.ndarray, words: np.ndarray, texts: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and its summed loss under both models."""
    hashed, bounds = _hashes(column)
    before = _before(hashed, bounds)

    def found(asked: np.ndarray) -> np.ndarray:
        order = np.argsort(asked)  # a search in order is far faster
        at = np.empty(len(asked), np.int64)
        at[order] = np.minimum(np.searchsorted(keys, asked[order]), max(len(keys) - 1, 0))
        return np.where(keys[at] == asked, counts[:, at], 0) if len(keys) else np.zeros((2, len(asked)), np.int64)

    each, place = np.unique(hashed, return_inverse=True)
    word = found(_words(each))
    context = (word - found(_ends(each)))[:, place]
    word, pair = word[:, place], found(_pairs(before, hashed))
    out = np.zeros((2, len(bounds) - 1))
    for k in range(2):
        own = (word[k] + 1) / (words[k] + vocabulary)
        seen = np.empty(len(hashed), np.int64)
        seen[1:] = context[k][:-1]
        seen[before == 0] = texts[k, 0]
        both = np.where(seen > 0, pair[k] / np.maximum(seen, 1), own)
        loss = -np.log(MIX * both + (1 - MIX) * own)
        total = np.r_[0, np.cumsum(loss)]
        out[k] = total[bounds[1:]] - total[bounds[:-1]]
    return np.diff(bounds), out


def _in_blocks(source: DataFrame) -> DataFrame:
    """``source`` with ``block``: texts of about ``BLOCK_BYTES`` that a task
    read one after the other, and ``row``, their number in it. Stored, so that
    every reader sees one deal."""
    limit = BLOCK_BYTES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, row, size = 0, 0, limit
        for batch in tx.chunks(batches, "text"):
            if size >= limit:
                block, row, size = int.from_bytes(os.urandom(8), "big") >> 1, 0, 0
            size += batch.column("text").nbytes
            place = [pa.array(np.full(len(batch), block)), pa.array(np.arange(row, row + len(batch)))]
            row += len(batch)
            yield pa.RecordBatch.from_arrays([*place, *batch.columns], names=["block", "row", *batch.schema.names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return stored(source.mapInArrow(deal, f"block long, row long, {fields}"), "blocks")


def _answers(texts: DataFrame, models: Models) -> DataFrame:
    """``block, keys, target, background``: the counts of all keys of a block."""
    buckets = models.buckets

    def asked(block: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = _different(np.concatenate(held))
        rows = [(b, block, _packed_keys(keys[at])) for b, at in _parts(keys, buckets)]
        if rows:
            yield _table(rows, bucket=pa.int64(), block=pa.int64(), keys=pa.binary())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None
        for block, rows in _runs(tx.chunks(batches, "text"), "block"):
            if held and block != at:
                yield from asked(at, held)
                held = []
            at = block
            held.append(_asked([rows.column("text")]))
        if held:
            yield from asked(at, held)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, counts = None, np.zeros(0, np.uint64), []
        for bucket, rows in _runs(batches, "bucket"):
            for block, *packed in zip(*(rows.column(c) for c in ("block", "keys", "target", "background")), strict=True):
                own = _unpacked_keys(packed[0])
                if not block.is_valid:
                    at, keys, counts = bucket, own, [_unpacked(p) for p in packed[1:]]
                elif at == bucket:
                    place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    known = keys[place] == own
                    row = (block.as_py(), _packed_keys(own[known]), *(_packed(c[place[known]]) for c in counts))
                    if known.any():
                        yield _table([row], block=pa.int64(), keys=pa.binary(), target=pa.binary(), background=pa.binary())

    none = F.lit(None).cast("binary")
    requests = texts.select("block", "text").mapInArrow(ask, "bucket long, block long, keys binary")
    requests = requests.withColumns({"target": none, "background": none})
    met = models.table.withColumn("block", F.lit(None).cast("long")).unionByName(requests)
    met = _by_bucket(met, buckets, F.col("block").asc_nulls_first())
    return met.mapInArrow(answer, "block long, keys binary, target binary, background binary")


SCORES = "n_tokens long, target_loss double, background_loss double, score double"


def _scored(ids: pa.Array, n_tokens: np.ndarray, losses: np.ndarray) -> pa.RecordBatch:
    means = losses / np.maximum(n_tokens, 1)
    values = [pa.array(v, pa.float64(), mask=n_tokens == 0) for v in (means[0], means[1], means[0] - means[1])]
    names = ["id", "n_tokens", "target_loss", "background_loss", "score"]
    return pa.RecordBatch.from_arrays([ids, pa.array(n_tokens, pa.int64()), *values], names=names)


def _kinds(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys of all words, pairs and ends; where the texts' words begin; which
    texts have any."""
    hashed, bounds = _hashes(column)
    full = bounds[:-1] < bounds[1:]
    return [_words(hashed), _pairs(_before(hashed, bounds), hashed), _ends(hashed[bounds[1:][full] - 1])], bounds, full


def _asked(columns: list[pa.Array]) -> np.ndarray:
    """All keys that texts are scored by, sorted: a word is asked for as an end
    as well, wherever it stands."""
    found = []
    for column in columns:
        hashed, bounds = _hashes(column)
        each = _different(hashed)
        found += [_words(each), _ends(each), _different(_pairs(_before(hashed, bounds), hashed))]
    return _different(np.concatenate(found))


def scored(docs: DataFrame, target: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The scores of all documents under the models counted from them.

    The same rows as ``score(docs, count(docs, target))``, with one exchange of
    keys instead of two.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    size = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = -(-size // BUCKET_BYTES) or 1
    texts = _in_blocks(source)

    def counted(block: int, first: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, marked, rows = [], [], 0
        for batch in held:
            kinds, bounds, full = _kinds(batch.column("text"))
            mark = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            own = np.repeat(mark, np.diff(bounds))
            every += kinds
            marked += [k[m] for k, m in zip(kinds, (own, own, mark[full]), strict=True)]
            rows += len(batch)
        keys = _asked([b.column("text") for b in held])
        many, few = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for counts, found in ((many, every), (few, marked)):
            own, times = np.unique(np.concatenate(found), return_counts=True)
            counts[np.searchsorted(keys, own)] = times
        found = [(b, block, first, first + rows, _packed_keys(keys[at]), *_rare(few[at], 0), *_rare(many[at], 1)) for b, at in _parts(keys, buckets)]
        if found:
            yield _table(found, bucket=pa.int64(), **_PLACE, keys=pa.binary(), **_COUNTS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, held = None, 0, []
        for block, rows in _runs(tx.chunks(batches, "text"), "block"):
            # What a task reads of a block, if a block is read by several.
            if held and block != at:
                yield from counted(at, first, held)
                held = []
            if not held:
                at, first = block, rows.column("row")[0].as_py()
            held.append(rows)
        if held:
            yield from counted(at, first, held)

    def answered(bucket: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []
        for batch in held:
            for block, first, stop, packed, *rest in zip(*(batch.column(c) for c in (*_PLACE, "keys", *_COUNTS)), strict=True):
                keys = _unpacked_keys(packed)
                counts = np.stack([_whole(rest[0], rest[1], len(keys), 0), _whole(rest[2], rest[3], len(keys), 1)])
                asked.append((block.as_py(), first.as_py(), stop.as_py(), keys, counts))
        keys, counts = _summed(np.concatenate([a[3] for a in asked]), np.concatenate([a[4] for a in asked], axis=1))
        sums = [int(n) for kind in (WORD, PAIR, END) for n in counts[:, keys & _KIND == kind].sum(1)]
        rows = [(bucket, None, None, None, None, None, None, None, None, [*sums, int(np.sum(keys & _KIND == WORD))])]
        for block, first, stop, own, _ in asked:
            found = counts[:, np.searchsorted(keys, own)]
            rows.append((bucket, block, first, stop, len(own), *_rare(found[0], 0), *_rare(found[1], 1), None))
        yield _table(rows, bucket=pa.int64(), **_PLACE, n=pa.int64(), **_COUNTS, sums=pa.list_(pa.int64()))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for bucket, rows in _runs(batches, "bucket"):
            if held and bucket != at:
                yield from answered(at, held)
                held = []
            at = bucket
            held.append(rows)
        if held:
            yield from answered(at, held)

    place, counts = "block long, first long, stop long", "target_at binary, target binary, background_at binary, background binary"
    asked = texts.select("block", "row", "text", "target").mapInArrow(ask, f"bucket long, {place}, keys binary, {counts}")
    answers = stored(_by_bucket(asked, buckets).mapInArrow(answer, f"bucket long, {place}, n long, {counts}, sums array<long>"), "answers")
    sums = answers.where("block is null").agg(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(7)]).first()
    words, pairs, many = np.array(sums[:6], np.int64).reshape(3, 2, 1)
    vocabulary = max(sums[6], WORDS)

    def finished(held: list[pa.RecordBatch], parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = _asked([b.column("text") for b in held])
        counts = np.concatenate([np.zeros((2, 0), np.int64), *[p[1] for p in sorted(parts, key=lambda p: p[0])]], axis=1)
        for batch in held:
            yield _scored(batch.column("id"), *_losses(batch.column("text"), keys, counts, words, many, vocabulary))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, parts = None, [], {}
        for block, rows in _runs(tx.chunks(batches, "text"), "block"):
            if block != at:
                at, parts = block, {}
            n = len(rows) - rows.column("first").null_count  # they come before the texts
            for k in range(n):
                own = {c: rows.column(c)[k] for c in ("bucket", "first", "stop", "n", *_COUNTS)}
                size = own["n"].as_py()
                found = np.stack([_whole(own["target_at"], own["target"], size, 0), _whole(own["background_at"], own["background"], size, 1)])
                parts.setdefault((own["first"].as_py(), own["stop"].as_py()), []).append((own["bucket"].as_py(), found))
            rows = rows.slice(n)
            while len(rows):
                row = rows.column("row")[0].as_py()
                span = next((p for p in parts if p[0] <= row < p[1]), None)
                if span is None:  # texts without a word are in no count
                    span = (row, min([p[0] for p in parts if p[0] > row], default=row + len(rows)))
                own = rows.slice(0, span[1] - row)
                held.append(own)
                if row + len(own) >= span[1]:
                    yield from finished(held, parts.pop(span, []))
                    held = []
                rows = rows.slice(len(own))

    met = texts.drop("target").unionByName(answers.where("block is not null").drop("sums"), allowMissingColumns=True)
    met = met.repartition("block").sortWithinPartitions("block", F.col("first").isNull(), "row")
    kind = texts.schema["id"].dataType.simpleString()
    return met.mapInArrow(finish, f"id {kind}, {SCORES}")


#: Where an answer belongs, and its counts: bits and the values that differ.
_PLACE = {"block": pa.int64(), "first": pa.int64(), "stop": pa.int64()}
_COUNTS = {"target_at": pa.binary(), "target": pa.binary(), "background_at": pa.binary(), "background": pa.binary()}


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, target_loss, background_loss, score``, means per word."""
    texts = _in_blocks(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    kind = texts.schema["id"].dataType.simpleString()
    words, many, vocabulary = models.words, models.texts, max(models.vocabulary, WORDS)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, keys, counts = None, [], np.zeros(0, np.uint64), np.zeros((2, 0), np.int64)
        for block, rows in _runs(tx.chunks(batches, "text"), "block"):
            if block != at:
                at, held, keys, counts = block, [], np.zeros(0, np.uint64), np.zeros((2, 0), np.int64)
            packed = rows.column("keys")
            n = len(packed) - packed.null_count  # they come before the texts
            for k in range(n):
                own = [rows.column(c)[k] for c in ("keys", "target", "background")]
                held.append((_unpacked_keys(own[0]), np.stack([_unpacked(c) for c in own[1:]]).astype(np.int64)))
            rows = rows.slice(n)
            if not len(rows):
                continue
            if held:
                keys = np.concatenate([h[0] for h in held])
                counts = np.concatenate([h[1] for h in held], axis=1)
                order, held = np.argsort(keys), []
                keys, counts = keys[order], counts[:, order]
            yield _scored(rows.column("id"), *_losses(rows.column("text"), keys, counts, words, many, vocabulary))

    met = texts.drop("row").unionByName(_answers(texts, models), allowMissingColumns=True)
    met = met.repartition("block").sortWithinPartitions("block", F.col("keys").isNull())
    return met.mapInArrow(make, f"id {kind}, {SCORES}")
