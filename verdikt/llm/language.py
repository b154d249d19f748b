"""Language identification: averaged hashed subword embeddings, linear softmax.

A text's features are its byte n-grams (``ORDERS``) with letters lower-cased
and everything but letters a blank; each n-gram is hashed to one of
``BUCKETS`` embeddings, their average goes through a linear softmax. Both are
trained together by stochastic gradient descent in numpy on a bounded sample:
at most ``PER_LANG`` labelled texts of each language, chosen by a hash of their
id. A fifth of the sample is kept back to calibrate: a temperature makes the
scores probabilities, and ``floor`` is the score below which a text is
rejected, set so that ``LOST`` of the rightly recognised ones fall under it.
Prediction reads whole texts; embeddings and softmax are folded into one table
of ``BUCKETS`` rows first, 4 bytes a language each, which is what is broadcast.

Defined results: null text and text without a letter is ``und`` with score 0
and rejected; ties go to the language first in order; without any labelled text
to learn from every text is ``und``; with one language only, that one scores 1.
Repeated rows get the same result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdikt.llm import text as tx
from verdikt.llm.pieces import expanded
from verdikt.llm.rows import free

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
DIMENSIONS = 16
#: Texts of a language that are learned from, at most.
PER_LANG = 1000
EPOCHS = 6
RATE = 2.0
LOST = 0.001
UNKNOWN = "und"

_SHOWN = np.full(256, 32, np.uint8)
_SHOWN[97:123] = np.arange(97, 123)
_SHOWN[65:91] = np.arange(97, 123)
_SHOWN[128:] = np.arange(128, 256)
_ASCII_LETTER = tx.byte_class([(65, 90), (97, 122)])


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shown bytes with a blank before and after each text, where each text's
    part begins (and the last ends), and which texts hold a letter."""
    data, offsets = tx.utf8(column)
    n = len(offsets) - 1
    shown = np.full(len(data) + n + 1, 32, np.uint8)
    shown[expanded(offsets[:-1] + np.arange(1, n + 1), np.diff(offsets))] = _SHOWN[data]
    ascii_ = np.r_[0, np.cumsum(_ASCII_LETTER[data])][offsets]
    letter = ascii_[1:] > ascii_[:-1]
    for k in np.flatnonzero(~letter & (np.diff(offsets) > 0)):
        letter[k] = any(c.isalpha() for c in column[k].as_py())
    return shown, offsets + np.arange(n + 1), letter


def _buckets(shown: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each place, and whether it is more than blanks."""
    n = max(len(shown) - order + 1, 0)
    value = np.zeros(n, np.uint32)
    for k in range(order):
        value |= shown[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    blank = np.uint32(int.from_bytes(b" " * order, "little"))
    used = value != blank
    value = (value ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    value ^= value >> np.uint32(15)
    value *= np.uint32(0xC2B2AE35)
    return (value >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1), used


def _limits(bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last n-gram of each text, its blanks included."""
    return bounds[:-1], np.maximum(bounds[1:] + 1 - order + 1, bounds[:-1])


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its buckets and their shares of all its n-grams."""
    shown, bounds, _ = _padded(column)
    found: list[list[np.ndarray]] = [[] for _ in range(len(bounds) - 1)]
    for order in ORDERS:
        bucket, used = _buckets(shown, order)
        for k, (a, b) in enumerate(zip(*_limits(bounds, order), strict=True)):
            found[k].append(bucket[a:b][used[a:b]])
    out = []
    for parts in found:
        bucket, many = np.unique(np.concatenate(parts), return_counts=True)
        out.append((bucket, many / max(many.sum(), 1)))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    floor: float

    def logits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean logits of each text, and which texts hold a letter."""
        shown, bounds, letter = _padded(column)
        n = len(bounds) - 1
        total, count = np.zeros((n, len(self.languages))), np.zeros(n)
        for order in ORDERS:
            bucket, used = _buckets(shown, order)
            first, last = _limits(bounds, order)
            kept = np.r_[0, np.cumsum(used)]
            first, last = kept[np.minimum(first, len(used))], kept[np.minimum(last, len(used))]
            bucket = bucket[used]
            count += last - first
            own = np.flatnonzero(last > first)
            if not len(own):
                continue
            for lang in range(len(self.languages)):
                values = np.r_[self.table[bucket, lang], 0.0].astype(np.float64)
                ends = np.stack([first[own], last[own]], 1).ravel()
                total[own, lang] += np.add.reduceat(values, ends)[::2]
        return total / np.maximum(count, 1)[:, None] + self.bias, letter

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def judge(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        logits, letter = self.logits(column)
        if not self.languages:
            return [UNKNOWN] * len(letter), np.zeros(len(letter))
        p = self.scores(logits)
        best = p.argmax(1)
        score = np.where(letter, p[np.arange(len(p)), best], 0.0)
        return [self.languages[b] if has else UNKNOWN for b, has in zip(best, letter, strict=True)], score


def held_out(id_col: str) -> Column:
    """crc32 of the id's text leaves 1 when divided by 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> pa.Table:
    """``lang, buckets, shares`` of the texts that are learned from.

    Ids are chosen without their texts; per language at most PER_LANG of them
    leave a task already. What reaches the driver is bounded by the number of
    languages, PER_LANG and BUCKETS.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(False)))
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col)).alias("_order"))
    first = Window.partitionBy("lang").orderBy("_order", "id")
    chosen = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= PER_LANG).select("id", "lang").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where("text is not null").join(F.broadcast(chosen), ["id", "lang"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches, "text"):
            found = features(batch.column("text"))
            columns = [
                pa.array(batch.column("id").cast(pa.string())),
                batch.column("lang"),
                pa.array([b.astype(np.int32) for b, _ in found], pa.list_(pa.int32())),
                pa.array([s.astype(np.float32) for _, s in found], pa.list_(pa.float32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "lang", "buckets", "shares"])

    return texts.mapInArrow(make, "id string, lang string, buckets array<int>, shares array<float>").toArrow()


def _learnt_from(table: pa.Table) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Language, buckets and shares, in an order of their own, however the
    sample arrived; the arrays are views of the table."""
    rows = []
    for batch in table.to_batches():
        buckets, shares = batch.column("buckets"), batch.column("shares")
        ends = buckets.offsets.to_numpy()
        bucket, share = buckets.values.to_numpy(), shares.values.to_numpy()
        for k, (lang, key) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("id").to_pylist(), strict=True)):
            if ends[k] < ends[k + 1]:
                rows.append((lang, key, bucket[ends[k] : ends[k + 1]], share[ends[k] : ends[k + 1]]))
    rows.sort(key=lambda r: (r[0], r[1], zlib.crc32(r[2]), zlib.crc32(r[3])))
    return [(lang, b, s) for lang, _, b, s in rows]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the labelled texts that are not held out."""
    model = fit(_learnt_from(_sample(docs, id_col, text_col, lang_col)))
    pa.default_memory_pool().release_unused()  # the driver keeps the model only
    return model


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    languages = sorted({r[0] for r in rows}, key=lambda x: x.encode())
    k = len(languages)
    rng = np.random.Generator(np.random.PCG64(7))
    place = {lang: i for i, lang in enumerate(languages)}
    back = [r for i, r in enumerate(rows) if i % 5 == 4]
    used = [r for i, r in enumerate(rows) if i % 5 != 4]
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, k), np.float32), np.zeros(k, np.float32)
    steps, done = max(EPOCHS * len(used), 1), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(used)):
            lang, bucket, share = used[i]
            own = vectors[bucket]
            hidden = share @ own
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[place[lang]] -= 1
            rate = np.float32(RATE * (1 - done / steps))
            back_ = weights @ p
            weights -= rate * np.outer(hidden, p)
            bias -= rate * np.float32(0.05) * p
            # Shares are small; the embeddings' step makes up for that.
            vectors[bucket] = own - rate * np.float32(10) * share[:, None] * back_
            done += 1
    model = Model(languages, vectors @ weights, bias, 1.0, 0.0)
    return _calibrated(model, back, place)


def _calibrated(model: Model, rows: list, place: dict[str, int]) -> Model:
    """Temperature with the least loss on rows kept back, and the floor."""
    if not rows or len(model.languages) < 2:
        return model
    z = np.stack([s @ model.table[b] + model.bias for _, b, s in rows]).astype(np.float64)
    truth = np.array([place[r[0]] for r in rows])

    def loss(t: float) -> float:
        p = z / t
        p = p - p.max(1, keepdims=True)
        return float((np.log(np.exp(p).sum(1)) - p[np.arange(len(truth)), truth]).mean())

    model.temperature = min((2.0 ** (k / 4) for k in range(-12, 25)), key=loss)
    p = model.scores(z)
    right = np.sort(p.max(1)[p.argmax(1) == truth])
    if len(right):
        model.floor = float(right[int(LOST * len(right))]) * (1 - 1e-9)
    # Never above an even choice between two: such a text is in some language.
    model.floor = min(model.floor, 0.5)
    return model


def judgement(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """``lang_pred, score, rejected`` of each row as one column."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(texts):
        import pandas as pd

        batch = pa.record_batch([pa.array(texts, pa.string(), from_pandas=True)], names=["text"])
        names, scores = [], [np.empty(0)]
        for part in tx.chunks([batch], "text"):
            lang, score = sent.value.judge(part.column(0))
            names += lang
            scores.append(score)
        score = np.concatenate(scores)
        gone = (score < sent.value.floor) | (np.array(names, object) == UNKNOWN)
        return pd.DataFrame({"lang_pred": names, "score": score, "rejected": gone.astype(bool)})

    return judge(F.col(text_col).cast("string"))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred, score, rejected``; columns of these names are replaced."""
    judged = free(docs) + "judged"
    found = docs.withColumn(judged, judgement(docs, model, text_col))
    return found.withColumns({c: F.col(f"{judged}.{c}") for c in ("lang_pred", "score", "rejected")}).drop(judged)


def recognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    judged = free(docs) + "judged"
    found = docs.withColumn(judged, judgement(docs, model, text_col))
    return found.where(~F.col(f"{judged}.rejected")).drop(judged)
