"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` turns documents into index segments, a row each: the sorted
terms of some megabytes of text and, per term, the ascending positions where it
stands. ``search`` takes windows of consecutive benchmark words to every
segment: it starts from the postings of the window's rarest term there, moves
them by the term's place in the window, and intersects them with the other
terms' lists from rare to frequent. A segment holds whole documents, so nothing
is shuffled and a phrase that many documents share is no hot key.

Defined results: null text and text without words have no words and are never
hit; a benchmark item without words has no window; repeated documents are
judged one by one; repeated items count once per item id, of which
a null is one (named last). Words that repeat without end, in a text and in an
item, take no more memory than others. Other columns of the
inputs are ignored, whatever their names. Empty tables give empty results, an
empty benchmark gives documents without hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from verdikt.llm import text as tx
from verdikt.llm.store import stored

WINDOW = 13
#: Benchmark words sent to every executor at a time: 16 MB of hashes at most
#: (one item, if that is longer). More items are searched block after block.
BLOCK_WORDS = 1 << 20
#: Postings that are intersected at a time: some 100 MB of helper arrays.
SLICE = 1 << 20


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, letters lower-cased, and the offsets of each text."""
    data, offsets = tx.utf8(column)
    data = tx.LOWER[data]
    starts, ends, bounds = tx.words(data, offsets, tx.ALNUM)
    return tx.span_hash(tx.prefix_hash(data), starts, ends), bounds


def segment_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("segment", T.StringType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("bounds", T.BinaryType()),
            T.StructField("terms", T.BinaryType()),
            T.StructField("firsts", T.BinaryType()),
            T.StructField("positions", T.BinaryType()),
        ]
    )


def _segment(column: pa.Array, keep: np.ndarray | None) -> dict[str, bytes]:
    words, bounds = _tokens(column)
    where = np.arange(len(words), dtype=np.uint32)
    if keep is not None:
        at = np.searchsorted(keep, words)
        at[at == len(keep)] = 0
        known = keep[at] == words if len(keep) else np.zeros(len(words), bool)
        words, where = words[known], where[known]
    order = np.argsort(words, kind="stable")
    words, where = words[order], where[order]
    firsts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.empty(0, np.int64)
    return {
        "bounds": bounds.astype(np.uint32).tobytes(),
        "terms": words[firsts].tobytes(),
        "firsts": np.r_[firsts, len(words)].astype(np.uint32).tobytes(),
        "positions": where.tobytes(),
    }


def build_index(docs: DataFrame, id_col: str, text_col: str, terms: np.ndarray | None = None) -> DataFrame:
    """Segments of the positional index, a lazy DataFrame; write it to keep it.

    ``terms`` (sorted hashes, see ``vocabulary``) leaves other words out of the
    lists: an index built for one benchmark needs that benchmark's terms only.
    Positions still count every word.
    """
    keep = docs.sparkSession.sparkContext.broadcast(terms) if terms is not None else None
    schema = segment_schema(docs.schema[id_col].dataType)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, number, task = None, count(), TaskContext.get().partitionId()
        for batch in tx.chunks(batches, "text"):
            ids = batch.column("id")
            arrow = arrow or pa.schema(
                [("segment", pa.string()), ("ids", pa.list_(ids.type))]
                + [(n, pa.binary()) for n in ("bounds", "terms", "firsts", "positions")]
            )
            parts = _segment(batch.column("text"), None if keep is None else keep.value)
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            columns = [pa.array([f"{task}-{next(number)}"]), lists]
            columns += [pa.array([parts[n]], pa.binary()) for n in ("bounds", "terms", "firsts", "positions")]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(build, schema)


class Windows:
    """The different windows of a block of items: hashes of all words in a row,
    where each window starts, and the items that have it.

    A window that stands many times, in one item or in several, is searched once.
    """

    def __init__(self, ids: list, column: pa.Array, width: int) -> None:
        self.words, bounds = _tokens(column)
        self.ids = ids
        sizes = np.diff(bounds)
        number = np.where(sizes > 0, np.maximum(sizes - width + 1, 1), 0)
        item = np.repeat(np.arange(len(ids)), number)
        inside = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        start = bounds[:-1][item] + inside
        length = np.minimum(sizes, width)[item]
        mark = length.astype(np.uint64)
        for k in range(width):
            own = k < length
            mark[own] = tx.mixed(mark[own] ^ self.words[start[own] + k])
        _, first, same = np.unique(mark, return_index=True, return_inverse=True)
        self.start, self.length = start[first], length[first]
        # Items of window k: self.items[self.bounds[k] : self.bounds[k + 1]].
        pairs = np.unique(np.stack([same.reshape(-1), item]), axis=1)
        self.items = pairs[1]
        self.bounds = np.searchsorted(pairs[0], np.arange(len(first) + 1))


def item_blocks(items: DataFrame, id_col: str, text_col: str, width: int, block_words: int) -> list:
    """The windows of all items, in broadcasts of bounded size.

    The number of items is not bounded, what is held at a time is: items are
    dealt over so many blocks that one holds about ``block_words`` words.
    """
    chosen = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = chosen.where(F.col("text").isNotNull())
    size = chosen.agg(F.sum(F.length("text"))).first()[0] or 0
    number = max(1, -(-size // (2 * block_words)))  # a word and its gap take two characters at least
    blocks = []
    for k in range(number):
        part = chosen if number == 1 else chosen.where(F.pmod(F.xxhash64("id"), F.lit(number)) == k)
        table = part.orderBy("id", "text").toArrow()
        column = pa.array(table.column("text").to_pylist(), pa.string())
        blocks.append(items.sparkSession.sparkContext.broadcast(Windows(table.column("id").to_pylist(), column, width)))
    return blocks


def vocabulary(blocks: list) -> np.ndarray:
    """The sorted hashes of all terms in the blocks' windows."""
    return np.unique(np.concatenate([b.value.words for b in blocks] or [np.empty(0, np.uint64)]))


def _found(row: dict, windows: Windows, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Window number, first and last word of each occurrence in a segment.

    Occurrences come in slices: the rarest terms' postings are laid end to end
    over all windows, and SLICE of them are taken at a time.
    """
    terms = np.frombuffer(row["terms"], np.uint64)
    firsts = np.frombuffer(row["firsts"], np.uint32).astype(np.int64)
    positions = np.frombuffer(row["positions"], np.uint32).astype(np.int64)
    bounds = np.frombuffer(row["bounds"], np.uint32).astype(np.int64)
    total = int(bounds[-1]) + 1
    if not len(terms) or not len(windows.start):
        return
    term = np.searchsorted(terms, windows.words)
    term[term == len(terms)] = 0
    absent = np.r_[0, np.cumsum(terms[term] != windows.words)]
    number = np.flatnonzero(absent[windows.start + windows.length] == absent[windows.start])
    lists = np.repeat(np.arange(len(terms)), np.diff(firsts)) * total + positions  # sorted
    for width in np.unique(windows.length[number]):
        own = number[windows.length[number] == width]
        term_at = term[windows.start[own][:, None] + np.arange(width)]
        order = np.argsort(firsts[term_at + 1] - firsts[term_at], axis=1, kind="stable")  # rarest first
        rare = np.take_along_axis(term_at, order[:, :1], 1)[:, 0]
        ends = np.cumsum(firsts[rare + 1] - firsts[rare])
        for begin in range(0, int(ends[-1]), SLICE):
            posting = np.arange(begin, min(begin + SLICE, int(ends[-1])))
            window = np.searchsorted(ends, posting, "right")
            # Counted from its window's end, a posting is as far from its list's end.
            start = positions[firsts[rare[window] + 1] - (ends[window] - posting)] - order[window, 0]
            window, start = window[start >= 0], start[start >= 0]
            low = high = start + order[window, 0]
            for step in range(1, int(width)):
                place = order[window, step]
                base = term_at[window, place] * total
                wanted = start + place
                at = np.searchsorted(lists, base + np.maximum(wanted - slop, 0))
                at[at == len(lists)] = len(lists) - 1
                seen = lists[at] - base
                fits = (seen >= wanted - slop) & (seen <= np.minimum(wanted + slop, total - 1)) & (seen >= 0)
                window, start, seen = window[fits], start[fits], seen[fits]
                low, high = np.minimum(low[fits], seen), np.maximum(high[fits], seen)
            doc = np.searchsorted(bounds, low, "right")
            same = doc == np.searchsorted(bounds, high, "right")
            yield own[window[same]], low[same], high[same]


def _judged(row: dict, windows: Windows, slop: int) -> Iterator[tuple]:
    """Per document of a segment: words, joined hit spans, items found.

    Of a slice's occurrences only the span ends, added up per word, and the
    different pairs of document and window are kept.
    """
    bounds = np.frombuffer(row["bounds"], np.uint32).astype(np.int64)
    change = np.zeros(int(bounds[-1]) + 2, np.int64)
    pairs, fresh = np.empty(0, np.int64), []
    for window, low, high in _found(row, windows, slop):
        np.add.at(change, low, 1)
        np.add.at(change, high + 1, -1)
        doc = np.searchsorted(bounds, low, "right") - 1
        fresh.append(np.unique(doc * len(windows.start) + window))
        if sum(map(len, fresh)) > SLICE:
            pairs, fresh = np.unique(np.concatenate([pairs, *fresh])), []
    pairs = np.unique(np.concatenate([pairs, *fresh]))
    hit = np.cumsum(change)[:-1] > 0
    hits = np.r_[0, np.cumsum(hit)]
    doc, window = np.divmod(pairs, max(len(windows.start), 1))
    ends = np.searchsorted(doc, np.arange(len(bounds)))
    for d, key in enumerate(row["ids"]):
        items: set = set()
        for w in window[ends[d] : ends[d + 1]]:
            items.update(windows.items[windows.bounds[w] : windows.bounds[w + 1]].tolist())
        own = hit[bounds[d] : bounds[d + 1]].astype(np.int8)
        turn = np.flatnonzero(np.diff(np.r_[0, own, 0])) if items else np.empty(0, np.int64)
        spans = [[int(a), int(b)] for a, b in turn.reshape(-1, 2)]
        yield key, int(bounds[d + 1] - bounds[d]), int(hits[bounds[d + 1]] - hits[bounds[d]]), spans, {windows.ids[i] for i in items}


def search(segments: DataFrame, blocks: list, item_type: T.DataType, slop: int = 0) -> DataFrame:
    """Each document with its words, hit words, hit spans and items found.

    ``slop`` 0 finds exact phrases; with a larger one each term may stand up to
    so many words from its place beside the window's rarest term (proximity).
    """
    id_type = segments.schema["ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("place", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("items", T.ArrayType(item_type)),
        ]
    )
    names, item = schema.names, to_arrow_type(item_type)

    def one(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind = batch.column("ids").type.value_type
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    out = [(i, f"{row['segment']}/{n}", w, h, s, sorted(x, key=lambda i: (i is None, i))) for n, (i, w, h, s, x) in enumerate(_judged(row, block.value, slop))]
                    columns = list(zip(*out, strict=True)) or [[]] * len(names)
                    kinds = [kind, pa.string(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(item)]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

        return segments.mapInArrow(run, schema)

    found = one(blocks[0])
    if len(blocks) == 1:
        return found
    for block in blocks[1:]:
        found = found.unionByName(one(block))
    joined = found.groupBy("place").agg(
        F.first("id").alias("id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s[1] - F.greatest(a["end"], s[0]), F.lit(0))).cast("long").alias("n"),
            F.greatest(a["end"], s[1]).alias("end"),
        ),
        lambda a: a["n"],
    )
    return joined.withColumn("n_hit", covered).select(*names)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    slop: int = 0,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Index the documents, search the benchmark and judge each document.

    Returns ``id, place, n_words, n_hit, spans, items``; ``place`` is unique
    per row of the input, also where ids repeat.
    """
    blocks = item_blocks(items, item_col, item_text, width, block_words)
    index = stored(build_index(docs, id_col, text_col, vocabulary(blocks)), "postings")
    return search(index, blocks, items.schema[item_col].dataType, slop)


def is_contaminated() -> F.Column:
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))

