"""Runs of repeated words, found on a grammar of the texts.

Words are runs of everything but blanks and line breaks. A run is a stretch of
words with a smallest period q, at least ``least`` words and two periods long,
that no neighbouring word extends.

Spark deals the rows; a task takes its texts in blocks of bounded bytes and
compresses the words of a block with Re-Pair: pairs of neighbouring symbols
that stand more than once become a new symbol, frequent pairs before rarer
ones, until no pair stands twice. In a round all pairs are replaced that no
better pair overlaps. What is left of each text is paired up to one symbol by
a balanced tree. Every symbol is two parts; the runs that cross the boundary
between them are computed once for the symbol, at one place where it stands:
for each period the words around the boundary are compared with those one
period on, by hashes of the word ids, and what matches on both sides tells the
run. A run in a text crosses the boundary of the least symbol that holds it
whole, so nothing else has to be looked at. The finds are translated to every
place to which the symbol derives, and pieces that a larger symbol cut out of
the same run are merged into the maximal one.

Cost: a block of n words has at most n symbols of Re-Pair, of which only those
of ``least`` words and more are searched, and log n levels of the trees; a
text of one word repeated a million times has twenty symbols.

Defined results: null, empty and blank texts have no words and no runs; a text
of any length is one row; repeated rows each have the same finds; an empty
table gives no rows. Other columns are ignored, whatever their names. Words are
told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from verdikt.llm import text as tx

#: Words of a run at least, and bytes of text that share a grammar.
LEAST, CHUNK = 12, 1 << 20
#: Pairs of a boundary and a period that are compared together.
TRIED = 1 << 20


class Grammar:
    """Re-Pair of the words of several texts, ``bounds`` apart.

    Symbols below ``words`` are word ids; symbol ``words + k`` is made of
    ``left[k]`` and ``right[k]`` and stands for instance at word ``at[k]``.
    ``top`` and ``place`` are the symbols that are left, and where they begin.
    """

    def __init__(self, ids: np.ndarray, bounds: np.ndarray) -> None:
        self.words = int(ids.max()) + 1 if len(ids) else 0
        self.left, self.right, self.at = (np.empty(0, np.int64) for _ in range(3))
        self.length = np.ones(self.words, np.int64)
        #: First symbol of each round.
        self.rounds = [self.words]
        self.top, self.place = ids.astype(np.int64), np.arange(len(ids))
        self.last = np.zeros(len(ids), bool)
        self.last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
        self._keys, self._made = np.empty(0, np.int64), np.empty(0, np.int64)
        while self._round():
            pass

    def _round(self) -> bool:
        free = np.flatnonzero(~self.last[:-1])
        if not len(free):
            return False
        keys = self.top[free] << 32 | self.top[free + 1]
        pairs, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        known = np.minimum(np.searchsorted(self._keys, pairs), max(len(self._keys) - 1, 0))
        old = self._keys[known] == pairs if len(self._keys) else np.zeros(len(pairs), bool)
        wanted = (count > 1) | old
        if not wanted.any():
            return False
        # Frequent pairs first, by powers of two; a hash decides among equals,
        # so that chains of pairs that wait for one another stay short.
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((tx.mixed(tx.mixed(pairs.astype(np.uint64))), np.frexp(count)[1]))] = np.arange(len(pairs))
        n = len(self.top)
        value = np.full(n + 2, -1, np.int64)
        taken = wanted[back]
        value[free[taken] + 1] = rank[back[taken]]
        here = value[1:-1]
        # Of a symbol repeated, every second pair.
        changed = here != value[:-2]
        odd = (np.arange(n) - np.maximum.accumulate(np.where(changed, np.arange(n), 0))) & 1
        picked = np.flatnonzero((here >= 0) & (odd == 0) & (value[:-2] <= here) & (value[2:] <= here))
        chosen, first, which = np.unique(self.top[picked] << 32 | self.top[picked + 1], return_index=True, return_inverse=True)
        base = self.words + len(self.left)
        symbol = np.empty(len(chosen), np.int64)
        spot = np.minimum(np.searchsorted(self._keys, chosen), max(len(self._keys) - 1, 0))
        had = self._keys[spot] == chosen if len(self._keys) else np.zeros(len(chosen), bool)
        symbol[had] = self._made[spot[had]]
        symbol[~had] = base + np.arange((~had).sum())
        new = chosen[~had]
        if len(new):
            left, right = new >> 32, new & 0xFFFFFFFF
            self.left, self.right = np.r_[self.left, left], np.r_[self.right, right]
            self.at = np.r_[self.at, self.place[picked[first[~had]]]]
            self.length = np.r_[self.length, self.length[left] + self.length[right]]
            where = np.searchsorted(self._keys, new)
            self._keys, self._made = np.insert(self._keys, where, new), np.insert(self._made, where, symbol[~had])
            self.rounds.append(base + len(new))
        self.top[picked] = symbol[which]
        self.last[picked] = self.last[picked + 1]
        kept = np.ones(n, bool)
        kept[picked + 1] = False
        self.top, self.place, self.last = self.top[kept], self.place[kept], self.last[kept]
        return True

    def boundaries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, boundary and end of every made symbol, where it stands first."""
        made = self.length[self.words :]
        return self.at, self.at + self.length[self.left], self.at + made

    def trees(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of the nodes above what Re-Pair left of each text."""
        begin, end, last = self.place, self.place + self.length[self.top], self.last
        found = [[], [], []]
        while not last.all():
            n = len(begin)
            first = np.r_[True, last[:-1]]
            turn = (np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))) & 1
            pairs = np.flatnonzero((turn == 0) & ~last)
            for values, more in zip(found, (begin[pairs], begin[pairs + 1], end[pairs + 1]), strict=True):
                values.append(more)
            end, last = end.copy(), last.copy()
            end[pairs], last[pairs] = end[pairs + 1], last[pairs + 1]
            kept = np.ones(n, bool)
            kept[pairs + 1] = False
            begin, end, last = begin[kept], end[kept], last[kept]
        return tuple(np.concatenate([np.empty(0, np.int64), *v]) for v in found)

    def derived(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every place to which a symbol of ``wanted`` derives: symbol, word."""
        leads = np.r_[np.zeros(self.words, bool), wanted]
        for low, high in zip(self.rounds[:-1], self.rounds[1:], strict=True):
            made = slice(low - self.words, high - self.words)
            leads[low:high] |= leads[self.left[made]] | leads[self.right[made]]
        symbol, place = self.top[leads[self.top]], self.place[leads[self.top]]
        symbols, places = [], []
        while len(symbol):
            hit = wanted[symbol - self.words]
            symbols.append(symbol[hit] - self.words)
            places.append(place[hit])
            left, right = self.left[symbol - self.words], self.right[symbol - self.words]
            symbol, place = np.r_[left, right], np.r_[place, place + self.length[left]]
            symbol, place = symbol[leads[symbol]], place[leads[symbol]]
        none = np.empty(0, np.int64)
        return np.concatenate([none, *symbols]), np.concatenate([none, *places])


class Equal:
    """How far the words agree from two places on, by hashes of stretches."""

    def __init__(self, ids: np.ndarray) -> None:
        h = tx.mixed(tx.mixed(ids.astype(np.uint64) + np.uint64(1)))
        up, self.down = tx.powers(len(h))
        self.prefix = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=self.prefix[1:])
        padded = np.r_[h, np.zeros(4, np.uint64)]
        #: A hash of three words from each place on.
        self.three = padded[:-3] * np.uint64(3) + padded[1:-2] * np.uint64(0x9E3779B97F4A7C15) + padded[2:-1] * np.uint64(0xC2B2AE3D27D4EB4F)

    def _same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        p, down = self.prefix, self.down
        return (p[i + n] - p[i]) * down[i] == (p[j + n] - p[j]) * down[j]

    def _reach(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        got = np.zeros(len(i), np.int64)
        for bit in range(int(limit.max(initial=0)).bit_length() - 1, -1, -1):
            more = got + (1 << bit)
            open_ = np.flatnonzero(more <= limit)
            if len(open_):
                n = more[open_]
                a, b = (i[open_] - n, j[open_] - n) if back else (i[open_], j[open_])
                got[open_] = np.where(self._same(a, b, n), n, got[open_])
        return got

    def ahead(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words that agree from i and j on."""
        return self._reach(i, j, limit, False)

    def behind(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words that agree before i and j."""
        return self._reach(i, j, limit, True)


def crossing(equal: Equal, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Runs over the boundary of each stretch: its number, start, end, period."""
    large = np.flatnonzero(end - begin >= least)
    half = (end - begin)[large] // 2
    # A run has a whole period on one side of the boundary at least.
    tries = np.r_[np.minimum(half, (end - middle)[large]), np.minimum(half, (middle - begin)[large])]
    owner, leftward = np.r_[large, large], np.repeat([False, True], len(large))
    total, first, found = np.cumsum(tries), 0, []
    while first < len(tries):
        before = total[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(total, before + TRIED, "right")))
        some = tries[first:stop]
        who = np.repeat(np.arange(first, stop), some)
        q = np.arange(1, some.sum() + 1) - np.repeat(np.cumsum(some) - some, some)
        of = owner[who]
        i = middle[of] - np.where(leftward[who], q, 0)
        j = i + q
        # Half of a run's words agree, so three do on one side of the places.
        same = equal.three[i] == equal.three[j]
        same |= equal.three[np.maximum(i - 3, 0)] == equal.three[np.maximum(j - 3, 0)]
        of, i, j, q = of[same], i[same], j[same], q[same]
        a = equal.behind(i, j, i - begin[of])
        b = equal.ahead(i, j, end[of] - j)
        good = (a + b >= q) & (a + b + q >= least) & (i - a < middle[of]) & (j + b > middle[of])
        found.append((of[good], (i - a)[good], (j + b)[good], q[good]))
        first = stop
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    of, start, stop, q = (np.concatenate(c) for c in zip(*found, strict=True))
    # The least period of a stretch that has several.
    order = np.lexsort((q, stop, start, of))
    of, start, stop, q = of[order], start[order], stop[order], q[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    return of[new], start[new], stop[new], q[new]


def maximal(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of one text and period merged into the runs that hold them,
    in order of text, start and period."""
    order = np.lexsort((-stop, start, q, doc))
    doc, start, stop, q = doc[order], start[order], stop[order], q[order]
    if len(doc):
        group = np.r_[0, np.cumsum((doc[1:] != doc[:-1]) | (q[1:] != q[:-1]))]
        reach = group * (int(stop.max()) + 1) + stop
        whole = reach > np.r_[-1, np.maximum.accumulate(reach)[:-1]]
        doc, start, stop, q = doc[whole], start[whole], stop[whole], q[whole]
    order = np.lexsort((q, start, doc))
    return doc[order], start[order], stop[order], q[order]


def find(words: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """All runs in texts given by their words' hashes: text, start (a place in
    ``words``), end, period."""
    ids = np.unique(words, return_inverse=True)[1].astype(np.int64)
    grammar, equal = Grammar(ids, bounds), Equal(ids)
    begin, middle, end = grammar.boundaries()
    of, start, stop, q = crossing(equal, begin, middle, end, least)
    wanted = np.zeros(len(begin), bool)
    wanted[of] = True
    symbol, place = grammar.derived(wanted)
    # Each symbol's finds, at each of its places.
    count = np.bincount(of, minlength=len(begin))
    before = np.cumsum(count) - count
    n = count[symbol]
    which = np.repeat(before[symbol] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    shift = np.repeat(place - begin[symbol], n)
    _, start2, stop2, q2 = crossing(equal, *grammar.trees(), least)
    start, stop, q = np.r_[start[which] + shift, start2], np.r_[stop[which] + shift, stop2], np.r_[q[which], q2]
    return maximal(np.searchsorted(bounds, start, "right") - 1, start, stop, q)


RUN = T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("period", T.LongType())


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``id, n_words, runs, collapsed`` of every row.

    ``runs`` is ordered by start and period, starts are word numbers from 0;
    ``collapsed`` has the words that no run contains after its first period,
    one blank between them. ``least`` is 9 or more: three words of half a run
    have to be on one side of a boundary.
    """
    if least < 9:
        raise ValueError("runs of fewer than 9 words are not searched")
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", chosen.schema["id"].dataType)]).add("n_words", T.LongType())
    schema = schema.add("runs", T.ArrayType(RUN)).add("collapsed", T.StringType())
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches, "text", CHUNK):
            data, offsets = tx.utf8(batch.column("text"))
            starts, ends, bounds = tx.words(data, offsets, tx.NOT_SPACE)
            doc, start, stop, q = find(tx.span_hash(tx.prefix_hash(data), starts, ends), bounds, least)
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, start + q, 1)
            np.add.at(change, stop, -1)
            kept = np.cumsum(change)[:-1] == 0
            whole = np.ones(len(bounds) - 1, bool)
            whole[doc] = False
            texts = []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                words = data[a:b].tobytes().split()
                if not whole[k]:
                    words = [w for w, keep in zip(words, kept[bounds[k] : bounds[k + 1]].tolist(), strict=True) if keep]
                texts.append(b" ".join(words))
            rows = pa.StructArray.from_arrays([pa.array(start - bounds[doc]), pa.array(stop - start), pa.array(q)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(bounds))), pa.int32()), rows)
            values = [batch.column("id"), pa.array(np.diff(bounds)), lists, pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    return chosen.mapInArrow(run, schema)
