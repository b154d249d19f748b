"""SpotSigs: fingerprints from chains of content words behind common words.

Words are runs of ASCII letters, digits and everything beyond ASCII, with A-Z
lower-cased. A common word is an anchor; its signature is itself and the next
three content words behind it, fewer at the end of a text. A text's begin is an
anchor too, and where no common word stands, every eighth word is one, counted
from the last anchor, so that lists and tables have signatures as well; a text
of common words alone counts all its words as content. The fingerprint is the
set of signatures, 32-bit numbers, written in order as hexadecimal digits.

Likeness is the Jaccard share of two sets. Sets are put into classes by their
length so that only pairs of one class or of neighbouring ones can reach the
asked likeness; of those, a pair whose lengths bound it below is not opened.

Defined results: null and empty texts, and texts without a word, have an empty
fingerprint; two empty ones are alike by 1, an empty and another by 0. A text of
any length is taken whole; repeated rows have equal fingerprints; an empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from verdikt.llm import text as tx
from verdikt.llm.neighbours import CHUNK, beside_the_one_before

# Frequent words of four languages, the anchors of the method.
COMMON = {
    "en": "a an and are as at be but by for from had has have he her his in is it not of on or she that the they this to was we were which with you".split(),
    "fr": "au aux ce dans de des du elle en est et il je la le les mais ne nous on ou par pas pour que qui sa se son sur un une vous".split(),
    "de": "am auf aus bei das dem den der des die ein eine er es ich im ist mit nicht sich sie sind und von war wie wir zu zum zur".split(),
    "es": "al como con del el ella es esta fue ha la las lo los mas me muy no nos para pero por que se sin su sus un una y".split(),
}
#: Content words in a chain, and words to the next anchor where none is common.
CHAIN, GAP = 3, 8
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = tx.words(data, offsets, tx.ALNUM)
    return tx.span_hash(tx.prefix_hash(tx.LOWER[data]), starts, ends), bounds


def _of_words(words: list[str]) -> np.ndarray:
    return np.sort(np.unique(_hashes(*tx.utf8(pa.array(words)))[0]))


ANCHORS = _of_words([w for words in COMMON.values() for w in words])


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The different signatures of each text in order, and n + 1 offsets."""
    data, offsets = tx.utf8(texts)
    h, bounds = _hashes(data, offsets)
    n, size = len(offsets) - 1, np.diff(bounds)
    if not len(h):
        return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
    doc, index = np.repeat(np.arange(n), size), np.arange(len(h))
    at = np.minimum(np.searchsorted(ANCHORS, h), len(ANCHORS) - 1)
    common = ANCHORS[at] == h
    common &= (np.bincount(doc, ~common, n) > 0)[doc]
    # Words since the last common one, or since the text's begin.
    last = np.maximum(np.maximum.accumulate(np.where(common, index, -1)), bounds[:-1][doc] - 1)
    behind = np.flatnonzero((index - last) % GAP == 0)
    begins = np.flatnonzero(size)
    owner = np.r_[doc[behind], begins]
    own = np.r_[np.where(common[behind], h[behind], np.uint64(0)), np.zeros(len(begins), np.uint64)]
    content = h[~common]
    passed = np.r_[0, np.cumsum(~common)]
    first = passed[np.r_[behind + 1, bounds[:-1][begins]]]
    end = passed[bounds[1:]][owner]
    total = own * _FACTORS[0]
    for k in range(CHAIN):
        word = content[np.minimum(first + k, len(content) - 1)]
        total += np.where(first + k < end, word, np.uint64(0)) * _FACTORS[k + 1]
    some = first < end
    key = owner[some].astype(np.uint64) << np.uint64(32) | tx.mixed(tx.mixed(total[some])) >> np.uint64(32)
    key = np.unique(key)
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(key >> np.uint64(32), np.arange(n + 1))


def digits(sigs: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The fingerprints as text, eight hexadecimal digits a signature."""
    whole, cut = sigs.astype(">u4").tobytes().hex(), (offsets * 8).tolist()
    return [whole[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def length_class(sizes: np.ndarray, least: float) -> np.ndarray:
    """Sets alike by ``least`` or more are in one class or in neighbouring ones."""
    return np.floor(np.log(np.maximum(sizes, 1)) / -np.log(least)) if 0 < least < 1 else np.zeros(len(sizes))


def likeness(sigs: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Jaccard share of the sets ``a[i]`` and ``b[i]``; 0 where it is below ``least``."""
    size = np.diff(offsets)
    na, nb = size[a], size[b]
    near = np.abs(length_class(na, least) - length_class(nb, least)) <= 1
    bound = np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1)
    out = np.where((na == 0) & (nb == 0), 1.0, 0.0)
    open_ = np.flatnonzero(near & (bound > 0) & (bound >= least))
    if not len(open_):
        return out

    def keyed(sets: np.ndarray) -> np.ndarray:
        count = size[sets]
        before = np.cumsum(count) - count
        flat = np.repeat(offsets[sets] - before, count) + np.arange(count.sum())
        return np.repeat(np.arange(len(sets), dtype=np.uint64), count) << np.uint64(32) | sigs[flat]

    left, right = keyed(a[open_]), keyed(b[open_])
    place = np.minimum(np.searchsorted(left, right), len(left) - 1)
    both = np.bincount((right[left[place] == right] >> np.uint64(32)).astype(np.int64), minlength=len(open_))
    share = both / (na[open_] + nb[open_] - both)
    out[open_] = np.where(share >= least, share, 0.0)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint, signatures``: the set as text, and its size."""
    chosen = docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text")
    schema = T.StructType([T.StructField("id", chosen.schema["id"].dataType)])
    schema = schema.add("fingerprint", T.StringType()).add("signatures", T.LongType())
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches, "text", CHUNK):
            sigs, offsets = signatures(batch.column("text"))
            values = [batch.column("id"), pa.array(digits(sigs, offsets), pa.string()), pa.array(np.diff(offsets))]
            yield pa.RecordBatch.from_arrays(values, schema=arrow)

    return chosen.mapInArrow(run, schema)


def edited(text: str, other: str) -> str:
    """The last third of the characters replaced by the first of another text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


def beside_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0) -> DataFrame:
    """Fingerprints of the texts and of edited texts, and their likeness.

    The next document is that of the next smaller id, after the least id that of
    the greatest; a text's end is edited with its begin. ``near_edited`` is the
    likeness of a text to its edited text, ``near_next`` to the next one.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)]).add("n_chars", T.LongType())
    for name in ("edited_sha256", "fingerprint", "edited_fingerprint"):
        schema = schema.add(name, T.StringType())
    schema = schema.add("near_edited", T.DoubleType()).add("near_next", T.DoubleType())
    names = [f.name for f in schema]

    def make(ids: pa.Array, texts: pa.Array, own: np.ndarray) -> pa.RecordBatch:
        plain = texts.to_pylist()
        mine = np.flatnonzero(own)
        after = [edited(plain[k + 1], plain[k]) for k in mine.tolist()]
        sigs, offsets = signatures(pa.concat_arrays([texts, pa.array(after, texts.type)]))
        prints = digits(sigs, offsets)
        here, there = mine + 1, len(plain) + np.arange(len(mine))
        values = [
            ids.take(pa.array(mine)),
            pa.array([len(plain[k]) for k in here.tolist()], pa.int64()),
            pa.array([sha256(t.encode()).hexdigest() for t in after], pa.string()),
            pa.array([prints[k] for k in here.tolist()], pa.string()),
            pa.array(prints[len(plain) :], pa.string()),
            pa.array(likeness(sigs, offsets, here, there, least), pa.float64()),
            pa.array(likeness(sigs, offsets, here, mine, least), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(values, names=names)

    return beside_the_one_before(docs, id_col, text_col, make, schema)
