"""Byte-level BPE of whole texts through the ``tokenizers`` library.

The library's pre-tokenizer cuts a text into pieces that are then encoded one
by one, independent of each other. Here the cuts are found for a whole chunk
of texts at once and each different piece goes to the library once; the ids of
pieces seen before come from a bounded cache. Texts with characters whose class
this module doesn't list, or with a special token's string, go to the library
whole. Either way the ids are those of ``encode(text)``.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from verdikt.llm import text as tx

SPACE, LETTER, NUMBER, OTHER, UNLISTED = range(5)
#: The code points of the regex class \s.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Blocks whose characters have kept their class over the versions of Unicode.
SETTLED = [(0, 0x377), (0x384, 0x52F), (0x2000, 0x2063), (0x20A0, 0x20B1), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5)]
#: Pieces whose ids are kept; beyond it the cache starts anew.
CACHED = 2_000_000
#: Pieces to a call of the library.
CALL = 4096


def _classes() -> np.ndarray:
    table = np.full(0x110000, UNLISTED, np.uint8)
    for low, high in SETTLED:
        for code in range(low, high + 1):
            kind = unicodedata.category(chr(code))
            if kind != "Cn":
                table[code] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    table[SPACES] = SPACE
    return table


def expanded(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + length[i] - 1, i after i."""
    total = np.cumsum(length)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - length), length)


_made: dict[str, Pieces] = {}


def encoder(tokenizer_json: str) -> Pieces:
    """One encoder per tokenizer and worker process, so that what one task
    learned serves the next."""
    if tokenizer_json not in _made:
        _made.clear()
        _made[tokenizer_json] = Pieces(tokenizer_json)
    return _made[tokenizer_json]


class Pieces:
    """Encodes Arrow columns of text with one tokenizer."""

    def __init__(self, tokenizer_json: str) -> None:
        self.library = Tokenizer.from_str(tokenizer_json)
        made = json.loads(tokenizer_json)
        before = made.get("pre_tokenizer") or {}
        plain = (
            before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and made.get("normalizer") is None
            and made["model"]["type"] == "BPE"
        )
        #: Whether the pieces of this tokenizer are cut by the rules below.
        self.cuts = plain
        self.special = [t["content"] for t in made.get("added_tokens", [])]
        self.classes = _classes()
        self._reset()

    def _reset(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.first = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _starts(self, codes: np.ndarray, kinds: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which characters begin a piece; ``docs``: where the texts begin."""
        n = len(codes)
        start = np.empty(n + 1, bool)
        start[1:-1] = kinds[1:] != kinds[:-1]
        start[docs] = True  # the place behind the last character as well
        start[0] = start[n] = True
        limit = np.zeros(n + 1, bool)
        limit[docs] = True
        limit[n] = True
        space = kinds == SPACE
        # The last blank of a run goes with what follows it in the same text;
        # any other white space there is a piece of its own.
        last = np.flatnonzero(space & np.r_[~space[1:], True] & ~limit[1:])
        start[last] = True
        start[last[codes[last] == 32] + 1] = False
        # Contractions, where an apostrophe is a run by itself.
        quote = np.flatnonzero((codes[:-1] == 39) & (kinds[1:] == LETTER) & start[:-2] & ~limit[1:-1])
        if len(quote):
            padded = np.r_[codes, 0, 0]
            one, two = padded[quote + 1], padded[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            long &= ~limit[np.minimum(quote + 2, n)]
            hit = short | long
            start[quote[hit] + 1] = False
            start[quote[hit] + np.where(short[hit], 2, 3)] = True
        return start

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids: list[list[int]] = []
        for k in range(0, len(texts), CALL):
            ids += [e.ids for e in self.library.encode_batch_fast(texts[k : k + CALL], add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, count.sum())])
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.first = np.insert(self.first, place, first)
        self.count = np.insert(self.count, place, count)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and n + 1 offsets. Null counts as empty."""
        if not self.cuts:
            ids = self._whole([t or "" for t in column.to_pylist()])
            return np.concatenate([np.empty(0, np.uint32), *ids]), np.cumsum([0, *map(len, ids)])
        data, offsets = tx.utf8(column)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        text = data.tobytes().decode("utf-8")
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        kinds = self.classes[codes]
        docs = np.searchsorted(lead, offsets)
        begins = np.flatnonzero(self._starts(codes, kinds, docs))
        bounds = np.r_[lead, len(data)][begins]
        prefix = tx.prefix_hash(data)
        keys = tx.span_hash(prefix, bounds[:-1], bounds[1:])
        unique, sample, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > CACHED:
            self._reset()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        new = sample[~known]
        if len(new):
            self._learn(unique[~known], [text[a:b] for a, b in zip(begins[new].tolist(), begins[new + 1].tolist(), strict=True)])
            at = np.searchsorted(self.keys, unique)
        of = at[back]
        count = self.count[of]
        ids = self.flat[expanded(self.first[of], count)]
        ends = np.r_[0, np.cumsum(count)][np.searchsorted(bounds[:-1], offsets)]
        return self._mended(column, text, kinds, docs, ids, ends)

    def _mended(self, column, text, kinds, docs, ids, ends):
        """Texts that must go to the library whole, put in place."""
        odd = np.flatnonzero(kinds == UNLISTED)
        whole = set((np.searchsorted(docs, odd, "right") - 1).tolist())
        if any(s in text for s in self.special):
            whole |= {k for k, t in enumerate(column.to_pylist()) if t and any(s in t for s in self.special)}
        if not whole:
            return ids, ends
        order = sorted(whole)
        made = dict(zip(order, self._whole([column[k].as_py() for k in order]), strict=True))
        parts = [made[k] if k in made else ids[ends[k] : ends[k + 1]] for k in range(len(ends) - 1)]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
