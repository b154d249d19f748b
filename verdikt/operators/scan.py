"""A pushdown automaton over JSON text: spans of values, without recursion.

``Json.end`` tells where the value at a place ends, by Python's rules for JSON.
Every list or object is walked once, whichever search asks for it, and is passed
over in one step afterwards; open ones are kept on an explicit stack, so depth
is bounded by memory alone. Nothing is decoded until it is asked for.

``handed_over`` prepares an answer for the JVM, which parses it into a VARIANT.
A VARIANT takes 1,000 levels, 20 million characters a text and 128 MB, keeps
neither the digits of a number nor the order of keys, and refuses repeated keys
and NaN. Where an answer goes beyond that, the fields that contracts look at go
as stand-ins of the same type, truth and length, and the others are dropped:
what lies deeper than any check looks, long texts, long numbers. Beside it go
the texts that Python would show for values that are neither text nor a word.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property
from hashlib import sha256

TOKEN = re.compile(
    r"[ \t\n\r]*+(?:([\[\]{},:])"
    r'|("[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+")'
    r"|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][-+]?[0-9]++)?+)"
    r"|(true|false|null|NaN|-?Infinity))"
)
MARK, TEXT, NUMBER = 1, 2, 3
#: Digits of a whole number that Python still reads.
DIGITS = 4300

#: What a VARIANT surely takes: levels, characters of a text, of a number, of all.
LEVELS, LONG, WIDE, SIZE = 500, 1 << 20, 18, 64 << 20
#: Levels of an answer that checks look at, and characters of a text they see.
LOOKED_AT, SEEN = 10, 1 << 16
#: Fields beside those of contracts are kept up to so many characters.
SMALL = 1000

# States: what may come next in the open list or object.
FIRST_KEY, COLON, MEMBER, AFTER_MEMBER, KEY, FIRST_ITEM, AFTER_ITEM, ITEM = range(8)
_VALUE_NEXT = {MEMBER: AFTER_MEMBER, FIRST_ITEM: AFTER_ITEM, ITEM: AFTER_ITEM}


def plain_text(token: str) -> str:
    """The text that a JSON string stands for."""
    return json.loads(token) if "\\" in token else token[1:-1]


def python_number(token: str) -> str:
    """How Python shows a number or a word of JSON."""
    words = {"true": "True", "false": "False", "null": "None", "NaN": "nan", "Infinity": "inf", "-Infinity": "-inf"}
    if token in words:
        return words[token]
    return repr(float(token)) if "." in token or "e" in token or "E" in token else repr(int(token))


#: Short texts are read by Python's parser first, a few times each, so that what
#: it reads in vain stays bounded: characters, openings, and readings.
SHORT, OPENINGS, READINGS = 1 << 16, 200, 6
#: What may be a number too long, or a word that a VARIANT refuses.
UNFIT = re.compile(r"[-+.0-9eE]{%d}|NaN|Infinity" % (WIDE + 1))


class _Repeated(Exception):
    """A key stands twice in an object."""


def _once(pairs: list) -> dict:
    own = dict(pairs)
    if len(own) < len(pairs):
        raise _Repeated
    return own


class Json:
    """Spans of the values in one text."""

    def __init__(self, text: str) -> None:
        self.text = text
        #: End of the list or object that begins at a place; -1: none is there.
        self.ends: dict[int, int] = {}
        #: End and value where Python's parser read one, with each key once; -1
        #: and None where it found none.
        self.read: dict[int, tuple[int, object]] = {}
        short = len(text) <= SHORT and text.count("{") + text.count("[") <= OPENINGS
        self.readings = READINGS if short else 0

    @cached_property
    def _decoder(self) -> json.JSONDecoder:
        return json.JSONDecoder(object_pairs_hook=_once)

    def _read(self, begin: int) -> bool:
        """Whether Python's parser settled what begins here."""
        if begin not in self.read:
            if not self.readings or begin in self.ends:
                return False
            self.readings -= 1
            try:
                value, end = self._decoder.raw_decode(self.text, begin)
                self.read[begin] = end, value
            except _Repeated:
                return False
            except ValueError:
                self.read[begin] = -1, None
        return True

    def _walked(self, begin: int) -> None:
        """Have the places inside a value that is known to be one."""
        if begin not in self.ends:
            self._walk(begin)

    def end(self, begin: int) -> int:
        """Where the one value at ``begin`` ends, or -1."""
        if self.text[begin : begin + 1] in ("{", "["):
            if self._read(begin):
                return self.read[begin][0]
            self._walked(begin)
            return self.ends[begin]
        m = TOKEN.match(self.text, begin)
        return m.end() if m and m.lastindex != MARK and not self._too_long(m) else -1

    @staticmethod
    def _too_long(m: re.Match) -> bool:
        return m.lastindex == NUMBER and m.end() - m.start(NUMBER) > DIGITS and m.group(NUMBER).lstrip("-").isdigit() and len(m.group(NUMBER).lstrip("-")) > DIGITS

    def _walk(self, begin: int) -> None:
        text, match, ends = self.text, TOKEN.match, self.ends
        opened, states = [begin], [FIRST_KEY if text[begin] == "{" else FIRST_ITEM]
        at = begin + 1
        while opened:
            m, state = match(text, at), states[-1]
            if m is None:
                break
            at, kind = m.end(), m.lastindex
            if kind == MARK:
                mark = text[at - 1]
                if mark == ",":
                    if state == AFTER_MEMBER:
                        states[-1] = KEY
                    elif state == AFTER_ITEM:
                        states[-1] = ITEM
                    else:
                        break
                elif mark == ":":
                    if state != COLON:
                        break
                    states[-1] = MEMBER
                elif mark in "{[":
                    if state not in _VALUE_NEXT:
                        break
                    states[-1] = _VALUE_NEXT[state]
                    known = ends.get(at - 1)
                    if known is None:
                        opened.append(at - 1)
                        states.append(FIRST_KEY if mark == "{" else FIRST_ITEM)
                    elif known < 0:
                        break
                    else:
                        at = known
                elif state in ((FIRST_KEY, AFTER_MEMBER) if mark == "}" else (FIRST_ITEM, AFTER_ITEM)):
                    ends[opened.pop()] = at
                    states.pop()
                else:
                    break
            elif state in _VALUE_NEXT:
                if self._too_long(m):
                    break
                states[-1] = _VALUE_NEXT[state]
            elif kind == TEXT and state in (FIRST_KEY, KEY):
                states[-1] = COLON
            else:
                break
        for place in opened:
            ends[place] = -1

    def members(self, begin: int) -> Iterator[tuple[str | None, int, int]]:
        """Key (None in a list), begin and end of each value right inside."""
        self._walked(begin)
        text, at, key = self.text, begin + 1, None
        in_object = text[begin] == "{"
        while True:
            m = TOKEN.match(text, at)
            at = m.end()
            if m.lastindex == MARK:
                mark = text[at - 1]
                if mark in "}]":
                    return
                if mark in "{[":
                    yield key, at - 1, self.ends[at - 1]
                    at, key = self.ends[at - 1], None
            elif in_object and key is None:
                key = m.group(TEXT)
            else:
                yield key, m.start(m.lastindex), at
                key = None

    def has_members(self, begin: int) -> bool:
        return bool(self.read[begin][1]) if begin in self.read else next(self.members(begin), None) is not None

    def fields(self, begin: int) -> dict[str, tuple[int, int]]:
        """The values of an object; of a repeated key the last one, at the place
        of the first."""
        return {plain_text(key): (a, b) for key, a, b in self.members(begin)}

    # What goes to the JVM

    def _fits(self, begin: int, end: int) -> tuple[bool, bool]:
        """Whether a VARIANT takes the value as it is, and has no key twice."""
        fits, single, keys, at, text = end - begin <= SIZE, True, [], begin, self.text
        key_next = False
        while at < end:
            m = TOKEN.match(text, at)
            at, kind = m.end(), m.lastindex
            if kind == MARK:
                mark = text[at - 1]
                if mark in "{[":
                    keys.append(set() if mark == "{" else None)
                    fits = fits and len(keys) <= LEVELS
                elif mark in "}]":
                    keys.pop()
                key_next = mark in "{," and keys and keys[-1] is not None
            elif kind == TEXT:
                if key_next:
                    key = plain_text(m.group(TEXT))
                    single = single and key not in keys[-1]
                    keys[-1].add(key)
                    key_next = False
                elif at - m.start(TEXT) > LONG:
                    fits = False
            elif kind == NUMBER:
                fits = fits and at - m.start(NUMBER) <= WIDE
            elif text[at - 1] in "Ny":  # NaN, Infinity
                fits = False
        return fits, single

    def _rendered(self, begin: int, end: int, python: bool) -> str:
        """The value with each key once, as JSON or as Python shows it."""
        comma, colon = (", ", ": ") if python else (",", ":")
        done: list = []
        stack: list[tuple[list | dict, list]] = []
        key, at, text = None, begin, self.text

        def put(value) -> None:
            if not stack:
                done.append(value)
            elif isinstance(stack[-1][0], dict):
                stack[-1][0][key] = value
            else:
                stack[-1][0].append(value)

        while at < end:
            m = TOKEN.match(text, at)
            at, kind = m.end(), m.lastindex
            if kind == MARK:
                mark = text[at - 1]
                if mark in "{[":
                    stack.append(({} if mark == "{" else [], [key]))
                    key = None
                elif mark in "}]":
                    own, (key,) = stack.pop()
                    pieces: list = ["{" if mark == "}" else "["]
                    for k, v in own.items() if mark == "}" else ((None, v) for v in own):
                        if len(pieces) > 1:
                            pieces.append(comma)
                        if k is not None:
                            pieces += [repr(k) if python else json.dumps(k), colon]
                        pieces.append(v)
                    pieces.append(mark)
                    put(pieces)
                    key = None
            elif kind == TEXT and stack and isinstance(stack[-1][0], dict) and key is None:
                key = plain_text(m.group(TEXT))
            else:
                token = m.group(kind)
                put((repr(plain_text(token)) if kind == TEXT else python_number(token)) if python else token)
                key = None
        out, left = [], [iter(done)]
        while left:
            piece = next(left[-1], None)
            if piece is None:
                left.pop()
            elif isinstance(piece, str):
                out.append(piece)
            else:
                left.append(iter(piece))
        return "".join(out)

    def shown(self, begin: int, end: int) -> str:
        """``repr()`` of the value, from its own digits and in its own order."""
        return self._rendered(begin, end, True)

    def _stand_in(self, begin: int, end: int, level: int) -> str:
        """JSON of the same type, truth and length as far as checks look."""
        first = self.text[begin]
        if first == "{":
            own = self.fields(begin)
            if level >= LOOKED_AT:
                return '{"":0}' if own else "{}"
            return "{" + ",".join(f"{json.dumps(k)}:{self._stand_in(a, b, level + 1)}" for k, (a, b) in own.items()) + "}"
        if first == "[":
            own = self.members(begin)
            if level >= LOOKED_AT:
                return "[0]" if next(own, None) else "[]"
            return "[" + ",".join(self._stand_in(a, b, level + 1) for _, a, b in own) + "]"
        token = self.text[begin:end]
        if first == '"':
            return token if end - begin <= SEEN else json.dumps(_shortened(plain_text(token)))
        if first in "tfn":
            return token
        sign = "-" if first == "-" else ""
        if token.lstrip("-").isdigit():
            return token if len(token) <= WIDE else f"{sign}9"
        return "0.0" if first not in "NI" and token != "-Infinity" and float(token) == 0 else f"{sign}1.5"

    @staticmethod
    def _plain(own: dict, names: frozenset[str], lists: dict[str, frozenset[str]]) -> bool:
        """Whether each value that would be shown is a text or a word."""

        def odd(value: object) -> bool:
            return not isinstance(value, str | bool | None)

        if any(odd(own[name]) for name in names & own.keys()):
            return False
        for name in lists.keys() & own.keys():
            for member in own[name] if isinstance(own[name], list) else ():
                if isinstance(member, dict) and any(odd(member[key]) for key in lists[name] & member.keys()):
                    return False
        return True

    def handed_over(self, begin: int, end: int, names: frozenset[str], lists: dict[str, frozenset[str]]) -> tuple[str, str | None, dict[str, str]]:
        """JSON text of the object with each key once; the fields for a VARIANT,
        None if that text serves; and how Python shows odd values.

        ``names`` are the fields whose values are shown, and ``lists`` those with
        the keys of their members whose values are.
        """
        if begin in self.read and self._plain(self.read[begin][1], names, lists) and not UNFIT.search(self.text, begin, end):
            return self.text[begin:end], None, {}
        fits, single = self._fits(begin, end)
        doc = self.text[begin:end] if single else self._rendered(begin, end, False)
        own = self.fields(begin)
        fields = None
        if not fits:
            kept = {
                k: self._stand_in(a, b, 2) if k in names or k in lists or b - a <= SMALL else "0" for k, (a, b) in own.items()
            }
            fields = "{" + ",".join(f"{json.dumps(k)}:{v}" for k, v in kept.items()) + "}"
        shown: dict[str, str] = {}

        def look(path: str, a: int, b: int) -> None:
            if self.text[a] not in '"tfn':
                shown[path] = self.shown(a, b)

        for name in names & own.keys():
            look(name, *own[name])
        for name in lists.keys() & own.keys():
            if self.text[own[name][0]] == "[":
                for i, (_, a, _) in enumerate(self.members(own[name][0])):
                    if self.text[a] == "{":
                        member = self.fields(a)
                        for key in lists[name] & member.keys():
                            look(f"{name}[{i}].{key}", *member[key])
        return doc, fields, shown


def _shortened(text: str) -> str:
    """A long text by its beginning: as blank before, as equal when stripped,
    with the signs that checks look for anywhere."""
    bare = text.strip()
    lead = text[: len(text) - len(text.lstrip())]
    signs = "".join(s for s in ("##", "\\") if s in text)
    return lead[:SEEN] + bare[:SEEN] + sha256(bare.encode("utf-8", "surrogatepass")).hexdigest() + signs
