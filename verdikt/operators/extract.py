"""Find the JSON object inside a free-text answer.

Native first: the strict parse, the first code fence and, where there is no
fence, the text between the outermost braces settle nearly every answer inside
the JVM. Only the texts left over are sent, through one Arrow UDF, to Python;
every other row carries a null across that boundary. With them go answers with
a value that a VARIANT would not show as Python does.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdikt.functions.text import SPACE_CLASS, strip
from verdikt.operators import scan
from verdikt.operators.contracts import SHOWN_FIELDS, SHOWN_MEMBERS
from verdikt.operators.scan import Json

EMITTED = ["clean", "fenced", "embedded", "tool-envelope"]
# Keys that wrap an answer, in the order they are tried.
ENVELOPE_KEYS = ["input", "arguments", "parameters", "tool_input"]
# Stop looking for a longer fragment beyond this share of the text.
ENOUGH = 0.6
# Places that are looked at one by one before tables are built.
NEARBY = 64

FENCED = rf"(?s)```(?:json|JSON)?[{SPACE_CLASS}]*(.*?)```"
END_MARK = "~~end of answer~~"


_names = "|".join(sorted(SHOWN_FIELDS.union(*SHOWN_MEMBERS.values())))
#: A number or container where a text is wanted, found from its colon: few
#: characters of an answer are one. Behind more white space than a look back
#: takes, any key counts.
ODD_VALUE = rf'(?<=:)(?=[ \t\n\r]*+[-0-9\[{{])(?<="(?:{_names})"[ \t\n\r]{{0,4}}:|[ \t\n\r]{{5}}:)'
#: A number too long for a VARIANT, behind its first digit.
ODD_NUMBER = "(?<=[0-9])[0-9]{18}"
#: Both in one walk over the text, which stops at colons and digits alone.
ODD = f"[:0-9](?:{ODD_VALUE}|{ODD_NUMBER})"
#: The begin of a key that may be one of those in other letters.
ESCAPE, ODD_KEY = "\\u00", r"\\u00[4-7]"


def is_odd(text: Column) -> Column:
    """Whether a VARIANT may not show some value as Python does."""
    return (text.contains(ESCAPE) & text.rlike(ODD_KEY)) | text.rlike(ODD)


def parse_exactly(text: Column) -> Column:
    """Parse one JSON value with nothing after it.

    ``try_parse_json`` ignores trailing text. Inside ``[text, mark]`` the mark
    can only be the second member if the text is exactly one value. Texts that
    hold the mark themselves, and those the JVM parser refuses although Python
    takes them (repeated keys, NaN), give null and go on to the residue.
    """
    wrapped = F.concat(F.lit("["), text, F.lit(f',"{END_MARK}"]'))
    return F.when(~text.contains(END_MARK), F.try_parse_json(wrapped))


def first_to_last_brace(text: Column) -> Column:
    """The text from its first ``{`` to its last ``}``, '' without both in that
    order. Plain searches: the time is linear in the text, whatever it holds."""
    first = F.instr(text, "{")
    length = F.length(text) - F.instr(F.reverse(text), "}") + 2 - first
    return F.when(text.contains("{") & text.contains("}"), F.substr(text, first, length)).otherwise(F.lit(""))


def _is_exact(parsed: Column) -> Column:
    return F.coalesce(F.try_variant_get(parsed, "$[1]", "string") == END_MARK, F.lit(False))


def _closing_braces(text: str) -> tuple[list[int], list[int]]:
    """Positions of the special characters, and for each the index of the
    ``}`` that closes a scan entered there outside a string (-1: never).

    One pass from the right. Two states are kept per special character, outside
    and inside a string, because every ``{`` starts again outside a string even
    when it lies within one.
    """
    marks = [m.start() for m in re.finditer(r'[{}"\\]', text)]
    n = len(marks)
    outside, inside = [-1] * (n + 2), [-1] * (n + 2)
    for i in range(n - 1, -1, -1):
        char = text[marks[i]]
        outside[i], inside[i] = outside[i + 1], inside[i + 1]
        if char == '"':
            outside[i], inside[i] = inside[i + 1], outside[i + 1]
        elif char == "}":
            outside[i] = i
        elif char == "{":
            close = outside[i + 1]
            outside[i] = outside[close + 1] if close >= 0 else -1
        else:
            skips_mark = i + 1 < n and marks[i + 1] == marks[i] + 1
            inside[i] = inside[i + 2] if skips_mark else inside[i + 1]
    return marks, outside


class _Longest:
    """First of the longest numbers, and first number over a limit, from any
    place on: tables of maxima over spans of 1, 2, 4 ... numbers."""

    def __init__(self, numbers: list[int]):
        self.numbers = numbers
        self.ahead = list(accumulate(reversed(numbers), max, initial=0))
        self.ahead.reverse()

    @cached_property
    def levels(self) -> list[list[int]]:
        numbers, levels = self.numbers, [self.numbers]
        while 2 * len(levels[-1]) > len(numbers) and len(numbers) >= 2 ** len(levels):
            last, half = levels[-1], 2 ** (len(levels) - 1)
            levels.append([max(a, b) for a, b in zip(last, last[half:], strict=False)])
        return levels

    def first_over(self, i: int, limit: float) -> int:
        """The first place from ``i`` on whose number is over ``limit``, which
        has to be below ``ahead[i]``. Nearby ones are found without the tables."""
        for place in range(i, min(i + NEARBY, len(self.numbers))):
            if self.numbers[place] > limit:
                return place
        for level in range(len(self.levels) - 1, -1, -1):
            maxima = self.levels[level]
            while i < len(maxima) and maxima[i] <= limit:
                i += 2**level
        return i


class _Residue:
    """The full rule order over one text; suffixes share one brace table, one
    table of fences and what the scanner found."""

    def __init__(self, text: str):
        self.text = text
        self.json = Json(text)
        self.fences = [m.start() for m in re.finditer("(?=```)", text)] if "```" in text else []
        self.fenced: dict[int, tuple[int, int] | None] = {}

    @cached_property
    def envelopes(self) -> dict[str, list[tuple[int, int]]]:
        return {key: [m.span() for m in re.finditer(rf'"{key}"\s*:\s*\{{', self.text)] if f'"{key}"' in self.text else [] for key in ENVELOPE_KEYS}

    @cached_property
    def _braces(self) -> tuple[list[int], list[int]]:
        return _closing_braces(self.text)

    @property
    def marks(self) -> list[int]:
        return self._braces[0]

    @property
    def closing(self) -> list[int]:
        return self._braces[1]

    @cached_property
    def _lengths(self) -> _Longest:
        """How long the balanced fragment is that starts at each mark, or 0."""
        marks, closing = self._braces
        lengths = [0] * len(marks)
        for i, at in enumerate(marks):
            if self.text[at] == "{" and closing[i + 1] >= 0:
                lengths[i] = marks[closing[i + 1]] + 1 - at
        return _Longest(lengths)

    def _fragment_span(self, begin: int) -> tuple[int, int] | None:
        """The first fragment that is long enough, else the longest."""
        # An object from the first brace to the last one is both.
        first, last = self.text.find("{", begin), self.text.rfind("}")
        if 0 <= first < last and self.json.end(first) == last + 1:
            return first, last + 1
        i = bisect_left(self.marks, begin)
        longest = self._lengths.ahead[i]
        if not longest:
            return None
        enough = (len(self.text) - begin) * ENOUGH
        i = self._lengths.first_over(i, min(enough, longest - 1))
        at = self.marks[i]
        return at, at + self._lengths.numbers[i]

    def _fragment(self, begin: int) -> str | None:
        span = self._fragment_span(begin)
        return None if span is None else self.text[slice(*span)]

    def _is_object(self, begin: int, end: int) -> bool:
        return self.text[begin : begin + 1] == "{" and self.json.end(begin) == end

    def _fenced_object(self, begin: int) -> tuple[int, int] | None:
        """The first object that fills a fence, fences being paired from
        ``begin`` on; each fence is looked at once."""
        passed, found = [], None
        while True:
            k = bisect_left(self.fences, begin)
            if k == len(self.fences):
                break
            fence = self.fences[k]
            if fence in self.fenced:
                found = self.fenced[fence]
                break
            passed.append(fence)
            first = PY_FENCE.match(self.text, fence).end()
            close = self.text.find("```", first)
            if close < 0:
                break
            last = close
            while last > first and self.text[last - 1].isspace():
                last -= 1
            if self._is_object(first, last):
                found = first, last
                break
            begin = close + 3
        for fence in passed:
            self.fenced[fence] = found
        return found

    def direct(self, begin: int) -> tuple[tuple[int, int] | None, str | None]:
        """Whole text, then fences, then the longest balanced fragment."""
        if self.json.end(begin) == len(self.text):
            return ((begin, len(self.text)), "clean") if self.text[begin] == "{" else (None, "not-object")
        span = self._fenced_object(begin)
        if span is not None:
            return span, "fenced"
        span = self._fragment_span(begin)
        if span is not None and self._is_object(*span):
            return span, "embedded"
        return None, None

    def _next_envelope(self, key: str, begin: int) -> int | None:
        spans = self.envelopes[key]
        i = bisect_left(spans, (begin, 0))
        return spans[i][1] - 1 if i < len(spans) else None

    def find(self) -> tuple[tuple[int, int] | None, str]:
        """Where the object stands, and the mode."""
        span, mode = self.direct(0)
        if mode is not None:
            return span, mode
        # Depth first through the envelopes, each suffix looked at once.
        seen: set[int] = set()
        stack = [self._next_envelope(key, 0) for key in reversed(ENVELOPE_KEYS)]
        while stack:
            begin = stack.pop()
            if begin is None or begin in seen:
                continue
            seen.add(begin)
            span, mode = self.direct(begin)
            if span is not None and self.json.has_members(span[0]):
                return span, "tool-envelope"
            if mode is None:
                stack.extend(self._next_envelope(key, begin) for key in reversed(ENVELOPE_KEYS))
        return None, "unparseable"


PY_FENCE = re.compile(r"```(?:json|JSON)?\s*")


def _look(text: str | None) -> tuple[str | None, str | None, str | None, dict[str, str] | None]:
    """Mode, JSON text, fields for a VARIANT, and how odd values are shown."""
    if text is None:
        return None, None, None, None
    residue = _Residue(text)
    span, mode = residue.find()
    if span is None:
        return mode, None, None, None
    return mode, *residue.json.handed_over(*span, SHOWN_FIELDS, SHOWN_MEMBERS)


def _find(text: str | None) -> tuple[str | None, str | None]:
    return _look(text)[:2]


FOUND = T.StructType([T.StructField(name, T.StringType()) for name in ("mode", "doc", "fields")])
FOUND = FOUND.add("shown", T.MapType(T.StringType(), T.StringType()))
# Send the function itself to the workers, so they need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
register_pickle_by_value(scan)


@F.pandas_udf(FOUND)
def find_in_text(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([_look(t) for t in texts], columns=["mode", "doc", "fields", "shown"])


def extract_json(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``extract`` (the mode), ``doc`` (JSON text), ``answer`` and ``shown``.

    ``answer`` is a VARIANT list whose first member is the object: taking the
    object out would encode it anew. ``doc`` keeps key order, which a variant
    does not.
    """
    text = F.col("_text")
    # Columns of their own: a look into a VARIANT at each mention would add up.
    exact, inner = F.col("_exact"), F.col("_inner")
    opens_object = text.startswith("{")
    # A text that opens like JSON may still be JSON for Python, so a fence
    # inside it must wait for the residue's verdict.
    may_be_json = opens_object | text.startswith("[") | text.startswith('"')
    # Without fences, an object from the first brace to the last one is the
    # longest fragment; if it is none, the residue looks for others.
    has_fence = text.contains("```")
    first_object = F.when(has_fence, F.regexp_extract(text, FENCED, 1)).otherwise(first_to_last_brace(text))

    df = df.withColumn("_text", strip(F.coalesce(F.col(raw), F.lit(""))))
    df = df.withColumn("_whole", F.when(text != "", parse_exactly(text)))
    df = df.withColumn("_exact", _is_exact(F.col("_whole")))
    df = df.withColumn("_body", F.when(~exact & ~may_be_json, first_object).otherwise(F.lit("")))
    df = df.withColumn("_body", strip(F.col("_body")))
    df = df.withColumn("_fence", F.when(F.col("_body").startswith("{"), parse_exactly(F.col("_body"))))
    df = df.withColumn("_inner", _is_exact(F.col("_fence")))
    settled = (exact | inner) & ~is_odd(text)
    df = df.withColumn("_found", find_in_text(F.when((text != "") & ~settled, text)))
    df = df.withColumn(
        "_mode",
        F.when(text == "", F.lit("empty"))
        .when(exact, F.when(opens_object, F.lit("clean")).otherwise(F.lit("not-object")))
        .when(inner, F.when(has_fence, F.lit("fenced")).otherwise(F.lit("embedded")))
        .otherwise(F.col("_found.mode")),
    )
    df = df.withColumn(
        "doc",
        F.when(exact & opens_object, text).when(inner, F.col("_body")).otherwise(F.col("_found.doc")),
    )
    fields = F.coalesce(F.col("_found.fields"), F.col("_found.doc"))
    found = F.try_parse_json(F.concat(F.lit("["), fields, F.lit("]")))
    whole = F.when(F.col("_found.fields").isNotNull(), found)
    whole = whole.when(exact & opens_object, F.col("_whole")).when(inner, F.col("_fence")).otherwise(found)
    df = df.withColumn("answer", F.when(F.col("doc").isNotNull(), whole))
    lost = F.col("_mode").isin(EMITTED) & F.col("answer").isNull()
    mode = F.when(lost, F.lit("unparseable")).otherwise(F.col("_mode"))
    # One row in a list, taken apart again: a filter on what was found stays
    # above this step and cannot repeat the extraction, while one on the other
    # columns passes through it, down to the scan.
    made = ["_text", "_whole", "_exact", "_body", "_fence", "_inner", "_found", "_mode", "doc", "answer"]
    kept = [c for c in df.columns if c not in [*made, "extract", "shown"]]
    return df.select(*kept, F.inline(F.array(F.struct(mode.alias("extract"), "doc", "answer", F.col("_found.shown").alias("shown")))))


def answer_object() -> Column:
    """The object found, as a map of its top-level keys."""
    return F.try_variant_get("answer", "$[0]", "map<string,variant>")


def extract_modes(df: DataFrame, by: str = "run") -> DataFrame:
    """Answers per extraction mode."""
    return df.groupBy(by, "extract").agg(F.count(F.lit(1)).alias("n"))
