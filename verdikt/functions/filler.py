"""Placeholder detection in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdikt.functions.text import SPACE_CLASS, strip

# A whole value equal to one of these is padding.
FILLER_EXACT = ["n/a", "na", "tbd", "todo", "...", "-", "none", "?", "xxx"]
# Padding inside a longer text, in order of precedence.
FILLER_PATTERNS = [
    r"\btodo\b",
    r"\btbd\b",
    r"\bfixme\b",
    r"\blorem ipsum\b",
    r"\byour code here\b",
    r"\bverify it works\b",
    r"\bverify functionality\b",
    r"\bcoming soon\b",
    r"\bsame as above\b",
    r"<(?:insert|your|add|todo|replace|fill|placeholder|value|name)\b[^>]{0,28}>",
    r"\{\{[a-z_ ]{2,30}\}\}",
    r"\[(?:insert|add|todo|placeholder)[^\]]{0,30}\]",
    r"example\.com/(?:path|foo|bar)",
]

# For each pattern, texts of which every match holds one. They are found by
# plain search, so that a pattern only runs where it can match.
NEEDLES = [
    ["todo"],
    ["tbd"],
    ["fixme"],
    ["lorem ipsum"],
    ["your code here"],
    ["verify it works"],
    ["verify functionality"],
    ["coming soon"],
    ["same as above"],
    ["<insert", "<your", "<add", "<todo", "<replace", "<fill", "<placeholder", "<value", "<name"],
    ["{{"],
    ["[insert", "[add", "[todo", "[placeholder"],
    ["example.com/"],
]
# For needles that begin with a frequent letter, a part of them that does not:
# where a search meets the first letter, it stops to compare.
PARTS = {
    "tbd": "bd",
    "fixme": "xme",
    "lorem ipsum": "m ipsum",
    "your code here": "ur code here",
    "coming soon": "g soon",
    "same as above": "me as above",
    "example.com/": "xample.com/",
}
# Begins that several needles share.
BEGINS = ["<", "verify "]
# Letters that fold onto "s" and "i" when case is ignored.
FOLDING = ["ſ", "ı"]

WORD_CHAR = r"[\p{L}\p{N}_]"


def java_pattern(pattern: str) -> str:
    """The pattern with Unicode word boundaries, in the JVM's dialect.

    The boundary before a word is tested after its first letter, so that the
    search can skip ahead to that letter.
    """
    if pattern.startswith(r"\b"):
        first = pattern[2]
        pattern = f"{first}(?<!{WORD_CHAR}{first})" + pattern[3:]
    return "(?iu)" + pattern.replace(r"\b", f"(?!{WORD_CHAR})")


PATTERNS = [java_pattern(p) for p in FILLER_PATTERNS]


# The rules below are SQL texts: they are used inside array lambdas, where one
# parsed text is far quicker to plan than hundreds of nested Column calls.


def _literal(value: str) -> str:
    return "r'" + value + "'" if "\\" in value else "'" + value + "'"


def _contains_any(text: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_literal(n)})" for n in needles) + ")"


def _is_exact(low: str) -> str:
    longest = max(len(v.encode()) for v in FILLER_EXACT)
    values = ", ".join(_literal(v) for v in FILLER_EXACT)
    return f"(octet_length({low}) <= {longest} AND {low} IN ({values}))"


def _may_match(low: str, i: int) -> str:
    return _contains_any(low, NEEDLES[i] + FOLDING)


def _may_match_any(low: str) -> str:
    """Whether any pattern can match, in fewer searches than pattern by pattern:
    needles that hold another one are left out, those of a common begin are only
    looked for where it occurs, and folding letters only in texts beyond ASCII."""
    needles = sum(NEEDLES, [])
    needles = [n for n in needles if not any(m != n and m in n for m in needles)]
    parts = [f"(octet_length({low}) <> length({low}) AND {_contains_any(low, FOLDING)})"]
    for begin in BEGINS:
        begun = [n for n in needles if n.startswith(begin)]
        needles = [n for n in needles if n not in begun]
        parts.append(f"(contains({low}, {_literal(begin)}) AND {_contains_any(low, begun)})")
    needles = [PARTS.get(n, n) for n in needles]
    return f"({_contains_any(low, needles)} OR " + " OR ".join(parts) + ")"


def _is_hit(low: str) -> str:
    matches = [f"({_may_match(low, i)} AND {low} RLIKE {_literal(p)})" for i, p in enumerate(PATTERNS)]
    return f"({_is_exact(low)} OR ({_may_match_any(low)} AND (" + " OR ".join(matches) + ")))"


def _first_match(low: str) -> str:
    """The match of the first pattern, in order, that occurs."""
    found = ", ".join(
        f"IF({_may_match(low, i)}, nullif(regexp_extract({low}, {_literal(p)}, 0), ''), null)"
        for i, p in enumerate(PATTERNS)
    )
    return f"coalesce({found})"


def _label(low: str) -> str:
    return (
        f"CASE WHEN {_is_exact(low)} THEN concat('empty-field:', {low}) "
        f"ELSE concat('filler:', {_first_match(low)}) END"
    )


def normalized(text: Column) -> Column:
    return F.lower(strip(text))


def is_hit(low: str) -> Column:
    """Whether a normalized text column is or holds padding."""
    return F.expr(_is_hit(low))


def hit_label(low: str) -> Column:
    return F.expr(_label(low))


def hit_rule(low: str) -> Column:
    """``exact``, or the position of the first pattern that occurs."""
    whens = " ".join(
        f"WHEN {_may_match(low, i)} AND {low} RLIKE {_literal(p)} THEN 'pattern-{i}'" for i, p in enumerate(PATTERNS)
    )
    return F.expr(f"CASE WHEN {_is_exact(low)} THEN 'exact' {whens} END")


def may_hold_hit(low_doc: str) -> Column:
    """False only if no string of the lower-cased JSON text can be a hit.

    Plain substring searches, so that most answers never reach the patterns.
    """
    return F.expr(f"{_may_match_any(low_doc)} OR {_contains_any(low_doc, HIDING)} OR {low_doc} RLIKE {_literal(QUOTED_EXACT)}")


def marks_of(strings: str) -> Column:
    """The different finds in normalized strings, in order: the exact value, or
    a blank and what a pattern matched."""
    mark = f"CASE WHEN {_is_exact('s')} THEN s ELSE concat(' ', {_first_match('s')}) END"
    return F.expr(f"array_distinct(transform(filter({strings}, s -> {_is_hit('s')}), s -> {mark}))")


def labels_of(marks: str) -> Column:
    """The notes of the finds."""
    return F.expr(f"transform({marks}, m -> IF(startswith(m, ' '), concat('filler:', substr(m, 2)), concat('empty-field:', m)))")


# Escapes that may hide a needle.
HIDING = ["\\u", "\\/"]
# A quoted exact value, or a string that starts with an escaped white space. The
# first letter is tested before the values are tried in turn.
QUOTED_EXACT = (
    rf'"(?=[{SPACE_CLASS}\\'
    + "".join(sorted({re.escape(v[0]) for v in FILLER_EXACT}))
    + rf'])(?:[{SPACE_CLASS}]*+(?:'
    + "|".join(re.escape(v) for v in FILLER_EXACT)
    + rf')(?:[{SPACE_CLASS}]|\\[ntrf])*"|\\[ntrf])'
)
