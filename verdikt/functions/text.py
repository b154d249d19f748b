"""Text helpers whose rules follow Python's ``str``, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and \s treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# The same set, as the inside of a regex character class.
SPACE_CLASS = r"\x09-\x0d\x1c-\x20\x85\xa0  -     　"

WORD = f"[^{SPACE_CLASS}]+"
WORD_WITH_GAP = f"[{SPACE_CLASS}]*{WORD}"

# A JSON string literal. Possessive, so a long value cannot exhaust the
# regex stack.
JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a let-binding)."""
    return F.transform(F.array(value), body)[0]


def settled(col: Column) -> Column:
    """The same value, behind a term the optimizer takes for non-deterministic.

    A filter on such a column stays above it. Pushed further down, it would
    repeat the column's whole expression at each mention in its condition.
    """
    return F.when(F.spark_partition_id() >= 0, col)


def strip(col: Column) -> Column:
    """``str.strip()``; the full trim only runs where an end is white space.

    To take a letter, Spark counts all letters of the text; a byte costs no such
    walk, and most texts begin and end with a byte that is no white space.
    """
    spaces, data = list(WHITESPACE), col.cast("binary")

    def visible(byte: Column) -> Column:
        return (byte > F.lit(b" ")) & (byte < F.lit(b"\x80"))

    ends = F.substring(col, 1, 1).isin(spaces) | F.substring(col, -1, 1).isin(spaces)
    ends = ~(visible(F.substring(data, 1, 1)) & visible(F.substring(data, -1, 1))) & ends
    return F.when(ends, F.btrim(col, F.lit(WHITESPACE))).otherwise(col)


def word_count(col: Column) -> Column:
    """Number of white-space separated words: the length unit used here.

    Each word shrinks, with the gap before it, to one letter; only a gap at the
    end is left over. No list of words is built to be counted.
    """
    letters = F.regexp_replace(col, f"[{SPACE_CLASS}]*+[^{SPACE_CLASS}]++", "x")
    return F.length(F.rtrim(letters, F.lit(WHITESPACE)))


def words_with_gaps(col: Column) -> Column:
    """Words, each with the white space before it, so that a join is lossless."""
    return F.regexp_extract_all(col, F.lit(WORD_WITH_GAP), F.lit(0))


def _escape_char(char: Column) -> Column:
    code = F.ascii(char)
    digits = F.lower(F.hex(code))
    return (
        F.when(char == "\n", F.lit("\\n"))
        .when(char == "\r", F.lit("\\r"))
        .when(char == "\t", F.lit("\\t"))
        .when(code <= 0xFF, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
        .when(code <= 0xFFFF, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
    )


UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"


def quoted(text: Column) -> Column:
    """``repr()`` of a string."""

    def body(s: Column) -> Column:
        quote = F.when(s.contains("'") & ~s.contains('"'), F.lit('"')).otherwise(F.lit("'"))
        escaped = F.replace(s, F.lit("\\"), F.lit("\\\\"))
        escaped = F.when(quote == "'", F.replace(escaped, F.lit("'"), F.lit("\\'"))).otherwise(escaped)
        plain = F.when(
            escaped.rlike(UNPRINTABLE),
            F.array_join(
                F.transform(
                    F.split(escaped, ""),
                    lambda c: F.when(c.rlike(UNPRINTABLE), _escape_char(c)).otherwise(c),
                ),
                "",
            ),
        ).otherwise(escaped)
        return F.concat(quote, plain, quote)

    return bind(text, body)


def unquote_json(token: Column) -> Column:
    """The value of a JSON string literal."""
    return F.try_variant_get(F.try_parse_json(token), "$", "string")


def python_repr(json: Column) -> Column:
    """``repr()`` of the value a JSON text stands for, token by token."""
    pattern = JSON_STRING + r'|[,:{}\[\]]|[^",:{}\[\]]+'

    def token_repr(token: Column) -> Column:
        return (
            F.when(token.startswith('"'), quoted(unquote_json(token)))
            .when(token == ",", F.lit(", "))
            .when(token == ":", F.lit(": "))
            .when(token == "true", F.lit("True"))
            .when(token == "false", F.lit("False"))
            .when(token == "null", F.lit("None"))
            .otherwise(token)
        )

    tokens = F.regexp_extract_all(json, F.lit(pattern), F.lit(0))
    return F.array_join(F.transform(tokens, token_repr), "")
