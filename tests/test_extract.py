import json
import random
import time

import pytest
from pyspark.sql import functions as F

from verdikt.operators import extract
from verdikt.operators.extract import _closing_braces, extract_json

CASES = [
    (None, "empty", None),
    ("", "empty", None),
    ("  \u00a0\n", "empty", None),
    ('  {"a":1}  ', "clean", {"a": 1}),
    ('\u00a0{"a":1}\u3000', "clean", {"a": 1}),
    ('{"a":1,"a":2}', "clean", {"a": 2}),
    ('{"input":{"a":1}}', "clean", {"input": {"a": 1}}),
    ("[1]", "not-object", None),
    ('"x"', "not-object", None),
    ("3", "not-object", None),
    ("NaN", "not-object", None),
    ('```json\n{"a":1}\n```', "fenced", {"a": 1}),
    ('so: ```{"a":1}``` and ```{"b":1}```', "fenced", {"a": 1}),
    ('```\nnope\n``` ```{"a":1}```', "fenced", {"a": 1}),
    ('text {"a":{"b":1}} text', "embedded", {"a": {"b": 1}}),
    ('{"a":1} x', "embedded", {"a": 1}),
    ('{"a":1}],[{"b":2}', "embedded", {"a": 1}),
    ('{"a":"}"} x', "embedded", {"a": "}"}),
    ('{x} {"a":1}', "embedded", {"a": 1}),
    ('{not json at all} {"a":1}', "unparseable", None),
    ('{bad "input": {"a":1} bad}', "tool-envelope", {"a": 1}),
    ('{bad "input": {} "arguments": {"z": 1} bad}', "tool-envelope", {"z": 1}),
    ("no json", "unparseable", None),
    ('{"a":1}~~end of answer~~', "embedded", {"a": 1}),
]


def test_modes(spark):
    rows = [(i, raw) for i, (raw, _, _) in enumerate(CASES)]
    got = extract_json(spark.createDataFrame(rows, "i int, raw string")).select("i", "extract", "doc").collect()
    for row in got:
        raw, mode, value = CASES[row.i]
        assert row.extract == mode, raw
        assert (json.loads(row.doc) if row.doc else None) == value, raw


#: Texts around one object, and whether they have to go to Python.
AROUND = [
    ('see {"a":{"b":"}"}} there', "embedded", {"a": {"b": "}"}}),
    ('\u00e9\U0001f600 {"a":"\U0001f600"} \u00e9', "embedded", {"a": "\U0001f600"}),
    ("see {} there", "embedded", {}),
    ('see ```{"a":1}``` there', "fenced", {"a": 1}),
    ('see ``` {"a":1}', "residue", None),
    ('see {"a":1} and {"b":2}', "residue", None),
    ('see {"a":1},{"b":2}', "residue", None),
    ('see {"a":1}],[{"b":2}', "residue", None),
    ('see {"a":1,"a":2}', "residue", None),
    ('see } and {', "residue", None),
    ('see {"a":1', "residue", None),
    ('[1] {"a":1}', "residue", None),
    ("no json", "residue", None),
]


def test_one_object_inside_a_text_is_settled_without_python(spark, monkeypatch):
    def asked(text):
        mode = F.when(text.isNotNull(), F.lit("residue"))
        return F.from_json(F.to_json(F.struct(mode.alias("mode"))), extract.FOUND.simpleString())

    rows = spark.createDataFrame([(i, raw) for i, (raw, _, _) in enumerate(AROUND)], "i int, raw string")
    whole = {r.i: (r.extract, r.doc) for r in extract_json(rows).select("i", "extract", "doc").collect()}
    monkeypatch.setattr(extract, "find_in_text", asked)
    for row in extract_json(rows).select("i", "extract", "doc").collect():
        raw, mode, value = AROUND[row.i]
        assert row.extract == mode, raw
        if mode != "residue":
            assert json.loads(row.doc) == value, raw
        # What Python finds in the whole text is what is found here.
        assert whole[row.i] == extract._find(raw), raw


def test_long_text_with_many_escapes(spark):
    text = json.dumps({"a": 'x"\\\n{' * 60_000})
    rows = [(1, text), (2, "see " + text), (3, "{" * 20_000 + text)]
    got = extract_json(spark.createDataFrame(rows, "i int, raw string")).select("i", "extract").collect()
    assert {r.i: r.extract for r in got} == {1: "clean", 2: "embedded", 3: "embedded"}


def literal_fragment_end(text: str, start: int) -> int | None:
    depth, inside, skip = 0, False, False
    for i in range(start, len(text)):
        if skip:
            skip = False
        elif inside and text[i] == "\\":
            skip = True
        elif text[i] == '"':
            inside = not inside
        elif not inside and text[i] in "{}":
            depth += 1 if text[i] == "{" else -1
            if depth == 0:
                return i
    return None


def test_closing_braces_against_a_literal_scan():
    import random

    rng = random.Random(7)
    for _ in range(400):
        text = "".join(rng.choice('{}"\\a ') for _ in range(rng.randint(0, 40)))
        marks, closing = _closing_braces(text)
        for i, at in enumerate(marks):
            if text[at] == "{":
                end = marks[closing[i + 1]] if closing[i + 1] >= 0 else None
                assert end == literal_fragment_end(text, at), (text, at)


def test_unknown_task_stops_the_job(spark):
    from verdikt.operators.score import score

    df = spark.createDataFrame([("nope", "{}")], "task string, raw string")
    with pytest.raises(Exception, match="unknown task: nope"):
        score(df).collect()


def test_longest_fragment_against_a_literal_scan():
    def literal(residue, begin):
        best, length = None, 0
        enough = (len(residue.text) - begin) * extract.ENOUGH
        for i, at in enumerate(residue.marks):
            if at < begin or residue.text[at] != "{" or residue.closing[i + 1] < 0:
                continue
            end = residue.marks[residue.closing[i + 1]] + 1
            if end - at > length:
                best, length = at, end - at
            if length > enough:
                break
        return None if best is None else residue.text[best : best + length]

    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choices('{}"\\a {}', k=r.randint(0, 30)))
        residue, begin = extract._Residue(text), r.randint(0, len(text))
        assert residue._fragment(begin) == literal(residue, begin), (text, begin)


def test_many_envelopes_take_linear_time():
    began = time.process_time()
    assert extract._find('"input": {x ' * 8000) == ("unparseable", None)
    assert time.process_time() - began < 3
