"""The scanner against Python's own reader, and what it makes of odd answers."""

import json
import random
import time

import pytest

from verdikt.operators import extract, scan
from verdikt.operators.extract import SHOWN_FIELDS, SHOWN_MEMBERS
from verdikt.operators.scan import Json
from verdikt.operators.score import score

PIECES = ["{", "}", "[", "]", ",", ":", '"a"', '"b"', "1", "-0", "1.5e3", "true", "null", "NaN", " ", '"\\u00e9"', '"\\x"', "01", "-", '"\n"', "Infinity", "-Infinity"]


def test_takes_what_python_takes():
    rng, taken = random.Random(1), 0
    for _ in range(60_000):
        text = "".join(rng.choices(PIECES, k=rng.randint(1, 9))).strip()
        try:
            json.loads(text)
            want = True
        except ValueError:
            want = False
        assert bool(text) and (Json(text).end(0) == len(text)) == want if text else True, text
        taken += want
    assert taken > 1000


def some_value(rng, depth=0):
    r = rng.random()
    if depth > 4 or r < 0.4:
        return rng.choice([1, -2, 1.0, 1e22, 0.1, True, None, "x", "é'\"", float("nan"), float("-inf"), 10**41, "", [], {}])
    if r < 0.7:
        return [some_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice("abcde"): some_value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def test_shows_what_python_shows():
    rng = random.Random(2)
    for _ in range(2000):
        text = json.dumps({"a": some_value(rng), "verdict": some_value(rng)})
        if rng.random() < 0.5:
            text = '{"a":7,' + text[1:]  # a repeated key: the last value at the first place
        value, scanner = json.loads(text), Json(text)
        assert scanner.end(0) == len(text) and scanner.shown(0, len(text)) == repr(value)
        doc, fields, _ = scanner.handed_over(0, len(text), SHOWN_FIELDS, SHOWN_MEMBERS)
        assert repr(json.loads(doc)) == repr(value)
        assert fields is None or list(json.loads(fields)) == list(value)


@pytest.mark.parametrize(
    "unit",
    ['"input": {x ', '"input": {x ```y``` ', '"input": {"input": ', '{"a": "{', '```{"a": 1 ', '"arguments": {"a": [1, 2]} x '],
)
def test_residue_is_linear(unit):
    def seconds(n):
        text, best = unit * n, 9.0
        for _ in range(3):
            began = time.process_time()
            extract._look(text)
            best = min(best, time.process_time() - began)
        return best

    seconds(100)
    small, middle, large = (seconds(n) for n in (2000, 4000, 8000))
    assert large < 1 and large < 8 * max(small, 0.005) and middle < 4 * max(small, 0.005)


def review(**fields):
    return {"verdict": "BLOCK", "summary": "s" * 60, "findings": []} | fields


def answers(spark, raws, task="review"):
    rows = [(i, task, raw) for i, raw in enumerate(raws)]
    found = score(spark.createDataFrame(rows, "i int, task string, raw string")).orderBy("i").collect()
    return [(r.extract, round(r.score, 6), list(r.notes)) for r in found]


def test_depth_and_size_decide_nothing(spark):
    good = json.dumps(review())[:-1]
    deep = [good + ', "x": ' + "[" * n + "]" * n + "}" for n in (10, 1500, 20_000)]
    long = [json.dumps(review(summary="s" * n)) for n in (60, 21_000_000)]
    many = [json.dumps(review(findings=[{"file": "f", "severity": "minor", "issue": "i" * k}] * n)) for k, n in ((5, 1), (500, 40_000))]
    found = answers(spark, [*deep, *long, *many, "text before " + deep[1]])
    assert {f[:2] for f in found[:7]} == {("clean", 1.0)} and not any(f[2] for f in found)
    assert found[7][:2] == ("embedded", 1.0)


def test_deep_and_long_values_keep_their_checks(spark):
    deep = "[" * 2000 + "]" * 2000
    raws = [f'{{"verdict": {deep}, "summary": {deep}, "findings": {{"a": {deep}}}}}', '{"verdict": "BLOCK", "summary": [], "findings": [%s]}' % deep]
    (mode, _, notes), (mode2, _, notes2) = answers(spark, raws)
    assert mode == mode2 == "clean"
    assert notes[:4] == ["wrongtype:verdict=list", "wrongtype:summary=list", "wrongtype:findings=dict", "item:findings[0] not-object"]
    assert notes2[:3] == ["missing/empty:summary", "wrongtype:summary=list", "array:findings n=1 min=0"]


# What Python shows for a value, as the notes have it.
SHOWN = {
    "1.0": "1.0",
    "1e22": "1e+22",
    "Infinity": "inf",
    "NaN": "nan",
    "12345678901234567890123456789012345678901": "12345678901234567890123456789012345678901",
    '{"z": 1, "a": 2}': "{'z': 1, 'a': 2}",
    "[1.0, -0.0, 1e-7, true, null]": "[1.0, -0.0, 1e-07, True, None]",
    '"It\'s"': '"It\'s"',
    "null": "None",
    "7": "7",
}


@pytest.mark.parametrize("where", ["top", "member", "fence"])
def test_values_in_notes(spark, where):
    raws = []
    for value in SHOWN:
        if where == "member":
            raws.append(json.dumps(review(findings=[{"file": "f", "severity": "@", "issue": "i"}])).replace('"@"', value))
        else:
            raws.append(json.dumps(review(verdict="@")).replace('"@"', value))
    if where == "fence":
        raws = [f"Here:\n```json\n{raw}\n```" for raw in raws]
    path = "findings[0].severity" if where == "member" else "verdict"
    for (mode, _, notes), shown in zip(answers(spark, raws), SHOWN.values(), strict=True):
        assert mode == ("fenced" if where == "fence" else "clean")
        assert f"enum:{path}={shown}" in notes


def test_long_whole_numbers_are_whole(spark):
    raws = [f'{{"verdict": "BLOCK", "summary": {"9" * n}, "findings": []}}' for n in (5, 19, 41, 2000)]
    assert ["wrongtype:summary=int" in notes for _, _, notes in answers(spark, raws)] == [True] * 4
    assert answers(spark, ['{"verdict": "BLOCK", "summary": %s, "findings": []}' % ("9" * 5000)])[0][0] == "unparseable"


def test_severities_as_shown(spark):
    raw = json.dumps(review(verdict="APPROVE", findings=[{"file": "f", "severity": "critical", "issue": "i"}, {"file": "f", "severity": 2.0, "issue": "i"}]))
    assert "verdict-inconsistent:APPROVE-with-['2.0', 'critical']" in answers(spark, [raw])[0][2]


def test_short_texts_are_not_walked(monkeypatch):
    """An object inside prose, and one whose shown values are texts, is read by
    Python's parser alone; odd values, repeated keys and long numbers are walked."""
    walked = []
    monkeypatch.setattr(scan.Json, "_walk", lambda self, begin, walk=scan.Json._walk: walked.append(begin) or walk(self, begin))
    assert extract._look('Sure: {"title":"a","changes":[{"path":"p","action":"create"}]} ok') == (
        "embedded",
        '{"title":"a","changes":[{"path":"p","action":"create"}]}',
        None,
        {},
    )
    assert walked == []
    assert extract._look('Sure: {"title":[1.50]} ok')[3] == {"title": "[1.5]"}
    assert extract._look('Sure: {"a":1,"b":2,"a":3} ok')[1] == '{"a":3,"b":2}'
    assert extract._look('Sure: {"x":12345678901234567890} ok')[2] is not None
    assert extract._look('Sure: {"x":NaN} ok')[2] is not None
    assert walked
