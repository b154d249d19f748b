import json
import re

import pytest
from pyspark.sql import functions as F

from verdikt.functions import filler
from verdikt.functions.variants import truthy
from verdikt.operators.score import WEIGHTS, examine, score

EMPTY = {
    "plan": (0.25, 0.4375), "dev": (0, 0.35), "qe": (0, 0.35), "bug": (0, 0.35), "custom": (0, 0.35),
    "review": (2 / 3, 0.583333), "devops": (1 / 3, 0.466667),
}

WELL_FORMED = {
    "plan": {
        "title": "Export", "description_md": "d" * 100, "effort": "M",
        "acceptance_criteria": [f"Given a report number {i} it exports" for i in range(3)],
    },
    "dev": {
        "commit_message": "feat(api): add export", "pr_title": "Export", "pr_body": "## Why\n" + "b" * 80,
        "summary": "Adds it", "changes": [{"path": "src/a.py", "action": "create", "description": "new"}],
    },
    "review": {"verdict": "APPROVE", "summary": "s" * 60, "findings": []},
    "qe": {
        "summary": "All paths",
        "suites": [
            {
                "name": c, "category": c,
                "cases": [
                    {
                        "id": f"TC-{s * 3 + i + 1:03d}", "priority": "P1", "covers_ac": ["AC1"],
                        "steps": [{"action": "click", "expected": "opens"}],
                    }
                    for i in range(3)
                ],
            }
            for s, c in enumerate(["happy", "negative", "edge", "security"])
        ],
    },
    "bug": {
        "title": "Crash", "severity": "S1", "steps_to_reproduce": ["open", "close"], "expected": "opens",
        "actual": "crashes", "suspected_cause": "c" * 40,
    },
    "devops": {"strategy": "canary", "steps": ["a", "b", "c"], "rollback": "r" * 40, "checks": ["x", "y"]},
    "custom": {"summary": "s", "actions": [{"title": "t", "detail": "d" * 30}]},
}


def scored(spark, rows):
    df = spark.createDataFrame([(i, t, r) for i, (t, r) in enumerate(rows)], "i int, task string, raw string")
    return [r for r in sorted(score(df).collect(), key=lambda r: r.i)]


def test_answers_by_hand(spark):
    rows = [(t, "{}") for t in EMPTY]
    rows += [(t, json.dumps(o)) for t, o in WELL_FORMED.items()]
    rows += [("review", '{"verdict":"APPROVE","summary":"...","findings":[]}')]
    rows += [("plan", "prose only"), ("plan", None)]
    got = scored(spark, rows)
    for row, (rigor, total) in zip(got, EMPTY.values()):
        assert (row.schema, row.enums, row.clean) == (0.0, 1.0, 1.0)
        assert row.rigor == pytest.approx(rigor) and row.score == pytest.approx(total, abs=1e-6)
    for row in got[len(EMPTY) : len(EMPTY) + len(WELL_FORMED)]:
        assert row.score == pytest.approx(1.0) and row.notes == [], row
    usage, prose, missing = got[-3:]
    assert usage.score == pytest.approx(0.845833, abs=1e-6) and usage.notes == ["empty-field:..."]
    assert (prose.emitted, prose.score, prose.notes, prose.chars) == (0, 0.0, ["extract:unparseable"], 10)
    assert (missing.notes, missing.chars) == (["extract:empty"], 0)
    for row in got:
        assert all(0 <= row[m] <= 1 for m in [*WEIGHTS, "score"])


def test_notes_and_odd_values(spark):
    got = scored(
        spark,
        [
            ("dev", '{"changes":5}'),
            ("dev", '{"changes":[{"path":[1]}]}'),
            ("plan", '{"acceptance_criteria":7}'),
            ("qe", '{"suites":[{"category":["x"],"cases":[{}]}]}'),
            ("dev", '{"changes":"ab","summary":true}'),
            ("plan", '{"title":null,"effort":"it\'s","acceptance_criteria":["a",5],"suggested_labels":"x"}'),
            ("review", '{"verdict":{"b":[1,"x",null,true]},"summary":1.5,"findings":[{"severity":"Major"},3]}'),
            ("plan", json.dumps({"title": None, "description_md": False, "effort": "A\tB"})),
        ],
    )
    assert "wrongtype:changes=int" in got[0].notes and "no-changes" in got[0].notes
    assert "item:changes[0].action" in got[1].notes and "bad-paths" in got[1].notes
    assert "wrongtype:acceptance_criteria=int" in got[2].notes
    assert "enum:suites[0].category=['x']" in got[3].notes
    assert got[4].notes[-3:] == ["item:changes[0] not-object", "item:changes[1] not-object", "no-changes"]
    assert got[5].notes == [
        "missing/empty:title", "missing/empty:description_md", "wrongtype:suggested_labels=str",
        "array:acceptance_criteria n=2 min=3", 'enum:effort="it\'s"', "thin-ac:2",
    ]
    assert "wrongtype:verdict=dict" in got[6].notes and "wrongtype:summary=float" in got[6].notes
    assert "enum:verdict={'b': [1, 'x', None, True]}" in got[6].notes
    # A null title reads "None", which is a title of four characters.
    assert got[7].rigor == pytest.approx((0 + 1 + 1 + 0) / 4)
    assert "enum:effort='A\\tB'" in got[7].notes


def test_filters_on_scores_plan_quickly(spark):
    df = spark.createDataFrame([("plan", "{}")], "task string, raw string")
    assert score(df).where("score < 0.5 AND extract = 'clean'").count() == 1


PADDING = [
    ("TODO", "empty-field:todo"), (" N/A ", "empty-field:n/a"), ("see TODO.", "filler:todo"),
    ("<insert name>", "filler:<insert name>"), ("{{user_name}}", "filler:{{user_name}}"),
    ("[add details]", "filler:[add details]"), ("at example.com/foo", "filler:example.com/foo"),
    ("tbd, then todo", "filler:todo"), ("coming \u017foon", "filler:coming \u017foon"),
    ("<script>", None), ("<label for>", None), ("fill in all fields", None), ("input placeholder text", None),
    ("mastodon", None), ("\u00e9todo", None), ("todo_list", None), ("a-", None),
]


def test_placeholders(spark):
    rows = [(i, t) for i, (t, _) in enumerate(PADDING)]
    df = spark.createDataFrame(rows, "i int, text string").withColumn("low", filler.normalized(_col("text")))
    got = {r.i: r.label for r in df.where(filler.is_hit("low")).withColumn("label", filler.hit_label("low")).collect()}
    assert got == {i: label for i, (_, label) in enumerate(PADDING) if label}
    # The same texts inside an answer, whose pre-check must let every hit pass.
    answers = scored(spark, [("custom", json.dumps({"x": t}, ensure_ascii=i % 2 == 0)) for i, t in rows])
    for row, (text, label) in zip(answers, PADDING):
        assert [n for n in row.notes if n.startswith(("filler", "empty-field"))] == ([label] if label else []), text


def test_escaped_padding_is_found(spark):
    raws = ['{"a":"\\u0054ODO it"}', '{"a":"\\nn/a\\t"}', '{"a":"example.com\\/foo"}', '{"todo":"x"}']
    got = scored(spark, [("custom", r) for r in raws])
    assert [r.clean for r in got] == [0.75, 0.75, 0.75, 1.0]


def test_partitioning_does_not_change_results(spark):
    rows = [(i, t, json.dumps(o) + ("x" if i % 3 else "")) for i, (t, o) in enumerate(list(WELL_FORMED.items()) * 3)]
    df = spark.createDataFrame(rows, "i int, task string, raw string")
    one, many = (sorted(score(df.repartition(n)).collect()) for n in (1, 7))
    assert one == many


def _col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_filters_reach_the_scan_through_the_scorer(spark, tmp_path):
    rows = [("a", 1, "plan", "{}"), ("b", 2, "bug", 'see {"title": 1}'), ("b", 3, "plan", "")]
    spark.createDataFrame(rows, "run string, row_id bigint, task string, raw string").write.partitionBy("run").parquet(str(tmp_path / "in"))
    scored_frame = score(spark.read.parquet(str(tmp_path / "in")))
    by_run = scored_frame.where("run = 'b'").groupBy("run").avg("score")
    plan = by_run._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan and plan.count("ArrowEvalPython") == 1
    plan = scored_frame.where("row_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(row_id,2)" in plan
    plan = scored_frame.where("score < 0.5 AND extract = 'embedded'")._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 200_000 and plan.count("ArrowEvalPython") == 1
    assert [r.row_id for r in scored_frame.where("extract = 'embedded'").collect()] == [2]


def test_all_notes_are_kept_unless_fewer_are_asked_for(spark):
    body = {"summary": "todo", "actions": [{"title": "", "detail": ""}] * 12, "x": ["tbd", "n/a", "lorem ipsum", "coming soon", "fixme"]}
    df = spark.createDataFrame([("custom", json.dumps(body))], "task string, raw string")
    notes = score(df).first().notes
    assert len(notes) > 25 and sum(n.startswith(("empty-field:", "filler:")) for n in notes) >= 5
    assert score(df, max_notes=3).first().notes == notes[:3]


def test_rollups_render_no_notes(spark):
    """Notes are columns of their own: what doesn't ask for them has none."""
    from verdikt.plans import registry

    def plan(name):
        return registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()

    texts = ["missing/empty", "wrongtype", "item:", "enum:", "filler:", "array:", "thin-ac", "bad-paths"]
    assert not [t for t in texts if t in plan("scores_by_task")]
    assert all(t in plan("score_answers") for t in texts)


def test_truth_of_values_needs_no_path_that_leads_nowhere(spark):
    values = {
        '""': False, '"a"': True, '"0"': True, '"long text"': True, "0": False, "-0.0": False, "0e7": False, "0.5": True,
        "[]": False, "[0]": True, "[null]": True, "[[],[]]": True, "{}": False, '{"a":0}': True, "null": False,
        "true": True, "false": False,
    }
    df = spark.createDataFrame([(v,) for v in [*values, None]], "json string").withColumn("v", F.parse_json("json"))
    rows = df.select("json", truthy(F.col("v")).alias("a"), truthy(F.col("v"), often_list=True).alias("b")).collect()
    assert {r.json: r.a for r in rows} == values | {None: False}
    assert all(r.a == r.b for r in rows)
    assert "$[0]" not in str(truthy(F.col("v")))


def test_texts_without_padding_are_searched_few_times(spark):
    # Without the searches that only follow on a begin or a letter beyond ASCII.
    always = re.sub(r"AND \((?:[^()]|\([^()]*\))*\)", "", filler._may_match_any("low"))
    assert always.count("contains(low") < len(sum(filler.NEEDLES, [])) * 2 // 3
    texts = [f"so {n} it" for n in sum(filler.NEEDLES, []) + filler.FOLDING]
    df = spark.createDataFrame([(t,) for t in [*texts, "plain < text", "verify this", "\u00e9\u00e8"]], "low string")
    found = {r.low for r in df.where(F.expr(filler._may_match_any("low"))).collect()}
    assert found == set(texts)


PLANS = [
    '{"suites":[{"category":"happy","cases":[{"id":"TC-001","steps":[{"action":"a","expected":"b"},null],"covers_ac":["x"],"priority":"P1"},null]},null]}',
    '{"suites":[{"cases":[{"id":1,"steps":"ab","covers_ac":"x","priority":["P1"]},3]},"x"]}',
    '{"suites":[{"cases":[{"id":"TC-001","steps":{"a":1},"covers_ac":{},"priority":"P9"},{"id":"TC-002","steps":5}]}]}',
    '{"suites":[{"cases":"none"},{"cases":[{"id":"TC-001","steps":[],"covers_ac":0,"priority":null}]}]}',
    '{"suites":[{"cases":null},{}]}',
    '{"suites":"text"}',
    '{"suites":[{"cases":[{"id":"TC-001","steps":[{"action":0,"expected":[0]},{"action":true,"expected":{"a":1}}]}]}]}',
]


def test_plans_read_in_one_pass_score_as_taken_apart(spark):
    from verdikt.operators import rigor
    from verdikt.operators.extract import extract_json

    df = spark.createDataFrame([(i, p) for i, p in enumerate(PLANS)], "i int, raw string")
    found = extract_json(df).withColumn("_items", F.expr("try_variant_get(answer, '$[0].suites', 'array<map<string,variant>>')"))
    found = found.withColumn("objects", F.filter("_items", lambda m: m.isNotNull()))

    def counted(doc):
        cases = found.withColumn("cases", rigor.qe_cases(F.col("objects"), doc)).withColumn("t", rigor.step_counts(F.col("cases")))
        return {r.i: r[1:] for r in cases.select("i", F.to_json("cases"), "t").collect()}

    # What cannot be read as a plan is taken apart from its VARIANT.
    assert counted(F.col("doc")) == counted(F.lit('{"suites":1}'))
    got = [r.notes for r in scored(spark, [("qe", p) for p in PLANS])]
    assert "unpaired-steps:1" in got[0] and "unpaired-steps:2" in got[1] and "unpaired-steps:1" in got[2]
    assert "no-cases" in got[4] and "no-cases" in got[5] and "ids-not-contiguous" not in got[3]
    assert "unpaired-steps:1" in got[6]


def test_no_fused_step_of_the_scorer_is_too_long_to_be_compiled(spark):
    from verdikt.operators import rollup

    limit = "spark.sql.codegen.hugeMethodLimit"
    before = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", limit)}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set(limit, "65535")
        rows = spark.range(1).selectExpr("'r' AS run", "'s' AS slice", "'plan' AS task", "cast(id AS string) AS raw")
        plan = rollup.task_sums(score(rows))._jdf.queryExecution()
        text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(plan, "codegen")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert len(sizes) >= 4 and max(sizes) < 8000, sizes


def test_odd_values_are_found_from_their_colon(spark):
    from verdikt.operators.extract import is_odd

    texts = {
        '{"title":1}': True, '{"title" \n: [1]}': True, '{"title"        :-1}': True, '{"severity":{"a":"b"}}': True,
        '{"x":1234567890123456789}': True, '{"\\u0074itle":1}': True, '{"title":"1"}': False, '{"title":null}': False,
        '{"x":1,"y":[2],"z" : {"a":"b"}}': False, '{"x":"\\u00e9"}': False, '{"x":123456789012345678}': False,
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.odd for r in df.withColumn("odd", is_odd(F.col("text"))).collect()} == texts


def test_values_of_members_are_looked_up_once(spark):
    """One look-up per checked key of a member, and value sets without arrays in lambdas."""
    raw = '{"summary": "s", "findings": [{"file": "a", "severity": "major", "issue": "i"}, 5, {"severity": "major,minor"}, {"severity": ""}]}'
    df = spark.createDataFrame([("r", 1, "review", "gen", raw)], "run string, row_id long, task string, slice string, raw string")
    examined = examine(df)
    row = examined.select("schema_checks", "schema_passes", "enum_checks", "enum_passes", "enum_notes").first()
    assert (row.enum_checks, row.enum_passes) == (3, 1)
    assert row.enum_notes == ["enum:findings[2].severity='major,minor'", "enum:findings[3].severity=''"]
    fields = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = examined.select("schema_passes", "enum_passes", "extract")._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", fields)
    assert plan.count("array_contains(") == 1
    assert plan.count("element_at(") <= 12
    assert plan.count("variant_get(_whole") == 1


def test_strip_takes_no_letter_of_a_visible_end(spark):
    from verdikt.functions.text import strip

    texts = ["", " ", "a", " a", "a ", "é", "é ", "　é ", "\x1fa\x1c", "\x7f", "\x00", None, "a b", "\U0001f600"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(strip(F.col("t")).alias("s")).collect()] == [t if t is None else t.strip() for t in texts]
