"""Answers derived from ``orders``: the scorer's input when no corpus is given.

Each order yields one answer per run. The answer's fields follow from the
order's columns, some outside the contract on purpose, and the text around it
is damaged in ten ways. Everything is computed inside the row, so deriving the
answers needs no join and no group, however skewed the keys are. The narrow
orders alone are dealt evenly over the tasks.

The parameters are SQL texts that Spark and DuckDB both read. The expected
scores are computed elsewhere from the same parameters, never from the JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.operators.contracts import TASKS
from verdikt.plans.partitions import dealt
from verdikt.sources.tables import table

RUNS = ["base", "tuned"]
COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]

# Row parameters: k order, n list length, p price, u urgency, m cases per suite.
PARAMETERS = {
    "k": "o_orderkey",
    "n": "o_custkey % 6",
    "p": "CAST(floor(o_totalprice) AS BIGINT)",
    "u": "CAST(substr(o_orderpriority, 1, 1) AS INT)",
    "m": "CAST(floor(o_totalprice) AS BIGINT) % 6",
}
# Parameters that differ by run: the kind of damage and of padding. The tuned
# run damages a third of its answers and pads none.
DAMAGE = "CASE WHEN run = 'base' OR k % 30 < 10 THEN k % 10 ELSE 0 END"
PADDING = "CASE WHEN run = 'base' THEN p % 10 ELSE 9 END"

TASK = "CASE k % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TASKS)) + " END"
SLICE = "CASE WHEN k % 4 = 0 THEN 'real' ELSE 'gen' END"
CAP = "CASE WHEN k % 7 = 1 THEN 120 ELSE 200 END"


def choice(index: str, values: list[str]) -> str:
    """SQL for ``values[index]``; beyond the end, the last one."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {index} {whens} ELSE '{values[-1]}' END"


# Field texts shared with the expected-score SQL, which takes their lengths.
TEXTS = {
    "plan_title": "CASE WHEN p % 11 = 0 THEN '' WHEN p % 13 = 0 THEN repeat('Long title ', 12) ELSE 'Order ' || k || ' story' END",
    "plan_body": "'Describe order ' || k || '. ' || repeat('More detail. ', p % 12)",
    "plan_effort": choice("u - 1", ["S", "M", "L", "XL", "XXL"]),
    "criterion": "CASE WHEN (k + i) % 4 = 0 THEN 'short ' || i ELSE 'Given order ' || k || ' item ' || i || ' ships in time' END",
    "commit": "CASE p % 3 WHEN 0 THEN 'feat(order): add ' || k WHEN 1 THEN 'update ' || k ELSE 'fix: patch ' || k END",
    "pr_body": "CASE WHEN p % 2 = 0 THEN '## Why ' ELSE 'Why ' END || repeat('because ', p % 16)",
    "path": "CASE WHEN (k + i) % 5 = 0 THEN '/abs/file' || i WHEN (k + i) % 5 = 1 THEN 'src/shared.py' ELSE 'src/file' || i || '.py' END",
    "action": choice("(p + i) % 3", ["create", "modify", "delete"]),
    "change": "CASE WHEN (p + i) % 4 = 0 THEN '' ELSE 'Change ' || i END",
    "verdict": choice("u - 1", ["APPROVE", "APPROVE WITH NITS", "REQUEST CHANGES", "BLOCK", "LGTM"]),
    "review_summary": "'Review of order ' || k || ' ' || repeat('looks fine ', p % 8)",
    "severity": choice("(k + i) % 5", ["critical", "major", "minor", "nit", "blocker"]),
    "issue": "CASE WHEN (p + i) % 6 = 0 THEN '' ELSE 'Issue ' || i END",
    "category": choice(
        "(k + i) % 8",
        ["happy", "negative", "edge", "security", "accessibility", "performance", "regression", "smoke"],
    ),
    "case_id": "CASE WHEN p % 7 = 0 THEN 'T' ELSE 'TC-' END || lpad(CAST((i - 1) * m + j AS VARCHAR(9)), 3, '0')",
    "expected_step": "CASE WHEN (p + j) % 5 = 0 THEN '' ELSE 'See ' || j END",
    "priority": "'P' || ((p + i + j) % 5)",
    "expected": "'Total is ' || k",
    "actual": "CASE WHEN p % 3 = 0 THEN ' Total is ' || k || ' ' ELSE 'Total is ' || p END",
    "cause": "repeat('cache ', p % 12)",
    "strategy": choice("u - 1", ["direct", "canary", "blue-green", "feature-flag", "big-bang"]),
    "rollback": "'Restore build ' || repeat('again ', p % 8)",
    "act_title": "CASE WHEN (k + i) % 4 = 0 THEN '' ELSE 'Act ' || i END",
    "act_detail": "'Detail ' || repeat('step ', (p + i) % 8)",
}


def _members(count: str, body: str, var: str = "i", most: int = 5) -> str:
    """Spark SQL for a JSON list of ``count`` members, numbered from 1."""
    numbers = f"filter(sequence(1, {most}), {var} -> {var} <= {count})"
    return f"'[' || array_join(transform({numbers}, {var} -> {body}), ',') || ']'"


def _text(sql: str) -> str:
    return f"'\"' || ({sql}) || '\"'"


def _object(**members: str) -> str:
    parts = [f"""'"{name}":' || ({sql})""" for name, sql in members.items()]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _named(name: str) -> str:
    return _text(TEXTS[name])


# Every answer ends in a field outside the contract that carries the padding,
# quotes and braces that the extraction has to cope with.
CONTEXT = (
    "CASE f WHEN 0 THEN '\"TODO: write this\"' WHEN 1 THEN '\"n/a\"' "
    "WHEN 2 THEN '\"Lorem ipsum\",\"extra\":[\"TBD\",\"coming soon\"]' "
    "WHEN 3 THEN '\"see <script> and <label for> and fill in all fields\"' "
    "WHEN 4 THEN '\"use {{user_name}} at example.com/foo\"' "
    "ELSE '\"say ' || chr(92) || '\"hi' || chr(92) || '\" {ok}\"' END"
)

OBJECTS = {
    "plan": _object(
        title=_named("plan_title"),
        description_md=_named("plan_body"),
        acceptance_criteria=_members("n", _named("criterion")),
        effort=_named("plan_effort"),
        suggested_labels="""CASE WHEN p % 5 = 0 THEN '"ops"' ELSE '["ops"]' END""",
        context="context",
    ),
    "dev": _object(
        commit_message=_named("commit"),
        pr_title="""CASE WHEN p % 11 = 0 THEN 'null' ELSE '"PR ' || k || '"' END""",
        pr_body=_named("pr_body"),
        summary=_text("'Patch for order ' || k"),
        changes=_members("n", _object(path=_named("path"), action=_named("action"), description=_named("change"))),
        context="context",
    ),
    "review": _object(
        verdict=_named("verdict"),
        summary=_named("review_summary"),
        findings=_members(
            "n",
            _object(file=_text("'src/f' || i || '.py'"), severity=_named("severity"), issue=_named("issue"), line="'' || i"),
        ),
        context="context",
    ),
    "qe": _object(
        summary=_text("'Plan for order ' || k"),
        suites=_members(
            "n",
            _object(
                name=_text("'Suite ' || i"),
                category=_named("category"),
                cases=_members(
                    "m",
                    _object(
                        id=_text(TEXTS["case_id"].replace("VARCHAR(9)", "STRING")),
                        steps="'[' || " + _object(action=_text("'Do ' || j"), expected=_named("expected_step")) + " || ']'",
                        covers_ac="""CASE WHEN (k + j) % 3 = 0 THEN '[]' ELSE '["AC' || j || '"]' END""",
                        priority=_named("priority"),
                    ),
                    var="j",
                ),
            ),
        ),
        context="context",
    ),
    "bug": _object(
        title=_text("'Bug in order ' || k"),
        severity=_text("'S' || u"),
        steps_to_reproduce=_members("n", _text("'Step ' || i")),
        expected=_named("expected"),
        actual=_named("actual"),
        suspected_cause=_named("cause"),
        context="context",
    ),
    "devops": _object(
        strategy=_named("strategy"),
        steps=_members("n", _text("'Step ' || i")),
        rollback=_named("rollback"),
        checks=_members("n % 3", _text("'Check ' || i")),
        context="context",
    ),
    "custom": _object(
        summary=_text("'Actions for order ' || k"),
        actions=_members("n", _object(title=_named("act_title"), detail=_named("act_detail"))),
        context="context",
    ),
}

DAMAGED = (
    "CASE d WHEN 1 THEN '  ' || object || chr(10) "
    "WHEN 4 THEN '```json' || chr(10) || object || chr(10) || '```' "
    "WHEN 5 THEN 'Here is the answer: ' || object || ' Hope that helps.' "
    "WHEN 6 THEN substr(object, 1, length(object) - 1) "
    "WHEN 7 THEN '[' || object || ']' "
    "WHEN 8 THEN CASE WHEN k % 20 = 8 THEN '' ELSE '   ' END "
    """WHEN 9 THEN '{bad "input": ' || object || '}' """
    "ELSE object END"
)


def derive(orders: DataFrame) -> DataFrame:
    """``run, row_id, task, slice, status, raw, new_tokens, cap`` per order and run."""
    df = orders.select(
        *[F.expr(sql).alias(name) for name, sql in PARAMETERS.items()],
        F.col("o_orderstatus").alias("status"),
        F.explode(F.array(*[F.lit(r) for r in RUNS])).alias("run"),
    )
    df = df.withColumns({"task": F.expr(TASK), "d": F.expr(DAMAGE), "f": F.expr(PADDING)})
    df = df.withColumn("context", F.expr(CONTEXT))
    by_task = "CASE task " + " ".join(f"WHEN '{t}' THEN {sql}" for t, sql in OBJECTS.items()) + " END"
    df = df.withColumn("object", F.expr(by_task)).withColumn("raw", F.expr(DAMAGED))
    return df.select(
        "run",
        F.col("k").alias("row_id"),
        "task",
        F.expr(SLICE).alias("slice"),
        "status",
        "raw",
        F.expr("CAST(p % 211 AS INT)").alias("new_tokens"),
        F.expr(f"CAST({CAP} AS INT)").alias("cap"),
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(*COLUMNS)
    return derive(dealt(orders, "o_orderkey"))
