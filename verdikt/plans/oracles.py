"""DuckDB SQL for the registered queries.

Expected scores are computed from the order columns each answer was derived
from, by rule and never through JSON, so they do not depend on the extraction.
"""

from __future__ import annotations

from verdikt.operators.contracts import CONTRACTS, TASKS, TOOLS
from verdikt.operators.corpus import CAP_FACTOR, LEAST_BUDGET, MARKER, PER_TASK, WINDOWS
from verdikt.operators.quantize import BITS, BLOCK, INT4, NF4
from verdikt.plans.completions import CAP, DAMAGE, PADDING, PARAMETERS, RUNS, SLICE, TASK, TEXTS, choice
from verdikt.plans.corpora import SPLIT
from verdikt.plans.registry import CHAT_LEAST, CHAT_WINDOW, MARKERS


def _each(body: str, count: str = "n", var: str = "i") -> str:
    return f"list_transform(range(1, {count} + 1), lambda {var}: {body})"


def _hits(condition: str, count: str = "n", var: str = "i") -> str:
    """How many of the numbers 1..count meet a condition."""
    return f"len(list_filter(range(1, {count} + 1), lambda {var}: {condition}))"


def _sum(body: str, count: str = "n", var: str = "i") -> str:
    return f"coalesce(list_sum({_each(body, count, var)}), 0)"


def _list(*items: str) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)" if items else "[]::VARCHAR[]"


def _if(condition: str, note: str) -> str:
    return f"CASE WHEN {condition} THEN {note} END"


def _item_notes(body: str) -> str:
    """Notes of all list members; ``body`` lists those of member ``i``."""
    return f"flatten({_each(body)})"


def _at(name: str) -> str:
    return f"'{name}[' || (i - 1) || ']."


ANSWERS = f"""
answers AS (
  SELECT *, {TASK} AS task, {SLICE} AS slice, {DAMAGE} AS d, {PADDING} AS f, {CAP} AS cap, p % 211 AS new_tokens
  FROM (SELECT {", ".join(f"{sql} AS {name}" for name, sql in PARAMETERS.items())}, o_orderstatus AS status FROM orders)
  CROSS JOIN (SELECT unnest({RUNS}) AS run)
)"""

MODE = """CASE WHEN d < 4 THEN 'clean' WHEN d = 4 THEN 'fenced' WHEN d = 5 THEN 'embedded'
  WHEN d = 6 THEN CASE WHEN n > 0 AND task IN ('dev', 'review', 'qe', 'custom') THEN 'embedded' ELSE 'unparseable' END
  WHEN d = 7 THEN 'not-object' WHEN d = 8 THEN 'empty' ELSE 'tool-envelope' END"""

ITEM_LIST = {t: c.item_list for t, c in CONTRACTS.items()}


def _missing(field: str) -> str:
    return f"'missing/empty:{field}'"


ENUM_OK = "(u <= 4)"

# Per task: schema checks, schema notes, enum checks, enum notes, rigor, rigor notes.
EXPECTED = {
    "plan": (
        "10",
        _list(
            _if("p % 11 = 0", _missing("title")),
            _if("n = 0", _missing("acceptance_criteria")),
            _if("p % 5 = 0", "'wrongtype:suggested_labels=str'"),
            _if("n < 3", "'array:acceptance_criteria n=' || n || ' min=3'"),
        ),
        "1",
        _list(_if("u = 5", "'enum:effort=''XXL'''")),
        f"""(least(1, n / 3) + CASE WHEN n = 0 THEN 1 ELSE {_hits("(k + i) % 4 <> 0")} / n END
          + CASE WHEN length({TEXTS["plan_title"]}) BETWEEN 1 AND 120 THEN 1 ELSE 0 END
          + CASE WHEN length({TEXTS["plan_body"]}) >= 100 THEN 1 ELSE 0 END) / 4""",
        _list(_if("n < 3", "'thin-ac:' || n")),
    ),
    "dev": (
        "(5 + CASE WHEN p % 11 = 0 THEN 4 ELSE 5 END + 1 + 3 * n)",
        "list_concat("
        + _list(
            _if("p % 11 = 0", _missing("pr_title")),
            _if("n = 0", _missing("changes")),
            _if("n = 0", "'array:changes n=0 min=1'"),
        )
        + ", "
        + _item_notes(_list(_if("(p + i) % 4 = 0", "'item:' || " + _at("changes") + "description'")))
        + ")",
        "n",
        _item_notes(_list(_if("(p + i) % 3 = 2", "'enum:' || " + _at("changes") + "action=''delete'''"))),
        f"""CASE WHEN n = 0 THEN 0 ELSE ({_hits("(k + i) % 5 <> 0")} / n
          + CASE WHEN len(list_distinct({_each(TEXTS["path"])})) = n THEN 1 ELSE 0.5 END
          + CASE WHEN p % 2 = 0 AND length({TEXTS["pr_body"]}) > 80 THEN 1 ELSE 0 END
          + CASE WHEN p % 3 <> 1 THEN 1 ELSE 0 END) / 4 END""",
        "CASE WHEN n = 0 THEN ['no-changes'] ELSE "
        + _list(
            _if(_hits("(k + i) % 5 <> 0") + " < n", "'bad-paths'"),
            _if("p % 3 = 1", "'non-conventional-commit'"),
        )
        + " END",
    ),
    "review": (
        "(7 + 3 * n)",
        _item_notes(_list(_if("(p + i) % 6 = 0", "'item:' || " + _at("findings") + "issue'"))),
        "(1 + n)",
        "list_concat("
        + _list(_if("u = 5", "'enum:verdict=''LGTM'''"))
        + ", "
        + _item_notes(_list(_if("(k + i) % 5 = 4", "'enum:' || " + _at("findings") + "severity=''blocker'''")))
        + ")",
        f"""(CASE WHEN n = 0 THEN 1 ELSE {_hits("(p + i) % 6 <> 0")} / n END
          + CASE WHEN {_hits("(k + i) % 5 < 2")} > 0 AND u NOT IN (3, 4) THEN 0 ELSE 1 END
          + CASE WHEN length({TEXTS["review_summary"]}) >= 60 THEN 1 ELSE 0 END) / 3""",
        _list(
            _if(
                f"{_hits('(k + i) % 5 < 2')} > 0 AND u NOT IN (3, 4)",
                f"'verdict-inconsistent:' || {TEXTS['verdict']} || '-with-[' || array_to_string(list_transform("
                f"list_sort(list_distinct({_each(TEXTS['severity'])})), lambda s: '''' || s || ''''), ', ') || ']'",
            )
        ),
    ),
    "qe": (
        "(5 + 3 * n)",
        "list_concat("
        + _list(_if("n = 0", _missing("suites")), _if("n = 0", "'array:suites n=0 min=1'"))
        + ", "
        + _item_notes(_list(_if("m = 0", "'item:' || " + _at("suites") + "cases'")))
        + ")",
        "n",
        _item_notes(_list(_if("(k + i) % 8 = 7", "'enum:' || " + _at("suites") + "category=''smoke'''"))),
        f"""CASE WHEN n * m = 0 THEN 0 ELSE (CASE WHEN p % 7 = 0 THEN 0 ELSE 1 END
          + {_hits("(p + j) % 5 <> 0", "m", "j")} / m + {_hits("(k + j) % 3 <> 0", "m", "j")} / m
          + {_sum(_hits("(p + i + j) % 5 <> 4", "m", "j"))} / (n * m)
          + least(1, len(list_distinct(list_filter({_each("(k + i) % 8")}, lambda c: c < 5))) / 4)
          + CASE WHEN n * m BETWEEN 12 AND 22 THEN 1 ELSE greatest(0, 1 - abs(n * m - 16) / 16) END) / 6 END""",
        "CASE WHEN n * m = 0 THEN ['no-cases'] ELSE "
        + _list(
            _if("p % 7 = 0", "'ids-not-contiguous'"),
            _if(
                f"{_hits('(p + j) % 5 = 0', 'm', 'j')} > 0",
                f"'unpaired-steps:' || (n * {_hits('(p + j) % 5 = 0', 'm', 'j')})",
            ),
            _if(f"n * {_hits('(k + j) % 3 <> 0', 'm', 'j')} < n * m * 0.8", "'weak-traceability'"),
        )
        + " END",
    ),
    "bug": (
        "13",
        _list(
            _if("n = 0", _missing("steps_to_reproduce")),
            _if("p % 12 = 0", _missing("suspected_cause")),
            _if("n < 2", "'array:steps_to_reproduce n=' || n || ' min=2'"),
        ),
        "1",
        _list(_if("u = 5", "'enum:severity=''S5'''")),
        f"""(CASE WHEN n >= 2 THEN 1 ELSE 0 END
          + CASE WHEN trim({TEXTS["actual"]}) <> {TEXTS["expected"]} THEN 1 ELSE 0 END
          + CASE WHEN length({TEXTS["cause"]}) >= 40 THEN 1 ELSE 0 END) / 3""",
        _list(_if(f"trim({TEXTS['actual']}) = {TEXTS['expected']}", "'expected==actual'")),
    ),
    "devops": (
        "10",
        _list(
            _if("n = 0", _missing("steps")),
            _if("n % 3 = 0", _missing("checks")),
            _if("n < 2", "'array:steps n=' || n || ' min=2'"),
            _if("n % 3 = 0", "'array:checks n=0 min=1'"),
        ),
        "1",
        _list(_if("u = 5", "'enum:strategy=''big-bang'''")),
        f"""(CASE WHEN n >= 3 THEN 1 ELSE 0.5 END + CASE WHEN length({TEXTS["rollback"]}) >= 40 THEN 1 ELSE 0 END
          + CASE WHEN n % 3 >= 2 THEN 1 ELSE 0.5 END) / 3""",
        _list(_if(f"length({TEXTS['rollback']}) < 40", "'thin-rollback'")),
    ),
    "custom": (
        "(5 + 2 * n)",
        "list_concat("
        + _list(_if("n = 0", _missing("actions")), _if("n = 0", "'array:actions n=0 min=1'"))
        + ", "
        + _item_notes(_list(_if("(k + i) % 4 = 0", "'item:' || " + _at("actions") + "title'")))
        + ")",
        "0",
        _list(),
        f"""CASE WHEN n = 0 THEN 0
          ELSE {_hits(f"(k + i) % 4 <> 0 AND length({TEXTS['act_detail']}) >= 30")} / n END""",
        "CASE WHEN n = 0 THEN ['no-actions'] ELSE "
        + _list(_if(f"{_hits('(k + i) % 4 <> 0 AND length(' + TEXTS['act_detail'] + ') >= 30')} < n", "'thin-actions'"))
        + " END",
    ),
}

# A cut answer leaves one list member, which meets no rule of its contract.
CUT_NOTES = {
    t: "[" + ", ".join(_missing(r.name) for r in c.fields if r.required) + "]" for t, c in CONTRACTS.items()
}
CUT_CHECKS = {t: str(sum(r.required for r in c.fields)) for t, c in CONTRACTS.items()}
CUT_RIGOR = {"review": ("2.0 / 3", "[]::VARCHAR[]")}
NO_ITEMS = {"dev": "no-changes", "qe": "no-cases", "custom": "no-actions"}
HITS = """CASE WHEN cut THEN [] WHEN f = 0 THEN ['filler:todo'] WHEN f = 1 THEN ['empty-field:n/a']
  WHEN f = 2 THEN ['filler:lorem ipsum', 'empty-field:tbd', 'filler:coming soon']
  WHEN f = 4 THEN ['filler:{{user_name}}'] ELSE [] END"""


def _case(position: int, cut: dict[str, str]) -> str:
    whens = "".join(f" WHEN task = '{t}' AND cut THEN {sql}" for t, sql in cut.items())
    whens += "".join(f" WHEN task = '{t}' THEN {parts[position]}" for t, parts in EXPECTED.items())
    return f"CASE{whens} END"


def _cut_rigor(part: int) -> dict[str, str]:
    whole = {t: ("0.0", f"['{NO_ITEMS[t]}']") for t in NO_ITEMS} | CUT_RIGOR
    return {t: values[part] for t, values in whole.items()}


EXPECTED_SQL = f"""
{ANSWERS},
moded AS (SELECT *, {MODE} AS extract, d = 6 AS cut FROM answers),
checked AS (
  SELECT *, extract IN ('clean', 'fenced', 'embedded', 'tool-envelope') AS found,
    {_case(0, CUT_CHECKS)} AS schema_checks,
    {_case(1, CUT_NOTES)} AS schema_notes,
    {_case(2, {t: "0" for t in TASKS})} AS enum_checks,
    {_case(3, {t: "[]::VARCHAR[]" for t in TASKS})} AS enum_notes,
    {_case(4, _cut_rigor(0))} AS rigor_value,
    {_case(5, _cut_rigor(1))} AS rigor_notes,
    ({HITS})::VARCHAR[] AS hits
  FROM moded
),
parts AS (
  SELECT *,
    1 - len(schema_notes) / schema_checks AS schema_value,
    CASE WHEN enum_checks = 0 THEN 1 ELSE 1 - len(enum_notes) / enum_checks END AS enum_value,
    greatest(0, 1 - 0.25 * len(hits)) AS clean_value
  FROM checked
),
scored AS (
  SELECT run, k AS row_id, task, slice, status, extract, found::INT AS emitted,
    CASE WHEN found THEN schema_value ELSE 0 END AS schema,
    CASE WHEN found THEN enum_value ELSE 0 END AS enums,
    CASE WHEN found THEN rigor_value ELSE 0 END AS rigor,
    CASE WHEN found THEN clean_value ELSE 0 END AS clean,
    CASE WHEN found THEN 0.30 * schema_value + 0.20 * enum_value + 0.35 * rigor_value + 0.15 * clean_value ELSE 0 END AS score,
    CASE WHEN found
      THEN list_concat(schema_notes, enum_notes, rigor_notes, hits)
      ELSE ['extract:' || extract] END AS notes
  FROM parts
)"""

METRICS = ["schema", "enums", "rigor", "clean", "score"]
RATES = ["emit_rate", *METRICS]


def _round(*names: str) -> str:
    return ", ".join(f"round({n}::DOUBLE, 9) AS {n}" for n in names)


BY_TASK = f"""
by_task AS (
  SELECT run, task, count(*) AS n, avg(emitted) AS emit_rate, {", ".join(f"avg({m}::DOUBLE) AS {m}" for m in METRICS)}
  FROM scored GROUP BY run, task
),
by_cell AS (
  SELECT run, slice, task, count(*) AS n, avg(emitted) AS emit_rate, {", ".join(f"avg({m}::DOUBLE) AS {m}" for m in METRICS)}
  FROM scored GROUP BY run, slice, task
),
overall AS (SELECT run, sum(n)::BIGINT AS n, {", ".join(f"avg({m}) AS {m}" for m in RATES)} FROM by_task GROUP BY run),
by_slice AS (SELECT run, slice, sum(n)::BIGINT AS n, {", ".join(f"avg({m}) AS {m}" for m in RATES)} FROM by_cell GROUP BY run, slice)"""


def _scored(select: str) -> str:
    return f"WITH {EXPECTED_SQL} {select}"


def _rolled(select: str) -> str:
    return f"WITH {EXPECTED_SQL}, {BY_TASK} {select}"


LABELLED = f"""
scored AS (
  SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'smoke_plain' END AS run, lang AS task, source AS slice,
    quality AS emitted, {", ".join(f"quality AS {m}" for m in METRICS)}
  FROM documents JOIN labels USING (doc_id)
)"""


def _labelled(select: str) -> str:
    return f"WITH {LABELLED}, {BY_TASK} {select}"


def _scoring() -> dict[str, str]:
    keys = "CASE task WHEN 'plan' THEN 6 WHEN 'dev' THEN 6 WHEN 'review' THEN 4 WHEN 'qe' THEN 3 WHEN 'bug' THEN 7 WHEN 'devops' THEN 5 ELSE 3 END"
    cut_keys = "CASE task WHEN 'review' THEN 4 WHEN 'custom' THEN 2 ELSE 3 END"
    return {
        "extract_answers": _scored(
            f"""SELECT run, k AS row_id, extract, CASE WHEN found THEN CASE WHEN cut THEN {cut_keys}
              ELSE {keys} + CASE WHEN f = 2 THEN 1 ELSE 0 END END END AS n_keys FROM checked"""
        ),
        "modes_by_run": _scored("SELECT run, extract, count(*) AS n FROM scored GROUP BY run, extract"),
        "schema_checks": _scored(
            """SELECT run, k AS row_id, schema_checks AS checks, array_to_string(schema_notes, '; ') AS notes,
              round(schema_value::DOUBLE, 9) AS schema FROM parts WHERE found"""
        ),
        "enum_checks": _scored(
            """SELECT run, k AS row_id, enum_checks AS checks, array_to_string(enum_notes, '; ') AS notes,
              round(enum_value::DOUBLE, 9) AS enums FROM parts WHERE found"""
        ),
        "rigor_checks": _scored(
            """SELECT run, k AS row_id, task, round(rigor_value::DOUBLE, 9) AS rigor,
              array_to_string(rigor_notes, '; ') AS notes FROM parts WHERE found"""
        ),
        "placeholder_checks": _scored(
            """SELECT run, k AS row_id, array_to_string(hits, '; ') AS hits, round(clean_value::DOUBLE, 9) AS clean
              FROM parts WHERE found"""
        ),
        "score_answers": _scored(
            f"""SELECT run, row_id, task, slice, extract, emitted, {_round(*METRICS)},
              array_to_string(notes, '; ') AS notes FROM scored"""
        ),
        "streamed_scores": _scored(
            f"""SELECT run, row_id, task, slice, extract, emitted, {_round(*METRICS)},
              array_to_string(notes, '; ') AS notes FROM scored"""
        ),
        "pending_scores": _scored(
            f"SELECT run, row_id, task, extract, {_round('score')} FROM scored WHERE status <> 'F' OR run = '{RUNS[1]}'"
        ),
        "resumed_scores": _scored(f"SELECT run, row_id, task, extract, {_round('score')} FROM scored"),
        "scores_by_task": _rolled(f"SELECT run, task, n, {_round(*RATES)} FROM by_task"),
        "scores_overall": _rolled(f"SELECT run, n, {_round(*RATES)} FROM overall"),
        "scores_by_slice": _rolled(f"SELECT run, slice, n, {_round(*RATES)} FROM by_slice"),
        "run_scores": _rolled(
            f"""SELECT o.run, o.n, {", ".join(f"round(o.{m}, 9) AS {m}" for m in RATES)},
              round(coalesce(s.score, 'nan'::DOUBLE), 9) AS real_score
              FROM overall o LEFT JOIN by_slice s ON s.run = o.run AND s.slice = 'real'"""
        ),
        "run_gains": _rolled(
            f"""SELECT task, round(b.score, 9) AS before, round(a.score, 9) AS after, round(a.score - b.score, 9) AS gain,
              round(a.score / greatest(b.score, 1e-9), 9) AS ratio
              FROM by_task b JOIN by_task a USING (task) WHERE b.run = '{RUNS[0]}' AND a.run = '{RUNS[1]}'"""
        ),
        "overall_gain": _rolled(
            f"""SELECT 'overall' AS scope, round(b.score, 9) AS before, round(a.score, 9) AS after,
              round(a.score - b.score, 9) AS gain, round(a.score / greatest(b.score, 1e-9), 9) AS ratio
              FROM overall b, overall a WHERE b.run = '{RUNS[0]}' AND a.run = '{RUNS[1]}'"""
        ),
        "task_run_matrix": _rolled(
            f"""SELECT task, {", ".join(f"round(max(score) FILTER (run = '{r}'), 9) AS {r}" for r in RUNS)}
              FROM by_task GROUP BY task"""
        ),
        "results_roundtrip": _rolled(
            f"""SELECT run, 'task' AS scope, task AS name, n, {_round(*RATES)} FROM by_task
              UNION ALL SELECT run, 'slice', slice, n, {_round(*RATES)} FROM by_slice
              UNION ALL SELECT run, 'overall', 'all', n, {_round(*RATES)} FROM overall"""
        ),
        "label_scores_by_task": _labelled(f"SELECT run, task, n, {_round(*RATES)} FROM by_task"),
        "label_scores_overall": _labelled(f"SELECT run, n, {_round(*RATES)} FROM overall"),
        "label_scores_by_slice": _labelled(f"SELECT run, slice, n, {_round(*RATES)} FROM by_slice"),
        "reported_runs": _labelled(f"SELECT run, n, {_round(*RATES)} FROM overall WHERE run NOT LIKE 'smoke\\_%' ESCAPE '\\'"),
    }


def _answers(select: str) -> str:
    return f"WITH {ANSWERS} {select}"


def _contract_rules() -> str:
    rows = []
    for task, c in CONTRACTS.items():
        for r in c.fields:
            allowed = f"'{'|'.join(r.allowed)}'" if r.allowed else "NULL"
            least = "NULL" if r.min_len is None else r.min_len
            element = f"'{r.element}'" if r.element else "NULL"
            rows.append(f"('{task}', '{TOOLS[task]}', NULL, '{r.name}', '{r.want}', {r.required}, {least}, {element}, {allowed})")
        for r in c.items:
            allowed = f"'{'|'.join(r.allowed)}'" if r.allowed else "NULL"
            rows.append(f"('{task}', '{TOOLS[task]}', '{c.item_list}', '{r.name}', NULL, true, NULL, NULL, {allowed})")
    columns = "task, tool, list, field, want_type, required, min_len, element, allowed"
    return _answers(
        f"""SELECT r.*, a.answers FROM (VALUES {", ".join(rows)}) r({columns})
          JOIN (SELECT task, count(*) AS answers FROM answers GROUP BY task) a USING (task)"""
    )


def _tables() -> dict[str, str]:
    caps = ",".join(f"{t}={120 if t == TASKS[1] else 200}" for t in sorted(TASKS))
    return {
        "contract_rules": _contract_rules(),
        "event_properties": """SELECT event_type, 'clean' AS extract, count(*) AS n,
          sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS sum_k FROM events GROUP BY event_type""",
        "capped_answers": _answers(
            """SELECT run, task, count(*) FILTER (new_tokens >= cap - 1) AS hits, count(*) AS "of"
              FROM answers GROUP BY run, task HAVING hits > 0"""
        ),
        "run_conditions": _answers(
            f"""SELECT 'bfloat16' AS eval_dtype, false AS four_bit, true AS greedy, '{caps}' AS cap_of, n_rows,
              count(*) AS runs, string_agg(run, ',' ORDER BY run) AS names
              FROM (SELECT run, count(*) AS n_rows FROM answers GROUP BY run) GROUP BY n_rows"""
        ),
        "results_file": _scored(
            f"""SELECT run, 'mode' AS part, extract AS name, count(*)::VARCHAR AS value FROM scored GROUP BY run, extract
              UNION ALL SELECT run, 'hit_cap', task, (count(*) FILTER (new_tokens >= cap - 1))::VARCHAR || '/' || count(*)::VARCHAR
              FROM answers GROUP BY run, task HAVING count(*) FILTER (new_tokens >= cap - 1) > 0
              UNION ALL SELECT run, 'overall', 'n', count(*)::VARCHAR FROM answers GROUP BY run
              UNION ALL SELECT run, 'condition', 'n_rows', count(*)::VARCHAR FROM answers GROUP BY run
              UNION ALL SELECT run, 'condition', name, value FROM (VALUES
                ('{RUNS[0]}', 'eval_dtype', 'bfloat16'), ('{RUNS[0]}', 'four_bit', 'false'), ('{RUNS[0]}', 'greedy', 'true'), ('{RUNS[0]}', 'cap_of', '{caps}'),
                ('{RUNS[1]}', 'eval_dtype', 'float16'), ('{RUNS[1]}', 'four_bit', 'true'), ('{RUNS[1]}', 'greedy', 'true'), ('{RUNS[1]}', 'cap_of', '{caps}')
              ) v(run, name, value)"""
        ),
        "raw_sink": _scored(
            """SELECT run, task, slice, extract, new_tokens >= cap - 1 AS hit_cap, count(*) AS n,
              sum(new_tokens)::BIGINT AS tokens FROM checked GROUP BY ALL"""
        ),
        "upserted_runs": _answers(
            f"""SELECT run, task, count(*) AS n,
              sum(CASE WHEN run = '{RUNS[1]}' THEN -1 ELSE new_tokens END)::BIGINT AS tokens FROM answers GROUP BY run, task"""
        ),
        "dead_sources": """
          WITH cells AS (
            SELECT source || '/' || lang AS run, quality IS NULL AS task, count(*) AS n,
              avg(coalesce(quality, 0) * coalesce(toxic, 0)) AS emit_rate
            FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL)
          SELECT run, sum(n)::BIGINT AS n FROM cells GROUP BY run HAVING avg(emit_rate) = 0""",
    }


def _marked(text: str, index: str) -> str:
    return f"{text} || {choice(f'({index}) % {len(MARKERS)}', MARKERS)}"


def _fillers() -> dict[str, str]:
    # The tables hold no padding of their own, so the marker decides. Two blanks
    # in "coming  soon" and the tag keep those markers from counting.
    hits = {1: ("0", "todo"), 2: ("10", "{{user_name}}"), 3: ("9", "<insert name>"), 6: ("3", "lorem ipsum"), 7: ("1", "tbd")}
    cases = ", ".join(f"({i}, 'pattern-{rule}', 'filler:{label}')" for i, (rule, label) in hits.items())
    size = len(MARKERS)
    return {
        "filler_in_documents": f"""
          SELECT lang, rule, label, count(*) AS n FROM documents
          JOIN (VALUES {cases}) h(i, rule, label) ON doc_id % {size} = i GROUP BY ALL""",
        "filler_in_conversations": f"""
          SELECT role, rule, label, count(*) AS n FROM (
            SELECT role, (conv_id + turn) % {size} AS i FROM conversations
            UNION ALL SELECT role, {size} FROM conversations WHERE turn = 7)
          JOIN (VALUES {cases}, ({size}, 'exact', 'empty-field:n/a')) h(i, rule, label) USING (i) GROUP BY ALL""",
    }


def _words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '\\S+'))"


def _turns(*parts: tuple[str, str]) -> str:
    return " || ".join(f"'<|{role}|>' || chr(10) || {text} || '</s>' || chr(10)" for role, text in parts)


SYSTEM, USER, ANSWER = ("system", "system"), ("user", "body"), ("assistant", "answer")
LENGTHS = f"""
  {_words(_turns(SYSTEM, USER, ANSWER))} AS n_total,
  {_words(_turns(SYSTEM, ("user", "''"), ANSWER))} AS n_fixed,
  {_words("answer")} AS n_target"""

CHATS = f"""
WITH chats AS (
  SELECT a.conv_id, a.turn, {SPLIT.format("a.conv_id")} AS split, {choice("a.conv_id % 7", TASKS)} AS task,
    coalesce(s.text, '') AS system, coalesce(u.text, '') AS body, a.text AS answer
  FROM conversations a
  LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'
  LEFT JOIN (SELECT conv_id, min_by(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY conv_id) s
    ON s.conv_id = a.conv_id
  WHERE a.role = 'assistant'
),
lengths AS (SELECT *, {LENGTHS} FROM chats),
fitted AS (
  SELECT *, {CHAT_WINDOW} - n_fixed AS budget,
    CASE WHEN n_total <= {CHAT_WINDOW} THEN 'keep' WHEN {CHAT_WINDOW} - n_fixed >= {CHAT_LEAST} THEN 'trim' ELSE 'drop' END AS decision
  FROM lengths
)"""

DOCS = f"""
WITH chats AS (
  SELECT doc_id, {SPLIT.format("doc_id")} AS split, lang AS task,
    'Write in ' || lang AS system, 'A text like those of ' || source AS body, text AS answer FROM documents
),
lengths AS (SELECT *, {LENGTHS} FROM chats)"""


def _mark(first: int) -> str:
    return f"sum(('0x' || substr(h, {first}, 15))::BIGINT)::VARCHAR"


_fields = " || ".join(f"length({c}::VARCHAR) || ':' || {c}" for c in ("conv_id", "turn", "system", "body", "answer"))


def _corpora() -> dict[str, str]:
    windows = " UNION ALL ".join(
        f"SELECT task, count(*) AS n, {w} AS \"window\", round(avg(CASE WHEN n_total <= {w} OR {w} - n_fixed >= {LEAST_BUDGET} "
        f"THEN 1.0 ELSE 0.0 END), 9) AS share FROM lengths GROUP BY task"
        for w in WINDOWS
    )
    mark = len(MARKER.split())
    marker = "'" + MARKER.replace("\n", "' || chr(10) || '") + "'"
    pieces = "regexp_extract_all(body, '\\s*\\S+')"
    head, tail = f"((budget - {mark}) // 2)", f"(budget - {mark} - (budget - {mark}) // 2)"
    return {
        "split_files": f"{CHATS} SELECT split, task, count(*) AS n, sum(length(answer))::BIGINT AS target_chars FROM chats GROUP BY split, task",
        "eval_set": f"""{CHATS}
          SELECT conv_id, turn, task, 'real' AS slice, answer AS target FROM chats WHERE split = 'test_real'
          UNION ALL SELECT conv_id, turn, task, 'gen', answer FROM (
            SELECT * FROM chats WHERE split = 'test_gen'
            QUALIFY row_number() OVER (PARTITION BY task ORDER BY conv_id, turn) <= {PER_TASK})""",
        "smoke_set": f"""{CHATS} SELECT conv_id, turn, task, answer AS target FROM chats
          QUALIFY row_number() OVER (PARTITION BY task ORDER BY conv_id, turn) = 1""",
        "corpus_manifest": f"""{CHATS} SELECT split, task, count(*) AS n,
          {_mark(1)} || '-' || {_mark(16)} AS mark FROM (SELECT *, sha256({_fields}) AS h FROM chats) GROUP BY split, task""",
        "rendered_chats": f"""{CHATS} SELECT conv_id, turn, md5({_turns(SYSTEM, USER, ANSWER)}) AS text_md5,
          md5({_turns(SYSTEM, USER)} || '<|assistant|>' || chr(10)) AS prompt_md5 FROM chats""",
        "whole_chats": """
          WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, md5(coalesce(text, '')) AS tie,
              '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '</s>' || chr(10) AS piece FROM conversations
          ),
          placed AS (
            SELECT *, coalesce(sum(strlen(piece)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, tie
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 4096 AS segment,
              lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, tie) AS follows FROM turns
          )
          SELECT conv_id, segment, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user,
            count(*) FILTER (role = 'user' AND follows IS DISTINCT FROM 'assistant') AS n_open, sum(length(piece))::BIGINT AS n_chars,
            md5(string_agg(piece, '' ORDER BY turn NULLS FIRST, role, tie)) AS text_md5
          FROM placed GROUP BY conv_id, segment""",
        "chat_lengths": f"{CHATS} SELECT conv_id, turn, n_total, n_fixed, n_target FROM lengths",
        "document_lengths": f"{DOCS} SELECT doc_id, n_total, n_fixed, n_target FROM lengths",
        "fitted_chats": f"{CHATS} SELECT conv_id, turn, decision, budget FROM fitted",
        "trimmed_chats": f"""{CHATS} SELECT conv_id, turn, CASE WHEN decision = 'keep' THEN body ELSE
          array_to_string(list_slice({pieces}, 1, {head}), '') || {marker} ||
          array_to_string(list_slice({pieces}, greatest(len({pieces}) - {tail} + 1, 1), len({pieces})), '') END AS "user"
          FROM fitted WHERE decision <> 'drop'""",
        "chat_fit_report": f"{CHATS} SELECT task, decision, count(*) AS n FROM fitted GROUP BY task, decision",
        "document_window_coverage": f"{DOCS} {windows}",
        "document_generation_caps": f"""{DOCS} SELECT task, max(n_target) AS longest,
          ceil({CAP_FACTOR} * max(n_target)::DOUBLE)::BIGINT AS cap FROM lengths GROUP BY task""",
        "document_target_quantiles": f"""{DOCS} SELECT task, round(quantile_cont(n_target::DOUBLE, 0.5), 9) AS median,
          round(quantile_cont(n_target::DOUBLE, 0.9), 9) AS p90 FROM lengths GROUP BY task""",
        "longest_documents": f"""{DOCS} SELECT doc_id, length(system) + length(body) + length(answer) AS chars
          FROM chats WHERE split = 'train' ORDER BY chars DESC, doc_id LIMIT 8""",
        "training_text": f"{CHATS} SELECT {_turns(SYSTEM, USER, ANSWER)} AS text FROM chats WHERE split = 'train'",
    }


def _levels(levels: list[float]) -> str:
    return "[" + ", ".join(f"{x!r}::DOUBLE" for x in levels) + "]"


def _code(levels: list[float], value: str) -> str:
    """Index of the nearest level, the first on a tie, by trying every level."""
    distances = f"list_transform({_levels(levels)}, lambda level: abs(level - {value}))"
    return f"(list_position({distances}, list_min({distances})) - 1)"


def _weights(size: int) -> str:
    return f"""
WITH vectors AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
blocks AS (
  SELECT vec_id, b AS block, list_slice(e, b * {size} + 1, (b + 1) * {size}) AS w
  FROM vectors, unnest(range(0, ceil(len(e) / {size})::BIGINT)) t(b)
),
scaled AS (
  SELECT *, CASE WHEN list_max(list_transform(w, lambda x: abs(x))) = 0 THEN 1 ELSE list_max(list_transform(w, lambda x: abs(x))) END AS absmax
  FROM blocks
),
weights AS (SELECT vec_id, block, absmax, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM scaled),
coded AS (SELECT *, {_code(NF4, "(x / absmax)")} AS nf4_code, {_code(INT4, "(x / absmax)")} AS int4_code FROM weights),
errors AS (
  SELECT *, abs(x - {_levels(NF4)}[nf4_code + 1] * absmax) AS nf4_err, abs(x - {_levels(INT4)}[int4_code + 1] * absmax) AS int4_err
  FROM coded
)"""


def _vectors() -> dict[str, str]:
    pooled = ", ".join(
        f"round(sqrt(sum({b}_err * {b}_err) / count(*)), 9) AS {b}_rmse, round(avg({b}_err), 9) AS {b}_mae, "
        f"round(max({b}_err), 9) AS {b}_max_err"
        for b in ("nf4", "int4")
    )
    occupancy = " UNION ALL ".join(
        f"""SELECT '{book}' AS code_book, c AS code, count(x) AS n,
          round(100.0 * count(x) / (SELECT count(*) FROM coded), 9) AS share_pct, round(100.0 / {size}, 9) AS equal_share_pct
          FROM range(0, {size}) r(c) LEFT JOIN coded ON {book}_code = c GROUP BY c"""
        for book, size in (("nf4", len(NF4)), ("int4", len(INT4)))
    )
    scale = 2 / 255
    zero = -1 + 127 * scale
    sizes = " UNION ALL ".join(
        f"""SELECT '{name}' AS precision, {bits} AS bits, weights, weights * {bits} // 8 / 1e9 AS gb,
          weights * {bits} // 8 / 1073741824 AS gib, (weights * 32 // 8) / (weights * {bits} // 8) AS shrink,
          {bits + (0.5 if bits == 4 else 0.0)}::DOUBLE AS bits_raw_scales,
          {bits + (0.126953125 if bits == 4 else 0.0)}::DOUBLE AS bits_double_quant FROM total"""
        for name, bits in BITS.items()
    )
    return {
        "vector_blocks": f"{_weights(24)} SELECT vec_id, block, len(w) AS n, round(absmax, 9) AS absmax FROM scaled",
        "vector_codes": f"""{_weights(BLOCK)} SELECT vec_id, block, string_agg(nf4_code::VARCHAR, ',' ORDER BY pos) AS codes
          FROM coded GROUP BY vec_id, block""",
        "vector_block_errors": f"""{_weights(BLOCK)} SELECT vec_id, block, round(avg(int4_err), 9) AS mae,
          round(max(int4_err), 9) AS max_err, round(sqrt(sum(int4_err * int4_err) / count(*)), 9) AS rmse
          FROM errors GROUP BY vec_id, block""",
        "pooled_vector_errors": f"{_weights(BLOCK)} SELECT count(*) AS n, {pooled} FROM errors",
        "code_book_comparison": f"""{_weights(BLOCK)} SELECT count(*) AS n, round(100.0 * (sqrt(sum(int4_err * int4_err) / count(*))
          - sqrt(sum(nf4_err * nf4_err) / count(*))) / sqrt(sum(int4_err * int4_err) / count(*)), 9) AS rmse_improvement_pct FROM errors""",
        "affine_codes": f"""
          WITH x AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings),
          q AS (SELECT x, greatest(-127, least(128, round_even((x - ({zero!r})) / {scale!r}, 0)))::INT AS q FROM x)
          SELECT q, count(*) AS n, round(max({scale!r} * q + ({zero!r})), 9) AS x_hat,
            round(max(abs(x - ({scale!r} * q + ({zero!r})))), 9) AS max_err FROM q GROUP BY q""",
        "vector_code_occupancy": f"{_weights(BLOCK)} {occupancy}",
        "vector_footprint": f"""
          WITH total AS (SELECT sum(len(embedding))::BIGINT AS weights FROM embeddings), sizes AS ({sizes})
          SELECT precision, bits, weights, round(gb, 9) AS gb, round(gib, 9) AS gib, round(shrink, 9) AS shrink,
            bits_raw_scales, bits_double_quant, round(weights * bits_double_quant / 8 / 1e9, 9) AS gb_double_quant FROM sizes""",
    }


def all_sql() -> dict[str, str]:
    return {**_scoring(), **_tables(), **_fillers(), **_corpora(), **_vectors()}
