"""Task-specific rigor: the mean of a few components, plus notes.

Each function reads the slots of an inspected answer and its member objects, and
returns two columns, the value and the notes, so that either can do without the
other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdikt.functions.text import bind, python_repr, quoted, strip
from verdikt.functions.variants import as_object, as_objects, as_string, is_string, key_count, truthy
from verdikt.operators.checks import ratio, shown_at
from verdikt.operators.contracts import PRIORITY, slot_of

# Fixed values.
COMMIT_TYPES = "^(feat|fix|chore|refactor|docs|test|perf)"
COMMIT_LINE = r"(?d)" + COMMIT_TYPES + r"(\(.+\))?: .+"
COVERED = ["happy", "negative", "edge", "security", "accessibility"]


def _field(task: str, name: str, part: str) -> Column:
    return F.col(f"_{part}{slot_of(task, name)}")


def _text(task: str, name: str) -> Column:
    """``str()`` of a field, '' when absent."""
    return F.coalesce(_field(task, name, "text"), F.lit(""))


def _length(task: str, name: str) -> Column:
    """``len()`` of a list, text or object; 0 for anything else."""
    return F.coalesce(_field(task, name, "n"), F.lit(0))


def _step(condition: Column, otherwise: float = 0.0) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(otherwise))


def _count(values: Column, condition) -> Column:
    return F.size(F.filter(values, condition))


def _note(condition: Column, note: Column | str) -> Column:
    return F.when(condition, F.lit(note) if isinstance(note, str) else note).otherwise(F.lit(""))


Result = tuple[Column, Column]


def _result(parts: list[Column], notes: list[Column]) -> Result:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return (total / len(parts)).cast("double"), F.array_remove(F.array(*notes), "")


def _unless(nothing: Column, note: str, result: Result) -> Result:
    """No credit and one note where there is nothing to look at."""
    value, notes = result
    return F.when(nothing, F.lit(0.0)).otherwise(value), F.when(nothing, F.array(F.lit(note))).otherwise(notes)


def text_of(value: Column) -> Column:
    """``str()`` of a member's value; '' when the key is absent."""
    text = F.when(is_string(value), as_string(value)).otherwise(python_repr(F.to_json(value)))
    return F.when(value.isNull(), F.lit("")).otherwise(text)


def member_text(m: Column, i: Column, name: str, key: str) -> Column:
    """``str()`` of a value of the ``i``-th member of the list ``name``."""
    path = F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"].{key}"))
    return F.coalesce(shown_at(path), text_of(F.element_at(m, key)))


def plan() -> Result:
    def criteria(part: str) -> Column:
        return _field("plan", "acceptance_criteria", part)

    n = _length("plan", "acceptance_criteria")
    long_texts = _count(criteria("list"), lambda x: is_string(x) & (F.length(as_string(x)) >= 20))
    long_keys = _count(F.map_keys(as_object(criteria("value"))), lambda k: F.length(k) >= 20)
    kind = criteria("kind")
    good = F.when(kind == "list", long_texts).when(kind == "dict", long_keys).otherwise(F.lit(0))
    return _result(
        [
            F.least(F.lit(1.0), n / 3),
            ratio(good, n),
            _step(F.length(_text("plan", "title")).between(1, 120)),
            _step(F.length(_text("plan", "description_md")) >= 100),
        ],
        [_note(n < 3, F.concat(F.lit("thin-ac:"), n.cast("string")))],
    )


def dev(changes: Column) -> Result:
    paths = F.transform(changes, lambda m: F.element_at(m, "path"))

    def relative(path: Column) -> Column:
        text = as_string(path)
        return is_string(path) & ~text.startswith("/") & ~text.contains("\\")

    n = F.size(changes)
    good = _count(paths, relative)
    # Paths that are no text are told apart by their JSON.
    distinct = F.size(F.array_distinct(F.transform(paths, lambda p: F.coalesce(F.to_json(p), F.lit("null")))))
    body, commit = _text("dev", "pr_body"), _text("dev", "commit_message")
    scored = _result(
        [
            ratio(good, n),
            _step(distinct == n, 0.5),
            _step(body.contains("##") & (F.length(body) > 80)),
            _step(commit.rlike(COMMIT_LINE)),
        ],
        [
            _note(good < n, "bad-paths"),
            _note(~commit.rlike(COMMIT_TYPES), "non-conventional-commit"),
        ],
    )
    return _unless(n == 0, "no-changes", scored)


def review(findings: Column) -> Result:
    located = _count(findings, lambda m: truthy(F.element_at(m, "file")) & truthy(F.element_at(m, "issue")))
    found = F.transform("members", lambda m, i: F.when(m.isNotNull(), F.lower(member_text(m, i, "findings", "severity"))))
    severities = F.array_sort(F.array_compact(F.array_distinct(found)))
    verdict = F.upper(_text("review", "verdict"))
    grave = F.arrays_overlap(severities, F.array(F.lit("critical"), F.lit("major")))
    inconsistent = grave & ~verdict.isin("REQUEST CHANGES", "BLOCK")
    listed = F.array_join(F.transform(severities, quoted), ", ")
    return _result(
        [
            ratio(located, F.size(findings)),
            _step(~inconsistent),
            _step(F.length(_text("review", "summary")) >= 60),
        ],
        [
            _note(
                inconsistent,
                F.concat(F.lit("verdict-inconsistent:"), verdict, F.lit("-with-["), listed, F.lit("]")),
            )
        ],
    )


def _steps_of(case: Column) -> Column:
    """A case's steps as objects, null for each step that is none."""
    value = F.element_at(case, "steps")
    none = F.lit(None).cast("map<string,variant>")
    by_char = F.when(is_string(value), F.array_repeat(none, F.length(as_string(value))))
    by_key = F.array_repeat(none, key_count(as_object(value)))
    return F.coalesce(as_objects(value), by_char, by_key, F.array())


#: A test case as far as checks look, and the answer it stands in. The last field
#: is filled where any other one has another type.
STEP = "struct<action: variant, expected: variant>"
CASE = f"struct<id: variant, steps: array<{STEP}>, covers_ac: variant, priority: variant>"
PLAN = f"struct<suites: array<struct<cases: array<{CASE}>>>, other string>"


def _case(m: Column) -> Column:
    steps = F.transform(
        _steps_of(m),
        lambda x: F.when(x.isNotNull(), F.struct(*[F.element_at(x, k).alias(k) for k in ("action", "expected")])),
    )
    id_, covers, priority = (F.element_at(m, k).alias(k) for k in ("id", "covers_ac", "priority"))
    return F.struct(id_, steps.alias("steps"), covers, priority)


def qe_cases(suites: Column, doc: Column) -> Column:
    """The case objects of all suites, in order.

    The plan is read from its JSON in one pass, each value taken out once. One
    with a value of another type has its VARIANT members taken apart instead.
    """
    none = F.array().cast(f"array<{CASE}>")
    lists = F.transform(suites, lambda s: F.coalesce(as_objects(F.element_at(s, "cases")), F.array()))
    objects = F.filter(F.flatten(lists), lambda c: c.isNotNull())

    def cases(read: Column) -> Column:
        whole = F.flatten(F.transform(read["suites"], lambda s: F.coalesce(s["cases"], none)))
        regular = F.when(read["other"].isNull(), F.filter(whole, lambda c: c.isNotNull()))
        return F.coalesce(regular, F.transform(objects, _case))

    return bind(F.from_json(doc, PLAN, {"columnNameOfCorruptRecord": "other"}), cases)


def step_counts(cases: Column) -> Column:
    """Over all cases: steps, and steps that pair an action with a result."""
    none = F.array().cast(f"array<{STEP}>")

    def counts(steps: Column) -> Column:
        paired = _count(steps, lambda x: x.isNotNull() & truthy(x["action"]) & truthy(x["expected"]))
        return F.struct(F.size(steps).alias("n"), paired.alias("paired"))

    return bind(F.flatten(F.transform(cases, lambda c: F.coalesce(c["steps"], none))), counts)


def qe(suites: Column, cases: Column) -> Result:
    n = F.size(cases)
    ids_right = F.size(
        F.filter(
            F.transform(
                cases,
                lambda c, i: text_of(c["id"])
                == F.concat(F.lit("TC-"), F.when(i < 999, F.lpad((i + 1).cast("string"), 3, "0")).otherwise((i + 1).cast("string"))),
            ),
            lambda same: same,
        )
    )
    traced = _count(cases, lambda c: truthy(c["covers_ac"], often_list=True))
    ranked = _count(
        cases,
        lambda c: F.coalesce(
            is_string(c["priority"]) & as_string(c["priority"]).isin(PRIORITY), F.lit(False)
        ),
    )
    categories = F.transform(
        suites,
        lambda s: F.when(is_string(F.element_at(s, "category")), as_string(F.element_at(s, "category"))),
    )
    breadth = F.size(F.array_intersect(categories, F.array(*[F.lit(c) for c in COVERED])))
    t = F.col("_steps")
    scored = _result(
        [
            ids_right / n,
            F.when(t["n"] == 0, F.lit(0.0)).otherwise(t["paired"] / t["n"]),
            traced / n,
            ranked / n,
            F.least(F.lit(1.0), breadth / 4),
            F.when(n.between(12, 22), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(n - 16) / 16)),
        ],
        [
            _note(ids_right < n, "ids-not-contiguous"),
            _note(
                t["paired"] < t["n"],
                F.concat(F.lit("unpaired-steps:"), (t["n"] - t["paired"]).cast("string")),
            ),
            _note(traced < n * 0.8, "weak-traceability"),
        ],
    )
    return _unless(n == 0, "no-cases", scored)


def bug() -> Result:
    expected, actual = _text("bug", "expected"), _text("bug", "actual")
    same = strip(expected) == strip(actual)
    return _result(
        [
            _step(_length("bug", "steps_to_reproduce") >= 2),
            _step((expected != "") & (actual != "") & ~same),
            _step(F.length(_text("bug", "suspected_cause")) >= 40),
        ],
        [_note(same, "expected==actual")],
    )


def devops() -> Result:
    thin = F.length(_text("devops", "rollback")) < 40
    return _result(
        [_step(_length("devops", "steps") >= 3, 0.5), _step(~thin), _step(_length("devops", "checks") >= 2, 0.5)],
        [_note(thin, "thin-rollback")],
    )


def custom(actions: Column) -> Result:
    n = F.size(actions)
    told = F.transform(
        "members", lambda m, i: truthy(F.element_at(m, "title")) & (F.length(member_text(m, i, "actions", "detail")) >= 30)
    )
    full = _count(told, lambda good: F.coalesce(good, F.lit(False)))
    return _unless(n == 0, "no-actions", _result([full / n], [_note(full < n, "thin-actions")]))


def rigor_inputs() -> list[dict[str, Column]]:
    """The member objects, and for test plans the flattened cases and their
    steps; each step's columns build on those before."""
    objects = F.filter("members", lambda m: m.isNotNull())
    none = F.array().cast(f"array<{CASE}>")
    is_plan = (F.col("task") == "qe") & F.col("answer").isNotNull()
    return [
        {"_objects": objects},
        {"_cases": F.when(is_plan, qe_cases(F.col("_objects"), F.col("doc"))).otherwise(none)},
        {"_steps": step_counts(F.col("_cases"))},
    ]


def rigor_result() -> Result:
    """F8: the task's rigor and its notes, from an inspected answer and its
    rigor inputs."""
    objects = F.col("_objects")
    by_task = {
        "plan": plan(),
        "dev": dev(objects),
        "review": review(objects),
        "qe": qe(objects, F.col("_cases")),
        "bug": bug(),
        "devops": devops(),
        "custom": custom(objects),
    }

    def chosen(part: int) -> Column:
        result = F.when(F.lit(False), by_task["plan"][part])
        for task, parts in by_task.items():
            result = result.when(F.col("task") == task, parts[part])
        return result

    return chosen(0), chosen(1)
