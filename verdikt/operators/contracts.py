"""The answer contracts, as plain values and as one literal column.

The contracts are a small fixed dimension (seven tasks). They are folded into
the plan as a map literal, so looking one up needs neither join nor shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tasks, labels and the value sets of the contracts.
TASKS = ["plan", "dev", "review", "qe", "bug", "devops", "custom"]
TOOLS = {
    "plan": "draft_story",
    "dev": "propose_changes",
    "review": "submit_review",
    "qe": "author_test_plan",
    "bug": "file_bug",
    "devops": "plan_release",
    "custom": "respond",
}
EFFORT = ["S", "M", "L", "XL"]
PRIORITY = ["P0", "P1", "P2", "P3"]
SUITE_CATEGORY = ["happy", "negative", "edge", "security", "accessibility", "performance", "regression"]
CHANGE_ACTION = ["create", "modify"]
VERDICT = ["APPROVE", "APPROVE WITH NITS", "REQUEST CHANGES", "BLOCK"]
SEVERITY = ["critical", "major", "minor", "nit"]
BUG_SEVERITY = ["S1", "S2", "S3", "S4"]
RELEASE_STRATEGY = ["direct", "canary", "blue-green", "feature-flag"]


@dataclass(frozen=True)
class FieldRule:
    """One top-level field: its type and, if any, its list or value-set rule."""

    name: str
    want: str = "str"
    required: bool = True
    min_len: int | None = None
    element: str | None = None
    allowed: tuple[str, ...] | None = None


@dataclass(frozen=True)
class ItemRule:
    """One field of the objects inside the contract's item list."""

    name: str
    allowed: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Contract:
    fields: tuple[FieldRule, ...]
    item_list: str | None = None
    items: tuple[ItemRule, ...] = field(default=())


def _text(*names: str) -> list[FieldRule]:
    return [FieldRule(n) for n in names]


def _choice(name: str, allowed: list[str]) -> FieldRule:
    return FieldRule(name, allowed=tuple(allowed))


def _list(name: str, min_len: int, element: str) -> FieldRule:
    return FieldRule(name, "list", min_len=min_len, element=element)


def _optional_list(name: str) -> FieldRule:
    return FieldRule(name, "list", required=False)


CONTRACTS: dict[str, Contract] = {
    "plan": Contract(
        (
            *_text("title", "description_md"),
            _list("acceptance_criteria", 3, "str"),
            _optional_list("suggested_labels"),
            _choice("effort", EFFORT),
            _optional_list("file_hints"),
        )
    ),
    "dev": Contract(
        (*_text("commit_message", "pr_title", "pr_body", "summary"), _list("changes", 1, "dict")),
        "changes",
        (ItemRule("path"), ItemRule("action", tuple(CHANGE_ACTION)), ItemRule("description")),
    ),
    "review": Contract(
        (_choice("verdict", VERDICT), *_text("summary"), _list("findings", 0, "dict")),
        "findings",
        (ItemRule("file"), ItemRule("severity", tuple(SEVERITY)), ItemRule("issue")),
    ),
    "qe": Contract(
        (*_text("summary"), _list("suites", 1, "dict")),
        "suites",
        (ItemRule("name"), ItemRule("category", tuple(SUITE_CATEGORY)), ItemRule("cases")),
    ),
    "bug": Contract(
        (
            *_text("title"),
            _choice("severity", BUG_SEVERITY),
            _list("steps_to_reproduce", 2, "str"),
            *_text("expected", "actual", "suspected_cause"),
        )
    ),
    "devops": Contract(
        (
            _choice("strategy", RELEASE_STRATEGY),
            _list("steps", 2, "str"),
            *_text("rollback"),
            _list("checks", 1, "str"),
        )
    ),
    "custom": Contract(
        (*_text("summary"), _list("actions", 1, "dict")),
        "actions",
        (ItemRule("title"), ItemRule("detail")),
    ),
}


#: Fields that are shown as texts, and the keys of list members that are.
SHOWN_FIELDS = frozenset(r.name for c in CONTRACTS.values() for r in c.fields if r.want == "str")
SHOWN_MEMBERS = {
    c.item_list: frozenset(r.name for r in c.items if r.allowed or r.name == "detail") for c in CONTRACTS.values() if c.item_list
}

#: Keys of list members that hold lists themselves.
LISTS = ["cases"]

MAX_FIELDS = max(len(c.fields) for c in CONTRACTS.values())
MAX_ITEM_NAMES = max(len(c.items) for c in CONTRACTS.values())


def _sql(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, tuple):
        return "array(" + ", ".join(_sql(v) for v in value) + ")"
    return f"'{value}'" if isinstance(value, str) else str(value)


#: Column with the place of the row's task among ``TASKS``. Rules are found by it
#: in one step; comparing the task's name costs more than many of the checks.
TASK_PLACE = "_task"


def task_place() -> Column:
    return F.expr("CASE task " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TASKS)) + " END")


def _by_task(values: dict, sql_type: str) -> Column:
    """A small look-up on the row's task, in a list that Spark folds into the plan."""
    entries = ", ".join(_sql(values.get(task)) for task in TASKS)
    return F.expr(f"get(CAST(array({entries}) AS array<{sql_type}>), {TASK_PLACE})")


def _among(tasks: list[str]) -> Column:
    """Whether the row's task is one of these."""
    return F.col(TASK_PLACE).isin([TASKS.index(t) for t in tasks]) if tasks else F.lit(False)


RULE_TYPES = {
    "name": "string",
    "want": "string",
    "required": "boolean",
    "min_len": "int",
    "element": "string",
    "allowed": "array<string>",
}


def rule(i: int, part: str) -> Column:
    """One part of the ``i``-th field rule of the row's task."""
    values = {t: getattr(c.fields[i], part) for t, c in CONTRACTS.items() if i < len(c.fields)}
    return _by_task(values, RULE_TYPES[part])


def _choices() -> dict[str, int]:
    return {t: i for t, c in CONTRACTS.items() for i, r in enumerate(c.fields) if r.allowed}


def choice_slot() -> Column:
    """Position of the one top-level field with a value set, or null."""
    return _by_task(_choices(), "int")


def choice_rule() -> tuple[Column, Column]:
    """Name and value set of that field."""
    rules = {t: CONTRACTS[t].fields[i] for t, i in _choices().items()}
    names = _by_task({t: r.name for t, r in rules.items()}, "string")
    return names, _by_task({t: r.allowed for t, r in rules.items()}, "array<string>")


def _members(names: dict[str, str], sql_type: str) -> Column:
    whens = " ".join(f"WHEN {TASKS.index(t)} THEN try_variant_get(answer, '$[0].{n}', '{sql_type}')" for t, n in names.items())
    return F.expr(f"CASE {TASK_PLACE} {whens} END" if whens else f"CAST(null AS {sql_type})")


def _names(i: int, wanted) -> dict[str, str]:
    fields = {t: c.fields[i] for t, c in CONTRACTS.items() if i < len(c.fields)}
    return {t: r.name for t, r in fields.items() if wanted(t, r)}


def member_value(i: int) -> Column:
    """The ``i``-th field of the row's answer."""
    return _members(_names(i, lambda t, r: True), "variant")


def member_list(i: int) -> Column:
    """The same as a list, where the contract wants a list other than the items."""
    return _members(_names(i, lambda t, r: r.want == "list" and r.name != CONTRACTS[t].item_list), "array<variant>")


def is_item_slot(i: int) -> Column:
    """Whether the ``i``-th field of the row's task is its item list."""
    tasks = list(_names(i, lambda t, r: r.name == CONTRACTS[t].item_list))
    return _among(tasks)


def item_objects() -> Column:
    """The item list as maps, null for each member that is no object."""
    return _members({t: c.item_list for t, c in CONTRACTS.items() if c.item_list}, "array<map<string,variant>>")


def item_list() -> Column:
    """Name of the row's item list, or null."""
    return _by_task({t: c.item_list for t, c in CONTRACTS.items()}, "string")


def item_names() -> Column:
    """Keys each member of the item list must have."""
    return _by_task({t: tuple(r.name for r in c.items) or None for t, c in CONTRACTS.items()}, "array<string>")


def item_name_slots() -> list[Column]:
    """The same keys one by one, null where the row's task has fewer."""
    tasks = {t: [r.name for r in c.items] for t, c in CONTRACTS.items()}
    return [_by_task({t: n[k] for t, n in tasks.items() if k < len(n)}, "string") for k in range(MAX_ITEM_NAMES)]


def holds_lists(k: int) -> Column | None:
    """Whether the ``k``-th key of the row's list members should be a list; None
    if that holds for no task."""
    tasks = [t for t, c in CONTRACTS.items() if k < len(c.items) and c.items[k].name in LISTS]
    return _among(tasks) if tasks else None


def _item_choices() -> dict[str, ItemRule]:
    """The one key with a value set in each member."""
    return {task: r for task, c in CONTRACTS.items() for r in c.items if r.allowed}


def item_choice() -> Column:
    """Name of that key."""
    return _by_task({task: r.name for task, r in _item_choices().items()}, "string")


def in_item_choice(text: Column) -> Column:
    """Whether a text is in that key's value set: a search in the values' list as
    one text, as a search in an array boxes each member inside array lambdas."""
    sets = {task: r.allowed for task, r in _item_choices().items()}
    assert not any("," in value for values in sets.values() for value in values)
    return F.find_in_set(text, _by_task({task: ",".join(values) for task, values in sets.items()}, "string")) > 0


def known_task(task: Column) -> Column:
    """The task itself; an unknown one stops the job with its name."""
    unknown = F.raise_error(F.concat(F.lit("unknown task: "), F.coalesce(task, F.lit("null"))))
    return F.when(task.isin(list(CONTRACTS)), task).otherwise(unknown)


def slot_of(task: str, name: str) -> int:
    """Position of a field among its contract's fields."""
    return [r.name for r in CONTRACTS[task].fields].index(name)


def contract_table(spark: SparkSession) -> DataFrame:
    """The contracts as rows, one per rule."""
    rows = []
    for task, c in CONTRACTS.items():
        tool = TOOLS.get(task)
        for r in c.fields:
            rows.append((task, tool, None, r.name, r.want, r.required, r.min_len, r.element, r.allowed))
        for r in c.items:
            rows.append((task, tool, c.item_list, r.name, None, True, None, None, r.allowed))
    return spark.createDataFrame(
        rows,
        "task string, tool string, list string, field string, want_type string, "
        "required boolean, min_len int, element string, allowed array<string>",
    )
