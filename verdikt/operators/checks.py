"""Contract checks on an extracted answer.

The outcomes of a row are bit masks: which field checks apply and which pass,
and a mask of the keys that hold for each member of the item list. Scores are
counts of bits. Notes are rendered from the masks by columns of their own, so
that a query that asks for none has none in its plan.

A contract has at most six top-level fields. Each takes one slot of plain
columns (value, kind, length, text), so that the field checks compile to JVM
code; only the members of a list are walked with array lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.functions import filler
from verdikt.functions.text import JSON_STRING, python_repr, quoted, settled, unquote_json
from verdikt.functions.variants import as_list, as_object, as_string, is_string, key_count, kind_of, truthy
from verdikt.operators.contracts import (
    MAX_FIELDS,
    MAX_ITEM_NAMES,
    choice_rule,
    choice_slot,
    holds_lists,
    in_item_choice,
    is_item_slot,
    item_choice,
    item_list,
    item_name_slots,
    item_names,
    item_objects,
    member_list,
    member_value,
    rule,
)

SLOTS = range(MAX_FIELDS)


def ratio(ok: Column, total: Column) -> Column:
    """Share of passes; with nothing to check, full credit."""
    return F.when(total == 0, F.lit(1.0)).otherwise(ok / total)


# Looking at the answer


def _slot(name: str, i: int) -> Column:
    return F.col(f"_{name}{i}")


def shown_at(path: Column) -> Column:
    """How Python shows the value at a path, where a VARIANT would not."""
    return F.try_element_at(F.col("shown"), path)


def inspect_answer(df: DataFrame) -> DataFrame:
    """Fill the slots, ``members``, the item list as maps, and ``_keyed``, the
    values of each member that are checked.

    Slot columns: value, list, typed (whether all list members have the wanted
    type), schema, then kind, n (length) and text. Beside them, ``_strings``: the
    texts that may be padding.
    """
    lists = {f"_list{i}": member_list(i) for i in SLOTS}
    df = df.withColumns({"_items": item_objects(), "_strings": walked_strings()} | lists)

    def listed(i: int) -> Column:
        return _slot("list", i).isNotNull() | (is_item_slot(i) & F.col("_items").isNotNull())

    # Lists are settled; only the other values are taken out and looked at. The
    # walk over the lists keeps this step, like the one before, out of the fused
    # code of the steps below it: beyond 8,000 bytes the JVM would interpret that.
    typed = {f"_typed{i}": F.when(rule(i, "element") == "str", F.forall(_slot("list", i), is_string)) for i in SLOTS}
    df = df.withColumns(typed | {f"_value{i}": F.when(~listed(i), member_value(i)) for i in SLOTS})
    schemas = {f"_schema{i}": F.when(listed(i), F.lit("ARRAY")).otherwise(F.schema_of_variant(_slot("value", i))) for i in SLOTS}
    item_value = F.coalesce(*[F.when(is_item_slot(i), _slot("value", i)) for i in SLOTS])
    df = df.withColumns(schemas | {"_item_value": item_value})

    # A text is taken out once, for its length and itself.
    df = df.withColumns({f"_plain{i}": F.when(_slot("schema", i) == "STRING", as_string(_slot("value", i))) for i in SLOTS})

    columns, odd_texts = {}, []
    for i in SLOTS:
        value, schema = _slot("value", i), _slot("schema", i)
        columns[f"_kind{i}"] = kind_of(f"_schema{i}")
        odd_text = F.when((schema != "STRING") & (rule(i, "want") == "str"), F.to_json(value))
        odd_texts.append(odd_text)
        columns[f"_n{i}"] = (
            F.when(
                schema.startswith("ARRAY"),
                F.coalesce(
                    F.array_size(_slot("list", i)),
                    F.when(is_item_slot(i), F.array_size("_items")),
                    F.array_size(as_list(value)),
                ),
            )
            .when(schema == "STRING", F.length(_slot("plain", i)))
            .when(schema.startswith("OBJECT"), key_count(as_object(value)))
        )
    # A text is walked by character and an object by key, as Python does; a
    # number or boolean, on which Python fails, counts as an empty list.
    none = F.lit(None).cast("map<string,variant>")
    item_value = F.col("_item_value")
    walked = F.when(is_string(item_value), F.length(as_string(item_value))).otherwise(key_count(as_object(item_value)))
    columns["members"] = F.coalesce(F.col("_items"), F.array_repeat(none, F.coalesce(walked, F.lit(0))))
    # ``str()`` of the values that should be texts and are not.
    columns["_odd_texts"] = F.when(F.coalesce(*odd_texts).isNotNull(), F.transform(F.array(*odd_texts), python_repr))
    df = df.withColumns(columns)
    texts = {f"_text{i}": F.coalesce(_slot("plain", i), shown_at(rule(i, "name")), F.get("_odd_texts", F.lit(i))) for i in SLOTS}
    return df.withColumns(texts | {"_keyed": F.transform("members", _keyed)})


def _keyed(m: Column) -> Column:
    """The values of a member that are checked, each looked up once."""
    values = [F.element_at(m, name).alias(f"key{k}") for k, name in enumerate(item_name_slots())]
    return F.when(m.isNotNull(), F.struct(*values, F.element_at(m, item_choice()).alias("choice")))


# The checks themselves: whether each applies, whether it passes, and its note

Check = tuple[Column, Column, Column]


def required_check(i: int) -> Check:
    """Present, not null, and not empty unless the list may be empty."""
    kind = _slot("kind", i)
    may_be_empty = (kind == "list") & (F.coalesce(rule(i, "min_len"), F.lit(1)) == 0)
    empty = F.coalesce(_slot("n", i) == 0, F.lit(False))
    missing = kind.isNull() | (kind == "NoneType") | (empty & ~may_be_empty)
    return rule(i, "required"), ~missing, F.concat(F.lit("missing/empty:"), rule(i, "name"))


def type_check(i: int) -> Check:
    """The JSON type, where the field is present and not null."""
    kind = _slot("kind", i)
    note = F.concat(F.lit("wrongtype:"), rule(i, "name"), F.lit("="), kind)
    return kind != "NoneType", kind == rule(i, "want"), note


def list_check(i: int) -> Check:
    """Enough members, all of the wanted type."""
    n = _slot("n", i)
    all_objects = F.forall("members", lambda m: m.isNotNull())
    typed = F.when(rule(i, "element") == "str", _slot("typed", i)).otherwise(all_objects)
    note = F.concat(
        F.lit("array:"), rule(i, "name"), F.lit(" n="), n.cast("string"), F.lit(" min="), rule(i, "min_len").cast("string")
    )
    applies = rule(i, "element").isNotNull() & (_slot("kind", i) == "list")
    return applies, (n >= rule(i, "min_len")) & typed, note


def field_checks() -> list[Check]:
    """The checks of all fields, in note order; a check's place is its bit."""
    return [check(i) for check in (required_check, type_check, list_check) for i in SLOTS]


def _bits(conditions: list[Column]) -> Column:
    total = F.lit(0).cast("long")
    for k, condition in enumerate(conditions):
        total = total + F.when(F.coalesce(condition, F.lit(False)), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return total


def _place(name: Column, i: Column) -> Column:
    return F.concat(name, F.lit("["), i.cast("string"), F.lit("]"))


def _choice(part: str) -> Column:
    """Part of the slot of the one top-level field with a value set."""
    return F.get(F.array(*[_slot(part, i) for i in SLOTS]), choice_slot())


#: Outcomes of a value set: nothing to check, a pass, a failure.
NONE, PASSED, FAILED = 0, 1, 2


def _against(present: Column, passes: Column) -> Column:
    passes = F.coalesce(passes, F.lit(False))
    return F.when(~present, F.lit(NONE)).when(passes, F.lit(PASSED)).otherwise(F.lit(FAILED))


def check_masks() -> dict[str, Column]:
    """The outcomes of an inspected answer.

    ``_applies`` and ``_passes`` (C1-C3) have a bit per field check; ``_items``
    (C4) is per member a bit for each key that holds, or -1 if it is no object;
    ``_choice`` (C6) and ``_choices`` (C7, per member) are outcomes of value sets.
    """
    checks = field_checks()
    applies = _bits([c[0] for c in checks])
    passes = _bits([F.coalesce(c[0], F.lit(False)) & c[1] for c in checks])

    def held(m: Column, k: int) -> Column:
        value, listed = m[f"key{k}"], holds_lists(k)
        plain = truthy(value)
        return plain if listed is None else F.when(listed, truthy(value, often_list=True)).otherwise(plain)

    def keys_held(m: Column) -> Column:
        return _bits([held(m, k) for k in range(MAX_ITEM_NAMES)])

    items = F.transform("_keyed", lambda m: F.when(m.isNull(), F.lit(-1).cast("long")).otherwise(keys_held(m)))
    kind, allowed = _choice("kind"), choice_rule()[1]
    key = item_choice()

    def member_choice(m: Column) -> Column:
        value = m["choice"]
        return _against(value.isNotNull(), is_string(value) & in_item_choice(as_string(value)))

    none = F.array()
    return {
        "_applies": applies,
        "_passes": passes,
        "_held": F.when(item_list().isNotNull(), items).otherwise(none.cast("array<bigint>")),
        "_choice": _against(kind.isNotNull(), (kind == "str") & F.array_contains(allowed, _choice("text"))),
        "_choices": F.when(key.isNotNull(), F.transform("_keyed", member_choice)).otherwise(none.cast("array<int>")),
    }


def _sum(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, v: total + term(v))


def check_counts() -> dict[str, Column]:
    """Checks that apply and that pass, counted from the masks."""
    held, choices = F.col("_held"), F.col("_choices")
    keys = F.coalesce(F.array_size(item_names()), F.lit(0))
    several = _sum(choices, lambda v: F.when(v == NONE, F.lit(0)).otherwise(F.lit(1)))
    right = _sum(choices, lambda v: F.when(v == PASSED, F.lit(1)).otherwise(F.lit(0)))
    return {
        "schema_checks": F.bit_count("_applies") + _sum(held, lambda m: F.when(m < 0, F.lit(1)).otherwise(keys)),
        "schema_passes": F.bit_count("_passes") + _sum(held, lambda m: F.when(m < 0, F.lit(0)).otherwise(F.bit_count(m))),
        "enum_checks": (F.col("_choice") != NONE).cast("int") + several,
        "enum_passes": (F.col("_choice") == PASSED).cast("int") + right,
    }


def schema_notes() -> Column:
    """The failed schema checks of a row, in order."""
    failed = F.col("_applies").bitwiseAND(F.bitwise_not("_passes"))
    fields = [F.when(failed.bitwiseAND(1 << k) != 0, c[2]) for k, c in enumerate(field_checks())]
    name, keys = item_list(), item_names()

    def member(m: Column, i: Column) -> Column:
        def lacking(key: Column, k: Column) -> Column:
            held = m.bitwiseAND(F.get(F.array(*[F.lit(1 << b) for b in range(MAX_ITEM_NAMES)]), k).cast("long")) != 0
            return F.when(~held, F.concat(F.lit("item:"), _place(name, i), F.lit("."), key))

        whole = F.array(F.concat(F.lit("item:"), _place(name, i), F.lit(" not-object")))
        return F.when(m < 0, whole).otherwise(F.transform(keys, lacking))

    items = F.when(name.isNotNull(), F.flatten(F.transform("_held", member))).otherwise(F.array().cast("array<string>"))
    return F.array_compact(F.concat(F.array(*fields), items))


def enum_notes() -> Column:
    """The values outside their sets, in order.

    A contract has at most one top-level field with a value set.
    """
    kind, text, (name, _) = _choice("kind"), _choice("text"), choice_rule()
    shown = F.when(kind == "str", quoted(text)).otherwise(text)
    top = F.when(F.col("_choice") == FAILED, F.concat(F.lit("enum:"), name, F.lit("="), shown))
    listed, key = item_list(), item_choice()

    def member(outcome: Column, i: Column) -> Column:
        value = F.element_at(F.get("members", i), key)
        path = F.concat(_place(listed, i), F.lit("."), key)
        shown = F.coalesce(shown_at(path), python_repr(F.to_json(value)))
        return F.when(outcome == FAILED, F.concat(F.lit("enum:"), path, F.lit("="), shown))

    return F.array_compact(F.concat(F.array(top), F.transform("_choices", member)))


# Placeholder text


def strings_of(doc: Column) -> Column:
    """Every string value of a JSON text at any depth, keys left out."""
    tokens = F.regexp_extract_all(doc, F.lit(JSON_STRING + r"(?:\s*:)?"), F.lit(0))
    values = F.filter(tokens, lambda t: ~t.endswith(":"))
    return F.transform(
        values, lambda t: F.when(t.contains("\\"), unquote_json(t)).otherwise(F.substr(t, F.lit(2), F.length(t) - 2))
    )


def walked_strings(doc: str = "doc", low_doc: str = "_low_doc") -> Column:
    """The normalized strings of a JSON text, if any of them can be padding."""
    low = F.transform(strings_of(F.col(doc)), filler.normalized)
    return F.when(filler.may_hold_hit(low_doc), low).otherwise(F.array().cast("array<string>"))


def clean_score(hits: Column) -> Column:
    """E4, from the different hits or their marks."""
    return F.greatest(F.lit(0.0), 1.0 - 0.25 * F.size(hits))


def filler_scan(df: DataFrame, text: str) -> DataFrame:
    """E5: the same detector over a plain text column; one row per hit.

    Adds ``label`` and ``rule`` (exact, or the position of the pattern).
    """
    df = df.withColumn("_low", settled(filler.normalized(F.col(text)))).where(filler.is_hit("_low"))
    return df.withColumns({"label": filler.hit_label("_low"), "rule": filler.hit_rule("_low")}).drop("_low")
