"""Typed views of VARIANT values.

A cast would turn 5 into '5', so the kind of a value is read from its schema.
``schema_of_variant`` walks nested values; lists are therefore recognised by
the cheaper list cast first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON texts of the values that count as false: null, false, zero, empty.
FALSY = r'^(?:null|false|""|\[\]|\{\}|-?0(?:\.0*)?(?:[eE][+-]?\d+)?)$'


def as_list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def as_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_objects(value: Column) -> Column:
    """A list whose object members become maps and whose others become null."""
    return F.try_variant_get(value, "$", "array<map<string,variant>>")


def key_count(members: Column) -> Column:
    """Number of keys of a map; null, whatever the session's mode, for null."""
    return F.array_size(F.map_keys(members))


def as_string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def kind_of(schema: str) -> Column:
    """Name of a JSON value's type, from the column holding its variant schema.

    A decimal without fraction digits is an integer too long for BIGINT when it
    has 19 or more digits, else a float such as 10.0 whose zeros were stripped.
    """
    return F.expr(
        f"""CASE WHEN {schema} = 'STRING' THEN 'str' WHEN {schema} LIKE 'ARRAY%' THEN 'list'
        WHEN {schema} LIKE 'OBJECT%' THEN 'dict' WHEN {schema} = 'BIGINT' THEN 'int'
        WHEN {schema} = 'BOOLEAN' THEN 'bool' WHEN {schema} = 'VOID' THEN 'NoneType'
        WHEN {schema} RLIKE '^DECIMAL[(](19|2[0-9]|3[0-9]),0[)]$' THEN 'int'
        WHEN {schema} IS NOT NULL THEN 'float' END"""
    )


def truthy(value: Column, often_list: bool = False) -> Column:
    """Python truth of a JSON value; a missing value is false.

    Most values are texts, and those are told by their kind alone. All false
    values have texts of at most five characters, so that few others are
    serialized. Where lists are to be expected, a first member settles them; on
    other values that look is slow, because a path that leads nowhere is an
    exception inside Spark.
    """
    truth = F.when(value.isNull(), F.lit(False))
    if often_list:
        truth = truth.when(F.try_variant_get(value, "$[0]", "variant").isNotNull(), F.lit(True))
    text = as_string(value)
    truth = truth.when(is_string(value), text != "").when(F.length(text) > 5, F.lit(True))
    return truth.otherwise(~F.to_json(value).rlike(FALSY))
