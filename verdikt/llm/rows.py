"""Keep or drop rows of a table by results that were found for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a side that may be sent to every task: some megabytes.
SENT = 100_000


def sent(rows: DataFrame) -> DataFrame:
    """Rows to join with a larger table: broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else rows


def free(*frames: DataFrame) -> str:
    """A beginning for names of helper columns that no column of ``frames`` has."""
    names = [c.lower() for df in frames for c in df.columns]
    prefix = "_x_"
    while any(n.startswith(prefix) for n in names):
        prefix = "_" + prefix
    return prefix


def row_key(id_col: str, text_col: str) -> Column:
    """A key of a row: its id, and a mark that tells texts of one id apart."""
    text = F.col(text_col).cast("string")
    mark = F.concat_ws("/", F.octet_length(text).cast("string"), F.hex(F.xxhash64(text)))
    return F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), mark)


def without(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``keys(key)``."""
    key = free(docs) + "key"
    marked = docs.withColumn(key, row_key(id_col, text_col))
    gone = sent(keys.select(F.col("key").alias(key)).distinct())
    return marked.join(gone, key, "left_anti").drop(key)


def once(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with rows whose key is in ``keys`` left only once each."""
    key = free(docs) + "key"
    marked = docs.withColumn(key, row_key(id_col, text_col))
    these = sent(keys.select(F.col("key").alias(key)).distinct())
    single = marked.join(these, key, "left_semi").dropDuplicates([key])
    return marked.join(these, key, "left_anti").unionByName(single).drop(key)
