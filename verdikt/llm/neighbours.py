"""Give every row the text of its neighbour in the order of ids, in parallel.

The order is cut into ranges of bounded bytes. A first pass over ids and marks
finds the last key of each range; these keys, one per range, are all that the
driver holds. In the second pass every row goes to its range, and the last row
of a range goes to the next range as well, as a guest that only lends its text.
So no window runs over the whole table and texts are dealt once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from verdikt.llm import text as tx

#: Bytes of text in a range, and in what a task sorts.
RANGE, TASK = 8 << 20, 24 << 20
#: Bytes of text that are looked at together.
CHUNK = 1 << 20
LEAST = -(1 << 63)


def ranges_of(keys: np.ndarray, marks: np.ndarray, last: list[tuple[int, int]]) -> np.ndarray:
    """The range of each (key, mark): the first whose last one is not below it."""
    ends = np.array([k for k, _ in last], np.int64)
    ties = np.array([m for _, m in last], np.int64)
    found = np.searchsorted(ends, keys, "left")
    high = np.searchsorted(ends, keys, "right")
    # Only keys that end a range; several ranges end with one if it is repeated.
    for a in np.unique(found[found < high]):
        same = np.flatnonzero((found == a) & (found < high))
        found[same] = a + np.searchsorted(ties[a : high[same[0]]], marks[same], "left")
    return np.minimum(found, len(last) - 1)


def beside_the_one_before(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    make: Callable[[pa.Array, pa.Array, np.ndarray], pa.RecordBatch],
    schema: T.StructType,
    range_bytes: int = RANGE,
) -> DataFrame:
    """Rows that ``make(ids, texts, own)`` returns for runs of rows in ascending
    order of their ids.

    ``texts`` has one text more than ``ids``: ``texts[i + 1]`` is the text of
    row i and ``texts[i]`` that of the row before it; the row before the first
    of all is the last. ``make`` returns the rows of which ``own`` is true.
    Ids are whole numbers; null comes before all, equal ids are in the order of
    a hash of their texts. Null texts count as empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST).cast("long"))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), key.alias("key"), F.xxhash64(text).alias("mark"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    ranged = rows.select("key", "mark").repartitionByRange(max(1, -(-total // range_bytes)), "key", "mark")
    ends = ranged.groupBy(F.spark_partition_id().alias("range")).agg(F.max(F.struct("key", "mark")).alias("end"))
    last = sorted({(r.end.key, r.end.mark) for r in ends.collect()}) or [(0, 0)]
    held = rows.sparkSession.sparkContext.broadcast(last)

    @F.pandas_udf("array<struct<range:int,own:boolean>>")
    def places(keys: pd.Series, marks: pd.Series) -> pd.Series:
        keys, marks, ends = keys.to_numpy(), marks.to_numpy(), held.value
        found = ranges_of(keys, marks, ends)
        out = []
        for k, m, r in zip(keys.tolist(), marks.tolist(), found.tolist(), strict=True):
            out.append([{"range": r, "own": True}])
            if (k, m) == ends[r]:
                out[-1].append({"range": (r + 1) % len(ends), "own": False})
        return pd.Series(out)

    dealt = rows.withColumn("place", F.explode(places("key", "mark"))).select("id", "text", "key", "mark", "place.range", "place.own")
    dealt = dealt.repartition(max(1, -(-total // TASK)), "range").sortWithinPartitions("range", "own", "key", "mark")
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = ""
        for batch in tx.chunks(batches, "text", CHUNK):
            texts = batch.column("text")
            texts = pa.concat_arrays([pa.array([before], texts.type), texts])
            made = make(batch.column("id"), texts, batch.column("own").to_numpy(zero_copy_only=False))
            if made.num_rows:
                yield made.cast(arrow)
            before = texts[-1].as_py()

    return dealt.select("id", "text", "own").mapInArrow(run, schema)
