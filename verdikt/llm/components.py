"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.llm.store import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    tied = both.where("b > a").join(least, "a")
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    tied = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b")))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


#: Links that one task writes; tables of links shrink from round to round.
PART = 500_000


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is
    its least node. Links to itself are dropped, repeats do no harm. The number
    of rounds grows with the logarithm of the longest path."""
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = stored(ordered, "links")
    mark = _mark(state)
    while mark[0]:
        parts = mark[0] // PART + 1
        state = stored(_small_star(_large_star(state.coalesce(parts))).distinct().coalesce(parts), "links")
        after = _mark(state)
        if after == mark:
            break
        mark = after
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
