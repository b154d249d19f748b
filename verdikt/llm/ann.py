"""Nearest neighbours by collision counting over sorted projections.

Vectors are dealt over shards of about ``SHARD`` rows. In a shard each of
``PROJECTIONS`` random directions has one sorted array of the vectors' inner
products with it. For a query and a radius R every array opens a window of
``WIDTH * R`` around the query's own projection; a vector that falls into the
windows of at least ``threshold`` directions is verified with its exact
distance. While fewer than k verified vectors lie within R, R grows by
``GROWTH`` and the windows with it (virtual rehashing). The vectors nearest
along a few directions bound the k-th distance; R starts ``STEPS`` steps below.

A vector within R falls into a window with the probability ``P_NEAR`` at least,
so the number of its collisions is binomial and the threshold is the
``MISSED`` quantile of it: each true neighbour is missed with that probability
at most. There is no limit on candidates. Each shard gives its k nearest for
each query and a ranking over these few rows ends the search.

Defined results: vectors that are null, empty, zero or hold null, NaN or
infinite components take no part, neither as queries nor as candidates;
vectors of different lengths are not compared; a query's own row is any row
with its id; equal distances go to the smaller id, repeated rows are ranked
one after the other; if there are fewer than k candidates all come. A query
that repeats is asked once; one id with several vectors is asked for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD = 16_384
#: Queries that meet a shard at a time.
QUERIES = 2_048
PROJECTIONS = 48
WIDTH = 2.0
GROWTH = 1.2
STEPS = 3
MISSED = 0.005
#: P(|N(0, 1)| <= WIDTH / 2): a vector at distance R falls into a window.
P_NEAR = math.erf(WIDTH / 2 / math.sqrt(2))


def threshold(m: int = PROJECTIONS, p: float = P_NEAR, missed: float = MISSED) -> int:
    """The most collisions that a near vector fails to reach only that often."""
    total = 0.0
    for k in range(m + 1):
        total += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if total > missed:
            return k
    return m


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` of the vectors that take part."""
    chosen = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return chosen.where(F.col("vector").isNotNull() & F.col("id").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))


class _Index:
    """One sorted array per direction over the vectors of a shard.

    The arrays stand one behind the other, each moved beyond the last, so that
    one search finds the places of a query in all of them.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        n, size = vectors.shape
        rng = np.random.Generator(np.random.PCG64(size))
        self.directions = rng.standard_normal((size, PROJECTIONS))
        projected = (vectors @ self.directions).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.order = order.ravel()
        self.low, self.high = projected.min(), projected.max()
        self.moved = np.arange(PROJECTIONS) * (self.high - self.low + 2) + 1
        self.rows = np.arange(PROJECTIONS) * n
        self.sorted = (np.take_along_axis(projected, order, 1) - self.low + self.moved[:, None]).ravel()
        self.least = threshold()

    def _places(self, at: np.ndarray, side: str) -> np.ndarray:
        """Where each direction's value stands in its array."""
        inside = np.clip(at, self.low - 0.5, self.high + 0.5) - self.low + self.moved
        return np.searchsorted(self.sorted, inside, side)

    def _far(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.vectors[places] - query) ** 2).sum(1))

    def nearest(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, own id left out."""
        n = len(self.ids)
        at = query @ self.directions
        seen = self.ids == own
        want = min(k, n - int(seen.sum()))
        found = np.full(n, np.inf)
        # The nearest along a few directions bound the distance of the k-th.
        place = self._places(at, "left")[:8]
        around = np.clip(place[:, None] + np.arange(-k, k + 1), self.rows[:8, None], self.rows[:8, None] + n - 1)
        first = np.unique(self.order[around])
        first = first[~seen[first]]
        if len(first) < want:
            first = np.flatnonzero(~seen)
        found[first] = self._far(first, query)
        seen[first] = True
        bound = np.partition(found, want - 1)[want - 1] if want else 0.0
        counts = np.zeros(n, np.int64)
        low = high = self._places(at, "left")
        for step in range(STEPS, -1, -1):
            radius = bound / GROWTH**step
            if not want:
                break
            half = WIDTH / 2 * radius
            wide_low = np.minimum(self._places(at - half, "left"), low)
            wide_high = np.maximum(self._places(at + half, "right"), high)
            # Only what the wider windows add.
            parts = [*zip(wide_low.tolist(), low.tolist(), strict=True), *zip(high.tolist(), wide_high.tolist(), strict=True)]
            counts += np.bincount(np.concatenate([self.order[a:b] for a, b in parts]), minlength=n)
            low, high = wide_low, wide_high
            fresh = np.flatnonzero((counts >= self.least) & ~seen)
            seen[fresh] = True
            found[fresh] = self._far(fresh, query)
            if np.count_nonzero(found <= radius) >= want:
                break
        best = np.flatnonzero(found < np.inf)
        best = best[np.lexsort((self.ids[best], found[best]))][:k]
        return self.ids[best], found[best]


def _cells(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Every shard beside every block of queries, as rows to be grouped.

    Shards and blocks have a bounded number of rows; a shard's rows are written
    once per block of queries and a block's once per shard.
    """
    size = F.size("vector").alias("size")
    shards = vectors.groupBy(size).agg(F.ceil(F.count("*") / SHARD).alias("shards"))
    blocks = queries.groupBy(size).agg(F.ceil(F.count("*") / QUERIES).alias("blocks"))
    # A row per length that vectors have: no more rows than the longest has components.
    grid = F.broadcast(shards.join(blocks, "size"))
    hashed = F.xxhash64("id", "vector")
    queries = queries.distinct()
    vectors = vectors.withColumn("size", size).join(grid, "size")
    vectors = vectors.withColumn("shard", F.pmod(F.xxhash64(hashed, F.monotonically_increasing_id()), "shards"))
    vectors = vectors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    queries = queries.withColumn("size", size).join(grid, "size").withColumn("block", F.pmod(hashed, "blocks"))
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    columns = ["size", "shard", "block", "id", "vector", hashed.alias("mark")]
    return vectors.select(*columns, F.lit(False).alias("query")).unionByName(queries.select(*columns, F.lit(True).alias("query")))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id, score`` of the k nearest to each query.

    Ids are integers; ``score`` is the Euclidean distance in double precision.
    """
    cells = _cells(usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col))
    schema = "query_id long, mark long, id long, score double"

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("query").to_numpy()
        ids = table.column("id").to_numpy().astype(np.int64)
        size = table.column("size")[0].as_py()
        values = table.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, size)
        marks = table.column("mark").to_numpy()[asks].tolist()
        own, mark, near, score = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if not asks.all():
            index = _Index(ids[~asks], values[~asks])
            for q, one, v in zip(ids[asks].tolist(), marks, values[asks], strict=True):
                found, far = index.nearest(q, v, k)
                own.append(np.full(len(found), q))
                mark.append(np.full(len(found), one))
                near.append(found)
                score.append(far)
        return pa.table({"query_id": np.concatenate(own), "mark": np.concatenate(mark), "id": np.concatenate(near), "score": np.concatenate(score)})

    found = cells.groupBy("size", "shard", "block").applyInArrow(search, schema)
    order = Window.partitionBy("query_id", "mark").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
