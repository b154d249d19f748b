"""Merkle manifest of a table, with a version of the tree per tampered row.

Every row is a leaf. Inside a group (a source) the leaves ascend by id, and
every 16 consecutive nodes become one, until one is left: the group's subroot.
The subroots, in order of their groups, make the root in the same way.

On Spark: leaves are hashed where their rows are read, and only id and digest
move. ``numbered`` gives each leaf its place in its group: rows are dealt by
ranges of (group, id), counted per range, and the counts of the ranges before
are added, so that a group of any size is spread over many tasks. Places are
cut into aligned blocks of 4,096 leaves, the most that one task holds of a
group at a time; a block's root is a leaf of the level of blocks above. Paths
come down the same levels: a block's own path from its root to the table's
root is joined to the block, a row for 4,096 leaves.

A tampered leaf makes a version of its block's tree: nodes are only ever added
(``Nodes``), a version copies the leaf's ancestors and shares everything else,
and its new block root is carried on along the block's upper path, in the task
of the block. No version is held beside another one's upper levels, so that
millions of versions of one group are as many short paths.

Defined results: a null value of a column is `-`; null groups are one group,
before all others; rows with a null id come first in their group, rows of
equal id in order of their digests; a group of one leaf has it as subroot; an
empty table has no rows and no root. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from verdikt.llm.rows import sent
from verdikt.llm.store import stored

#: Children of a node, levels of a block, leaves of a block.
FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS

PATH = T.ArrayType(T.StructType().add("left", T.StringType()).add("right", T.StringType()))


def digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def leaf(values: list[Column]) -> Column:
    """Digest of a row's values, each with its length before it."""
    texts = [v.cast("string") for v in values]
    marked = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*marked).cast("binary"), 256)


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Nodes:
    """A block's tree in all its versions: nodes are added, never changed.

    A version is the number of its root. ``levels`` counts from the leaves; a
    lone node below the top still becomes a node of its own on every level.
    """

    def __init__(self, leaves: list[bytes], levels: int) -> None:
        self.levels = levels
        self.digests = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        row = list(range(len(leaves)))
        for _ in range(levels):
            row = [self._add(tuple(row[k : k + FAN])) for k in range(0, len(row), FAN)]
        (self.root,) = row

    def _add(self, children: tuple[int, ...]) -> int:
        self.children.append(children)
        self.digests.append(digest(b"".join([self.digests[c] for c in children])))
        return len(self.digests) - 1

    def path(self, root: int, place: int) -> list[tuple[int, int]]:
        """From a version's root down: a node, and which child leads to ``place``."""
        steps, node = [], root
        for level in range(self.levels - 1, -1, -1):
            child = place // FAN**level % FAN
            steps.append((node, child))
            node = self.children[node][child]
        return steps

    def siblings(self, root: int, place: int) -> list[tuple[bytes, bytes]]:
        """From the leaf up: the digests before and behind on each level."""
        found = []
        for node, child in reversed(self.path(root, place)):
            row = [self.digests[c] for c in self.children[node]]
            found.append((b"".join(row[:child]), b"".join(row[child + 1 :])))
        return found

    def replaced(self, root: int, place: int, changed: bytes) -> int:
        """The version in which one leaf has another digest."""
        self.children.append(())
        self.digests.append(changed)
        node = len(self.digests) - 1
        for old, child in reversed(self.path(root, place)):
            row = self.children[old]
            node = self._add((*row[:child], node, *row[child + 1 :]))
        return node


def folded(value: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The digest at a path's upper end."""
    for left, right in path:
        value = digest(left + value + right)
    return value


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``place``, from 0 in each ``part`` in the order of other columns,
    and ``n``, the rows of the part."""
    schema = T.StructType([*rows.schema.fields]).add("task", T.IntegerType()).add("at", T.LongType())
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            parts = batch.column("part")
            if not len(parts):
                continue
            new = np.ones(len(parts), bool)
            new[1:] = pc.not_equal(parts[1:], parts[:-1]).to_numpy(zero_copy_only=False)
            first = parts[0].as_py()
            new[0] = first != last
            begins = np.maximum.accumulate(np.where(new, np.arange(len(parts)), -1))
            at = np.arange(len(parts)) - np.maximum(begins, 0) + np.where(begins < 0, seen, 0)
            last, seen = parts[-1].as_py(), int(at[-1]) + 1
            numbers = [pa.array(np.full(len(parts), task, np.int32)), pa.array(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers], schema=arrow)

    ranged = rows.repartitionByRange("part", *order).sortWithinPartitions("part", *order)
    kept = stored(ranged.mapInArrow(count, schema), "numbered")
    # A row per range and part: what one window sees of a part is as many rows
    # as the part has ranges.
    counts = kept.groupBy("part", "task").agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("part")
    before = F.sum("rows").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("part", "task", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"))
    placed = kept.join(sent(counts), ["part", "task"])
    return placed.select(*rows.columns, (F.col("before") + F.col("at")).alias("place"), "n")


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("place") / BLOCK).cast("long"))


def _tree(table: pa.Table, digests: str = "digest") -> tuple[pa.Table, Nodes]:
    table = table.sort_by("place")
    leaves = [d.encode() for d in table.column(digests).to_pylist()]
    return table, Nodes(leaves, min(LEVELS, height(table.column("n")[0].as_py())))


ROOTS = T.StructType().add("part", T.StringType()).add("place", T.LongType()).add("digest", T.StringType()).add("n", T.LongType())


def _roots(blocks: DataFrame) -> DataFrame:
    """Each block's root, placed among the blocks of its part."""

    def root(table: pa.Table) -> pa.Table:
        table, nodes = _tree(table)
        row = table.slice(0, 1).to_pylist()[0]
        above = -(-row["n"] // BLOCK)
        return pa.Table.from_pylist(
            [{"part": row["part"], "place": row["block"], "digest": nodes.digests[nodes.root].decode(), "n": above}], schema=_arrow(ROOTS)
        )

    kept = blocks.select("part", "block", "place", "digest", "n")
    return kept.groupBy("part", "block").applyInArrow(root, ROOTS)


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])


STEPS = T.StructType().add("part", T.StringType()).add("place", T.LongType()).add("block", T.LongType()).add("path", PATH)


def _steps(blocks: DataFrame) -> DataFrame:
    """Each node's path to the root of its block."""

    def steps(table: pa.Table) -> pa.Table:
        table, nodes = _tree(table)
        rows = table.select(["part", "place", "block"]).to_pylist()
        for k, row in enumerate(rows):
            row["path"] = [{"left": a.decode(), "right": b.decode()} for a, b in nodes.siblings(nodes.root, k)]
        return pa.Table.from_pylist(rows, schema=_arrow(STEPS))

    return blocks.groupBy("part", "block").applyInArrow(steps, STEPS)


def paths(nodes: DataFrame) -> DataFrame:
    """``part, place, path, root`` of ``nodes(part, place, digest, n)``: the
    way from each node to its part's root, through levels of blocks."""
    if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
        return nodes.select("part", "place", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    blocks = _in_blocks(nodes)
    above = paths(stored(_roots(blocks), "roots"))
    above = above.select("part", F.col("place").alias("block"), F.col("path").alias("upper"), "root")
    joined = _steps(blocks).join(above, ["part", "block"])
    return joined.select("part", "place", F.concat("path", "upper").alias("path"), "root")


class Leaves(NamedTuple):
    """Placed leaves, and a row per block with its way to the table's root."""

    rows: DataFrame
    blocks: DataFrame


def tree(docs: DataFrame, columns: list[str], group_col: str, id_col: str, tampered: dict[str, Column] | None = None, when: Column | None = None) -> Leaves:
    """The tree over the rows of ``docs``, a leaf from the values of ``columns``.

    ``tampered`` replaces columns in the rows for which ``when`` holds; their
    leaves are kept beside the true ones, for ``proven``.
    """
    values = [F.col(c) for c in columns]
    changed = leaf([(tampered or {}).get(c, F.col(c)) for c in columns])
    # A name of its own before all groups that have one.
    part = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))
    apart = F.when(F.lit(False) if when is None else when, changed)
    rows = docs.select(part.alias("part"), F.col(id_col).alias("id"), leaf(values).alias("digest"), apart.alias("changed"))
    rows = stored(_in_blocks(numbered(rows, ["id", "digest", "changed"])), "leaves")
    within = paths(stored(_roots(rows), "roots"))
    within = stored(within.select("part", F.col("place").alias("block"), "path", F.col("root").alias("subroot")), "within")
    # The subroots are the leaves of one more tree.
    groups = within.where("block = 0").select(F.lit("").alias("part"), F.col("part").alias("group"), F.col("subroot").alias("digest"))
    groups = numbered(groups, ["group"])
    over = groups.join(paths(groups.drop("group")), ["part", "place"])
    over = over.select(F.col("group").alias("part"), F.col("path").alias("over"), "root")
    joined = within.join(sent(over), "part")
    return Leaves(rows, joined.select("part", "block", F.concat("path", "over").alias("path"), "subroot", "root"))


def proven(leaves: Leaves) -> DataFrame:
    """Each leaf with its proof, and what its version's path leads to.

    ``id, leaf, subroot, root``; ``proof_sha256``, the digest of its siblings
    from the leaf up; ``folded_root``, reached from the tampered leaf (else the
    true one) along the siblings; ``verified``, whether that is the root.
    """
    schema = T.StructType([T.StructField("id", leaves.rows.schema["id"].dataType)])
    for name in ["leaf", "subroot", "root", "proof_sha256", "folded_root"]:
        schema = schema.add(name, T.StringType())
    schema = schema.add("verified", T.BooleanType())

    def prove(rows: pa.Table, block: pa.Table) -> pa.Table:
        rows, nodes = _tree(rows)
        above = block.to_pylist()[0]
        upper = [(s["left"].encode(), s["right"].encode()) for s in above["path"]]
        behind = b"".join([a + b for a, b in upper])
        proofs, reached = [], []
        whole = folded(nodes.digests[nodes.root], upper)
        for k, changed in enumerate(rows.column("changed").to_pylist()):
            near = b"".join([a + b for a, b in nodes.siblings(nodes.root, k)])
            proofs.append(sha256(near + behind).hexdigest())
            if changed is None:
                reached.append(whole.decode())
            else:
                version = nodes.replaced(nodes.root, k, changed.encode())
                reached.append(folded(nodes.digests[version], upper).decode())
        n = len(rows)
        values = [rows.column("id").combine_chunks(), rows.column("digest").combine_chunks()]
        values += [pa.array([above[c]] * n, pa.string()) for c in ("subroot", "root")]
        values += [pa.array(proofs, pa.string()), pa.array(reached, pa.string())]
        values.append(pa.array([r == above["root"] for r in reached], pa.bool_()))
        return pa.Table.from_arrays(values, schema=_arrow(schema))

    left, right = leaves.rows.groupBy("part", "block"), leaves.blocks.groupBy("part", "block")
    return left.cogroup(right).applyInArrow(prove, schema)
