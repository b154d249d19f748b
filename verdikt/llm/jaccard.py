"""Exact n-gram Jaccard join through a token-group matrix.

1. Each text becomes the set of its word shingles (hashes). Texts with the same
   set form a class; from here on only classes count, so exact copies cost
   nothing more.
2. Classes are dealt into groups of similar ones: each to that of its first
   tokens that most classes have, in blocks of about ``BLOCK``. Within a block
   all pairs are compared in memory and what leaves the task is one row for each
   class that they join to a smaller one, never all pairs. One class per block
   and component then links the blocks of the same token.
3. The token-group matrix says which groups hold a token. Two sets with Jaccard
   similarity t or more share at least ``SHARED`` of the first
   ``n - ceil(t n) + SHARED`` tokens in any common order (all they must share,
   if that is less), so the matrix only holds those; tokens of very many
   classes come last in the order. A class opens a group of another class's
   only if it shares that many tokens with the group's union, the group has
   members of fitting size, and not all of them are in the class's component
   already. Opened groups are compared in blocks as before.
4. Components of all links.

No pair is missed: pairs inside a block are compared, others are bounded by
the union, which is never less than the pair's own overlap.

Sets are kept as 48-bit hashes, and a class is known by a 64-bit hash of its
set. Defined results: null text and text without words have an empty set, link
with nothing and are their own component; text with fewer words than a shingle
is one shingle; repeated ids fall together only if their texts link (and then
share the component's id anyway); a null id names a component only where there is
no other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdikt.llm import text as tx
from verdikt.llm.components import components
from verdikt.llm.rows import once, row_key, sent, without
from verdikt.llm.store import stored

#: Tokens that a pair must share among the first ones (see above).
SHARED = 20
#: Classes that are compared with each other in one task.
BLOCK = 256
#: Classes that a token must have, as seen in single tasks, to come last. The
#: order is free, so this changes the work and never the result.
COMMON = 200
#: Most tokens that come last: 8 MB, sent to every task.
MOST_COMMON = 1_000_000
WIDTH = 6  # bytes of a token


def _pack(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :WIDTH] = raw
    return wide.view("<u8").ravel()


def _shingles(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    data, offsets = tx.utf8(column)
    data = tx.LOWER[data]
    starts, ends, bounds = tx.words(data, offsets, tx.NOT_SPACE)
    word = tx.span_hash(tx.prefix_hash(data), starts, ends)
    factor = [np.uint64(pow(tx.MULTIPLIER, k + 1, 1 << 64)) for k in range(size)]
    run = np.zeros(max(len(word) - size + 1, 0), np.uint64)
    for k in range(size):
        run += word[k : k + len(run)] * factor[k]
    run = tx.mixed(run)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(run[a : b - size + 1])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for k in range(b - a):
                short = short + word[a + k : a + k + 1] * factor[k]
            yield tx.mixed(short)
        else:
            yield np.empty(0, np.uint64)


def _least_overlap(n: int, share: Fraction) -> int:
    """Tokens that a set of n shares with any set it links with, at least."""
    return -(-n * share.numerator // share.denominator)


def _first(n: int, share: Fraction) -> int:
    """How many tokens of a set stand in the matrix."""
    return n - _least_overlap(n, share) + SHARED


def _class(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _chosen(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def overview(source: DataFrame, size: int, share: Fraction) -> DataFrame:
    """One narrow pass over the texts. Rows with ``many`` null are texts with
    their class and set size; the others are tokens that three or more of a
    task's classes have among twice their first ones."""
    kind = source.schema["id"].dataType.simpleString()
    names = ["id", "class", "n", "token", "many"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total, seen, id_type = 0, set(), None

        def counted() -> pa.RecordBatch:
            token, many = np.unique(np.concatenate(held), return_counts=True)
            keep = many >= 3
            none = pa.nulls(int(keep.sum()), pa.int64())
            columns = [pa.nulls(int(keep.sum()), id_type), none, none, pa.array(token[keep].astype(np.int64)), pa.array(many[keep])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in tx.chunks(batches, "text"):
            classes, counts = [], []
            id_type = batch.column("id").type
            for found in _shingles(batch.column("text"), size):
                n = len(found)
                counts.append(n)
                classes.append(_class(found) if n else None)
                if n and classes[-1] not in seen:
                    seen.add(classes[-1])
                    held.append(found[: 2 * _first(n, share)] >> np.uint64(16))
                    total += len(held[-1])
            none = pa.nulls(len(counts), pa.int64())
            columns = [batch.column("id"), pa.array(classes, pa.int64()), pa.array(counts, pa.int64()), none, none]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if total > 2_000_000:
                yield counted()
                held, total, seen = [], 0, set()
        if held:
            yield counted()

    return source.mapInArrow(make, f"id {kind}, class long, n long, token long, many long")


def common_tokens(seen: DataFrame) -> np.ndarray:
    """Tokens of very many classes, by the counts of ``overview``.

    The threshold rises with the input so that the list stays below its bound.
    """
    counts = stored(seen.where("many is not null").groupBy("token").agg(F.sum("many").alias("many")), "counts")
    total = counts.agg(F.sum("many")).first()[0] or 0
    least = max(COMMON, total // MOST_COMMON + 1)
    rows = counts.where(F.col("many") >= least).select("token").toArrow()
    return np.sort(rows.column("token").to_numpy().astype(np.uint64))


def first_tokens(source: DataFrame, size: int, share: Fraction, common: np.ndarray) -> DataFrame:
    """``token, class, n``: the tokens of which a linked set shares enough."""
    last = source.sparkSession.sparkContext.broadcast(common)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in tx.chunks(batches, "text"):
            parts, kinds, sizes = [np.empty(0, np.uint64)], [], []
            for found in _shingles(batch.column("text"), size):
                if not len(found) or (key := _class(found)) in seen:
                    continue
                seen.add(key)
                tokens = found >> np.uint64(16)
                if len(last.value):
                    at = np.searchsorted(last.value, tokens)
                    at[at == len(last.value)] = 0
                    rare = last.value[at] != tokens
                    tokens = np.concatenate([tokens[rare], tokens[~rare]])
                parts.append(tokens[: _first(len(found), share)])
                kinds.append(key)
                sizes.append(len(found))
            counts = [len(p) for p in parts[1:]]
            columns = [
                pa.array(np.concatenate(parts).astype(np.int64)),
                pa.array(np.repeat(np.array(kinds, np.int64), counts)),
                pa.array(np.repeat(np.array(sizes, np.int64), counts)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "class", "n"])
            if len(seen) > 1_000_000:
                seen = set()

    return source.mapInArrow(make, "token long, class long, n long")


def sets(source: DataFrame, size: int) -> DataFrame:
    """The tokens of texts that stand for their class; rows whose text has
    another class (an id that repeats with other texts) are left out."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches, "text"):
            found = list(_shingles(batch.column("text"), size))
            keep = [k for k, (f, c) in enumerate(zip(found, batch.column("class").to_pylist(), strict=True)) if len(f) and _class(f) == c]
            rows = batch.take(pa.array(keep, pa.int64()))
            tokens = pa.array([_pack(found[k] >> np.uint64(16)) for k in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("class", "block", "n")] + [tokens], names=["class", "block", "n", "tokens"])

    return source.select("text", "class", "block", "n").mapInArrow(make, "class long, block long, n long, tokens binary")


class _Forest:
    """Union by least label."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, list]]:
    """Consecutive rows with the same key, as lists by column."""
    held: dict[str, list] | None = None
    for batch in batches:
        rows = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        keys, first = rows[key], 0
        for k in range(1, len(keys) + 1):
            if k < len(keys) and keys[k] == keys[first]:
                continue
            run = {c: v[first:k] for c, v in rows.items()}
            if held is not None and held[key][0] == run[key][0]:
                for c, v in run.items():
                    held[c].extend(v)
            else:
                if held is not None:
                    yield held
                held = run
            first = k
    if held is not None:
        yield held


def _overlaps(tokens: np.ndarray, owners: np.ndarray, many: int, query: np.ndarray) -> np.ndarray:
    """How many of the query's tokens each of ``many`` sets has; ``tokens`` is
    sorted, ``owners`` says whose each is."""
    low, high = np.searchsorted(tokens, query, "left"), np.searchsorted(tokens, query, "right")
    count = high - low
    total = np.cumsum(count)
    if not len(total) or total[-1] == 0:
        return np.zeros(many, np.int64)
    at = np.arange(total[-1]) + np.repeat(low - (total - count), count)
    return np.bincount(owners[at], minlength=many)


def _compared(run: dict[str, list], share: Fraction) -> list[tuple[int, int]]:
    """Component labels that links of a block join, each with the least label
    they are joined to: queries with members, and members with each other where
    no row is marked as a query."""
    member = [k for k, q in enumerate(run["query"]) if not q]
    query = [k for k, q in enumerate(run["query"]) if q]
    inner = not query
    sets_ = {k: _unpack(run["tokens"][k]) for k in member}
    if not member:
        return []
    owners = np.repeat(np.arange(len(member)), [len(sets_[k]) for k in member])
    tokens = np.concatenate([sets_[k] for k in member])
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    sizes = np.array([run["n"][k] for k in member])
    forest = _Forest()
    for place, k in enumerate(member if inner else query):
        n, label = run["n"][k], run["component"][k]
        both = _overlaps(tokens, owners, len(member), sets_[k] if inner else _unpack(run["tokens"][k]))
        linked = both * share.denominator >= (n + sizes - both) * share.numerator
        if inner:
            linked[place:] = False
        for m in np.flatnonzero(linked).tolist():
            forest.join(label, run["component"][member[m]])
    return [(label, forest.root(label)) for label in forest.up]


def _links(rows: DataFrame, share: Fraction) -> DataFrame:
    """Compare rows ``block, component, n, tokens, query`` block by block:
    ``a, b``, a label and the least one that the block joins it to."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "block"):
            if found := _compared(run, share):
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = rows.select("block", "component", "n", "tokens", "query")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(compare, "a long, b long")


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``block``: rows with the same key, at most about BLOCK of them."""
    many = rows.groupBy(key).agg(F.count("*").alias("_many"))
    deal = F.pmod(F.xxhash64("class"), F.ceil(F.col("_many") / BLOCK))
    return rows.join(many, key).withColumn("block", F.xxhash64(F.col(key), deal)).drop("_many")


def _relabelled(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """``component`` replaced by what ``joined(a, b)`` joins it to, if anything."""
    to = joined.select(F.col("a").alias("component"), F.col("b").alias("_to"))
    return rows.join(to, "component", "left").withColumn("component", F.coalesce("_to", "component")).drop("_to")


def _mixed(rows: DataFrame, kind: str) -> DataFrame:
    """The rows of tokens that stand in more than one ``kind``; ``many`` is how
    many rows have the token."""
    alike = Window.partitionBy("token")
    found = {"_low": F.min(kind).over(alike), "_high": F.max(kind).over(alike), "many": F.count("*").over(alike)}
    return rows.drop("many").withColumns(found).where("_low < _high").drop("_low", "_high")


def _enough(n: Column, share: Fraction) -> Column:
    """How many of its first tokens a set shares with any it links with."""
    return F.least(F.lit(SHARED), F.ceil(n * share.numerator / share.denominator))


def _opened(matrix: DataFrame, share: Fraction) -> DataFrame:
    """``class, block`` for each block whose union may hold a linked set.

    ``matrix`` has a row per class and token, with the class's block and
    component. A block with classes in several components counts for all.
    """
    t = float(share)
    unions = matrix.groupBy("token", "block").agg(
        F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.min("component").alias("c_low"), F.max("component").alias("c_high")
    )
    near = (F.col("u.n_high") >= F.floor(F.col("q.n") * t)) & (F.col("u.n_low") <= F.ceil(F.col("q.n") / t))
    other = (F.col("u.c_low") != F.col("q.component")) | (F.col("u.c_high") != F.col("q.component"))
    shared = matrix.alias("q").join(unions.alias("u"), "token").where((F.col("q.block") < F.col("u.block")) & near & other)
    shared = shared.groupBy(F.col("q.class").alias("class"), F.col("u.block").alias("block"), F.col("q.n").alias("n"))
    return shared.agg(F.count("*").alias("both")).where(F.col("both") >= _enough(F.col("n"), share)).select("class", "block")


def _meetings(opened: DataFrame, active: DataFrame) -> DataFrame:
    """Rows for ``_links``: each block's members with the classes that open it,
    in parts of about four times BLOCK of these."""
    many = opened.groupBy("block").agg(F.ceil(F.count("*") / (4 * BLOCK)).alias("parts"))
    deal = F.pmod(F.xxhash64("class"), F.col("parts"))
    queries = opened.join(many, "block").select("class", F.xxhash64("block", deal).alias("to"))
    queries = queries.join(active, "class").withColumn("query", F.lit(True))
    members = active.join(many, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    members = members.withColumn("to", F.xxhash64("block", "part")).withColumn("query", F.lit(False))
    columns = [F.col("to").alias("block"), "class", "component", "n", "tokens", "query"]
    return queries.select(*columns).unionByName(members.select(*columns))


def similar(docs: DataFrame, id_col: str, text_col: str, size: int = 5, share: Fraction = Fraction(4, 5)) -> DataFrame:
    """``id, n, component``: set size, and the least id reachable by links; null
    where only rows without an id are."""
    source = _chosen(docs, id_col, text_col)
    if source.where("id is null").isEmpty():
        return _similar(source, size, share)
    # Rows are fetched by their id: those without get a mark of their text, and
    # come after all others.
    none = F.col("id").isNull()
    key = F.struct(none.alias("none"), F.col("id").alias("id"), F.when(none, F.xxhash64("text")).alias("mark"))
    found = _similar(source.withColumn("id", key), size, share)
    return found.select(F.col("id")["id"].alias("id"), "n", F.col("component")["id"].alias("component"))


def _similar(source: DataFrame, size: int, share: Fraction) -> DataFrame:
    seen = stored(overview(source, size, share), "overview")
    texts = seen.where("many is null").drop("many")
    common = common_tokens(seen)
    classes = texts.where("n > 0").groupBy("class").agg(F.min("id").alias("id"), F.first("n").alias("n"))

    # Tokens of one class alone link nothing; most are. Nor does a class with
    # too few of the others.
    first = stored(_mixed(first_tokens(source, size, share, common), "class").distinct(), "first")
    may = first.groupBy("class", "n").agg(F.count("*").alias("both")).where(F.col("both") >= _enough(F.col("n"), share))
    first = stored(_mixed(first.join(may.select("class"), "class", "left_semi"), "class"), "first")

    # Sets of the classes that may link, in blocks.
    # A class goes where most of its like are: to the token that most have, the
    # least of equals.
    popular = F.least("many", F.lit((1 << 15) - 1)) * (1 << 48) - F.col("token")
    may = first.groupBy("class", "n").agg(F.count("*").alias("both"), F.max_by("token", popular).alias("token"))
    may = may.where(F.col("both") >= _enough(F.col("n"), share)).select("class", "token")
    dealt = stored(_blocks(classes.join(may, "class"), "token"), "dealt")
    active = stored(sets(source.join(sent(dealt.select("id", "class", "block", "n")), "id"), size), "active")
    crowded = dealt.groupBy("block").agg(F.count("*").alias("_many")).where("_many > 1").select("block")
    inner = active.join(sent(crowded), "block", "left_semi").withColumns({"component": F.col("class"), "query": F.lit(False)})
    # A class is in one block, so what a block joins are whole components yet.
    own = dealt.select("class", "token", "block", F.col("class").alias("component"))
    own = stored(_relabelled(own, _links(inner, share)), "own")

    # One class of each component in a block ties the blocks of a token.
    heads = own.withColumn("_rank", F.row_number().over(Window.partitionBy("block", "component").orderBy("class")))
    heads = heads.where("_rank = 1").drop("_rank")
    several = heads.groupBy("token").agg(F.count_distinct("block").alias("_blocks")).where("_blocks > 1").select("token")
    heads = stored(_blocks(heads.drop("block").join(several, "token", "left_semi"), "token"), "heads")
    tied = active.drop("block").join(sent(heads.select("class", "component", "block")), "class").withColumn("query", F.lit(False))
    members = stored(_relabelled(own.drop("token"), _links(tied, share)), "members")

    # The matrix, without tokens that are in one component only.
    matrix = stored(_mixed(first.join(members, "class"), "component"), "matrix")
    opened = stored(_opened(matrix, share), "opened")
    needed = opened.select("class").unionByName(members.join(opened.select("block").distinct(), "block", "left_semi").select("class")).distinct()
    needed = stored(needed.join(members.select("class", "component"), "class"), "needed")
    meetings = _meetings(opened, active.join(sent(needed), "class"))
    joined = components(_links(meetings, share)).select(F.col("node").alias("a"), F.col("component").alias("b"))

    # The least id of each component, for every text.
    kinds = classes.select("class", "id").join(_relabelled(members.drop("block"), joined), "class", "left")
    kinds = kinds.withColumn("component", F.coalesce("component", "class"))
    least = kinds.groupBy("component").agg(F.min("id").alias("least"))
    kinds = kinds.join(least, "component").select("class", "least")
    return texts.join(kinds, "class", "left").select("id", "n", F.coalesce("least", "id").alias("component"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of linked texts.

    The row with the least id stays (of several texts with that id the one with
    the least key). Texts without a word are linked with nothing and stay.
    """
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key")).alias("row"), F.col(text_col).alias("text"))
    found = stored(similar(keyed, "row", "text", size, share).where("n > 0"), "groups")
    others = found.where(F.col("id") != F.col("component")).select("id.key")
    repeated = found.where(F.col("id") == F.col("component")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id.key")
    kept = without(docs, others, id_col, text_col)
    repeated = stored(repeated, "repeated")
    return kept if repeated.isEmpty() else once(kept, repeated, id_col, text_col)
