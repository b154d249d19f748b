"""Mix sources to target weights by pivotal dependent rounding.

Every source gets a target in words: its weight's share of all words, at most
``MOST`` times its own size, what is over going to the others by weight. A
document of a source with target / size = r is taken floor(r) times and once
more with the probability p = r - floor(r). Those probabilities are rounded
dependently: two fractional sides are paired and a random one of two transfers
moves mass (words x probability) between them until one side is integral. The
expected mass of both stays, their sum stays exactly.

The rounding runs as a reduction tree. Documents are dealt over blocks; in a
block each document, from the longest to the shortest, is paired with all that
are shorter, which still share one probability. A long document is so settled
at once, and what is left of a block is its shortest document, or a long one
where the shorter could not take its mass. These residuals are folded pairwise,
``FAN`` at a time, until each source has one, for which a coin is thrown. A
source's words miss its target by part of that document, and no task holds more
than a block.

DataFrame functions only. All randomness comes from hashes of the ids, the
seed and the level: reruns agree.

Defined results: null or empty text has size 0 and takes no part in the fold
(its copies are drawn alone and take no words); sources are ordered by code
point, null last, as a source of its own; rows with the same id, source and
size share one decision, as one unit of their joint mass; an empty table gives
an empty result; ids may be null. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdikt.llm.rows import free
from verdikt.llm.store import stored

MOST = 3
#: Weights by place in the order of sources, repeating.
WEIGHTS = (1, 2, 3)
#: Documents of a block: at least, and at most about.
LEAF = 64
LARGEST_LEAF = 1024
#: A block has so many times the words of its source's longest document, if the
#: bound above allows it.
ROOM = 16
FAN = 64
#: Sources up to this many are sent to every task (32 bytes each), more are joined.
SENT = 100_000
SPACE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Runs of ``[^\\x20\\x09-\\x0D]``: each word, with the gap before it,
    shrinks to one letter; only a gap at the end is left over."""
    one = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.rtrim(one, F.lit(SPACE))), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: a null source is one of its own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``key, source_size, target`` from ``key, source, size`` rows.

    Sources that stop at their limit are those with the least limit per weight:
    in that order, the common level of the others is found as a running sum.
    The order is over one row per source, not over documents.
    """
    each = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    each = each.withColumn("weight", weight).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("limit") / F.col("weight"), "key")
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - before) / rest
    each = each.withColumn("_level", level)
    common = F.max("_level").over(everything)
    return each.withColumn("target", F.least("limit", common * F.col("weight"))).select("key", "source_size", "target")


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.transform(F.array(value), body)[0]


def _pair(state: Column, new: Column, level: int, seed: int, kind: str) -> Column:
    """One step of the fold: the held fractional document against the next."""

    def transfer(t: Column) -> Column:
        a, b, p, q = state["held"]["mass"], new["mass"], state["held"]["p"], new["p"]
        # To the held document: it becomes 1, or the new one 0; else the reverse.
        up = t["u"] * (t["to_held"] + t["to_new"]) < t["to_new"]
        held = F.when(up, F.when(t["held_full"], 1.0).otherwise(F.least(p + t["to_held"] / a, F.lit(1.0)))).otherwise(
            F.when(t["held_empty"], 0.0).otherwise(F.greatest(p - t["to_new"] / a, F.lit(0.0)))
        )
        next_ = F.when(up, F.when(t["held_full"], F.greatest(q - t["to_held"] / b, F.lit(0.0))).otherwise(0.0)).otherwise(
            F.when(t["held_empty"], F.least(q + t["to_new"] / b, F.lit(1.0))).otherwise(1.0)
        )
        return F.struct(held.alias("held"), next_.alias("new"))

    def settle(r: Column) -> Column:
        held = state["held"].withField("p", r["held"])
        following = new.withField("p", r["new"])
        done = F.filter(F.array(held, following), lambda x: (x["p"] == 0) | (x["p"] == 1))
        left = F.filter(F.array(held, following), lambda x: (x["p"] > 0) & (x["p"] < 1))
        return F.struct(F.get(left, F.lit(0)).alias("held"), F.concat(state["out"], done).alias("out"))

    a, b, p, q = state["held"]["mass"], new["mass"], state["held"]["p"], new["p"]
    moves = F.struct(
        F.least(a * (1 - p), b * q).alias("to_held"),
        F.least(a * p, b * (1 - q)).alias("to_new"),
        (a * (1 - p) <= b * q).alias("held_full"),
        (a * p <= b * (1 - q)).alias("held_empty"),
        _uniform(F.lit(seed), F.lit(level), state["held"]["hash"], new["hash"]).alias("u"),
    )
    paired = _let(moves, lambda t: _let(transfer(t), settle))
    started = F.struct(new.alias("held"), state["out"].alias("out"))
    return F.when(state["held"].isNull(), started).otherwise(paired).cast(kind)


def _gathered(rows: DataFrame) -> DataFrame:
    """``key, block, units``: the units of a block, longest first."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("unit.mass")).alias("mass"), F.col("unit.hash").alias("hash"), "unit")))
    return rows.groupBy("key", "block").agg(ordered.alias("units"))


def _pooled(rows: DataFrame, seed: int) -> DataFrame:
    """``key, block, held, out`` of blocks whose units share one probability."""
    unit = rows.schema["unit"].dataType.simpleString()
    kind = f"struct<p:double,rest:double,held:{unit},out:array<{unit}>>"

    def step(state: Column, new: Column) -> Column:
        a, p = new["mass"], state["p"]

        def transfer(t: Column) -> Column:
            up = _uniform(F.lit(seed), F.lit("pool"), new["hash"]) * (t["to_new"] + t["to_pool"]) < t["to_pool"]
            own = F.when(up, F.when(t["full"], 1.0).otherwise(F.least(p + t["to_new"] / a, F.lit(1.0)))).otherwise(
                F.when(t["empty"], 0.0).otherwise(F.greatest(p - t["to_pool"] / a, F.lit(0.0)))
            )
            pool = F.when(up, F.when(t["full"], F.greatest(p - t["to_new"] / t["rest"], F.lit(0.0))).otherwise(0.0)).otherwise(
                F.when(t["empty"], F.least(p + t["to_pool"] / t["rest"], F.lit(1.0))).otherwise(1.0)
            )
            return F.struct(own.alias("own"), pool.alias("pool"), t["rest"].alias("rest"))

        def settle(r: Column) -> Column:
            made = new.withField("p", r["own"])
            whole = (r["own"] == 0) | (r["own"] == 1)
            held = F.when(whole, state["held"]).otherwise(made)
            out = F.when(whole, F.concat(state["out"], F.array(made))).otherwise(state["out"])
            return F.struct(r["pool"].alias("p"), r["rest"].alias("rest"), held.alias("held"), out.alias("out")).cast(kind)

        rest = state["rest"] - a
        moves = F.struct(
            F.least(a * (1 - p), rest * p).alias("to_new"),
            F.least(a * p, rest * (1 - p)).alias("to_pool"),
            (a * (1 - p) <= rest * p).alias("full"),
            (a * p <= rest * (1 - p)).alias("empty"),
            rest.alias("rest"),
        )
        # The pool may be integral, and the last unit has no one to pair with.
        alone = F.struct(p.alias("own"), p.alias("pool"), rest.alias("rest"))
        result = F.when((p == 0) | (p == 1) | (rest <= 0), alone).otherwise(_let(moves, transfer))
        return _let(result, settle)

    blocks = _gathered(rows)
    total = F.aggregate("units", F.lit(0.0), lambda n, x: n + x["unit"]["mass"])
    start = F.struct(
        F.col("units")[0]["unit"]["p"].alias("p"), total.alias("rest"), F.lit(None).cast(unit).alias("held"), F.array().cast(f"array<{unit}>").alias("out")
    ).cast(kind)
    state = F.aggregate("units", start, lambda s, x: step(s, x["unit"]))
    return blocks.select("key", "block", state.alias("s")).select("key", "block", "s.held", "s.out")


def _folded(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """``key, block, held, out``: a block's fractional rest and its decisions."""
    unit = rows.schema["unit"].dataType.simpleString()
    kind = f"struct<held:{unit},out:array<{unit}>>"
    start = F.struct(F.lit(None).cast(unit).alias("held"), F.array().cast(f"array<{unit}>").alias("out")).cast(kind)
    state = F.aggregate("units", start, lambda s, x: _pair(s, x["unit"], level, seed, kind))
    return _gathered(rows).select("key", "block", state.alias("s")).select("key", "block", "s.held", "s.out")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id, source, key, size`` of every row."""
    source = F.col(source_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), source.alias("source"), source_key(source).alias("key"), word_count(F.col(text_col).cast("string")).alias("size"))


def copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0
) -> DataFrame:
    """``id, key, size, rows, source_size, target, copies`` per unit: rows with
    the same id, source and size, of which each is taken ``copies`` times."""
    whole = stored(sized(docs, id_col, text_col, source_col), "sizes")
    aims = stored(targets(whole), "targets")
    many_sources = aims.limit(SENT + 1).count() > SENT
    aims = aims if many_sources else F.broadcast(aims)
    units = whole.groupBy("id", "key", "size").agg(F.count("*").alias("rows")).join(aims, "key")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    hashed = F.xxhash64(F.lit(seed), "id", "size")
    units = units.withColumn("base", F.floor(ratio).cast("int")).withColumn("p", ratio - F.floor(ratio)).withColumn("hash", hashed)

    fields = ["id", "size", "rows", "source_size", "target", "base", "p", "hash"]
    unit = F.struct(*fields, (F.col("size") * F.col("rows")).cast("double").alias("mass"))
    even = units.where((F.col("p") == 0) | (F.col("size") == 0))
    coin = (_uniform(F.lit(seed), F.lit("alone"), "hash") < F.col("p")).cast("int")
    decided = [even.select("key", "id", "size", "rows", "source_size", "target", (F.col("base") + coin).alias("copies"))]

    open_ = units.where((F.col("p") > 0) & (F.col("size") > 0))
    mass = F.col("size") * F.col("rows")
    leaf = F.least(F.greatest(ROOM * F.max(mass) / F.avg(mass), F.lit(LEAF)), F.lit(LARGEST_LEAF))
    blocks = open_.groupBy("key").agg(F.ceil(F.count("*") / leaf).alias("blocks"))
    widest = blocks.agg(F.max("blocks")).first()[0]
    rows = open_.join(blocks if many_sources else F.broadcast(blocks), "key")
    rows = rows.select("key", F.pmod(F.xxhash64(F.lit("block"), "hash"), "blocks").alias("block"), unit.alias("unit"))

    def taken(frame: DataFrame, extra: Column) -> DataFrame:
        return frame.select("key", "u.id", "u.size", "u.rows", "u.source_size", "u.target", (F.col("u.base") + extra).alias("copies"))

    level = 0
    while widest:
        done = stored(_folded(rows, level, seed) if level else _pooled(rows, seed), "level")
        decided.append(taken(done.select("key", F.explode("out").alias("u")), F.col("u.p").cast("int")))
        rest = done.where("held is not null")
        if widest == 1:
            last = rest.select("key", F.col("held").alias("u"))
            decided.append(taken(last, (_uniform(F.lit(seed), F.lit("last"), F.col("u.hash")) < F.col("u.p")).cast("int")))
            break
        rows = rest.select("key", F.floor(F.col("block") / FAN).alias("block"), F.col("held").alias("unit"))
        widest, level = -(-widest // FAN), level + 1
    result = decided[0]
    for more in decided[1:]:
        result = result.unionByName(more)
    return result


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as often as they are taken, with their columns."""
    decided = copies(docs, id_col, text_col, source_col, seed).where("copies > 0")
    x = free(docs)
    decided = decided.select(F.struct("id", "key", "size", "copies").alias(f"{x}decided"))
    own = F.struct(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("key"), word_count(F.col(text_col).cast("string")).alias("size"))
    same = F.col(f"{x}own.id").eqNullSafe(F.col(f"{x}decided.id"))
    same &= (F.col(f"{x}own.key") == F.col(f"{x}decided.key")) & (F.col(f"{x}own.size") == F.col(f"{x}decided.size"))
    joined = docs.withColumn(f"{x}own", own).join(decided, same)
    joined = joined.withColumn(f"{x}copy", F.explode(F.sequence(F.lit(1), F.col(f"{x}decided.copies"))))
    return joined.drop(f"{x}own", f"{x}decided", f"{x}copy")
