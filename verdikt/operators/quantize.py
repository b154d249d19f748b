"""Block-wise vector quantization, measured on vector tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 16 levels of 4-bit NormalFloat.
NF4 = [
    -1.0, -0.6961928009986877, -0.5250730514526367, -0.39491748809814453,
    -0.28444138169288635, -0.18477343022823334, -0.09105003625154495, 0.0,
    0.07958029955625534, 0.16093020141124725, 0.24611230194568634, 0.33791524171829224,
    0.44070982933044434, 0.5626170039176941, 0.7229568362236023, 1.0,
]
INT4 = [i / 7.0 for i in range(-7, 8)]
CODE_BOOKS = {"nf4": NF4, "int4": INT4}
BITS = {"float32": 32, "float16": 16, "int8": 8, "nf4": 4}
BLOCK = 64


def blocks(df: DataFrame, vector: str, size: int = BLOCK) -> DataFrame:
    """One row per block of a vector, as doubles; the last may be short."""
    rest = [c for c in df.columns if c != vector]
    df = df.withColumn(vector, F.col(vector).cast("array<double>"))
    last = F.ceil(F.size(vector) / size).cast("int") - 1
    starts = F.when(F.size(vector) > 0, F.sequence(F.lit(0), last))
    # The vector is cut inside its row, so no row carries it whole per block.
    cut = F.transform(
        starts, lambda b: F.struct(b.alias("block"), F.slice(vector, b * size + 1, F.lit(size)).alias("w"))
    )
    return df.select(*rest, F.inline(cut))


def absmax(weights: Column) -> Column:
    """Largest magnitude, 1.0 for an all-zero block."""
    largest = F.greatest(F.abs(F.array_max(weights)), F.abs(F.array_min(weights)))
    return F.when(largest == 0, F.lit(1.0)).otherwise(largest)


def _nearer(levels: list[float], i: int, value: Column) -> Column:
    """``i`` or ``i + 1``, whichever level is nearer; the lower one on a tie."""
    low, high = F.abs(F.lit(levels[i]) - value), F.abs(F.lit(levels[i + 1]) - value)
    return F.when(low <= high, F.lit(i)).otherwise(F.lit(i + 1))


def nearest(levels: list[float], value: Column) -> Column:
    """Index of the nearest level, by bisection over the sorted code book.

    About four comparisons and two distances per weight, where trying every
    level would take sixteen of each.
    """

    def search(first: int, last: int) -> Column:
        if last - first == 1:
            return _nearer(levels, first, value)
        middle = (first + last) // 2
        return F.when(value < levels[middle], search(first, middle)).otherwise(search(middle, last))

    return search(0, len(levels) - 1)


def encode(weights: Column, scale: Column, levels: list[float]) -> Column:
    """Codes of a block."""
    return F.transform(weights, lambda w: nearest(levels, w / scale))


def _level(levels: list[float], code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in levels]), code + 1)


def decode(codes: Column, scale: Column, levels: list[float]) -> Column:
    """The weights a block's codes stand for."""
    return F.transform(codes, lambda c: _level(levels, c) * scale)


def quantized(block_rows: DataFrame, levels: list[float]) -> DataFrame:
    """J2-J4 on block rows: adds ``absmax``, ``codes`` and ``recon``."""
    df = block_rows.withColumn("absmax", absmax(F.col("w")))
    df = df.withColumn("codes", encode(F.col("w"), F.col("absmax"), levels))
    return df.withColumn("recon", decode(F.col("codes"), F.col("absmax"), levels))


def block_error(quantized_rows: DataFrame) -> DataFrame:
    """Mean, largest and root mean square error of each block."""
    errors = F.zip_with("w", "recon", lambda a, b: F.abs(a - b))
    df = quantized_rows.withColumn("_errors", errors)
    n = F.size("_errors")
    total = F.aggregate("_errors", F.lit(0.0), lambda s, e: s + e)
    squares = F.aggregate("_errors", F.lit(0.0), lambda s, e: s + e * e)
    return df.withColumns(
        {"mae": total / n, "max_err": F.array_max("_errors"), "rmse": F.sqrt(squares / n)}
    ).drop("_errors")


def weights_of(block_rows: DataFrame) -> DataFrame:
    """One row per weight with its block's scale.

    From here everything is scalar arithmetic in generated code, and only the
    aggregates' partial results leave a task.
    """
    scaled = block_rows.select("w", absmax(F.col("w")).alias("absmax"))
    return scaled.select("absmax", F.explode("w").alias("w"))


def _coded(weights: DataFrame) -> DataFrame:
    """Adds the code of each weight under each code book."""
    scaled = F.col("w") / F.col("absmax")
    return weights.withColumns({f"{name}_code": nearest(levels, scaled) for name, levels in CODE_BOOKS.items()})


def blockwise_error(block_rows: DataFrame) -> DataFrame:
    """Errors of both code books pooled over all weights, one pass."""
    df = _coded(weights_of(block_rows))
    errors = {
        f"{name}_err": F.abs(F.col("w") - _level(levels, F.col(f"{name}_code")) * F.col("absmax"))
        for name, levels in CODE_BOOKS.items()
    }
    df = df.withColumns(errors)
    parts = []
    for name in CODE_BOOKS:
        e = F.col(f"{name}_err")
        parts += [
            F.sqrt(F.sum(e * e) / F.count(e)).alias(f"{name}_rmse"),
            F.avg(e).alias(f"{name}_mae"),
            F.max(e).alias(f"{name}_max_err"),
        ]
    return df.agg(F.count("w").alias("n"), *parts)


def compare_codebooks(block_rows: DataFrame) -> DataFrame:
    """By how many percent the NF4 error is below int4's."""
    pooled = blockwise_error(block_rows)
    gain = 100.0 * (F.col("int4_rmse") - F.col("nf4_rmse")) / F.col("int4_rmse")
    return pooled.withColumn("rmse_improvement_pct", gain)


def affine_scale(x_min: float, x_max: float, q_min: int, q_max: int) -> float:
    return (x_max - x_min) / (q_max - q_min)


def affine_roundtrip(
    df: DataFrame,
    value: str,
    x_min: float = -1.0,
    x_max: float = 1.0,
    q_min: int = -127,
    q_max: int = 128,
    force_zero_point: float | None = None,
) -> DataFrame:
    """Adds the integer code, its value and the absolute error."""
    scale = affine_scale(x_min, x_max, q_min, q_max)
    zero = x_min - q_min * scale if force_zero_point is None else force_zero_point
    code = F.rint((F.col(value) - zero) / scale)
    code = F.greatest(F.lit(q_min), F.least(F.lit(q_max), code)).cast("int")
    df = df.withColumn("q", code).withColumn("x_hat", scale * F.col("q") + zero)
    return df.withColumn("abs_err", F.abs(F.col(value) - F.col("x_hat")))


def code_occupancy(block_rows: DataFrame) -> DataFrame:
    """How often each code occurs, beside the equal share claimed for it."""
    pairs = _coded(weights_of(block_rows)).groupBy("nf4_code", "int4_code").agg(F.count(F.lit(1)).alias("n"))
    # At most 16 x 15 rows from here on.
    books = F.array(
        *[
            F.struct(F.lit(name).alias("code_book"), F.lit(len(levels)).alias("size"), F.col(f"{name}_code").alias("code"))
            for name, levels in CODE_BOOKS.items()
        ]
    )
    counts = pairs.select("n", F.inline(books)).groupBy("code_book", "size", "code").agg(F.sum("n").alias("n"))
    per_book = counts.groupBy("code_book", "size").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("by_code")
    )
    every_code = per_book.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("code"))
    n = F.coalesce(F.element_at("by_code", F.col("code")), F.lit(0))
    return every_code.select(
        "code_book",
        "code",
        n.alias("n"),
        (100.0 * n / F.col("total")).alias("share_pct"),
        (100.0 / F.col("size")).alias("equal_share_pct"),
    )


def scale_overhead(
    block: int = BLOCK, second_block: int = 256, const_bits: int = 32, dq_bits: int = 8
) -> dict[str, float]:
    """Bits per weight spent on block scales, raw and quantized again."""
    return {"raw": const_bits / block, "double": dq_bits / block + const_bits / (block * second_block)}


def footprint(df: DataFrame, vector: str) -> DataFrame:
    """Stored size of a vector table per precision.

    The 4-bit row also carries the scale bits per weight. The table is reduced
    to one count before the precisions are unfolded.
    """
    overhead = scale_overhead()
    precisions = F.array(
        *[
            F.struct(
                F.lit(name).alias("precision"),
                F.lit(bits).alias("bits"),
                F.lit(bits + (overhead["raw"] if bits == 4 else 0.0)).alias("bits_raw_scales"),
                F.lit(bits + (overhead["double"] if bits == 4 else 0.0)).alias("bits_double_quant"),
            )
            for name, bits in BITS.items()
        ]
    )
    total = df.agg(F.sum(F.size(vector)).alias("weights"))
    rows = total.select("weights", F.inline(precisions))
    size = F.floor(F.col("weights") * F.col("bits") / 8)
    base = F.floor(F.col("weights") * BITS["float32"] / 8)
    return rows.select(
        "precision",
        "bits",
        "weights",
        (size / 1e9).alias("gb"),
        (size / 1024**3).alias("gib"),
        (base / size).alias("shrink"),
        "bits_raw_scales",
        "bits_double_quant",
        (F.col("weights") * F.col("bits_double_quant") / 8 / 1e9).alias("gb_double_quant"),
    )
