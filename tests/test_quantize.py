import math

import pytest

from verdikt.operators import quantize as Q
from pyspark.sql import functions as F

WEIGHTS = [0.0031, -0.0142, 0.0087, -0.0009, 0.0410, -0.0056, 0.0021, -0.0198]


def block(spark, *vectors):
    return Q.blocks(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id int, v array<double>"), "v")


def test_eight_weights_by_hand(spark):
    nf4 = Q.block_error(Q.quantized(block(spark, WEIGHTS), Q.NF4)).first()
    int4 = Q.block_error(Q.quantized(block(spark, WEIGHTS), Q.INT4)).first()
    assert nf4.codes == [8, 3, 10, 7, 15, 6, 8, 2] and int4.codes == [8, 5, 8, 7, 14, 6, 7, 4]
    assert (round(nf4.mae, 6), round(nf4.rmse, 6)) == (0.001150, 0.001349)
    assert (round(int4.mae, 6), round(int4.rmse, 6)) == (0.001696, 0.002004)


def test_zero_block_ties_and_short_tail(spark):
    df = Q.quantized(block(spark, [0.0] * 3, [1.0, 0.5 / 7, -0.5 / 7]), Q.INT4).orderBy("vec_id").collect()
    assert df[0].absmax == 1.0 and df[0].codes == [7, 7, 7]
    assert df[1].codes == [14, 7, 6]
    sizes = Q.blocks(spark.createDataFrame([([1.0] * 130,), ([],)], "v array<double>"), "v").select(F.size("w").alias("n"))
    assert sorted(r.n for r in sizes.collect()) == [2, 64, 64]


def test_nearest_is_the_first_of_the_nearest_levels(spark):
    values = [i / 997 - 1 for i in range(0, 1995)] + Q.NF4 + Q.INT4
    values += [(a + b) / 2 for book in (Q.NF4, Q.INT4) for a, b in zip(book, book[1:])]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for levels in (Q.NF4, Q.INT4):
        for r in df.select("v", Q.nearest(levels, F.col("v")).alias("c")).collect():
            distances = [abs(x - r.v) for x in levels]
            assert r.c == distances.index(min(distances))


def test_int8_by_hand(spark):
    df = spark.createDataFrame([(x,) for x in [0.75, 0.1234, -0.5, 0.0039, -0.9999, 5.0]], "x double")
    rows = Q.affine_roundtrip(df, "x").collect()
    assert [r.q for r in rows] == [96, 16, -63, 1, -127, 128]
    assert [round(r.abs_err, 6) for r in rows[:5]] == [0.000980, 0.001831, 0.001961, 0.000022, 0.000100]
    assert all(r.abs_err <= Q.affine_scale(-1, 1, -127, 128) / 2 + 1e-12 for r in rows[:5])
    forced = Q.affine_roundtrip(df, "x", force_zero_point=0.0).first()
    assert forced.x_hat == pytest.approx(forced.q * 2 / 255)


def test_overhead_and_footprint(spark):
    assert Q.scale_overhead() == {"raw": 0.5, "double": 0.126953125}
    rows = {r.precision: r for r in Q.footprint(spark.createDataFrame([([0.0] * 64,)], "v array<double>"), "v").collect()}
    assert rows["nf4"].shrink == 8 and rows["nf4"].bits_raw_scales == 4.5 and math.isclose(rows["float32"].gb, 256e-9)
