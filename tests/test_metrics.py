import itertools

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import metrics as m


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("q, anchor, expected", [(0, 0.4, 0), (0.4, 0.4, 0.5), (1, 0.4, 1), (0.2, 0.4, 0.25), (0.7, 0.4, 0.75), (1, 1, 1), (0.5, 1, 0.25), (0, 0, 0.5), (0.6, 0, 0.8)])
def test_anchored_map(spark, q, anchor, expected):
    assert one(spark, m.anchored(F.lit(float(q)), F.lit(float(anchor)))) == pytest.approx(expected)


def test_soft_floor_grid(spark):
    rows = [(f, t, e) for f, t, e in itertools.product(range(6), range(0, 40, 3), (1, 2, 5)) if f + t > 0]
    df = spark.createDataFrame(rows, "f int, t int, e int").withColumn("x", m.soft_floor(F.col("f"), F.col("f") + F.col("t"), F.col("e")))
    for r in df.collect():
        expected = 1.0 if r.f == 0 else 1 - r.f / (r.f + min(r.t, 3 * r.e))
        assert r.x == pytest.approx(expected)
        assert 0 <= r.x <= 1


def test_planted_classes_give_one_seventh(spark):
    assert one(spark, m.soft_floor(F.lit(6), F.lit(7), F.lit(3))) == pytest.approx(1 / 7)


def test_interval_loss(spark):
    for low, high, y, expected in ((1.0, 2.0, 1.5, 1.0), (1.0, 2.0, 3.0, 21.0), (1.0, 2.0, 0.5, 11.0), (2.0, 2.0, 2.0, 0.0)):
        assert one(spark, m.interval_loss(F.lit(low), F.lit(high), F.lit(y))) == pytest.approx(expected)


def test_composites_of_the_contract(spark):
    """Four entities, naive 2.5 in [0.5, 3.5]: the perfect answer and the zero-width one."""
    truth, naive = [1.0, 2.0, 3.0, 4.0], (2.5, 0.5, 3.5)
    rows = [(y, naive[0], naive[1], naive[2]) for y in truth]
    df = spark.createDataFrame(rows, "y double, n double, nl double, nh double")
    for point, low, high in ((F.col("y"), F.col("y") - 0.1, F.col("y") + 0.1),):
        a = df.agg(F.avg(F.abs(point - F.col("y"))).alias("e"), F.avg(F.abs(F.col("n") - F.col("y"))).alias("ne"), F.avg(m.interval_loss(low, high, F.col("y"))).alias("l"), F.avg(m.interval_loss(F.col("nl"), F.col("nh"), F.col("y"))).alias("nl"))
        q = a.withColumn("q", m.error_ratio(F.col("e"), F.col("ne"))).withColumn("i", m.capped(m.ratio_quality(F.col("l"), F.col("nl")), F.col("q"))).select("q", m.composite(F.col("q"), F.col("i")).alias("c")).first()
        assert q.q == 1.0 and 0.9 < q.c <= 1.0


def test_error_ratio_edges(spark):
    assert one(spark, m.error_ratio(F.lit(0.0), F.lit(0.0))) == 1.0
    assert one(spark, m.error_ratio(F.lit(1.0), F.lit(0.0))) == 0.0


def test_rank_quality_ties_and_constants(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 5.0, 1.0), ("b", 5.0, 2.0), ("c", 1.0, 1.0), ("d", 1.0, 2.0), ("d", 2.0, 1.0)], "k string, x double, y double")
    got = {r.k: r.rank_quality for r in m.rank_quality(df, ["k"], "x", "y").collect()}
    assert got["a"] == pytest.approx(0.9330, abs=1e-4)
    assert got["b"] == 0.5 and got["c"] == 0.5 and got["d"] == 0.0


def test_worst_case_and_display(spark):
    assert one(spark, m.with_worst_case(F.lit(0.7), F.lit(True))) == 0.0
    assert one(spark, m.with_worst_case(F.lit(1.7), F.lit(False))) == 1.0
    assert one(spark, m.leaderboard(F.lit(1.0), F.lit(None).cast("double"))) == pytest.approx(1.0)


def test_rounding_is_that_of_scaled_doubles(spark):
    import duckdb

    cases = [32.0725, 1.005, 2.5, -2.5, 0.49999999999999994, -0.3, 12350.0, 1e300, -1e17, 0.0, float("inf"), None] + [k + 0.0005 for k in range(60)]
    for digits in (3, 2, 0, -2):
        got = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, v double").select("i", m.rounded(F.col("v"), digits).alias("x")).orderBy("i").collect()]
        assert got == [duckdb.execute("select round($1::double, $2::int)", [x, digits]).fetchall()[0][0] for x in cases]
