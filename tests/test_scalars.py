from builders import at
from pyspark.sql import functions as F

from touchline.functions import scalars as S


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_ratio_guards_the_denominator(spark):
    assert value(spark, S.ratio(F.lit(1), F.lit(4))) == 0.25
    assert value(spark, S.ratio(F.lit(1), F.lit(0))) == 0.0
    assert value(spark, S.ratio(F.lit(1), F.lit(-1), default=1.0)) == 1.0
    assert value(spark, S.ratio(F.lit(1), F.lit(None).cast("int"))) == 0.0


def test_half_up_rounds_ties_up(spark):
    for x, expected in [(2.675, 2.68), (27.69375, 27.69), (0.005, 0.01), (-0.005, -0.01)]:
        assert value(spark, S.half_up(F.lit(x), 2)) == expected


def test_floor_division(spark):
    for x, step, expected in [(7, 3, 2), (-7, 3, -3), (-6, 3, -2), (0, 3, 0), (2**52 + 1, 3600 * 10**6, (2**52 + 1) // (3600 * 10**6))]:
        assert value(spark, S.floor_div(F.lit(x), step)) == expected


def test_exact_sum_does_not_depend_on_order(spark):
    rows = spark.createDataFrame([(x / 100,) for x in range(1000)], "x double")
    sums = {rows.orderBy(F.rand(seed)).repartition(7).agg(S.exact_sum("x")).first()[0] for seed in range(5)}
    assert sums == {4995.0}


def test_join_matches_nulls(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, y int")
    rows = S.join_null_safe(left, right, ["k"]).collect()
    assert sorted((r.k or "", r.x, r.y) for r in rows) == [("", 2, 20), ("a", 1, 10)]


def test_suspicious_device(spark):
    for device, expected in [("Web-Crawler", True), ("mobile", False), (None, False)]:
        assert value(spark, S.suspicious_device(F.lit(device).cast("string"), ("bot", "crawler"))) is expected
