import random
import statistics

import pytest

from touchline.operators.order_stats import medians, rank_values, upper_median

SCHEMA = "g string, v double, n long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed", range(4))
def test_medians_of_random_groups(spark, seed):
    rng = random.Random(seed)
    draw = [
        lambda: rng.uniform(-50, 50), lambda: float(rng.randrange(3)), lambda: 10 ** rng.uniform(-9, 9),
        lambda: rng.choice([0.0, -1.5, 1e-300, 2.0 ** 500, None]),
    ][seed]
    rows = [(rng.choice(["a", "b", None]), draw(), 1) for _ in range(301)]
    got = {r.g: r for r in medians(frame(spark, rows), ["g"], "v").collect()}
    for g in ("a", "b", None):
        values = sorted(v for k, v, _ in rows if k == g and v is not None)
        n = len(values)
        assert got[g].lower_median == values[(n - 1) // 2]
        assert got[g].upper_median == values[n // 2]
        assert got[g].median == pytest.approx(statistics.median(values))


def test_weights_repeat_values(spark):
    rows = [("a", 1.0, 5), ("a", 2.0, 1), ("a", 9.0, 3), ("a", None, 100)]
    got = medians(frame(spark, rows), ["g"], "v", weight="n").first()
    assert (got.lower_median, got.upper_median) == (1.0, 1.0)
    rows = [("a", 1.0, 2), ("a", 4.0, 2)]
    assert medians(frame(spark, rows), ["g"], "v", weight="n").first().median == 2.5


def test_any_rank_without_groups(spark):
    rows = [("a", float(v), 1) for v in range(1, 8)]
    got = rank_values(frame(spark, rows), [], "v", {
        "second": lambda n: n * 0 + 2, "last": lambda n: n,
    }).first()
    assert (got.second, got.last) == (2.0, 7.0)


@pytest.mark.parametrize("values,expected", [
    ([1, 2, 3, 4], 3.0), ([1, 2, 3, 4, 5], 3.0), ([7], 7.0), ([], 0.0),
])
def test_upper_median(spark, values, expected):
    rows = frame(spark, [("a", float(v), 1) for v in values])
    one = spark.range(1).select(upper_median(rows, "v", default=0.0).alias("m"))
    assert one.first().m == expected
