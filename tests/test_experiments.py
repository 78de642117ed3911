import math
from statistics import NormalDist

import pytest
from builders import P
from pyspark.sql import functions as F

from touchline.functions.scalars import two_tailed_p
from touchline.plans import experiments

SCHEMA = (
    "experiment_id string, control_conversions long, control_visitors long, variant_conversions long, "
    "variant_visitors long"
)
# control c/n, variant c/n, z, p, interval in percentage points
TABLE = [
    (150, 5000, 180, 5000, 1.6794, 0.0931, -0.100, 1.300),
    (85, 10000, 92, 10000, 0.5285, 0.5972, -0.190, 0.330),
    (45, 5000, 38, 5000, -0.7716, 0.4404, -0.496, 0.216),
    (100, 10000, 100, 10000, 0.0, 1.0, -0.276, 0.276),
    (200, 5000, 150, 5000, -2.7206, 0.0065, -1.720, -0.280),
    (10000, 1000000, 10100, 1000000, 0.7089, 0.4784, -0.018, 0.038),
]


def analyzed(spark, rows, **options):
    counts = spark.createDataFrame([(str(n), *r) for n, r in enumerate(rows)], SCHEMA)
    return experiments.analyze_experiments(counts, **options)


def test_z_p_and_interval(spark):
    rows = {r.experiment_id: r for r in analyzed(spark, [t[:4] for t in TABLE]).collect()}
    for n, (*_, z, p, low, high) in enumerate(TABLE):
        row = rows[str(n)]
        assert row.z_score == pytest.approx(z, abs=5e-5)
        assert row.p_value == pytest.approx(p, abs=5e-5)
        assert row.ci_lower * 100 == pytest.approx(low, abs=1e-3)
        assert row.ci_upper * 100 == pytest.approx(high, abs=1e-3)
        assert row.is_significant == (p < 0.05)


def test_edges(spark):
    rows = {r.experiment_id: r for r in analyzed(spark, [
        (0, 1000, 0, 1000), (0, 0, 0, 0), (1, 100000, 2, 100000), (1000, 1000, 1000, 1000), (5, 100, 0, 0),
    ]).collect()}
    assert rows["0"].z_score == 0.0 and rows["0"].p_value == 1.0 and rows["0"].relative_lift == 0.0
    assert rows["1"].control_rate == 0.0 and rows["1"].z_score is None and rows["1"].ci_lower is None
    assert rows["1"].is_significant is None
    assert rows["2"].relative_lift == pytest.approx(1.0) and not rows["2"].is_significant
    assert rows["3"].z_score == 0.0
    assert rows["4"].p_value is None


def test_wider_interval_for_more_confidence(spark):
    usual = analyzed(spark, [TABLE[0][:4]]).first()
    sure = analyzed(spark, [TABLE[0][:4]], confidence=0.99).first()
    assert sure.ci_lower < usual.ci_lower < usual.ci_upper < sure.ci_upper


def test_interpretation(spark):
    rows = experiments.experiment_report(analyzed(spark, [
        (150, 5000, 180, 5000), (200, 5000, 150, 5000), (100, 5000, 200, 5000), (1, 10, 0, 0),
    ])).orderBy("experiment_id").collect()
    assert "NOT statistically significant" in rows[0].interpretation
    assert rows[1].interpretation.startswith("Variant is 25.0% worse")
    assert rows[2].interpretation.startswith("Variant is 100.0% better")
    assert rows[3].interpretation is None
    assert (rows[0].control_rate_pct, rows[0].variant_rate_pct, rows[0].relative_lift_pct) == (3.0, 3.6, 20.0)


def test_two_tailed_p(spark):
    zs = [x / 10 for x in range(-80, 81)]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select(
        "z", two_tailed_p(F.col("z")).alias("p")
    ).collect()
    exact = NormalDist()
    assert max(abs(r.p - 2 * exact.cdf(-abs(r.z))) for r in rows) < 2e-7


def test_intervals_widen_with_confidence(spark):
    counts = spark.createDataFrame(
        [("e", 5000, 150, 5000, 180)],
        "experiment_id string, control_visitors long, control_conversions long, variant_visitors long, "
        "variant_conversions long",
    )
    widths = [
        row.ci_upper - row.ci_lower
        for c in (0.8, 0.9, 0.95, 0.99) for row in experiments.analyze_experiments(counts, confidence=c).collect()
    ]
    assert widths == sorted(widths) and len(set(widths)) == 4
    assert widths[1] / widths[2] == pytest.approx(NormalDist().inv_cdf(0.95) / 1.96)


@pytest.mark.parametrize("baseline,mde,n", [
    (0.03, 0.15, 24166), (0.05, 0.10, 31218), (0.10, 0.10, 14745), (0.05, 0.05, 122108), (0.05, 0.20, 8143),
    (0.01, 0.10, 163004),
])
def test_sample_size(spark, baseline, mde, n):
    got = spark.range(1).select(
        experiments.required_sample_size(F.lit(baseline), F.lit(mde), P).alias("n")
    ).first().n
    assert got == n


def test_sample_size_undefined(spark):
    for baseline, mde in [(0.05, 0.0), (0.9, 0.2), (0.0, 0.1)]:
        assert spark.range(1).select(
            experiments.required_sample_size(F.lit(baseline), F.lit(mde), P)
        ).first()[0] is None


def test_more_power_or_smaller_effect_needs_more(spark):
    size = lambda mde, p: spark.range(1).select(
        experiments.required_sample_size(F.lit(0.05), F.lit(mde), p)
    ).first()[0]
    assert size(0.05, P) > size(0.1, P) > size(0.2, P)
    assert size(0.1, P.with_(power=0.9)) > size(0.1, P)
    assert size(0.1, P.with_(alpha=0.01)) > size(0.1, P)


def test_units_count_once_and_only_when_exposed(spark):
    rows = [
        ("e", "control", "u1", True, False), ("e", "control", "u1", False, True), ("e", "control", "u1", True, False),
        ("e", "control", "u2", False, True), ("e", "variant", "u3", True, False),
    ]
    exposures = spark.createDataFrame(
        rows, "experiment_id string, arm string, unit_id string, exposed boolean, converted boolean"
    )
    row = experiments.experiment_counts(exposures).first()
    assert (row.control_visitors, row.control_conversions, row.variant_visitors, row.variant_conversions) == (1, 1, 1, 0)


def test_durations_by_traffic(spark):
    visitors = spark.createDataFrame(
        [(f"e{n}", float(n * 1000)) for n in range(1, 7)], "experiment_id string, daily_visitors double"
    )
    baselines = visitors.select("experiment_id", F.lit(0.05).alias("baseline_rate"))
    rows = {r.experiment_id: r for r in experiments.required_durations(baselines, visitors, P).collect()}
    assert [rows[f"e{n}"].traffic_tier for n in range(1, 7)] == ["low", "low", "medium", "medium", "high", "high"]
    assert rows["e1"].days_required == pytest.approx(8143 / 500)
    slower = experiments.required_durations(baselines, visitors, P.with_(traffic_split=0.1)).collect()
    assert all(r.days_required > rows[r.experiment_id].days_required for r in slower)
    assert math.isclose(rows["e6"].mde, 0.10)
