"""A/B tests: outcome tables from exposures, significance, sample sizes."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.metrics import lookup
from touchline.functions.scalars import half_up, ratio, two_tailed_p
from touchline.operators.order_stats import scalars_at_ranks
from touchline.params import Params

# Critical points and texts of the interpretation.
CRITICAL = {0.95: 1.96, 0.99: 2.576}
NOT_SIGNIFICANT = (
    "Result is NOT statistically significant. Continue testing or accept that "
    "there's no meaningful difference."
)
BETTER = "Variant is %.1f%% better than control. Statistically significant. Consider rolling out."
WORSE = "Variant is %.1f%% worse than control. Statistically significant. Stick with control."
# End of fixed values.


def experiment_counts(exposures: DataFrame) -> DataFrame:
    """Visitors and conversions per experiment and arm.

    A unit counts once however often it shows up, and converts only if exposed.
    Both steps combine on the map side.
    """
    units = exposures.groupBy("experiment_id", "arm", "unit_id").agg(
        F.max("exposed").alias("exposed"), F.max("converted").alias("converted")
    ).where(F.col("exposed"))

    def count(arm: str, condition: Column) -> Column:
        return F.count_if((F.col("arm") == arm) & condition)

    any_unit = F.lit(True)
    return units.groupBy("experiment_id").agg(
        count("control", any_unit).alias("control_visitors"),
        count("control", F.col("converted")).alias("control_conversions"),
        count("variant", any_unit).alias("variant_visitors"),
        count("variant", F.col("converted")).alias("variant_conversions"),
    )


def analyze_experiments(counts: DataFrame, alpha: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """Rates, lift, pooled z test and interval of the rate difference, per experiment.

    z, p and the interval are NULL when an arm has no visitors. The critical point of the
    interval is rounded at 95 and 99 % and the exact quantile at any other confidence.
    """
    a, b = F.col("control_visitors"), F.col("variant_visitors")
    both = (a > 0) & (b > 0)
    critical = CRITICAL.get(confidence) or NormalDist().inv_cdf((1 + confidence) / 2)
    rated = counts.withColumns({
        "control_rate": ratio("control_conversions", "control_visitors"),
        "variant_rate": ratio("variant_conversions", "variant_visitors"),
    })
    c, v = F.col("control_rate"), F.col("variant_rate")
    pooled = ratio(F.col("control_conversions") + F.col("variant_conversions"), a + b)
    measured = rated.withColumns({
        "absolute_lift": v - c,
        "relative_lift": F.when(c > 0, (v - c) / c).otherwise(0.0),
        "_pooled_se": F.when(both, F.sqrt(pooled * (1 - pooled) * (ratio(F.lit(1), a) + ratio(F.lit(1), b)))),
        "_se": F.when(both, F.sqrt(ratio(c * (1 - c), a) + ratio(v * (1 - v), b))),
    })
    tested = measured.withColumn(
        "z_score",
        F.when(F.col("_pooled_se") > 0, F.col("absolute_lift") / F.col("_pooled_se"))
        .when(F.col("_pooled_se").isNotNull(), F.lit(0.0)),
    ).withColumn("p_value", two_tailed_p(F.col("z_score")))
    margin = F.col("_se") * critical
    return tested.withColumns({
        "is_significant": F.col("p_value") < alpha,
        "ci_lower": F.col("absolute_lift") - margin,
        "ci_upper": F.col("absolute_lift") + margin,
    }).drop("_pooled_se", "_se")


def interpretation() -> Column:
    lift = half_up(F.abs("relative_lift") * 100, 1)
    better = F.format_string(BETTER, lift)
    worse = F.format_string(WORSE, lift)
    return (
        F.when(~F.col("is_significant"), NOT_SIGNIFICANT)
        .when(F.col("is_significant") & (F.col("relative_lift") > 0), better)
        .when(F.col("is_significant"), worse)
    )


def experiment_report(analyzed: DataFrame) -> DataFrame:
    """Percentages and statistics rounded for reading, with the interpretation."""
    def pct(c, places):
        return half_up(F.col(c) * 100, places)

    return analyzed.select(
        "experiment_id",
        "control_visitors", "control_conversions", pct("control_rate", 3).alias("control_rate_pct"),
        "variant_visitors", "variant_conversions", pct("variant_rate", 3).alias("variant_rate_pct"),
        pct("absolute_lift", 3).alias("absolute_lift_pct"),
        pct("relative_lift", 2).alias("relative_lift_pct"),
        half_up("z_score", 3).alias("z_score"),
        half_up("p_value", 4).alias("p_value"),
        "is_significant",
        pct("ci_lower", 3).alias("ci_lower_pct"),
        pct("ci_upper", 3).alias("ci_upper_pct"),
        interpretation().alias("interpretation"),
    )


def required_sample_size(baseline: Column, effect: Column, p: Params) -> Column:
    """Visitors per arm to detect a relative `effect` (difference of arcsine-transformed rates).

    NULL where the effect is 0 or would take the rate above 1.
    """
    normal = NormalDist()
    z = normal.inv_cdf(1 - p.alpha / 2) + normal.inv_cdf(p.power)
    target = baseline * (1 + effect)
    h = 2 * (F.asin(F.sqrt(target)) - F.asin(F.sqrt(baseline)))
    sound = (baseline >= 0) & (target <= 1) & (effect != 0) & (baseline > 0)
    return F.when(sound, F.ceil(F.lit(2.0 * z * z) / (h * h)))


def sample_sizes(baselines: DataFrame, p: Params) -> DataFrame:
    """Every row's `baseline_rate` against every detectable effect."""
    effects = F.explode(F.array(*[
        F.struct(F.lit(tier).alias("traffic_tier"), F.lit(float(mde)).alias("mde"))
        for tier, mde in p.mde_by_traffic.items()
    ]))
    return (
        baselines.withColumn("_effect", effects).select(*baselines.columns, "_effect.*")
        .withColumn(
            "sample_size_per_arm", required_sample_size(F.col("baseline_rate"), F.col("mde"), p)
        )
    )


def control_baselines(counts: DataFrame) -> DataFrame:
    """The control arm's rate as the baseline for the next test of the same subject."""
    return counts.select(
        "experiment_id", ratio("control_conversions", "control_visitors").alias("baseline_rate")
    )


def daily_visitors(exposures: DataFrame) -> DataFrame:
    """Distinct exposed units per experiment and active day, averaged over the days.

    `exposures` has a `day` column besides those `experiment_counts` reads.
    """
    days = exposures.where(F.col("exposed")).groupBy("experiment_id", "day").agg(
        F.count_distinct("unit_id").alias("visitors")
    )
    return days.groupBy("experiment_id").agg(
        (F.sum("visitors") / F.count(F.lit(1))).alias("daily_visitors")
    )


def with_traffic_tier(rows: DataFrame, visitors: str = "daily_visitors") -> DataFrame:
    """Low, medium or high traffic by thirds of the rows; equal values share a tier."""
    cuts = scalars_at_ranks(rows, visitors, {
        "low": lambda n: F.ceil(n / 3), "medium": lambda n: F.ceil(n * 2 / 3),
    })
    tier = (
        F.when(F.col(visitors) <= cuts.getField("low"), "low")
        .when(F.col(visitors) <= cuts.getField("medium"), "medium")
        .otherwise("high")
    )
    return rows.withColumn("traffic_tier", tier)


def required_durations(baselines: DataFrame, visitors: DataFrame, p: Params) -> DataFrame:
    """Days until one arm has its sample, for the effect each subject's traffic tier aims at."""
    tiered = with_traffic_tier(visitors).withColumn(
        "mde", lookup("traffic_tier", dict(p.mde_by_traffic))
    )
    per_arm = F.col("daily_visitors") * p.traffic_split
    return baselines.join(tiered, "experiment_id").withColumn(
        "sample_size_per_arm", required_sample_size(F.col("baseline_rate"), F.col("mde"), p)
    ).withColumn(
        "days_required",
        F.when(per_arm > 0, F.col("sample_size_per_arm").cast("double") / per_arm),
    )
