"""Campaign ranking, optimisation opportunities and budget shares.

Inputs are campaign totals (one row per campaign). Medians, maxima and totals
over all campaigns enter as scalar subqueries; nothing is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.metrics import lookup
from touchline.functions.scalars import exact_sum, half_up, join_null_safe, ratio
from touchline.operators.order_stats import upper_median
from touchline.params import Params

# Tier sizes, thresholds and texts of the reports.
TOP_PLACES = 2
MID_PLACES = 5
TIERS = ("top_performers", "mid_performers", "underperformers")
HIGH_CPA_FACTOR = 1.5
LOW_CTR_FACTOR = 0.7
LOW_ROAS_FACTOR = 0.8
HIGH_SPEND_USD = 4000.0
SCALING_ROAS_FACTOR = 1.2
SCALING_REVENUE_SHARE = 0.1
ADVICE = {
    "high_cpa": "Review targeting, landing pages, or bid strategy",
    "low_ctr": "Refresh ad creatives or improve targeting",
    "high_spend_low_roi": "Consider pausing or significantly optimizing",
}
DEFAULT_TIER_SHARES = {"top_performers": 0.5, "mid_performers": 0.3, "underperformers": 0.2}
# End of fixed values.

_SCORE = "decimal(28,12)"


def performance_tiers(campaigns: DataFrame) -> DataFrame:
    """Tier by return on spend: places 1-2, 3-5, the rest. Ties go by campaign id.

    Only the leading five rows are ranked (a distributed top-k); the others need
    no rank, so the campaigns are never sorted as a whole.
    """
    order = [F.desc("roas"), F.col("campaign_id"), F.col("channel")]
    leaders = (
        campaigns.select("campaign_id", "channel", "roas").orderBy(*order).limit(MID_PLACES)
        .withColumn("_place", F.row_number().over(W.orderBy(*order)))
        .select("campaign_id", "channel", "_place")
    )
    tier = (
        F.when(F.col("_place") <= TOP_PLACES, TIERS[0])
        .when(F.col("_place") <= MID_PLACES, TIERS[1])
        .otherwise(TIERS[2])
    )
    # Five rows at most, so broadcasting them is always safe.
    return (
        join_null_safe(campaigns, F.broadcast(leaders), ["campaign_id", "channel"], "left")
        .withColumn("tier", tier).drop("_place")
    )


def top_campaigns(campaigns: DataFrame, n: int, by: str = "roas") -> DataFrame:
    return campaigns.orderBy(F.desc(by), "campaign_id").limit(n)


def high_cpa(campaigns: DataFrame) -> DataFrame:
    converting = campaigns.where(F.col("conversions") > 0)
    median = upper_median(converting, "cpa", default=0.0)
    found = converting.withColumn("_median", median).where(
        F.col("cpa") > F.col("_median") * HIGH_CPA_FACTOR
    )
    return found.select(
        "campaign_id",
        half_up("cpa", 2).alias("current_cpa"),
        half_up("_median", 2).alias("median_cpa"),
        F.lit(ADVICE["high_cpa"]).alias("recommendation"),
    )


def low_ctr(campaigns: DataFrame) -> DataFrame:
    found = campaigns.withColumn("_median", upper_median(campaigns, "ctr")).where(
        F.col("ctr") < F.col("_median") * LOW_CTR_FACTOR
    )
    return found.select(
        "campaign_id",
        half_up(F.col("ctr") * 100, 2).alias("current_ctr"),
        half_up(F.col("_median") * 100, 2).alias("median_ctr"),
        F.lit(ADVICE["low_ctr"]).alias("recommendation"),
    )


def high_spend_low_roi(campaigns: DataFrame, spend_over: float = HIGH_SPEND_USD) -> DataFrame:
    found = campaigns.where(F.col("spend") > spend_over).withColumn(
        "_median", upper_median(campaigns, "roas")
    ).where(F.col("roas") < F.col("_median") * LOW_ROAS_FACTOR)
    return found.select(
        "campaign_id",
        half_up("spend", 2).alias("spend"),
        half_up("roas", 2).alias("roas"),
        F.lit(ADVICE["high_spend_low_roi"]).alias("recommendation"),
    )


def channel_winners(campaigns: DataFrame) -> DataFrame:
    """Unweighted mean return of each channel's campaigns."""
    total = F.sum(F.col("roas").cast(_SCORE)).cast("double")
    return campaigns.groupBy("channel").agg(
        half_up(total / F.count(F.lit(1)), 2).alias("avg_roas"),
        F.count(F.lit(1)).alias("num_campaigns"),
    )


def scaling_candidates(campaigns: DataFrame) -> DataFrame:
    found = campaigns.withColumn("_median", upper_median(campaigns, "roas")).where(
        F.col("roas") > F.col("_median") * SCALING_ROAS_FACTOR
    )
    return found.select(
        "campaign_id",
        half_up("roas", 2).alias("current_roas"),
        half_up("spend", 2).alias("current_spend"),
        half_up(F.col("revenue") * SCALING_REVENUE_SHARE, 2).alias("potential_10pct_increase_revenue"),
    )


def campaign_scores(campaigns: DataFrame, p: Params) -> DataFrame:
    """Weighted sum of return, click rate and conversions, each relative to the best campaign.

    A component whose best is not positive counts as 0.
    """
    w = p.scoring_weights

    parts = {"roas": "roas", "ctr": "efficiency", "conversions": "growth_potential"}
    # One subquery for all three maxima.
    best = campaigns.agg(
        F.struct(*[F.max(F.col(m).cast("double")).alias(m) for m in parts]).alias("best")
    ).scalar()

    def weighted(metric: str) -> Column:
        return ratio(F.col(metric).cast("double"), best.getField(metric)) * w[parts[metric]]

    score = weighted("roas") + weighted("ctr") + weighted("conversions")
    return campaigns.withColumn("score", score)


def budget_allocation(
    campaigns: DataFrame, p: Params, total_budget: float | None = None
) -> DataFrame:
    """Budget shared by score; the default budget is what is spent today.

    `change` is relative to current spend, NULL where nothing is spent.
    """
    scored = campaign_scores(campaigns, p)
    score_sum = scored.agg(F.sum(F.col("score").cast(_SCORE)).cast("double")).scalar()
    budget = _budget(campaigns, total_budget)
    allocated = scored.withColumn("allocation", ratio("score", score_sum) * budget)
    return _with_change(allocated)


def _budget(campaigns: DataFrame, total: float | None) -> Column:
    if total is None:
        return campaigns.agg(exact_sum("spend")).scalar()
    return F.lit(float(total))


def _with_change(allocated: DataFrame) -> DataFrame:
    change = (F.col("allocation") - F.col("spend")) / F.col("spend")
    return allocated.withColumn("change", F.when(F.col("spend") > 0, change))


def allocation_report(allocated: DataFrame) -> DataFrame:
    return allocated.select(
        "campaign_id", "channel",
        half_up("allocation", 2).alias("recommended_budget"),
        half_up("spend", 2).alias("current_budget"),
        half_up(F.col("change") * 100, 1).alias("change_pct"),
        half_up("roas", 2).alias("expected_roas"),
    )


def clamp_allocation(allocated: DataFrame, p: Params) -> DataFrame:
    """Keep each change within the allowed range.

    What the clamp frees (or overspends) is reported per row as `unallocated`
    and not redistributed.
    """
    low = F.col("spend") * (1 + p.min_budget_change)
    high = F.col("spend") * (1 + p.max_budget_change)
    clamped = F.when(
        F.col("spend") > 0, F.greatest(F.least("allocation", high), low)
    ).otherwise(F.col("allocation"))
    return allocated.withColumn("clamped_allocation", clamped).withColumn(
        "unallocated", F.col("allocation") - F.col("clamped_allocation")
    )


def budget_by_tier(
    campaigns: DataFrame,
    total_budget: float | None = None,
    shares: Mapping[str, float] = DEFAULT_TIER_SHARES,
) -> DataFrame:
    """Fixed share per tier, split equally within it; shares of empty tiers go to the others."""
    tiered = performance_tiers(campaigns)
    sizes = tiered.groupBy("tier").agg(F.count(F.lit(1)).alias("tier_size")).withColumn(
        "_share", lookup("tier", dict(shares), default=0.0)
    )
    share_sum = sizes.agg(F.sum(F.col("_share").cast(_SCORE)).cast("double")).scalar()
    # One row per tier: three at most.
    joined = tiered.join(F.broadcast(sizes), "tier")
    allocated = joined.withColumn(
        "allocation",
        _budget(campaigns, total_budget) * ratio("_share", share_sum) / F.col("tier_size"),
    )
    return _with_change(allocated).drop("_share")


def allocate(campaigns: DataFrame, p: Params, total_budget: float | None = None) -> DataFrame:
    """Budget by the configured method: scores, or tiers with their fixed shares."""
    if p.allocation_method == "performance_tier":
        return budget_by_tier(campaigns, total_budget)
    return budget_allocation(campaigns, p, total_budget)


def projected_volume(campaigns: DataFrame) -> DataFrame:
    """Conversions to expect from impressions at the campaign's click and conversion rates."""
    volume = F.col("impressions") * F.col("ctr") * F.col("cvr")
    return campaigns.select(
        "campaign_id", "channel", "impressions", "ctr", "cvr", volume.alias("projected_volume")
    )
