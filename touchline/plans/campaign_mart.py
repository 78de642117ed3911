"""Campaign marts: base counts joined per campaign and period, plus derived metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.metrics import CAMPAIGN_RATIOS, MART_RATIOS, add_metrics
from touchline.functions.scalars import exact_sum, half_up
from touchline.operators.rollups import (
    PERIODS,
    click_counts,
    conversion_counts,
    impression_counts,
)
from touchline.params import REPORT_LEVELS, REPORT_METRICS, Params

def campaign_metrics(
    impressions: DataFrame,
    clicks: DataFrame,
    conversions: DataFrame,
    level: str = "day",
    approximate_reach: bool = False,
) -> DataFrame:
    """Wide mart at day, week or month level.

    Inputs are the staged events, so distinct users are right at every level.
    Impressions lead: a campaign-day without impressions is not in the mart, and
    a campaign shown under two channels in a day repeats its clicks and revenue
    (`quality.unplaced_revenue` reports what is lost).
    """
    return from_counts(
        impression_counts(impressions, level, approximate_reach), click_counts(clicks, level),
        conversion_counts(conversions, level), level,
    )


def from_counts(impressions: DataFrame, clicks: DataFrame, conversions: DataFrame, level: str = "day") -> DataFrame:
    """The mart from base counts, however they were made."""
    keys = ["campaign_id", PERIODS[level]]
    joined = impressions.join(clicks, keys, "left").join(conversions, keys, "left")
    counts = ["clicks", "users_who_clicked", "conversions", "users_who_converted"]
    filled = joined.fillna(0, subset=counts).fillna(0.0, subset=["revenue"])
    return add_metrics(filled, MART_RATIOS)


def report_metrics(mart: DataFrame, level: str = "day", metrics: Sequence[str] = REPORT_METRICS) -> DataFrame:
    """The mart's report: keys and the metrics reports show."""
    return mart.select("campaign_id", "channel", PERIODS[level], *metrics)


def reports(impressions: DataFrame, clicks: DataFrame, conversions: DataFrame, p: Params) -> dict[str, DataFrame]:
    """The configured report at each configured level: by "daily", "weekly", "monthly"."""
    return {
        name: report_metrics(
            campaign_metrics(impressions, clicks, conversions, REPORT_LEVELS[name]), REPORT_LEVELS[name], p.report_metrics
        ) for name in p.report_levels
    }


def sorted_mart(mart: DataFrame, level: str = "day") -> DataFrame:
    """Report order."""
    return mart.orderBy(F.col(PERIODS[level]).desc(), "campaign_id")


def with_audit(mart: DataFrame, p: Params) -> DataFrame:
    return mart.withColumn("updated_at", p.now())


def campaign_totals(mart: DataFrame) -> DataFrame:
    """One row per campaign over the whole period, ratios recomputed from summed counts."""
    totals = mart.groupBy("campaign_id", "channel").agg(
        exact_sum("spend").alias("spend"),
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum("conversions").alias("conversions"),
        exact_sum("revenue").alias("revenue"),
        F.count_distinct("event_date").alias("days_active"),
    )
    return add_metrics(totals, CAMPAIGN_RATIOS)


def campaign_report(campaigns: DataFrame) -> DataFrame:
    """Totals with metrics rounded to cents, rates as percentages."""
    percent = {"ctr", "cvr"}
    return campaigns.select(
        "campaign_id", "channel", "spend", "impressions", "clicks", "conversions", "revenue",
        "days_active",
        *[
            half_up(F.col(m) * 100 if m in percent else F.col(m), 2).alias(m)
            for m in CAMPAIGN_RATIOS
        ],
    )


def minimum_spend(campaigns: DataFrame, p: Params) -> DataFrame:
    return campaigns.where(F.col("spend") >= p.min_spend_usd)
