"""Daily, weekly or monthly base counts per campaign.

Each input is aggregated on its own before anything is joined. The single
distinct column of each aggregate is planned as: partial counts per (campaign,
period, user) on the map side, spread over tasks by user, then a small final
merge, so one campaign holding most rows does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import exact_sum

PERIODS = {"day": "event_date", "week": "week_start", "month": "month_start"}


def period_start(level: str) -> Column:
    if level not in PERIODS:
        raise ValueError(f"unknown level {level!r}, choose from {sorted(PERIODS)}")
    day = F.to_date("event_timestamp")
    return day if level == "day" else F.to_date(F.date_trunc(level, "event_timestamp"))


def impression_counts(
    impressions: DataFrame, level: str = "day", approximate_reach: bool = False
) -> DataFrame:
    """Deduplicated ids are unique, so counting them needs no distinct.

    `approximate_reach` estimates distinct users (within about 5%) without
    shuffling them.
    """
    period = PERIODS[level]
    users = F.approx_count_distinct if approximate_reach else F.count_distinct
    return (
        impressions.withColumn(period, period_start(level))
        .groupBy("campaign_id", "campaign_name", "channel", period)
        .agg(
            F.count("impression_id").alias("impressions"),
            users("user_id").alias("unique_users"),
            exact_sum("impression_cost").alias("spend"),
            F.count_if(F.col("impression_cost") == 0).alias("zero_cost_impressions"),
        )
    )


def click_counts(clicks: DataFrame, level: str = "day") -> DataFrame:
    period = PERIODS[level]
    return (
        clicks.withColumn(period, period_start(level))
        .groupBy("campaign_id", period)
        .agg(
            F.count(F.lit(1)).alias("clicks"),
            F.count_distinct("user_id").alias("users_who_clicked"),
        )
    )


def conversion_counts(conversions: DataFrame, level: str = "day", by: tuple = ()) -> DataFrame:
    period = PERIODS[level]
    return (
        conversions.withColumn(period, period_start(level))
        .groupBy("campaign_id", period, *by)
        .agg(
            F.count("conversion_id").alias("conversions"),
            F.count_distinct("user_id").alias("users_who_converted"),
            exact_sum("conversion_value_usd").alias("revenue"),
        )
    )


def request_fill(
    impressions: DataFrame, unfilled: DataFrame, level: str = "day"
) -> DataFrame:
    """Served and unfilled ad requests with their fill rate, one shuffle for both."""
    period = PERIODS[level]

    def marked(rows, served):
        return rows.select(
            "campaign_id", period_start(level).alias(period), F.lit(served).alias("served")
        )

    both = marked(impressions, 1).unionByName(marked(unfilled, 0))
    counts = both.groupBy("campaign_id", period).agg(
        F.sum("served").alias("served_impressions"),
        F.sum(1 - F.col("served")).alias("unfilled_requests"),
    )
    requests = F.col("served_impressions") + F.col("unfilled_requests")
    return counts.withColumn("request_fill_rate", F.col("served_impressions") / requests)


# --- mergeable reach ---------------------------------------------------------

#: Sketches of 2^12 registers: a standard error of 1.04 / 2^6, 1.6 %, in 2.5 kB at most.
SKETCH_BITS = 12
REACH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
_REACH_KEYS = ["campaign_id", "campaign_name", "channel"]


def reach_sketches(impressions: DataFrame, level: str = "day") -> DataFrame:
    """A sketch of each campaign's users per period, to be stored and united later on."""
    period = PERIODS[level]
    return impressions.withColumn(period, period_start(level)).groupBy(*_REACH_KEYS, period).agg(
        F.hll_sketch_agg("user_id", SKETCH_BITS).alias("users_sketch")
    )


def reach_rollup(sketches: DataFrame, level: str, by: tuple = tuple(_REACH_KEYS)) -> DataFrame:
    """Estimated users per week, month or day (and per fewer keys) from daily sketches, without the events.

    Three times `REACH_ERROR` hold for all but a few in a thousand.
    """
    period = PERIODS[level]
    start = F.col("event_date") if level == "day" else F.to_date(F.date_trunc(level, "event_date"))
    return sketches.withColumn(period, start).groupBy(*by, period).agg(
        F.hll_sketch_estimate(F.hll_union_agg("users_sketch")).alias("estimated_users")
    )
