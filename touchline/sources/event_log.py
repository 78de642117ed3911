"""Adapter from a generic event log to the raw advertising tables.

The log has (event_id, ts, user_id, event_type, value, props) with props a JSON
text `{"k": n}`, 0 <= n < 100. Views become impressions, clicks clicks,
purchases and sign-ups conversions, errors unfilled ad requests. It is a pure
projection, so column pruning and the event-type filter reach the file scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The mapping repeated by the check queries.
CHANNELS = ("Search", "Display", "Video", "Social")
CAMPAIGNS = (
    "brand_search", "brand_display", "teaser_video", "feed_social",
    "generic_search", "retarget_display", "discover_video", "stories_social",
)
DEVICES = ("desktop", "mobile", "tablet", "mobile", "crawler")
AS_OF = "2024-01-31 00:00:00"


def _pick(names, index):
    return F.get(F.array(*[F.lit(n) for n in names]), index)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return from_log(spark.read.parquet(f"{folder}/events.parquet"))


def from_log(log: DataFrame) -> DataFrame:
    """The log with a UTC instant and the number taken out of its JSON text."""
    k = F.get_json_object("props", "$.k").cast("int")
    return log.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("user_id"),
        "event_type",
        "value",
        k.alias("k"),
    )


def with_stale_versions(log: DataFrame) -> DataFrame:
    """Every event twice: an early version, synced an hour sooner with another value."""
    hours = F.make_dt_interval(hours=F.col("k"))
    fresh = log.withColumn("_synced_at", F.col("ts") + hours)
    stale = fresh.withColumn("_synced_at", F.col("_synced_at") - F.expr("INTERVAL 1 HOUR")).withColumn(
        "value", F.col("value") + 1
    )
    return fresh.unionByName(stale)


def with_corrections(log: DataFrame) -> DataFrame:
    """Three versions of every event, numbered by `delivery`: an early one (0) with another value, campaign,
    bot and user flags and for some the day before, the right one (1), synced up to four days later, and a
    stale one (2) of a later time, synced before both and delivered last."""
    def version(delivery, synced, **columns):
        return log.withColumns({
            "_synced_at": F.col("ts") + synced, "delivery": F.lit(delivery), **columns,
        }).select(*log.columns, "_synced_at", "delivery")

    k, ts, value = F.col("k"), F.col("ts"), F.col("value")
    day_before = ts - F.expr("INTERVAL 1 DAY")
    early = version(
        0, F.expr("INTERVAL -1 HOUR"), value=value + 1, k=(k + 40) % 100, ts=F.when(k % 5 == 0, day_before).otherwise(ts)
    )
    stale = version(2, F.expr("INTERVAL -2 HOUR"), value=value + 2, k=(k + 7) % 100, ts=ts + F.expr("INTERVAL 3 HOURS"))
    return early.unionByName(version(1, F.make_dt_interval(hours=k))).unionByName(stale)


def _synced_at(log: DataFrame):
    if "_synced_at" in log.columns:
        return F.col("_synced_at")
    return F.col("ts") + F.make_dt_interval(hours=F.col("k"))


def impressions(log: DataFrame) -> DataFrame:
    k = F.col("k")
    return log.where(F.col("event_type") == "view").select(
        F.col("event_id").alias("impression_id"),
        F.when(k != 93, F.col("user_id")).alias("user_id"),
        _pick(CAMPAIGNS, k % 8).alias("campaign_id"),
        F.initcap(F.translate(_pick(CAMPAIGNS, k % 8), "_", " ")).alias("campaign_name"),
        _pick(CHANNELS, k % 4).alias("channel"),
        F.col("ts").alias("event_timestamp"),
        F.col("value").alias("impression_cost"),
        F.lit("advertiser").alias("advertiser_id"),
        F.concat(F.lit("creative_"), (k % 3).cast("string")).alias("creative_id"),
        F.concat(F.lit("placement_"), (k % 6).cast("string")).alias("placement_id"),
        _pick(DEVICES, k % 5).alias("device_type"),
        F.lit("US").alias("country"),
        F.when(k != 94, k >= 95).alias("is_bot"),
        F.lit("events").alias("_source_relation"),
        _synced_at(log).alias("_synced_at"),
    )


def clicks(log: DataFrame) -> DataFrame:
    return log.where(F.col("event_type") == "click").select(
        F.col("event_id").alias("click_id"),
        _pick(CAMPAIGNS, F.col("k") % 8).alias("campaign_id"),
        "user_id",
        F.col("ts").alias("event_timestamp"),
    )


def conversions(log: DataFrame) -> DataFrame:
    k = F.col("k")
    kind = F.when(F.col("event_type") == "purchase", "purchase").otherwise("trial_signup")
    return log.where(F.col("event_type").isin("purchase", "signup")).select(
        F.col("event_id").alias("conversion_id"),
        F.when(k != 10, F.col("user_id")).alias("user_id"),
        _pick(CAMPAIGNS, k % 8).alias("campaign_id"),
        F.concat(F.lit("order_"), F.col("event_id")).alias("order_id"),
        F.col("ts").alias("event_timestamp"),
        F.when(~k.isin(7, 8), F.col("value")).alias("conversion_value"),
        F.when(~k.isin(8, 9), F.col("value")).alias("conversion_value_usd"),
        kind.alias("conversion_type"),
        F.lit("advertiser").alias("advertiser_id"),
        F.lit("US").alias("country"),
        _pick(DEVICES, k % 5).alias("device_type"),
        F.lit("events").alias("_source_relation"),
        _synced_at(log).alias("_synced_at"),
    )


def unfilled_requests(log: DataFrame) -> DataFrame:
    return log.where(F.col("event_type") == "error").select(
        F.col("event_id").alias("request_id"),
        _pick(CAMPAIGNS, F.col("k") % 8).alias("campaign_id"),
        F.col("ts").alias("event_timestamp"),
    )


def exposures(log: DataFrame, experiment: str = "channel") -> DataFrame:
    """Experiment exposures: a row per view or purchase, an experiment per channel or campaign.

    The unit is a user's day; even users are the control arm.
    """
    names = {"channel": CHANNELS, "campaign": CAMPAIGNS}[experiment]
    arm = F.when(F.col("user_id").cast("long") % 2 == 0, "control").otherwise("variant")
    return log.where(F.col("event_type").isin("view", "purchase")).select(
        _pick(names, F.col("k") % len(names)).alias("experiment_id"),
        arm.alias("arm"),
        F.to_date("ts").alias("day"),
        F.concat_ws("@", F.col("user_id"), F.to_date("ts").cast("string")).alias("unit_id"),
        (F.col("event_type") == "view").alias("exposed"),
        (F.col("event_type") == "purchase").alias("converted"),
    )
