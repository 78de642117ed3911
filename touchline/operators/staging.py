"""Cleaned impression and conversion tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import MICROS_PER_HOUR, bot_flag, suspicious_device
from touchline.operators.dedup import latest_version, version_order
from touchline.params import Params

IMPRESSION_KEY_FIELDS = ["impression_id", "user_id", "campaign_id", "event_timestamp"]
IMPRESSION_MEASURES = [
    "user_id", "campaign_id", "campaign_name", "channel", "impression_cost", "device_type", "is_bot",
]
IMPRESSION_DETAILS = [
    "advertiser_id", "creative_id", "placement_id", "country", "_source_relation",
]
CONVERSION_MEASURES = [
    "user_id", "campaign_id", "conversion_value", "conversion_value_usd", "conversion_type",
]
CONVERSION_DETAILS = ["order_id", "advertiser_id", "country", "device_type", "_source_relation"]


def retention_start(p: Params, days: int | None = None):
    """Midnight `days` (by default `retention_days`) before the as-of day, inclusive."""
    return F.date_sub(p.today(), p.retention_days if days is None else days).cast("timestamp")


def retained_clicks(clicks: DataFrame, p: Params) -> DataFrame:
    """Clicks are kept raw, but for those past a retention of their own."""
    if p.click_retention_days is None:
        return clicks
    return clicks.where(F.col("event_timestamp") >= retention_start(p, p.click_retention_days))


def with_bot_flag(rows: DataFrame, p: Params) -> DataFrame:
    flag = bot_flag("is_bot", "impression_cost", "event_timestamp") if p.flag_zero_cost else F.col("is_bot")
    if p.flag_suspicious_devices:
        flag = flag | suspicious_device("device_type", p.suspicious_devices)
    return rows.withColumn("is_bot_flag", flag)


def served_impressions(latest: DataFrame, p: Params) -> DataFrame:
    """Of latest versions those that are complete and not from a bot, of any date."""
    complete = latest.dropna(subset=IMPRESSION_KEY_FIELDS)
    return with_bot_flag(complete, p).where(~F.col("is_bot_flag"))


def stage_impressions(raw: DataFrame, p: Params, details: bool = True) -> DataFrame:
    """Latest version of each impression, complete, recent and not from a bot.

    The date and null filters run on the latest version and must stay above the
    deduplication: an id whose latest version fails them is gone, even if an
    older version would have passed. With `details=False` descriptive columns
    are neither read nor shuffled; the measures are the same.
    """
    extra = IMPRESSION_DETAILS if details else []
    rows = raw.select(
        "impression_id", "event_timestamp", "_synced_at", *IMPRESSION_MEASURES, *extra
    )
    latest = latest_version(rows, "impression_id", version_order(IMPRESSION_MEASURES, extra))
    kept = served_impressions(latest, p).where(F.col("event_timestamp") >= retention_start(p))
    if not details:
        return kept.drop("_synced_at", "is_bot", "is_bot_flag")
    return kept.drop("_synced_at", "is_bot", "_source_relation").withColumns({
        "impression_key": F.sha2("impression_id", 256),
        "updated_at": p.now(),
    })


def latest_conversions(raw: DataFrame, details: bool = True) -> DataFrame:
    """Latest version of each conversion with its validity flag, nothing filtered."""
    extra = CONVERSION_DETAILS if details else []
    rows = raw.select(
        "conversion_id", "event_timestamp", "_synced_at", *CONVERSION_MEASURES, *extra
    )
    latest = latest_version(rows, "conversion_id", version_order(CONVERSION_MEASURES, extra))
    return with_validity(latest)


def invalid_reasons() -> dict:
    return {
        "lacks_value": F.col("conversion_value").isNull() & F.col("conversion_value_usd").isNull(),
        "lacks_timestamp": F.col("event_timestamp").isNull(),
        "lacks_user": F.col("user_id").isNull(),
    }


def with_validity(conversions: DataFrame) -> DataFrame:
    """Reasons for which a record is invalid, and whether any holds. Works on streams too."""
    return conversions.withColumns(invalid_reasons()).withColumn(
        "is_invalid_record", F.col("lacks_value") | F.col("lacks_timestamp") | F.col("lacks_user")
    )


def valid_conversions(latest: DataFrame) -> DataFrame:
    """Of latest versions those that are valid, of any date."""
    return with_validity(latest).where(~F.col("is_invalid_record"))


def with_conversion_columns(valid: DataFrame, p: Params) -> DataFrame:
    """The value with its fallback, and how late the record came."""
    late_from = p.now() - F.expr(f"INTERVAL {p.late_window_hours} HOURS")
    lag = F.unix_micros("_synced_at") - F.unix_micros("event_timestamp")
    return valid.withColumns({
        "conversion_value": F.coalesce("conversion_value", "conversion_value_usd", F.lit(0.0)),
        "is_late_arrival": F.coalesce(F.col("_synced_at") > late_from, F.lit(False)),
        "arrival_lag_hours": lag / F.lit(float(MICROS_PER_HOUR)),
    })


def stage_conversions(raw: DataFrame, p: Params, details: bool = True) -> DataFrame:
    """Latest version of each conversion, valid, within retention and not in the future.

    `conversion_value` falls back to the dollar value; `conversion_value_usd`
    stays as delivered. `is_late_arrival` marks records synced within the late
    window before as-of; `arrival_lag_hours` is how long after the event that was.
    """
    valid = valid_conversions(latest_conversions(raw, details)).where(
        (F.col("event_timestamp") >= retention_start(p, p.conversion_retention_days))
        & (F.col("event_timestamp") <= p.now())
    )
    staged = with_conversion_columns(valid, p).drop(
        "_synced_at", "_source_relation", "lacks_value", "lacks_timestamp", "lacks_user"
    )
    if not details:
        return staged.drop("is_invalid_record", "is_late_arrival", "arrival_lag_hours")
    return staged.withColumns({
        "conversion_key": F.sha2("conversion_id", 256),
        "updated_at": p.now(),
    })
