"""Schemas of the raw event tables. Fixed and name-based: nothing is inferred."""

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind(), True) for name, kind in columns.items()])


IMPRESSIONS = _schema(
    impression_id=StringType,
    user_id=StringType,
    campaign_id=StringType,
    campaign_name=StringType,
    channel=StringType,
    event_timestamp=TimestampType,
    impression_cost=DoubleType,
    advertiser_id=StringType,
    creative_id=StringType,
    placement_id=StringType,
    device_type=StringType,
    country=StringType,
    is_bot=BooleanType,
    _source_relation=StringType,
    _synced_at=TimestampType,
)

CONVERSIONS = _schema(
    conversion_id=StringType,
    user_id=StringType,
    campaign_id=StringType,
    order_id=StringType,
    event_timestamp=TimestampType,
    conversion_value=DoubleType,
    conversion_value_usd=DoubleType,
    conversion_type=StringType,
    advertiser_id=StringType,
    country=StringType,
    device_type=StringType,
    _source_relation=StringType,
    _synced_at=TimestampType,
)

CLICKS = _schema(
    click_id=StringType,
    campaign_id=StringType,
    user_id=StringType,
    event_timestamp=TimestampType,
)

UNFILLED_REQUESTS = _schema(
    request_id=StringType,
    campaign_id=StringType,
    event_timestamp=TimestampType,
)

# Columns a source may leave out; they are then filled in by the reader.
OPTIONAL = {"_source_relation", "_synced_at", "click_id", "request_id"}
