import pytest
from builders import P, at, conversions, impressions
from pyspark.sql import functions as F

from touchline.operators import staging
from touchline.params import CATALOG_RANGE_RULES
from touchline.plans import quality

MART = (
    "campaign_id string, channel string, event_date string, spend double, clicks long, conversions long, "
    "cpm double, ctr double, cpc double, cvr double, cpa double, roas double, aov double"
)


def mart(spark, rows):
    return spark.createDataFrame(rows, MART).withColumn("event_date", F.to_date("event_date"))


def day(n, spend, campaign="a", channel="Search"):
    return (campaign, channel, f"2024-01-{n:02d}", spend, 10, 2, 50.0, 0.02, 2.5, 0.2, 12.5, 2.0, 25.0)


def test_range_rules(spark):
    rows = mart(spark, [day(1, 25.0), ("b", "Video", "2024-01-01", 1.0, 0, 0, 500.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)])
    got = {(r.campaign_id, r.metric): r.in_range for r in quality.range_violations(rows, ["campaign_id"]).collect()}
    assert got == {
        ("a", "cpm"): True, ("a", "ctr"): True, ("a", "roas"): True,
        ("b", "cpm"): False, ("b", "ctr"): True, ("b", "roas"): True,
    }
    strict = quality.range_violations(rows, ["campaign_id"], CATALOG_RANGE_RULES)
    assert strict.where("campaign_id = 'b' AND NOT in_range").count() == 5


def test_outliers(spark):
    rows = [day(n, 10.0 + n % 2) for n in range(1, 29)] + [day(29, 500.0)] + [day(1, 7.0, "v", "Video")]
    rows.append(day(1, 7.0, "n", None))
    assert quality.outliers(mart(spark, rows), "spend", P).count() == len(rows)
    got = quality.outliers(mart(spark, rows), "spend", P).where("is_outlier").collect()
    assert [(r.campaign_id, r.spend) for r in got] == [("a", 500.0)]


def test_missing_values(spark):
    raw = impressions(spark, [{"user_id": None}] + [{}] * 9 + [{"is_bot": None}] * 0)
    got = {r.column_name: r for r in quality.missing_values(raw, ["user_id", "is_bot"], P).collect()}
    assert (got["user_id"].missing, got["user_id"].missing_share, got["user_id"].within_tolerance) == (1, 0.1, False)
    assert got["is_bot"].within_tolerance


def test_freshness(spark):
    sources = {
        "fresh": impressions(spark, [{"event_timestamp": at("2024-01-30 20:00:00")}]),
        "alerting": impressions(spark, [{"event_timestamp": at("2024-01-30 12:00:00")}]),
        "stale": impressions(spark, [{"event_timestamp": at("2024-01-29 12:00:00")}]),
        "empty": impressions(spark, []),
    }
    got = {r.source: (r.staleness_hours, r.is_stale, r.alert) for r in quality.freshness(sources, P).collect()}
    assert got == {
        "fresh": (4.0, False, False), "alerting": (12.0, False, True), "stale": (36.0, True, True),
        "empty": (None, True, True),
    }


def test_spend_anomaly_needs_history(spark):
    rows = mart(spark, [day(n, 100.0) for n in range(1, 8)] + [day(8, 79.0), day(9, 100.0)])
    got = {r.event_date.day: r for r in quality.spend_anomalies(rows, P).collect()}
    assert got[1].is_anomaly is None and got[1].average_spend is None
    assert got[8].is_anomaly and got[8].average_spend == 100.0
    assert not got[9].is_anomaly


def test_error_rate(spark):
    served = impressions(spark, [{}] * 19)
    failed = impressions(spark, [{}])
    row = quality.error_rate(served, failed, P).first()
    assert (row.requests, row.errors, row.error_rate, row.alert) == (20, 1, 0.05, False)


def test_zero_conversion_spend(spark):
    rows = mart(spark, [day(1, 5.0), ("b", "Video", "2024-01-01", 5.0, 0, 0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)])
    assert [r.campaign_id for r in quality.spend_without_conversions(rows).collect()] == ["b"]


def test_identities(spark):
    good = day(1, 25.0)
    bad = ("b", "Video", "2024-01-01", 25.0, 10, 2, 50.0, 0.02, 9.9, 0.2, 12.5, 2.0, 25.0)
    got = {r.identity: (r.rows_checked, r.violations) for r in quality.metric_identities(mart(spark, [good, bad])).collect()}
    assert got == {"cpc_from_cpm_ctr": (2, 1), "roas_from_aov_cpa": (2, 0), "cpa_from_cpc_cvr": (2, 1)}


def test_invalid_reasons(spark):
    raw = conversions(spark, [
        {}, {"conversion_value": None, "conversion_value_usd": None}, {"user_id": None},
        {"conversion_id": None}, {"conversion_id": None},
        {"user_id": None, "conversion_value": None, "conversion_value_usd": None},
    ])
    got = {r.reason: r.failing for r in quality.invalid_reasons(staging.latest_conversions(raw)).collect()}
    assert got == {"lacks_value": 2, "lacks_timestamp": 0, "lacks_user": 2, "is_invalid_record": 3, "lacks_id": 1}
    assert pytest.approx(5) == quality.invalid_reasons(staging.latest_conversions(raw)).first().records
