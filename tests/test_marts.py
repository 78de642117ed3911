import pytest
from builders import P, at, clicks, conversions, impressions
from pyspark.sql import functions as F

from touchline.functions.metrics import (
    METRIC_GROUPS, METRICS, add_benchmark_flags, add_channel_ctr_flag, add_metrics, add_seasonality, metrics_of_group,
)
from touchline.operators import rollups
from touchline.params import BENCHMARKS, CHANNEL_CTR_BENCHMARKS, SEASONALITY
from touchline.plans import campaign_mart, quality


@pytest.fixture(scope="module")
def mart(spark):
    imps = impressions(spark, [
        {"user_id": "u1", "impression_cost": 2.0},
        {"user_id": "u1", "impression_cost": 2.0},
        {"user_id": "u2", "impression_cost": 4.0},
        {"user_id": "u3", "campaign_id": "other", "event_timestamp": at("2024-01-21 00:00:00")},
        # The same campaign under a second channel on the same day.
        {"user_id": "u3", "campaign_id": "other", "channel": "Video", "event_timestamp": at("2024-01-21 01:00:00")},
    ])
    shown = clicks(spark, [
        {"user_id": "u1"}, {"user_id": "u1"}, {"campaign_id": "other", "event_timestamp": at("2024-01-21 02:00:00")},
    ])
    convs = conversions(spark, [
        {"conversion_value_usd": 12.0},
        {"campaign_id": "other", "event_timestamp": at("2024-01-22 00:00:00"), "conversion_value_usd": 5.0},
    ])
    return campaign_mart.campaign_metrics(imps, shown, convs), convs


def test_metrics_of_a_day(mart):
    row = mart[0].where("campaign_id = 'camp'").first()
    assert (row.impressions, row.unique_users, row.spend) == (3, 2, 8.0)
    assert (row.clicks, row.users_who_clicked, row.conversions, row.revenue) == (2, 1, 1, 12.0)
    assert row.cpm == pytest.approx(8000 / 3)
    assert row.ctr == pytest.approx(2 / 3)
    assert (row.cpc, row.cpa, row.roas, row.cvr, row.aov) == (4.0, 8.0, 1.5, 0.5, 12.0)
    assert (row.fill_rate, row.frequency) == (1.0, 1.5)


def test_no_clicks_or_conversions_means_zero_not_null(mart):
    rows = mart[0].where("campaign_id = 'other'").collect()
    assert len(rows) == 2
    for row in rows:
        # Clicks of the day repeat under both channels.
        assert (row.clicks, row.conversions, row.revenue, row.cpa, row.roas, row.aov) == (1, 0, 0.0, 0.0, 0.0, 0.0)


def test_conversion_day_without_impressions_is_reported_as_lost(mart):
    lost = quality.unplaced_revenue(mart[1], mart[0]).collect()
    assert [(r.campaign_id, r.conversions, r.revenue) for r in lost] == [("other", 1, 5.0)]


def test_weekly_users_are_distinct_over_the_week(spark):
    imps = impressions(spark, [
        {"user_id": "u1", "event_timestamp": at(f"2024-01-{d} 08:00:00")} for d in (15, 16, 21, 22)
    ])
    none = clicks(spark, []), conversions(spark, [])
    rows = campaign_mart.campaign_metrics(imps, *none, level="week").orderBy("week_start").collect()
    assert [(str(r.week_start), r.impressions, r.unique_users) for r in rows] == [
        ("2024-01-15", 3, 1), ("2024-01-22", 1, 1),
    ]
    month = campaign_mart.campaign_metrics(imps, *none, level="month").first()
    assert (str(month.month_start), month.impressions, month.unique_users) == ("2024-01-01", 4, 1)


def test_approximate_reach_is_close(spark):
    imps = impressions(spark, [{"user_id": f"u{n}"} for n in range(500)])
    row = rollups.impression_counts(imps, approximate_reach=True).first()
    assert abs(row.unique_users - 500) < 75


def test_unknown_level_is_rejected(spark):
    with pytest.raises((ValueError, KeyError)):
        rollups.click_counts(clicks(spark, [{}]), "hour")


def test_request_fill_counts_days_of_either_kind(spark):
    imps = impressions(spark, [{}, {}, {}])
    unfilled = spark.createDataFrame(
        [("r1", "camp", at("2024-01-20 00:00:00")), ("r2", "camp", at("2024-01-25 00:00:00"))],
        "request_id string, campaign_id string, event_timestamp timestamp",
    )
    rows = rollups.request_fill(imps, unfilled).orderBy("event_date").collect()
    assert [(r.served_impressions, r.unfilled_requests, r.request_fill_rate) for r in rows] == [
        (3, 1, 0.75), (0, 1, 0.0),
    ]


def test_spend_is_summed_exactly(spark):
    imps = impressions(spark, [{"impression_cost": 0.1} for _ in range(10)])
    assert rollups.impression_counts(imps).first().spend == 1.0


def test_registry_levels_and_groups(spark):
    counts = spark.createDataFrame(
        [(100, 5, 2, 50.0, 80.0, 40, 0)],
        "impressions long, clicks long, conversions long, spend double, revenue double, unique_users long, "
        "zero_cost_impressions long",
    )
    row = add_metrics(counts, [m for m in METRICS if METRICS[m].level > 1]).first()
    assert (row.cpm, row.ctr, row.cpc, row.cpa, row.roas, row.cvr, row.aov, row.frequency) == (
        500.0, 0.05, 10.0, 25.0, 1.6, 0.4, 40.0, 2.5,
    )
    assert metrics_of_group("efficiency") == ("cpm", "cpc", "cpa")
    with pytest.raises(KeyError):
        add_metrics(counts, ["profit"])
    credited = counts.withColumns({"attributed_revenue": F.lit(1.0), "zero_cost_impressions": F.lit(0)})
    for group in METRIC_GROUPS:
        assert set(metrics_of_group(group)) <= set(add_metrics(credited, metrics_of_group(group)).columns)
    with pytest.raises(ValueError, match="attributed_revenue"):
        add_metrics(counts, metrics_of_group("attribution"))


def test_flags_and_seasonality(mart):
    row = add_channel_ctr_flag(add_benchmark_flags(mart[0], BENCHMARKS), CHANNEL_CTR_BENCHMARKS).where(
        "campaign_id = 'camp'"
    ).first()
    assert (row.meets_roas, row.meets_cpa, row.meets_ctr, row.meets_cvr, row.meets_fill_rate) == (
        False, True, True, True, True,
    )
    assert row.channel_ctr_target == 0.015 and row.meets_channel_ctr
    adjusted = add_seasonality(mart[0], SEASONALITY, ["spend"]).where("campaign_id = 'camp'").first()
    assert adjusted.spend_adjusted == pytest.approx(8.0 / 1.2)
    summer = add_seasonality(mart[0].withColumn("event_date", F.to_date(F.lit("2025-06-01"))), SEASONALITY, ["spend"])
    assert {r.seasonal_factor for r in summer.collect()} == {0.9}
    both = add_seasonality(mart[0], {"01": 2.0, "2024-01": 5.0}, ["spend"]).first()
    assert both.seasonal_factor == 5.0
    plain = add_seasonality(mart[0], {"2030-01": 9.0}, ["spend"]).where("campaign_id = 'camp'").first()
    assert plain.spend_adjusted == 8.0


def test_campaign_totals_recompute_ratios(spark):
    mart = spark.createDataFrame(
        [("a", "Search", "2024-01-01", 10.0, 100, 10, 1, 20.0), ("a", "Search", "2024-01-02", 30.0, 100, 2, 1, 20.0)],
        "campaign_id string, channel string, event_date string, spend double, impressions long, clicks long, "
        "conversions long, revenue double",
    ).withColumn("event_date", F.to_date("event_date"))
    totals = campaign_mart.campaign_totals(mart)
    row = totals.first()
    assert (row.days_active, row.spend, row.cpc, row.roas) == (2, 40.0, 40.0 / 12, 1.0)
    assert campaign_mart.campaign_report(totals).first().ctr == 6.0
    assert campaign_mart.minimum_spend(totals, P).count() == 0
    assert campaign_mart.minimum_spend(totals, P.with_(min_spend_usd=40.0)).count() == 1
