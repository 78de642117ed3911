from builders import P, at, conversions, impressions
from pyspark.sql import functions as F

from touchline.operators import staging
from touchline.operators.dedup import latest_version, version_order


def ids(frame, column):
    return sorted(r[0] for r in frame.select(column).collect())


def test_bot_flag_follows_three_valued_logic(spark):
    raw = impressions(spark, [
        {"impression_id": "null_flag", "is_bot": None, "impression_cost": 1.0},
        {"impression_id": "null_cost", "is_bot": False, "impression_cost": None},
        {"impression_id": "free", "is_bot": False, "impression_cost": 0.0},
        {"impression_id": "bot", "is_bot": True, "impression_cost": 1.0},
        {"impression_id": "good", "is_bot": False, "impression_cost": 1.0},
    ])
    assert ids(staging.stage_impressions(raw, P), "impression_id") == ["good"]


def test_suspicious_devices_are_bots_when_enabled(spark):
    raw = impressions(spark, [
        {"impression_id": "a", "device_type": "GoogleBot 2"},
        {"impression_id": "b", "device_type": "mobile"},
        {"impression_id": "c", "device_type": None},
    ])
    assert ids(staging.stage_impressions(raw, P), "impression_id") == ["a", "b", "c"]
    strict = P.with_(flag_suspicious_devices=True)
    assert ids(staging.stage_impressions(raw, strict), "impression_id") == ["b", "c"]


def test_missing_keys_and_old_rows_are_dropped(spark):
    raw = impressions(spark, [
        {"impression_id": "ok"},
        {"impression_id": None},
        {"impression_id": "no_user", "user_id": None},
        {"impression_id": "no_campaign", "campaign_id": None},
        {"impression_id": "first_kept", "event_timestamp": at("2023-11-02 00:00:00")},
        {"impression_id": "too_old", "event_timestamp": at("2023-11-01 23:59:59")},
    ])
    assert ids(staging.stage_impressions(raw, P), "impression_id") == ["first_kept", "ok"]


def test_filters_apply_to_the_latest_version_only(spark):
    raw = impressions(spark, [
        {"impression_id": "x", "impression_cost": 2.0, "_synced_at": at("2024-01-21 00:00:00")},
        {"impression_id": "x", "impression_cost": 3.0, "_synced_at": at("2024-01-22 00:00:00")},
        {"impression_id": "y", "_synced_at": at("2024-01-21 00:00:00")},
        {"impression_id": "y", "event_timestamp": at("2023-01-01 00:00:00"), "_synced_at": at("2024-01-22 00:00:00")},
    ])
    rows = staging.stage_impressions(raw, P).collect()
    assert [(r.impression_id, r.impression_cost) for r in rows] == [("x", 3.0)]


def test_ties_are_broken_the_same_way_with_and_without_details(spark):
    raw = impressions(spark, [
        {"impression_id": "x", "impression_cost": c, "creative_id": d} for c in (1.0, 2.0, 3.0) for d in ("p", "q")
    ])
    full = staging.stage_impressions(raw, P).collect()
    lean = staging.stage_impressions(raw.orderBy(F.rand(3)), P, details=False).collect()
    assert len(full) == len(lean) == 1
    assert full[0].impression_cost == lean[0].impression_cost


def test_dedup_is_idempotent_and_null_is_one_key(spark):
    rows = conversions(spark, [{"conversion_id": i} for i in ("a", "a", None, None, "b")])
    order = version_order(["user_id"])
    once = latest_version(rows, "conversion_id", order)
    assert once.count() == 3
    assert latest_version(once, "conversion_id", order).count() == 3


def test_surrogate_key_is_stable(spark):
    raw = impressions(spark, [{"impression_id": "x"}])
    keys = {staging.stage_impressions(raw, P).first().impression_key for _ in range(2)}
    assert len(keys) == 1


def test_conversion_rules(spark):
    raw = conversions(spark, [
        {"conversion_id": "plain"},
        {"conversion_id": "no_value", "conversion_value": None, "conversion_value_usd": None},
        {"conversion_id": "local_only", "conversion_value": 7.0, "conversion_value_usd": None},
        {"conversion_id": "usd_only", "conversion_value": None, "conversion_value_usd": 9.0},
        {"conversion_id": "no_user", "user_id": None},
        {"conversion_id": "future", "event_timestamp": at("2024-01-31 00:00:01")},
        {"conversion_id": "now", "event_timestamp": at("2024-01-31 00:00:00")},
        {"conversion_id": "never_synced", "_synced_at": None},
        {"conversion_id": "late", "_synced_at": at("2024-01-30 00:00:00")},
    ])
    rows = {r.conversion_id: r for r in staging.stage_conversions(raw, P).collect()}
    assert sorted(rows) == ["late", "local_only", "never_synced", "now", "plain", "usd_only"]
    assert rows["local_only"].conversion_value == 7.0 and rows["local_only"].conversion_value_usd is None
    assert rows["usd_only"].conversion_value == 9.0
    assert rows["late"].is_late_arrival and not rows["plain"].is_late_arrival
    assert rows["never_synced"].is_late_arrival is False
    assert rows["late"].arrival_lag_hours == 24 * 9 + 14


def test_record_without_timestamp_is_invalid(spark):
    raw = conversions(spark, [{"event_timestamp": None, "_synced_at": at("2024-01-20 00:00:00")}])
    latest = staging.latest_conversions(raw).first()
    assert latest.lacks_timestamp and latest.is_invalid_record
    assert staging.stage_conversions(raw, P).count() == 0
