import pytest
from builders import at, clicks, conversions, impressions

from touchline.config import params_from
from touchline.operators import staging
from touchline.params import Params
from touchline.plans import campaign_mart, optimizer


def test_known_keys_override_defaults():
    p = params_from({
        "sources": {"conversions": {"late_arrival_window_hours": 48}},
        "attribution": {"time_decay_half_life_days": 3, "models": ["linear"]},
        "optimization": {"min_budget_change_pct": -20},
        "data_quality": {"missing_value_tolerance_pct": 2.5},
        "something_else": {"x": 1},
    }, as_of="2024-01-31")
    assert (p.late_window_hours, p.half_life_days, p.models) == (48, 3, ("linear",))
    assert (p.min_budget_change, p.missing_tolerance) == (-0.2, 0.025)
    assert p.retention_days == 90


def test_empty_config_is_the_defaults():
    assert params_from({}, "2024-01-31") == Params(as_of="2024-01-31")


def test_unknown_model_is_rejected():
    with pytest.raises(ValueError, match="u_shaped"):
        params_from({"attribution": {"models": ["u_shaped"]}}, "2024-01-31")


def test_all_sections_that_concern_the_operators_are_used():
    p = params_from({
        "sources": {
            "impressions": {"retention_days": 60, "table": "t", "refresh_frequency": "daily"},
            "conversions": {"retention_days": 30}, "clicks": {"retention_days": 45},
        },
        "campaigns": {"benchmarks": {"target_roas": 9.0, "target_cpa_usd": 20, "target_ctr_pct": 2}},
        "optimization": {"allocation_method": "performance_tier"},
        "reporting": {"default_metrics": ["clicks", "roas"], "aggregation_levels": ["weekly"]},
        "ab_testing": {"minimum_detectable_effects": {"low_traffic_campaigns": 0.3}},
        "data_quality": {"bot_detection": {"flag_zero_cost_impressions": False, "suspicious_device_patterns": ["robot"]}},
        "scheduling": {"daily_pipeline_time": "03:00"},
    }, "2024-01-31")
    assert (p.retention_days, p.conversion_retention_days, p.click_retention_days) == (60, 30, 45)
    assert (p.allocation_method, p.flag_zero_cost) == ("performance_tier", False)
    assert (p.report_metrics, p.report_levels) == (("clicks", "roas"), ("weekly",))
    assert p.benchmarks["roas"] == (">=", 9.0) and p.benchmarks["ctr"] == (">=", 0.02) and p.benchmarks["cpa"] == ("<=", 20)
    assert p.mde_by_traffic == {"low": 0.3, "medium": 0.15, "high": 0.10}
    assert p.suspicious_devices == ("robot",)


@pytest.mark.parametrize("config, name", [
    ({"attribution": {"windw_days": 3}}, "attribution.windw_days"),
    ({"optimization": {"allocation_method": "by_hand"}}, "allocation_method"),
    ({"reporting": {"aggregation_levels": ["hourly"]}}, "hourly"),
    ({"sources": {"impressions": {"retention": 7}}}, "impressions.retention"),
])
def test_other_settings_are_refused_by_name(config, name):
    with pytest.raises(ValueError, match=name):
        params_from(config, "2024-01-31")


def test_settings_take_effect(spark):
    p = params_from({
        "sources": {"clicks": {"retention_days": 5}},
        "optimization": {"allocation_method": "performance_tier"},
        "reporting": {"default_metrics": ["clicks", "fill_rate"], "aggregation_levels": ["weekly", "daily"]},
        "data_quality": {"bot_detection": {"flag_zero_cost_impressions": False}},
    }, as_of="2024-01-31 00:00:00")
    free = [{"impression_cost": 0.0, "event_timestamp": at("2024-01-30 08:00:00")}, {"event_timestamp": at("2024-01-30 09:00:00")}]
    staged = staging.stage_impressions(impressions(spark, free), p)
    clicked = staging.retained_clicks(clicks(spark, [
        {"event_timestamp": at("2024-01-30 08:00:01")}, {"event_timestamp": at("2024-01-20 08:00:01")},
    ]), p)
    reports = campaign_mart.reports(staged, clicked, conversions(spark, []), p)
    assert list(reports) == ["weekly", "daily"]
    assert reports["daily"].columns == ["campaign_id", "channel", "event_date", "clicks", "fill_rate"]
    # A free impression counts as unfilled: one of two billed, and two were shown.
    assert [(r.clicks, r.fill_rate) for r in reports["weekly"].collect()] == [(1, pytest.approx(2 / 3))]
    campaigns = spark.createDataFrame(
        [(f"c{n}", "Search", 100.0, 10.0 - n, 0.1, 5) for n in range(3)],
        "campaign_id string, channel string, spend double, roas double, ctr double, conversions long",
    )
    by_tier = optimizer.allocate(campaigns, p, 100.0)
    assert "tier" in by_tier.columns and "score" not in by_tier.columns
    assert "score" in optimizer.allocate(campaigns, p.with_(allocation_method="weighted_scoring"), 100.0).columns
