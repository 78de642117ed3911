"""Params from a nested configuration mapping (for example a parsed YAML file)."""

from __future__ import annotations

from collections.abc import Mapping

from touchline.params import BENCHMARKS, MDE_BY_TRAFFIC, Params

# The configuration keys users have in their files.
_KEYS = {
    ("sources", "impressions", "retention_days"): "retention_days",
    ("sources", "conversions", "retention_days"): "conversion_retention_days",
    ("sources", "conversions", "late_arrival_window_hours"): "late_window_hours",
    ("sources", "clicks", "retention_days"): "click_retention_days",
    ("attribution", "attribution_window_days"): "attribution_window_days",
    ("attribution", "time_decay_half_life_days"): "half_life_days",
    ("attribution", "models"): "models",
    ("attribution", "min_touches_for_attribution"): "min_touches",
    ("campaigns", "min_spend_usd"): "min_spend_usd",
    ("campaigns", "benchmarks", "target_roas"): "benchmarks.roas",
    ("campaigns", "benchmarks", "target_cpa_usd"): "benchmarks.cpa",
    ("campaigns", "benchmarks", "target_ctr_pct"): "benchmarks.ctr",
    ("optimization", "allocation_method"): "allocation_method",
    ("optimization", "scoring_weights"): "scoring_weights",
    ("optimization", "min_budget_change_pct"): "min_budget_change",
    ("optimization", "max_budget_change_pct"): "max_budget_change",
    ("ab_testing", "significance_level"): "alpha",
    ("ab_testing", "power"): "power",
    ("ab_testing", "minimum_detectable_effects", "low_traffic_campaigns"): "mde_by_traffic.low",
    ("ab_testing", "minimum_detectable_effects", "medium_traffic_campaigns"): "mde_by_traffic.medium",
    ("ab_testing", "minimum_detectable_effects", "high_traffic_campaigns"): "mde_by_traffic.high",
    ("reporting", "default_metrics"): "report_metrics",
    ("reporting", "aggregation_levels"): "report_levels",
    ("data_quality", "bot_detection", "flag_zero_cost_impressions"): "flag_zero_cost",
    ("data_quality", "bot_detection", "suspicious_device_patterns"): "suspicious_devices",
    ("data_quality", "outlier_threshold_std_dev"): "outlier_std_devs",
    ("data_quality", "missing_value_tolerance_pct"): "missing_tolerance",
    ("data_quality", "max_data_staleness_hours"): "max_staleness_hours",
    ("logging", "alerts", "spend_anomaly_threshold_pct"): "spend_drop_threshold",
    ("logging", "alerts", "error_rate_threshold_pct"): "error_rate_threshold",
    ("logging", "alerts", "freshness_alert_hours"): "freshness_alert_hours",
}
_PERCENT = {
    "min_budget_change", "max_budget_change", "missing_tolerance", "spend_drop_threshold",
    "error_rate_threshold", "benchmarks.ctr",
}
# Sections whose keys are all read here; the others are for schedulers, reports and alerts.
_READ = {"attribution", "campaigns", "optimization", "ab_testing", "data_quality"}
# Read from the tables handed to the operators, or by whoever schedules them.
_ELSEWHERE = {"table", "refresh_frequency"}
# End of fixed values.


def _leaves(config: Mapping, above: tuple = ()):
    for key, value in config.items():
        path = (*above, key)
        if isinstance(value, Mapping) and path not in _KEYS:
            yield from _leaves(value, path)
        else:
            yield path, value


def params_from(config: Mapping, as_of: str) -> Params:
    """Keys override the defaults; percentages become fractions.

    A key of a section that concerns the operators is used or refused by name, so a
    misspelt or unsupported setting cannot pass unnoticed.
    """
    found: dict = {}
    nested = {"benchmarks": dict(BENCHMARKS), "mde_by_traffic": dict(MDE_BY_TRAFFIC)}
    for path, value in _leaves(config):
        name = _KEYS.get(path)
        if name is None:
            if path[0] in _READ or path[0] == "sources" and path[-1] not in _ELSEWHERE:
                raise ValueError(f"unknown configuration key: {'.'.join(path)}")
            continue
        if value is None:
            continue
        if name in _PERCENT:
            value = value / 100.0
        group, _, key = name.partition(".")
        if key:
            old = nested[group][key]
            nested[group][key] = (old[0], value) if isinstance(old, tuple) else value
            found[group] = nested[group]
        else:
            found[name] = tuple(value) if isinstance(value, list) else value
    return Params(as_of=as_of, **found)
