"""Every tunable of the library in one immutable object.

`as_of` stands for "now" throughout: results depend on the data and on this
value only, so a rerun or a backfill of an old day gives the same answer.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model names, default thresholds and benchmarks of the domain.
MODELS = ("last_touch", "first_touch", "linear", "time_decay")
SCORING_WEIGHTS = {"roas": 0.5, "efficiency": 0.3, "growth_potential": 0.2}
BENCHMARKS = {
    "roas": (">=", 4.0),
    "cpa": ("<=", 50.0),
    "ctr": (">=", 0.015),
    "cvr": (">=", 0.03),
    "fill_rate": (">=", 0.95),
}
CHANNEL_CTR_BENCHMARKS = {"Search": 0.015, "Display": 0.005, "Video": 0.03}
SEASONALITY = {"11": 1.5, "12": 2.0, "01": 1.2, "05": 0.9, "06": 0.9, "07": 0.9}
MDE_BY_TRAFFIC = {"low": 0.20, "medium": 0.15, "high": 0.10}
# Rates are fractions here: 0..100 percent is 0..1.
RANGE_RULES = {"cpm": (0.0, 100.0), "ctr": (0.0, 1.0), "roas": (0.0, 1000.0)}
CATALOG_RANGE_RULES = {
    "cpm": (0.10, 100.0),
    "ctr": (0.0001, 0.50),
    "cvr": (0.001, 0.50),
    "roas": (0.1, 100.0),
    "cpa": (1.0, 500.0),
}
SUSPICIOUS_DEVICES = ("bot", "crawler", "spider")
ALLOCATION_METHODS = ("weighted_scoring", "performance_tier")
REPORT_METRICS = (
    "impressions", "clicks", "conversions", "spend", "revenue", "cpm", "ctr", "cpc", "cpa", "roas",
    "fill_rate", "frequency",
)
REPORT_LEVELS = {"daily": "day", "weekly": "week", "monthly": "month"}
# End of fixed values.


@dataclass(frozen=True)
class Params:
    as_of: str
    retention_days: int = 90
    # Conversions' own retention; impressions' by default.
    conversion_retention_days: int | None = None
    # Clicks' own retention; without it clicks are kept as they come.
    click_retention_days: int | None = None
    late_window_hours: int = 72
    attribution_window_days: int = 28
    half_life_days: float = 7.0
    models: tuple[str, ...] = MODELS
    min_touches: int = 1
    min_spend_usd: float = 100.0
    scoring_weights: dict = field(default_factory=lambda: dict(SCORING_WEIGHTS))
    allocation_method: str = "weighted_scoring"
    min_budget_change: float = -0.50
    max_budget_change: float = 1.00
    alpha: float = 0.05
    power: float = 0.80
    traffic_split: float = 0.5
    mde_by_traffic: dict = field(default_factory=lambda: dict(MDE_BY_TRAFFIC))
    # Whether free impressions are taken for bots.
    flag_zero_cost: bool = True
    flag_suspicious_devices: bool = False
    suspicious_devices: tuple[str, ...] = SUSPICIOUS_DEVICES
    benchmarks: dict = field(default_factory=lambda: dict(BENCHMARKS))
    report_metrics: tuple[str, ...] = REPORT_METRICS
    report_levels: tuple[str, ...] = tuple(REPORT_LEVELS)
    outlier_std_devs: float = 3.0
    missing_tolerance: float = 0.05
    max_staleness_hours: int = 24
    freshness_alert_hours: int = 6
    spend_drop_threshold: float = 0.20
    spend_average_days: int = 7
    error_rate_threshold: float = 0.05
    # Width of the time tiles that split one user's history over many tasks.
    tile_minutes: int = 60
    # Tiles with more touches of one user are measured and cut again by rank; None measures nothing.
    hot_tile_rows: int | None = None

    def __post_init__(self):
        if self.half_life_days <= 0:
            raise ValueError("half_life_days must be positive")
        # Weights span 2^(window / half life) both ways and must fit a double.
        if self.attribution_window_days / self.half_life_days > 900:
            raise ValueError("half_life_days is too short for the attribution window")
        unknown = set(self.models) - set(MODELS)
        if unknown:
            raise ValueError(f"unknown attribution models: {sorted(unknown)}")
        if self.allocation_method not in ALLOCATION_METHODS:
            raise ValueError(f"unknown allocation_method {self.allocation_method!r}, choose from {ALLOCATION_METHODS}")
        if odd := set(self.report_levels) - set(REPORT_LEVELS):
            raise ValueError(f"unknown aggregation_levels: {sorted(odd)}")

    def now(self) -> Column:
        return F.lit(self.as_of).cast("timestamp")

    def today(self) -> Column:
        return F.to_date(self.now())

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)
