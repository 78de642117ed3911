"""Registry of derived campaign metrics: name -> expression over base counts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import ratio


@dataclass(frozen=True)
class Metric:
    name: str
    level: int
    group: str
    expression: Callable[[], Column]


def _metric(name, level, group, expression):
    return name, Metric(name, level, group, expression)


# Metric names, levels and groups, and the order of ratios in reports.
#: Columns that a mart brings along, or a join with the credit per campaign.
BASE_METRICS = (
    "impressions", "clicks", "conversions", "spend", "revenue", "unique_users", "users_who_converted",
    "attributed_revenue",
)

METRICS: dict[str, Metric] = dict([
    *[_metric(name, 1, "base", partial(F.col, name)) for name in BASE_METRICS],
    _metric("cpm", 2, "efficiency", lambda: F.when(
        F.col("spend") > 0, ratio("spend", "impressions") * 1000).otherwise(F.lit(0.0))),
    _metric("ctr", 2, "engagement", lambda: ratio("clicks", "impressions")),
    _metric("cpc", 2, "efficiency", lambda: ratio("spend", "clicks")),
    _metric("cvr", 2, "engagement", lambda: ratio("conversions", "clicks")),
    _metric("aov", 2, "roi", lambda: ratio("revenue", "conversions")),
    _metric("fill_rate", 2, "inventory", lambda: ratio(
        "impressions", F.col("impressions") + F.col("zero_cost_impressions"), default=1.0)),
    _metric("frequency", 2, "reach", lambda: ratio("impressions", "unique_users")),
    _metric("cpa", 3, "efficiency", lambda: ratio("spend", "conversions")),
    _metric("roas", 3, "roi", lambda: ratio("revenue", "spend")),
])

CAMPAIGN_RATIOS = ("cpm", "ctr", "cpc", "cpa", "roas", "cvr", "aov")
MART_RATIOS = ("cpm", "ctr", "cpc", "cpa", "roas", "cvr", "aov", "fill_rate", "frequency")
METRIC_GROUPS = {
    "efficiency": ("cpm", "cpc", "cpa"),
    "engagement": ("ctr", "cvr", "frequency"),
    "roi": ("roas", "aov", "revenue"),
    "reach": ("impressions", "unique_users", "frequency"),
    "attribution": ("attributed_revenue",),
}
# End of fixed values.


def add_metrics(rows: DataFrame, names: Iterable[str] = MART_RATIOS) -> DataFrame:
    """Append metrics, one pass per dependency level; Catalyst merges the passes.

    Metrics of level 1 must be there already.
    """
    wanted = list(names)
    unknown = [n for n in wanted if n not in METRICS]
    if unknown:
        raise KeyError(f"unknown metrics: {unknown}")
    missing = [n for n in wanted if METRICS[n].level == 1 and n not in rows.columns]
    if missing:
        raise ValueError(f"base metrics are not among the columns: {missing}")
    for level in sorted({METRICS[n].level for n in wanted} - {1}):
        rows = rows.withColumns(
            {n: METRICS[n].expression() for n in wanted if METRICS[n].level == level}
        )
    return rows


def metrics_of_group(group: str) -> tuple[str, ...]:
    return METRIC_GROUPS[group]


def lookup(key, table: Mapping, default=None) -> Column:
    """Value of a small parameter table, as an expression instead of a join."""
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(literal, F.col(key) if isinstance(key, str) else key)
    return found if default is None else F.coalesce(found, F.lit(default))


def add_benchmark_flags(mart: DataFrame, benchmarks: Mapping[str, tuple[str, float]]) -> DataFrame:
    """One `meets_<metric>` flag per benchmark."""
    flags = {}
    for name, (direction, target) in benchmarks.items():
        flags[f"meets_{name}"] = (
            F.col(name) >= F.lit(target) if direction == ">=" else F.col(name) <= F.lit(target)
        )
    return mart.withColumns(flags)


def add_channel_ctr_flag(mart: DataFrame, targets: Mapping[str, float]) -> DataFrame:
    """Channel's own click-through target; NULL where the channel has none."""
    return mart.withColumn("channel_ctr_target", lookup("channel", targets)).withColumn(
        "meets_channel_ctr", F.col("ctr") >= F.col("channel_ctr_target")
    )


def add_seasonality(
    mart: DataFrame, factors: Mapping[str, float], metrics: Iterable[str], date: str = "event_date"
) -> DataFrame:
    """Divide metrics by the month's factor (1.0 where the month has none).

    Factors are keyed by month ("2024-11") or, for every year, by calendar month ("05");
    the former wins.
    """
    def month(pattern: str) -> Column:
        return lookup(F.date_format(F.col(date), pattern), factors)

    factor = F.coalesce(month("yyyy-MM"), month("MM"), F.lit(1.0))
    return mart.withColumn("seasonal_factor", factor).withColumns(
        {f"{m}_adjusted": F.col(m) / F.col("seasonal_factor") for m in metrics}
    )
