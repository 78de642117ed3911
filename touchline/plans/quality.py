"""Data quality: range rules, outliers, gaps, freshness, anomalies, identities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.scalars import MICROS_PER_HOUR, MONEY, exact_sum, join_null_safe
from touchline.operators.rollups import PERIODS, conversion_counts
from touchline.params import RANGE_RULES, Params


def range_violations(
    mart: DataFrame, keys: Sequence[str], rules: Mapping[str, tuple[float, float]] = RANGE_RULES
) -> DataFrame:
    """One row per mart row and rule, with whether the metric is in range."""
    checks = F.explode(F.array(*[
        F.struct(
            F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"),
            F.lit(float(low)).alias("min_value"), F.lit(float(high)).alias("max_value"),
        )
        for m, (low, high) in rules.items()
    ]))
    return mart.select(*keys, checks.alias("_check")).select(*keys, "_check.*").withColumn(
        "in_range", F.col("value").between(F.col("min_value"), F.col("max_value"))
    )


def outliers(mart: DataFrame, metric: str, p: Params, group: str = "channel") -> DataFrame:
    """Mart rows with a metric's distance from its group's mean, in standard deviations.

    Mean and deviation combine on the map side and come back by a join on the
    few groups, so no task holds a whole group. A group without spread has no
    outliers.
    """
    x = F.col(metric).cast("double")
    stats = mart.groupBy(group).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std_dev"))
    z = F.when(F.col("std_dev") > 0, (x - F.col("mean")) / F.col("std_dev")).otherwise(0.0)
    return join_null_safe(mart, stats, [group], "left").withColumn("z", z).withColumn(
        "is_outlier", F.abs("z") > p.outlier_std_devs
    )


def missing_values(rows: DataFrame, columns: Sequence[str], p: Params) -> DataFrame:
    """Share of NULLs per column, all columns in one pass over the data."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    entry = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns
    ]))
    share = F.when(F.col("rows") > 0, F.col("missing") / F.col("rows")).otherwise(0.0)
    return counts.select("rows", entry.alias("_entry")).select("_entry.*", "rows").withColumn(
        "missing_share", share
    ).withColumn("within_tolerance", F.col("missing_share") <= p.missing_tolerance)


def freshness(sources: Mapping[str, DataFrame], p: Params, column: str = "event_timestamp") -> DataFrame:
    """Hours between each source's newest event and as-of. An empty source is stale."""
    parts = [
        rows.agg(F.max(column).alias("newest")).withColumn("source", F.lit(name))
        for name, rows in sources.items()
    ]
    newest = parts[0]
    for part in parts[1:]:
        newest = newest.unionByName(part)
    hours = (F.unix_micros(p.now()) - F.unix_micros("newest")) / F.lit(float(MICROS_PER_HOUR))
    return newest.withColumn("staleness_hours", hours).select(
        "source", "newest", "staleness_hours",
        F.coalesce(F.col("staleness_hours") > p.max_staleness_hours, F.lit(True)).alias("is_stale"),
        F.coalesce(F.col("staleness_hours") > p.freshness_alert_hours, F.lit(True)).alias("alert"),
    )


def spend_anomalies(mart: DataFrame, p: Params) -> DataFrame:
    """Daily spend per campaign against the mean of its preceding days in the mart."""
    before = W.partitionBy("campaign_id").orderBy("event_date").rowsBetween(
        -p.spend_average_days, -1
    )
    daily = mart.groupBy("campaign_id", "event_date").agg(exact_sum("spend").alias("spend"))
    total = F.sum(F.col("spend").cast(MONEY)).over(before)
    average = total.cast("double") / F.count("spend").over(before)
    return daily.withColumn("average_spend", average).withColumn(
        "is_anomaly", F.col("spend") < F.col("average_spend") * (1 - p.spend_drop_threshold)
    )


def error_rate(served: DataFrame, failed: DataFrame, p: Params) -> DataFrame:
    """Share of failed requests per day, both kinds counted in one shuffle."""
    def marked(rows, is_error):
        return rows.select(F.to_date("event_timestamp").alias("event_date"), F.lit(is_error).alias("e"))

    return marked(served, 0).unionByName(marked(failed, 1)).groupBy("event_date").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("e").alias("errors")
    ).withColumn("error_rate", F.col("errors") / F.col("requests")).withColumn(
        "alert", F.col("error_rate") > p.error_rate_threshold
    )


def spend_without_conversions(mart: DataFrame) -> DataFrame:
    return mart.where((F.col("spend") > 0) & (F.col("conversions") == 0))


def metric_identities(mart: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Relations that must hold between derived metrics, with how many rows break them.

    CPC = CPM / (1000 CTR), ROAS = AOV / CPA, CPA = CPC / CVR, where all are defined.
    """
    identities = {
        "cpc_from_cpm_ctr": (
            (F.col("clicks") > 0) & (F.col("spend") > 0),
            F.col("cpc"), F.col("cpm") / (F.col("ctr") * 1000),
        ),
        "roas_from_aov_cpa": (
            (F.col("conversions") > 0) & (F.col("spend") > 0),
            F.col("roas"), F.col("aov") / F.col("cpa"),
        ),
        "cpa_from_cpc_cvr": (
            (F.col("conversions") > 0) & (F.col("clicks") > 0),
            F.col("cpa"), F.col("cpc") / F.col("cvr"),
        ),
    }
    checks = F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("identity"),
            applies.alias("applies"),
            F.when(applies, F.abs(left - right) > tolerance * F.greatest(F.abs(left), F.lit(1.0))).alias("broken"),
        )
        for name, (applies, left, right) in identities.items()
    ]))
    return mart.select(checks.alias("_c")).groupBy("_c.identity").agg(
        F.count_if("_c.applies").alias("rows_checked"),
        F.count_if("_c.broken").alias("violations"),
    )


def unplaced_revenue(conversions: DataFrame, mart: DataFrame) -> DataFrame:
    """Conversions and revenue of campaign-days that have no impressions, so miss the mart."""
    placed = mart.select("campaign_id", PERIODS["day"]).distinct()
    lost = conversion_counts(conversions).join(placed, ["campaign_id", PERIODS["day"]], "left_anti")
    return lost.select("campaign_id", PERIODS["day"], "conversions", F.coalesce("revenue", F.lit(0.0)).alias("revenue"))


def invalid_reasons(latest: DataFrame) -> DataFrame:
    """How many latest versions of conversions fail each validity rule, or lack an id."""
    names = ["lacks_value", "lacks_timestamp", "lacks_user", "is_invalid_record"]
    counts = latest.agg(
        F.count(F.lit(1)).alias("records"),
        *[F.count_if(F.col(n)).alias(n) for n in names],
        F.count_if(F.col("conversion_id").isNull()).alias("lacks_id"),
    )
    entry = F.explode(F.array(*[
        F.struct(F.lit(n).alias("reason"), F.col(n).alias("failing")) for n in [*names, "lacks_id"]
    ]))
    return counts.select("records", entry.alias("_entry")).select("_entry.*", "records")


def write_checks(p: Params, required: Sequence[str] = (), ranges: Mapping[str, tuple[float, float]] | None = None) -> dict:
    """Aggregates to be watched while a table is written (`sinks.write_checked`), each with its limit: the share
    of rows without a required column, and the share of rows whose metric is out of range."""
    def outside(metric: str, low: float, high: float) -> Column:
        return F.avg((~F.col(metric).between(low, high)).cast("double"))

    return {
        **{f"missing_{c}": (F.avg(F.col(c).isNull().cast("double")), p.missing_tolerance) for c in required},
        **{f"{m}_out_of_range": (outside(m, *limits), 0.0) for m, limits in (ranges or {}).items()},
    }
