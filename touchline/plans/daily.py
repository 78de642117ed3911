"""One day's run: staged tables once, then every mart and report from them.

Staging shuffles the raw events to find the latest versions. Writing its result
means that is paid once, however many marts read it, and that a failed run
resumes from stored tables instead of raw data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.rollups import period_start
from touchline.operators.staging import retained_clicks, stage_conversions, stage_impressions
from touchline.params import Params
from touchline.plans import attribution, campaign_mart, comparison, optimizer, quality
from touchline.sources import sinks


def store_staging(
    impressions: DataFrame, clicks: DataFrame, conversions: DataFrame, p: Params, folder: str
) -> None:
    """Staged events by date, clustered for the marts. Clicks are kept raw."""
    staged = {
        "stg_impressions": (stage_impressions(impressions, p), ("campaign_id", "channel")),
        "stg_conversions": (stage_conversions(conversions, p), ("campaign_id",)),
        "clicks": (retained_clicks(clicks, p), ("campaign_id",)),
    }
    for name, (rows, cluster) in staged.items():
        # All retained rows: a date without any, or past retention, goes.
        sinks.replace_dates(
            rows.withColumn("event_date", period_start("day")), f"{folder}/{name}", cluster_by=cluster
        )


def run_day(spark: SparkSession, folder: str, p: Params) -> list[str]:
    """Build marts and reports from the staged tables in `folder`; returns the tables written."""
    def staged(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}")

    impressions, conversions = staged("stg_impressions"), staged("stg_conversions")
    mart_path, shares_path = f"{folder}/mart_campaign_metrics", f"{folder}/credit_shares"
    mart = campaign_mart.campaign_metrics(impressions, staged("clicks"), conversions)
    sinks.replace_dates(campaign_mart.with_audit(mart, p), mart_path)

    # Touched or not, every conversion's shares, read by all attribution tables.
    # Journeys of the first days of the retained range are cut off by it: a later run leaves their
    # stored credit as it was when the whole window was there.
    whole = F.date_sub(p.today(), p.retention_days - p.attribution_window_days)
    shares = attribution.credit_shares(conversions, impressions, p, unattributed=True)
    dated = shares.withColumn("event_date", F.to_date("conversion_ts"))
    first_run = not sinks.stored_dates(spark, shares_path)
    sinks.replace_dates(dated, shares_path, None if first_run else whole, ("conversion_id",))
    shares = spark.read.parquet(shares_path)
    # Four reports need no more of the touched conversions' shares than their totals: these are read once.
    totals_path = f"{folder}/credit_totals"
    totals = attribution.totals_of_shares(shares.where(F.col("journey_touches") > 0))
    totals.write.mode("overwrite").parquet(totals_path)
    touched = spark.read.parquet(totals_path)

    campaigns = campaign_mart.campaign_totals(spark.read.parquet(mart_path))
    tables = {
        "mart_attribution_summary": attribution.summary_of_shares(shares, p.models),
        "credit_breakdowns": attribution.credit_breakdowns(touched, p.models),
        "model_comparison": comparison.model_comparison(touched, p.models),
        "channel_consensus": comparison.channel_consensus(touched, p.models),
        "channel_divergence": comparison.channel_divergence(touched, p.models),
        "performance_tiers": optimizer.performance_tiers(campaigns),
        "budget_allocation": optimizer.allocation_report(optimizer.allocate(campaigns, p)),
        "range_checks": quality.range_violations(
            spark.read.parquet(mart_path), ["campaign_id", "event_date"]
        ),
        "revenue_conservation": attribution.revenue_conservation(conversions, shares, p),
    }
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    return ["mart_campaign_metrics", "credit_shares", *tables]
