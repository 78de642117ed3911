"""How far the attribution models agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.scalars import CREDIT, exact_sum, half_up
from touchline.plans.attribution import credit_by


def model_comparison(shares: DataFrame, models: Sequence[str]) -> DataFrame:
    """Total credit and top channel per model; equal credit goes to the first name."""
    channels = credit_by(shares, ["channel"], models)
    first = F.row_number().over(
        W.partitionBy("attribution_model").orderBy(F.desc("credit"), "channel")
    )
    return channels.withColumn("_place", first).groupBy("attribution_model").agg(
        exact_sum("credit", CREDIT).alias("total_revenue"),
        F.max(F.when(F.col("_place") == 1, F.col("channel"))).alias("top_channel"),
    )


def channel_consensus(shares: DataFrame, models: Sequence[str], top: int = 2) -> DataFrame:
    """In how many models a channel is among the `top` by credit."""
    place = F.row_number().over(
        W.partitionBy("attribution_model").orderBy(F.desc("credit"), "channel")
    )
    leaders = credit_by(shares, ["channel"], models).withColumn("_place", place).where(
        F.col("_place") <= top
    )
    return leaders.groupBy("channel").agg(
        F.count(F.lit(1)).alias("appears_in_top_2"), F.lit(len(models)).alias("models")
    )


def channel_divergence(shares: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mean, population deviation and range of a channel's credit over the models.

    A model that gives a channel nothing counts as 0. The models are columns of
    one row per channel, so no channel x model grid is built.
    """
    sums = shares.groupBy("channel").agg(
        *[F.coalesce(exact_sum(m, CREDIT), F.lit(0.0)).alias(m) for m in models]
    )
    n = float(len(models))
    total = sum((F.col(m) for m in models[1:]), F.col(models[0]))
    spread = sum(
        ((F.col(m) - F.col("_mean")) * (F.col(m) - F.col("_mean")) for m in models[1:]),
        (F.col(models[0]) - F.col("_mean")) * (F.col(models[0]) - F.col("_mean")),
    )
    return sums.withColumn("_mean", total / n).select(
        "channel",
        half_up("_mean", 2).alias("mean_credit"),
        half_up(F.sqrt(spread / n), 2).alias("std_dev"),
        F.least(*models).alias("min_credit"),
        F.greatest(*models).alias("max_credit"),
    )
