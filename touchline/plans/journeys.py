"""Journeys: the ordered touches in each conversion's window.

Touches are stored once, numbered along their user's history; a journey is a
range of those numbers. That is exact and linear in the data. The touch lists
themselves come as pages: a page is cut out of a chunk of consecutive touches
that is collected once and never longer than `page_size`, however long the
journey is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import MICROS_PER_DAY, MICROS_PER_MINUTE, floor_div
from touchline.operators.timeline import cut_hot_tiles, running_totals
from touchline.params import Params

_BEFORE, _TOUCH, _UPTO = 0, 1, 2


def _tile(at: str, p: Params) -> Column:
    return floor_div(at, p.tile_minutes * MICROS_PER_MINUTE)


def numbered_touches(impressions: DataFrame, p: Params) -> DataFrame:
    """Touches with their number in their user's history: 1, 2, 3, ... in order of time."""
    touches = impressions.where(F.col("user_id").isNotNull()).select(
        "user_id", F.unix_micros("event_timestamp").alias("ts_us"), "impression_id", "channel",
        "campaign_id", F.col("impression_cost").alias("cost"),
    ).withColumn("tile", _tile("ts_us", p))
    places = touches.select("user_id", "tile", F.col("ts_us").alias("position"))
    touches = cut_hot_tiles(touches.withColumn("position", F.col("ts_us")), places, p, ["user_id"]).drop("position")
    return running_totals(
        touches, ["user_id"], ["ts_us", "impression_id"],
        {"number": ("sum", F.lit(1).cast("long"))}, keep=F.lit(True),
    )


def _of_converting_users(impressions: DataFrame, conversions: DataFrame) -> DataFrame:
    """Most users never convert, and their touches are in no journey."""
    return impressions.join(conversions.select("user_id").distinct(), "user_id", "left_semi")


def _bounds(conversions: DataFrame, impressions: DataFrame, p: Params) -> DataFrame:
    """How many touches the user had before each window's start and up to its end."""
    touches = _of_converting_users(impressions, conversions).select(
        "user_id", F.unix_micros("event_timestamp").alias("at"), F.lit(_TOUCH).alias("kind"),
        "impression_id",
    )
    end = F.unix_micros("event_timestamp")
    start = end - p.attribution_window_days * MICROS_PER_DAY
    bounds = conversions.where(F.col("user_id").isNotNull()).select(
        "user_id", "conversion_id",
        F.explode(F.array(
            F.struct(F.lit(_BEFORE).alias("kind"), start.alias("at")),
            F.struct(F.lit(_UPTO).alias("kind"), end.alias("at")),
        )).alias("_bound"),
    ).select("user_id", "conversion_id", "_bound.*")
    both = touches.unionByName(bounds, allowMissingColumns=True).withColumn("tile", _tile("at", p))
    places = touches.select("user_id", F.col("at").alias("position")).withColumn("tile", _tile("position", p))
    both = cut_hot_tiles(both.withColumn("position", F.col("at")), places, p, ["user_id"]).drop("position")
    return running_totals(
        both, ["user_id"], ["at", "kind", "impression_id", "conversion_id"],
        {"number": ("sum", F.when(F.col("kind") == _TOUCH, 1).otherwise(0).cast("long"))},
        keep=F.col("kind") != _TOUCH,
    )


def journey_ranges(conversions: DataFrame, impressions: DataFrame, p: Params) -> DataFrame:
    """One row per conversion: the numbers of its first and last touch, and how many."""
    before = F.max(F.when(F.col("kind") == _BEFORE, F.col("number")))
    upto = F.max(F.when(F.col("kind") == _UPTO, F.col("number")))
    return (
        _bounds(conversions, impressions, p)
        .groupBy("conversion_id", "user_id")
        .agg(
            F.max(F.when(F.col("kind") == _UPTO, F.col("at"))).alias("conversion_us"),
            (before + 1).alias("first_number"),
            upto.alias("last_number"),
        )
        .withColumn("n_touches", F.col("last_number") - F.col("first_number") + 1)
    )


def journeys(
    conversions: DataFrame, impressions: DataFrame, p: Params, page_size: int = 1000
) -> DataFrame:
    """Touch lists in order, at most `page_size` long; pages of a conversion add up to its journey.

    A conversion without touches has one page with an empty list.
    """
    size = F.lit(page_size)

    def chunk_of(number):
        return floor_div(F.col(number) - 1, page_size)

    touch = F.struct("ts_us", "impression_id", "channel", "campaign_id", "cost")
    chunks = (
        numbered_touches(_of_converting_users(impressions, conversions), p)
        .groupBy("user_id", chunk_of("number").alias("chunk"))
        .agg(F.array_sort(F.collect_list(touch)).alias("touches"))
    )
    wanted = F.when(
        F.col("n_touches") > 0, F.sequence(chunk_of("first_number"), chunk_of("last_number"))
    )
    pages = journey_ranges(conversions, impressions, p).withColumn(
        "chunk", F.explode_outer(wanted)
    )
    start = F.greatest(F.col("first_number") - F.col("chunk") * size, F.lit(1)).cast("int")
    stop = F.least(F.col("last_number") - F.col("chunk") * size, size).cast("int")
    return pages.join(chunks, ["user_id", "chunk"], "left").select(
        "conversion_id", "user_id", "conversion_us", "n_touches",
        F.coalesce(F.col("chunk") - chunk_of("first_number"), F.lit(0)).alias("page"),
        F.when(F.col("chunk").isNull(), F.slice(F.array(), 1, 0))
        .otherwise(F.slice("touches", start, stop - start + 1)).alias("touches"),
    )


def journey_touches(conversions: DataFrame, impressions: DataFrame, p: Params) -> DataFrame:
    """Interval left join: a row per conversion and touch in its window, unmatched kept."""
    pages = journeys(conversions, impressions, p)
    return pages.select(
        "conversion_id", "user_id", "conversion_us", F.explode_outer("touches").alias("touch")
    ).select("conversion_id", "user_id", "conversion_us", "touch.*")
