"""Exact medians and other order statistics of groups of any size.

A percentile aggregate keeps every distinct value of a group in one task's
memory. Here equal values are counted first, the counts are laid out in value
bins, and only the bins that hold a wanted rank are sorted, each by a task of
its own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.scalars import join_null_safe

BINS_PER_OCTAVE = 1024
_OCTAVES_BELOW_ONE = 1075


def value_bin(value: Column) -> Column:
    """Bin number that never decreases with the value (logarithmic, signed)."""
    magnitude = F.floor(F.log2(F.abs(value)) * BINS_PER_OCTAVE) + BINS_PER_OCTAVE * _OCTAVES_BELOW_ONE
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * (magnitude + 1))


def rank_values(
    rows: DataFrame,
    group: Sequence[str],
    value: str,
    ranks: Mapping[str, Callable[[Column], Column]],
    weight: str | None = None,
) -> DataFrame:
    """Per group the values at given 1-based ranks, NULL values left out.

    `ranks` maps an output column to its rank, as a function of the number of
    values in the group. `weight` says how many times a row counts.
    """
    group = list(group)
    # A constant key keeps one code path for the ungrouped case.
    keyed = rows if group else rows.withColumn("_all", F.lit(0))
    keys = group or ["_all"]
    # NULL values weigh nothing. Filtering them out instead would give this use
    # of `rows` a plan of its own, and its shuffles could not be shared.
    weigh = F.when(F.col(value).isNotNull(), F.col(weight) if weight else F.lit(1)).otherwise(0)
    counted = (
        keyed.groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.sum(weigh).alias("_n"))
        .withColumn("_bin", value_bin(F.col("_value")))
    )
    upto = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = (
        counted.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_in_bin"))
        .withColumn("_upto", F.sum("_in_bin").over(upto))
        .withColumn("_total", F.sum("_in_bin").over(W.partitionBy(*keys)))
        .withColumn("_start", F.col("_upto") - F.col("_in_bin"))
        .withColumns({f"_rank_{name}": rank(F.col("_total")) for name, rank in ranks.items()})
    )

    def held(name, first, last):
        return (F.col(f"_rank_{name}") > first) & (F.col(f"_rank_{name}") <= last)

    any_held = reduce(or_, [held(name, F.col("_start"), F.col("_upto")) for name in ranks])
    chosen = bins.where(any_held).select(
        *keys, "_bin", "_start", *[f"_rank_{name}" for name in ranks]
    )
    matched = join_null_safe(counted, chosen, [*keys, "_bin"])
    inside = W.partitionBy(*keys, "_bin").orderBy("_value").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    ranked = matched.withColumn("_last", F.col("_start") + F.sum("_n").over(inside))
    first = F.col("_last") - F.col("_n")
    found = ranked.groupBy(*keys).agg(*[
        F.max(F.when(held(name, first, F.col("_last")), F.col("_value"))).alias(name)
        for name in ranks
    ])
    return found.select(*group, *ranks)


def medians(
    rows: DataFrame, group: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """Per group the lower, upper and interpolated median. For an odd count they agree."""
    found = rank_values(rows, group, value, {
        "lower_median": lambda n: F.floor((n + 1) / 2),
        "upper_median": lambda n: F.floor(n / 2) + 1,
    }, weight)
    lower, upper = F.col("lower_median"), F.col("upper_median")
    return found.withColumn("median", lower + (upper - lower) * 0.5)


def refined_medians(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """`medians` in two passes over `rows`: a histogram first, then the values of the middle bins alone.

    The histogram is as large as the spread of the values in octaves, whatever their number,
    so nothing but it and the rows of at most two bins a group is shuffled.
    """
    group = list(group)
    valued = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_value")).withColumn(
        "_bin", value_bin(F.col("_value"))
    )
    upto = W.partitionBy(*group).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = valued.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_in_bin")).withColumns({
        "_upto": F.sum("_in_bin").over(upto), "_total": F.sum("_in_bin").over(W.partitionBy(*group)),
    }).withColumn("_start", F.col("_upto") - F.col("_in_bin"))
    ranks = {"_lower": F.floor((F.col("_total") + 1) / 2), "_upper": F.floor(F.col("_total") / 2) + 1}
    chosen = bins.withColumns(ranks).where(
        reduce(or_, [(F.col(r) > F.col("_start")) & (F.col(r) <= F.col("_upto")) for r in ranks])
    ).select(*group, "_bin", "_start", *ranks)
    counted = join_null_safe(valued, chosen, [*group, "_bin"]).groupBy(*group, "_bin", "_start", *ranks, "_value").agg(
        F.count(F.lit(1)).alias("_n")
    )
    inside = W.partitionBy(*group, "_bin").orderBy("_value").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = counted.withColumn("_last", F.col("_start") + F.sum("_n").over(inside))
    at = {r: (F.col(r) > F.col("_last") - F.col("_n")) & (F.col(r) <= F.col("_last")) for r in ranks}
    lower, upper = F.col("lower_median"), F.col("upper_median")
    return placed.groupBy(*group).agg(
        *[F.max(F.when(at[r], F.col("_value"))).alias(f"{r[1:]}_median") for r in ranks]
    ).withColumn("median", lower + (upper - lower) * 0.5)


def scalars_at_ranks(
    rows: DataFrame, value: str, ranks: Mapping[str, Callable[[Column], Column]]
) -> Column:
    """The values at ranks over all rows: one scalar subquery, a struct with a field per rank."""
    found = rank_values(rows, [], value, ranks)
    return found.agg(F.struct(*[F.max(name).alias(name) for name in ranks]).alias("at")).scalar()


def upper_median(rows: DataFrame, value: str, default: float | None = None) -> Column:
    """Upper median over all rows, as a scalar to compare columns with."""
    found = scalars_at_ranks(rows, value, {"upper": lambda n: F.floor(n / 2) + 1}).getField("upper")
    return found if default is None else F.coalesce(found, F.lit(float(default)))
