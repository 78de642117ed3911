"""Keep the latest version of each record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_version(rows: DataFrame, key: str, newest_first: Sequence[Column]) -> DataFrame:
    """One row per key. NULL is a key like any other.

    The rank filter is planned as a group limit on both sides of the shuffle, so
    a task sends at most one row per key and a hot key costs no more than others.
    """
    version = F.row_number().over(W.partitionBy(key).orderBy(*newest_first))
    return rows.withColumn("_version", version).where(F.col("_version") == 1).drop("_version")


def version_order(measures: Sequence[str], details: Sequence[str] = ()) -> list[Column]:
    """Newest first by sync time, then event time, then content.

    Content decides exact ties the same way on every run. `details` are compared
    last, so leaving them out cannot change which measures win.
    """
    order = [
        F.col("_synced_at").desc_nulls_last(),
        F.col("event_timestamp").desc_nulls_last(),
        F.xxhash64(*measures).desc(),
    ]
    if details:
        order.append(F.xxhash64(*details).desc())
    return order


def later_versions(known: DataFrame, arriving: DataFrame, key: str, newest_first: Sequence[Column]) -> DataFrame:
    """The latest of `arriving` per key, where it is later than the key's row in `known`.

    A version that is known already is no change, and neither is a stale one.
    """
    both = known.withColumn("_known", F.lit(True)).unionByName(
        latest_version(arriving, key, newest_first).withColumn("_known", F.lit(False))
    )
    newest = latest_version(both, key, [*newest_first, F.col("_known").desc()])
    return newest.where(~F.col("_known")).drop("_known")
