"""Daily campaign counts of streams that correct themselves.

A stream cannot take back what it has counted. Here each micro-batch is compared with the
latest version of every record known so far (`runs.KeyedTable`); what a record stood for is
subtracted and what it stands for now is added. The signed amounts are merged into a table
of sums (`runs.SummedTable`), by campaign, day and user: a corrected cost, a record moved to
another day or campaign, one withdrawn and one that turns out to be a bot end as the
batch mart has them, in whatever order versions arrive. Sums over users are the counts;
users whose rows have not cancelled out are the reach, exact and mergeable over batches,
days and campaigns, since the sums by user are.

Clicks are kept raw, without versions: each arrival counts, once per batch.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline.functions.scalars import MONEY
from touchline.operators.dedup import later_versions, version_order
from touchline.operators.rollups import PERIODS, period_start
from touchline.operators.staging import (
    CONVERSION_DETAILS,
    CONVERSION_MEASURES,
    IMPRESSION_DETAILS,
    IMPRESSION_MEASURES,
    served_impressions,
    valid_conversions,
)
from touchline.params import Params
from touchline.plans import campaign_mart
from touchline.sources.runs import KeyedTable, SummedTable
from touchline.sources.schemas import CONVERSIONS, IMPRESSIONS

#: Kinds of records with versions: schema, key, what orders versions.
_VERSIONED = {
    "impressions": (IMPRESSIONS, "impression_id", IMPRESSION_MEASURES, IMPRESSION_DETAILS),
    "conversions": (CONVERSIONS, "conversion_id", CONVERSION_MEASURES, CONVERSION_DETAILS),
}
_SUM = "decimal(28,6)"
#: Columns of the sums: keys, then what is added up; `rows` counts the records.
_COUNTS = {
    "impressions": ("campaign_id string, campaign_name string, channel string, event_date date, user_id string",
                    f"rows long, free long, amount {_SUM}"),
    "conversions": ("campaign_id string, event_date date, user_id string", f"rows long, ids long, amount {_SUM}"),
    "clicks": ("campaign_id string, event_date date, user_id string", "rows long"),
}


def counts_table(spark: SparkSession, path: str, kind: str) -> SummedTable:
    keys, sums = _COUNTS[kind]
    return SummedTable(spark, f"{path}/{kind}/counts", f"{keys}, {sums}", [c.split()[0] for c in sums.split(", ")])


def contributions(latest: DataFrame, kind: str, p: Params, sign: int = 1) -> DataFrame:
    """What records stand for: keys and amounts, signed. Records that staging would drop for any reason
    but their date stand for nothing."""
    if kind == "impressions":
        rows, amount = served_impressions(latest, p), "impression_cost"
        more = {"free": F.when(F.col(amount) == 0, sign).otherwise(0).cast("long")}
    elif kind == "conversions":
        rows, amount = valid_conversions(latest), "conversion_value_usd"
        more = {"ids": F.when(F.col("conversion_id").isNotNull(), sign).otherwise(0).cast("long")}
    else:
        rows, amount, more = latest, None, {}
    keys = [c.split()[0] for c in _COUNTS[kind][0].split(", ")]
    if amount:
        value = F.coalesce(F.col(amount).cast(MONEY), F.lit(0)).cast(_SUM)
        more["amount"] = (value if sign > 0 else -value).cast(_SUM)
    return rows.withColumn("event_date", period_start("day")).select(
        *keys, F.lit(sign).cast("long").alias("rows"), *[column.alias(name) for name, column in more.items()]
    )


def count_changes(
    events: DataFrame, kind: str, path: str, checkpoint: str, p: Params, trigger: Mapping | None = None,
    buckets: int = 64, set_late_aside: bool = False,
) -> StreamingQuery:
    """Keep the counts of one kind of stream (impressions, conversions or clicks) in `path`/`kind`.

    Nothing is dropped for being late. With `set_late_aside`, rows more than `late_window_hours`
    older than the newest of earlier batches, which a watermark would drop, first go to a side
    table (`late_rows`) and are counted with the next batch: figures that have been reported
    change for late rows once a batch, and it is known how many there were.
    """
    if kind not in _COUNTS:
        raise ValueError(f"unknown kind {kind!r}, choose from {sorted(_COUNTS)}")

    def count(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sums = counts_table(spark, path, kind)
        if set_late_aside:
            batch = _without_late(batch, f"{path}/{kind}", batch_id, p)
        if kind in _VERSIONED:
            schema, key, *columns = _VERSIONED[kind]
            order = version_order(*columns)
            versions = KeyedTable(spark, f"{path}/{kind}/versions", schema, key, buckets)
            arriving = batch.select(*versions.columns)
            versions.put_changes(later_versions(versions.latest(batch_id, arriving), arriving, key, order), batch_id)
            now = versions.changed_in(batch_id)
            # The table as it was before this batch still has its runs.
            signed = contributions(now, kind, p).unionByName(
                contributions(versions.latest(batch_id, now), kind, p, sign=-1)
            )
        else:
            signed = contributions(batch, kind, p)
        sums.put(sums.combine(signed), batch_id)

    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(count).start()
    )


def _without_late(batch: DataFrame, path: str, batch_id: int, p: Params) -> DataFrame:
    """The batch without its late rows, which are set aside, and with those of the batch before."""
    spark = batch.sparkSession
    newest = batch.agg(F.max("event_timestamp").alias("newest"))
    if not batch_id:
        newest.write.mode("overwrite").parquet(f"{path}/newest/batch_id=0")
        batch.limit(0).write.mode("overwrite").parquet(f"{path}/late/batch_id=0")
        return batch
    before = spark.read.schema("newest timestamp").parquet(f"{path}/newest/batch_id={batch_id - 1}")
    limit = before.agg(F.max("newest")).scalar() - F.expr(f"INTERVAL {p.late_window_hours} HOURS")
    is_late = F.coalesce(F.col("event_timestamp") < limit, F.lit(False))
    newest.unionByName(before).agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(
        f"{path}/newest/batch_id={batch_id}"
    )
    batch.where(is_late).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
    waiting = spark.read.schema(batch.schema).parquet(f"{path}/late/batch_id={batch_id - 1}")
    return batch.where(~is_late).unionByName(waiting)


def late_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All rows that were set aside, with the batch they came in; those of the newest are not yet counted."""
    return spark.read.parquet(f"{path}/{kind}/late")


def _within(days: int, p: Params):
    """Days inside retention that have begun before as-of."""
    last = F.to_date(p.now() - F.expr("INTERVAL 1 MICROSECOND"))
    return F.col("event_date").between(F.date_sub(p.today(), days), last)


def _per_period(rows: DataFrame, level: str, *keys: str) -> DataFrame:
    """Sums by user from days to periods: a user of several days is one user."""
    period = PERIODS[level]
    start = F.col("event_date") if level == "day" else F.to_date(F.date_trunc(level, "event_date"))
    sums = [c for c in ("rows", "free", "ids", "amount") if c in rows.columns]
    return rows.withColumn(period, start).groupBy(*keys, period, "user_id").agg(*[F.sum(c).alias(c) for c in sums])


def streamed_mart(spark: SparkSession, path: str, p: Params, level: str = "day") -> DataFrame:
    """The campaign mart of what the three streams have counted, at day, week or month level.

    Retention and as-of act on whole days, when the table is read; impressions dated after as-of stay, as in batch.
    """
    period = PERIODS[level]
    keep = F.date_sub(p.today(), p.retention_days)
    shown = _per_period(
        counts_table(spark, path, "impressions").totals(days=F.col("event_date") >= keep), level,
        "campaign_id", "campaign_name", "channel",
    ).groupBy("campaign_id", "campaign_name", "channel", period).agg(
        F.sum("rows").alias("impressions"), F.count("user_id").alias("unique_users"),
        F.sum("amount").cast("double").alias("spend"), F.sum("free").alias("zero_cost_impressions"),
    )
    clicked = _per_period(counts_table(spark, path, "clicks").totals(), level, "campaign_id").groupBy(
        "campaign_id", period
    ).agg(F.sum("rows").alias("clicks"), F.count("user_id").alias("users_who_clicked"))
    days = p.retention_days if p.conversion_retention_days is None else p.conversion_retention_days
    converted = _per_period(
        counts_table(spark, path, "conversions").totals(days=_within(days, p)), level, "campaign_id"
    ).groupBy("campaign_id", period).agg(
        F.sum("ids").alias("conversions"), F.count("user_id").alias("users_who_converted"),
        F.sum("amount").cast("double").alias("revenue"),
    )
    return campaign_mart.from_counts(shown, clicked, converted, level)
