"""Streaming forms of the operators.

Each function takes streaming DataFrames and returns one, or starts a query that
writes to a table. Late data has `late_window_hours` to arrive: that is the
watermark delay, and rows later than it are dropped and counted by Spark as
`numRowsDroppedByWatermark`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline.functions.scalars import MONEY, bot_flag
from touchline.operators.dedup import later_versions, latest_version, version_order
from touchline.operators.staging import CONVERSION_DETAILS, CONVERSION_MEASURES, stage_conversions
from touchline.params import Params
from touchline.plans.attribution import credit_shares
from touchline.sources.runs import KeyedTable
from touchline.sources.schemas import CONVERSIONS
from touchline.sources.sinks import watched


def with_lateness(events: DataFrame, p: Params, column: str = "event_timestamp") -> DataFrame:
    return events.withWatermark(column, f"{p.late_window_hours} hours")


# --- deduplication -----------------------------------------------------------


def first_arrivals(events: DataFrame, key: str, p: Params) -> DataFrame:
    """Drop redeliveries of a key while the watermark remembers it; the first one stays."""
    return with_lateness(events, p).dropDuplicatesWithinWatermark([key])


def latest_arrivals(spark: SparkSession, path: str, key: str, newest_first: Sequence) -> DataFrame:
    """Latest version per key of a table of all versions, as batch staging has it.

    The stream only appends (`append_batches`); which version wins is decided
    when the table is read, so a retried batch or a late version is no problem.
    """
    return latest_version(spark.read.parquet(path), key, newest_first)


# --- sinks -------------------------------------------------------------------


def append_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    output_mode: str = "append",
    transform: Callable[[DataFrame], DataFrame] | None = None,
    trigger: Mapping | None = None,
    checks: Mapping | None = None,
) -> StreamingQuery:
    """Write each micro-batch to its own `batch_id` folder.

    With `checks` (`quality.write_checks`), worked out while a batch is written, a batch that
    fails one is kept in `path`-refused instead and the stream goes on.

    By default the query works off what has arrived and ends; pass for example
    `trigger={"processingTime": "1 minute"}` to keep it running.

    A batch that is retried after a failure replaces its folder, so the table
    has every batch exactly once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        if not checks:
            out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            return
        refused = f"{path}-refused/batch_id={batch_id}"
        seen, failed = watched(out, checks)
        seen.write.mode("overwrite").parquet(refused)
        if not failed():
            _move(batch.sparkSession, refused, path, f"batch_id={batch_id}")

    return (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def read_latest_update(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Current rows of a table of updates: per key those of the newest batch."""
    updates = spark.read.parquet(path)
    values = [c for c in updates.columns if c not in (*keys, "batch_id")]
    newest = updates.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.col("batch_id")).alias("_row")
    )
    return newest.select(*keys, "_row.*")


# --- daily campaign counts ---------------------------------------------------


def daily_counts(impressions: DataFrame, p: Params, approximate_reach: bool = False) -> DataFrame:
    """Running counts per campaign and day. Bots are dropped as in batch staging, and so are
    redeliveries of an impression while the watermark remembers it.

    For output mode "update": a day's rows change until the watermark closes it.
    Streams cannot count distinct users exactly; `approximate_reach` adds an
    estimate.
    """
    served = impressions.dropna(subset=["impression_id", "user_id", "campaign_id", "event_timestamp"])
    served = served.where(~bot_flag("is_bot", "impression_cost", "event_timestamp"))
    measures = [
        F.count(F.lit(1)).alias("impressions"),
        F.sum(F.col("impression_cost").cast(MONEY)).cast("double").alias("spend"),
    ]
    if approximate_reach:
        measures.append(F.approx_count_distinct("user_id").alias("approximate_users"))
    day = F.window("event_timestamp", "1 day")
    return (
        first_arrivals(served, "impression_id", p)
        .groupBy(day, "campaign_id", "campaign_name", "channel")
        .agg(*measures)
        .withColumn("event_date", F.to_date(F.col("window.start")))
        .drop("window")
    )


# --- attribution -------------------------------------------------------------


def _attribution_tables(spark: SparkSession, path: str, buckets: int) -> tuple[KeyedTable, KeyedTable]:
    credit = "conversion_id string, user_id string, conversion_ts timestamp, value double, channel string, " \
        "campaign_id string, n_touches long, journey_touches long, is_last boolean, is_first boolean, " \
        "last_touch double, first_touch double, linear double, time_decay double"
    return (
        KeyedTable(spark, f"{path}/versions", CONVERSIONS, "conversion_id", buckets),
        KeyedTable(spark, f"{path}/credits", spark.createDataFrame([], credit).schema, "conversion_id", buckets),
    )


def attribute_batches(
    conversions: DataFrame,
    read_impressions: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    p: Params,
    trigger: Mapping | None = None,
    buckets: int = 64,
) -> StreamingQuery:
    """Credit the conversions of each micro-batch with the batch operator, as batch staging would.

    `path`/versions has the latest version of every conversion and `path`/credits its credit,
    both merged batch by batch (`runs.KeyedTable`). Of a micro-batch only versions later than
    the known ones go on, whenever and in whatever order they arrive: a redelivery or a stale
    version changes nothing, a correction replaces the credit, and a conversion that is
    withdrawn (its latest version lacks user, time or value, or has left retention) has none.
    Every batch credits what it has changed and, again, all those still open: within
    `late_window_hours` of the newest, or dated after as-of, touches may yet arrive.
    `path`/open has these, so neither they nor the known versions are searched for in
    earlier batches; a batch reads the buckets of the ids it names.

    Staged impressions are read as a table (the one their own stream writes), so
    no month of them is held as state, and a hot user is split as in batch. Only
    the windows of the credited conversions are read: a table with an `event_date`
    partition column is pruned to those days.
    """
    late = F.expr(f"INTERVAL {p.late_window_hours} HOURS")
    window = F.expr(f"INTERVAL {p.attribution_window_days} DAYS")
    order = version_order(CONVERSION_MEASURES, CONVERSION_DETAILS)

    def attribute(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions, credits = _attribution_tables(spark, path, buckets)
        arriving = batch.select(*versions.columns)
        versions.put_changes(
            later_versions(versions.latest(batch_id, arriving), arriving, "conversion_id", order), batch_id
        )
        changed = versions.changed_in(batch_id)

        ids = changed.select(F.col("conversion_id").alias("_id"))
        is_changed = F.col("conversion_id").eqNullSafe(F.col("_id"))
        candidates = changed
        if batch_id:
            before = spark.read.schema(CONVERSIONS).parquet(f"{path}/open/batch_id={batch_id - 1}")
            candidates = before.join(ids, is_changed, "left_anti").unionByName(changed)
        staged = stage_conversions(candidates, p, details=False)
        edges = staged.agg(F.min("event_timestamp").alias("oldest"), F.max("event_timestamp").alias("newest"))
        oldest, newest = (edges.select(c).scalar() for c in ("oldest", "newest"))
        candidates.where((F.col("event_timestamp") >= newest - late) | (F.col("event_timestamp") > p.now())).write.mode(
            "overwrite"
        ).parquet(f"{path}/open/batch_id={batch_id}")
        _delete(spark, f"{path}/open/batch_id={batch_id - 2}")

        touches = read_impressions()
        if "event_date" in touches.columns:
            touches = touches.where(F.col("event_date").between(F.to_date(oldest - window), F.to_date(newest)))
        touches = touches.where(F.col("event_timestamp").between(oldest - window, newest))
        credit = credit_shares(staged, touches, p, unattributed=True)
        gone = changed.join(
            staged.select(F.col("conversion_id").alias("_id")), is_changed, "left_anti"
        )
        credits.put_changes(credit, batch_id, gone)

    return (
        conversions.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(attribute).start()
    )


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _move(spark: SparkSession, source: str, into: str, name: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path
    files = folder(into).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder(into))
    files.delete(folder(f"{into}/{name}"), True)
    files.rename(folder(source), folder(f"{into}/{name}"))


def read_credits(spark: SparkSession, path: str, buckets: int = 64) -> DataFrame:
    """The credit of every conversion as its newest batch has it."""
    return _attribution_tables(spark, path, buckets)[1].latest()


def touch_pairs(
    conversions: DataFrame,
    impressions: DataFrame,
    p: Params,
    hot_users: Sequence[str] = (),
    salts: int = 16,
) -> DataFrame:
    """Stream-stream interval left join of conversions and the touches in their window.

    For consumers that need each pair as it happens. Conversions without touches
    come out, with NULL touch columns, once the watermark has passed them. State
    is kept by user; the conversions of `hot_users` are spread over `salts` tasks,
    to which the impressions of those users are copied.
    """
    is_hot = F.col("user_id").isin(list(hot_users)) if hot_users else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64("conversion_id"), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = with_lateness(
        conversions.select(
            "conversion_id", "user_id", F.col("event_timestamp").alias("conversion_ts"),
            F.col("conversion_value_usd").alias("value"), salt.alias("salt"),
        ),
        p, "conversion_ts",
    )
    right = with_lateness(
        impressions.select(
            F.col("user_id").alias("touch_user_id"), "impression_id", "channel",
            F.col("campaign_id").alias("touch_campaign_id"),
            F.col("event_timestamp").alias("touch_ts"),
            F.explode(copies).alias("touch_salt"),
        ),
        p, "touch_ts",
    )
    days = p.attribution_window_days
    in_window = (
        (F.col("user_id") == F.col("touch_user_id"))
        & (F.col("salt") == F.col("touch_salt"))
        & (F.col("touch_ts") <= F.col("conversion_ts"))
        & (F.col("touch_ts") >= F.col("conversion_ts") - F.expr(f"INTERVAL {days} DAYS"))
    )
    return left.join(right, in_window, "leftOuter").drop("salt", "touch_salt", "touch_user_id")


def hot_users(impressions: DataFrame, share: float = 0.001) -> DataFrame:
    """Users with more than `share` of all impressions: at most 1 / share of them."""
    total = impressions.agg(F.count(F.lit(1))).scalar()
    return impressions.groupBy("user_id").agg(F.count(F.lit(1)).alias("impressions")).where(
        F.col("user_id").isNotNull() & (F.col("impressions") > total * share)
    )


# --- freshness ---------------------------------------------------------------


def newest_events(events: DataFrame, source: str) -> DataFrame:
    """Newest event time of a stream so far, for output mode "update"."""
    return events.withColumn("source", F.lit(source)).groupBy("source").agg(
        F.max("event_timestamp").alias("newest")
    )


def staleness(newest: DataFrame, p: Params) -> DataFrame:
    """Alert columns for the newest event times, against as-of."""
    hours = (F.unix_micros(p.now()) - F.unix_micros("newest")) / F.lit(3_600_000_000.0)
    return newest.withColumn("staleness_hours", hours).withColumns({
        "is_stale": F.col("staleness_hours") > p.max_staleness_hours,
        "alert": F.col("staleness_hours") > p.freshness_alert_hours,
    })
