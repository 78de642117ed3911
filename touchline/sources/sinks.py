"""Writing results: date-partitioned tables, incremental refresh, nested JSON."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from touchline.functions.scalars import join_null_safe
from touchline.params import Params


def write_by_date(
    rows: DataFrame,
    path: str,
    cluster_by: Sequence[str] = ("campaign_id", "channel"),
    date: str = "event_date",
    mode: str = "overwrite",
) -> None:
    """One folder per date, rows clustered inside the files.

    Rebalancing by date gives a date few files, yet splits a date too large for
    one task. Only the dates present in `rows` are replaced, so a rerun or a
    backfill of some days leaves the others alone and can be repeated.
    """
    (
        rows.hint("rebalance", F.col(date))
        .sortWithinPartitions(date, *cluster_by)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(date)
        .parquet(path)
    )


class Refused(ValueError):
    """A table that did not keep its checks and was not published: `failed` has each check's value and limit."""

    def __init__(self, failed: Mapping[str, tuple[float, float]]):
        self.failed = dict(failed)
        super().__init__("not published: " + ", ".join(f"{n} is {v:g}, at most {m:g} allowed" for n, (v, m) in failed.items()))


def watched(rows: DataFrame, checks: Mapping[str, tuple[Column, float]]) -> tuple[DataFrame, Callable[[], dict]]:
    """`rows` with `checks` (aggregate, highest allowed value) worked out while they are written, and what to ask
    afterwards for those that failed. There is no second pass; a check without rows holds."""
    seen = Observation(f"checks-{uuid.uuid4().hex}")

    def failed() -> dict[str, tuple[float, float]]:
        return {
            n: (seen.get[n], limit) for n, (_, limit) in checks.items() if seen.get[n] is not None and seen.get[n] > limit
        }

    return rows.observe(seen, *[what.alias(n) for n, (what, _) in checks.items()]), failed


def write_checked(
    rows: DataFrame, path: str, checks: Mapping[str, tuple[Column, float]],
    cluster_by: Sequence[str] = ("campaign_id", "channel"), date: str = "event_date",
) -> None:
    """`write_by_date` behind a gate: the dates of `rows` replace those of the table only if all checks hold.

    Rows are written beside the table and moved in by date; if a check fails they go and
    `Refused` says why. The table is as it was.
    """
    spark = rows.sparkSession
    beside = f"{path.rstrip('/')}-unchecked-{uuid.uuid4().hex}"
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    into = spark._jvm.org.apache.hadoop.fs.Path
    try:
        seen, failed = watched(rows, checks)
        write_by_date(seen, beside, cluster_by, date)
        if problems := failed():
            raise Refused(problems)
        files.mkdirs(into(path))
        days = stored_dates(spark, beside, date)
        _delete(spark, path, days, date)
        for day in days:
            files.rename(into(f"{beside}/{date}={day}"), into(f"{path}/{date}={day}"))
    finally:
        files.delete(into(beside), True)


def stored_dates(spark: SparkSession, path: str, date: str = "event_date") -> dict[str, frozenset[str]]:
    """The dates a table has and the files of each: a listing of folders, no data is read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return {}
    found = {}
    for status in files.listStatus(folder):
        name, _, value = status.getPath().getName().partition("=")
        if name == date:
            found[value] = frozenset(f.getPath().getName() for f in files.listStatus(status.getPath()))
    return found


def _first_day(spark: SparkSession, start: Column | None) -> str:
    return "" if start is None else str(spark.range(1).select(start.cast("date")).first()[0])


def _delete(spark: SparkSession, path: str, days, date: str) -> None:
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for day in days:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{date}={day}"), True)


def replace_dates(
    rows: DataFrame, path: str, start: Column | None = None,
    cluster_by: Sequence[str] = ("campaign_id", "channel"), date: str = "event_date",
) -> None:
    """Make the dates from `start` on (all without it) those of `rows`, and no others.

    Dates with rows are replaced one by one; then the folders in the range that the
    write has left as they were go: their rows have moved, vanished or expired.
    Repeating the call after a failure gives the same table.
    """
    spark = rows.sparkSession
    first, before = _first_day(spark, start), stored_dates(spark, path, date)
    write_by_date(rows if start is None else rows.where(F.col(date) >= start), path, cluster_by, date)
    after = stored_dates(spark, path, date)
    # A folder that was written anew has other files only.
    _delete(spark, path, [d for d, names in before.items() if d >= first and after.get(d, frozenset()) & names], date)


def replace_some_dates(
    rows: DataFrame, path: str, days: Sequence[str],
    cluster_by: Sequence[str] = ("campaign_id", "channel"), date: str = "event_date",
) -> None:
    """Make `days` (texts like 2024-01-31) those of `rows`, which has no others; all else stays.

    `rows` may read the very days it replaces: they are exchanged when all rows are written.
    """
    spark = rows.sparkSession
    before = stored_dates(spark, path, date)
    write_by_date(rows, path, cluster_by, date)
    after = stored_dates(spark, path, date)
    _delete(spark, path, [d for d in days if after.get(d, frozenset()) & before.get(d, frozenset())], date)


def read_days(spark: SparkSession, path: str, days: Sequence[str], schema, date: str = "event_date") -> DataFrame:
    """The rows of `days` in a table stored by date, which need not be there; other days are not read."""
    if not stored_dates(spark, path, date):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col(date).isin([F.lit(d).cast("date") for d in days]))


def drop_before(spark: SparkSession, path: str, first: Column, date: str = "event_date") -> None:
    """Drop the dates before `first`, for example those past retention."""
    limit = _first_day(spark, first)
    _delete(spark, path, [day for day in stored_dates(spark, path, date) if day < limit], date)


@contextmanager
def _only_partitions_written(spark: SparkSession) -> Iterator[None]:
    """Inserting into a catalog table takes the overwrite mode from the session alone."""
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(mode, before)


def save_by_date(
    rows: DataFrame, table: str, start: Column | None = None,
    cluster_by: Sequence[str] = ("campaign_id", "channel"), date: str = "event_date",
) -> None:
    """`replace_dates` for a catalog table, which is created when it is not there. Other dates stay
    whatever overwrite mode the session has."""
    spark = rows.sparkSession
    chosen = rows if start is None else rows.where(F.col(date) >= start)
    dealt = chosen.hint("rebalance", F.col(date)).sortWithinPartitions(date, *cluster_by)
    if not spark.catalog.tableExists(table):
        dealt.write.partitionBy(date).saveAsTable(table)
        return
    first = _first_day(spark, start)
    path = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").first()["data_type"]
    before = stored_dates(spark, path, date)
    ordered = dealt.select(*spark.table(table).columns)
    with _only_partitions_written(spark):
        ordered.write.mode("overwrite").insertInto(table)
    after = stored_dates(spark, path, date)
    for day, names in before.items():
        if day >= first and after.get(day, frozenset()) & names:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({date} = '{day}')")
    spark.catalog.refreshTable(table)


def refresh_start(p: Params, days: int = 1):
    """First day an incremental run recomputes.

    Late records change old days: go back over the late window, plus `days`.
    """
    late_days = -(-p.late_window_hours // 24)
    return F.date_sub(p.today(), days + late_days)


def refresh_by_date(mart: DataFrame, path: str, p: Params, days: int = 1, date: str = "event_date") -> None:
    """Recompute and replace only the recent days of a table written by `write_by_date`; days past
    retention go.

    The date filter is on the grouping key, so it reaches the staged events
    below the aggregation.
    """
    replace_dates(mart, path, refresh_start(p, days), date=date)
    drop_before(mart.sparkSession, path, F.date_sub(p.today(), p.retention_days), date)


def write_json(documents: DataFrame, path: str) -> None:
    """One nested document per line, many files: documents are never put together."""
    documents.write.mode("overwrite").json(path)


def campaign_documents(campaigns: DataFrame, tiers: DataFrame, allocation: DataFrame) -> DataFrame:
    """One document per campaign: metrics, tier and recommended budget."""
    key = ["campaign_id", "channel"]
    metrics = [c for c in campaigns.columns if c not in key]
    advice = F.struct("recommended_budget", "current_budget", "change_pct", "expected_roas")
    documents = campaigns.select(*key, F.struct(*metrics).alias("metrics"))
    documents = join_null_safe(documents, tiers.select(*key, "tier"), key, "left")
    return join_null_safe(
        documents, allocation.select(*key, advice.alias("budget_allocation")), key, "left"
    )


def channel_documents(credit: DataFrame, models: Sequence[str]) -> DataFrame:
    """One document per channel: its credit under every model."""
    return credit.groupBy("channel").agg(F.struct(*[
        F.max(F.when(F.col("attribution_model") == m, F.col("credit"))).alias(m) for m in models
    ]).alias("credit"))


def experiment_documents(report: DataFrame) -> DataFrame:
    """One document per experiment: both arms, the test and its reading."""
    def arm(name):
        return F.struct(
            F.col(f"{name}_visitors").alias("visitors"),
            F.col(f"{name}_conversions").alias("conversions"),
            F.col(f"{name}_rate_pct").alias("conversion_rate"),
        ).alias(name)

    return report.select(
        "experiment_id", arm("control"), arm("variant"),
        F.struct(
            F.col("absolute_lift_pct").alias("absolute_lift"), "relative_lift_pct", "z_score",
            "p_value", "is_significant",
            F.col("ci_lower_pct").alias("confidence_interval_lower"),
            F.col("ci_upper_pct").alias("confidence_interval_upper"),
        ).alias("results"),
        "interpretation",
    )
