"""The daily run on what has changed since the last one.

`daily.run_day` stages all retained raw rows and rebuilds every mart. Here a run

1. takes the raw rows synced since the last run and keeps those that are a later version of
   their record than the one known (a table of latest versions by id, see `runs.KeyedTable`);
2. finds the dates these records had and have (a correction can move a record, withdraw it
   or bring it back) and merges the records by id into those dates of the staged tables;
3. recomputes the campaign mart for those dates;
4. credits again the conversions that changed and those with a changed touch in their
   window, and exchanges their credit in the dates they had and have.

Dates that nothing touches are neither read nor written. Dates past retention go. What
depends on "now" is not stored: conversions dated after as-of are staged and left out when
read (`read_conversions`), and their dates are recomputed once as-of has passed them.

Runs are numbered by a small log, written last: a run that failed is repeated whole with the
same number and leaves the same tables. Journeys at the start of the retained range are cut
off by it; credit of those days is only computed anew for conversions that changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType

from touchline.operators.dedup import later_versions, version_order
from touchline.operators.rollups import period_start
from touchline.operators.staging import (
    CONVERSION_DETAILS,
    CONVERSION_MEASURES,
    IMPRESSION_DETAILS,
    IMPRESSION_MEASURES,
    retained_clicks,
    retention_start,
    served_impressions,
    valid_conversions,
    with_conversion_columns,
)
from touchline.params import Params
from touchline.plans import attribution, campaign_mart
from touchline.sources import sinks
from touchline.sources.runs import KeyedTable
from touchline.sources.schemas import CLICKS, CONVERSIONS, IMPRESSIONS

#: What orders versions of each kind of record, and the columns its staged table is clustered by.
_ORDER = {
    "impressions": (IMPRESSION_MEASURES, IMPRESSION_DETAILS), "conversions": (CONVERSION_MEASURES, CONVERSION_DETAILS),
}
_CLUSTER = {"impressions": ("campaign_id", "channel"), "conversions": ("campaign_id",), "clicks": ("campaign_id",)}
_KEY = {"impressions": "impression_id", "conversions": "conversion_id"}
_SCHEMA = {"impressions": IMPRESSIONS, "conversions": CONVERSIONS, "clicks": CLICKS}
#: as_of as given; the newest time of sync of each kind in microseconds.
_LOG = "run long, as_of string, impressions_upto long, conversions_upto long"


def _dated(schema: StructType) -> StructType:
    return StructType([*schema.fields]).add("event_date", DateType())


def _day_texts(*frames: DataFrame) -> list[str]:
    """The distinct dates of the frames: as many as there are days, never rows."""
    found: set[str] = set()
    for rows in frames:
        found |= {str(r[0]) for r in rows.select("event_date").distinct().collect() if r[0] is not None}
    return sorted(found)


@dataclass(frozen=True)
class Change:
    """What a run has changed in one kind of record: its rows before and after, as staged."""

    ids: DataFrame
    before: DataFrame
    after: DataFrame

    def days(self) -> list[str]:
        return _day_texts(self.before, self.after)


class IncrementalTables:
    """The stored tables in `folder` and the runs that keep them up to date."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder
        self.versions = {
            kind: KeyedTable(spark, f"{folder}/versions/{kind}", _SCHEMA[kind], _KEY[kind], buckets) for kind in _KEY
        }

    # --- reading --------------------------------------------------------------

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _days(self, kind: str, days: list[str]) -> DataFrame:
        return sinks.read_days(self.spark, self.path(f"stg_{kind}"), days, _dated(_SCHEMA[kind]))

    def _all(self, kind: str) -> DataFrame:
        return self._days(kind, list(sinks.stored_dates(self.spark, self.path(f"stg_{kind}"))))

    def read_impressions(self, p: Params, days: list[str] | None = None) -> DataFrame:
        rows = self._all("impressions") if days is None else self._days("impressions", days)
        return rows.where(F.col("event_timestamp") >= retention_start(p))

    def read_conversions(self, p: Params, days: list[str] | None = None) -> DataFrame:
        rows = self._all("conversions") if days is None else self._days("conversions", days)
        return with_conversion_columns(rows, p).where(
            (F.col("event_timestamp") >= retention_start(p, p.conversion_retention_days))
            & (F.col("event_timestamp") <= p.now())
        )

    def read_clicks(self, p: Params, days: list[str] | None = None) -> DataFrame:
        return retained_clicks(self._all("clicks") if days is None else self._days("clicks", days), p)

    def last_run(self):
        """Log entry of the newest finished run, or None."""
        if not sinks.stored_dates(self.spark, self.path("log"), "run"):
            return None
        return self.spark.read.schema(_LOG).parquet(self.path("log")).orderBy(F.desc("run")).first()

    # --- one run --------------------------------------------------------------

    def run(self, impressions: DataFrame, clicks: DataFrame, conversions: DataFrame, p: Params) -> None:
        """Bring all tables to `p.as_of`. The raw tables may be whole: a filter on the time of sync
        reaches their scans (clicks have none: those of the last days before the last run are read)."""
        last = self.last_run()
        n = 0 if last is None else last["run"] + 1
        raw = {"impressions": impressions, "conversions": conversions}
        changes = {
            kind: self._merge(kind, raw[kind], None if last is None else last[f"{kind}_upto"], n, p) for kind in raw
        }
        click_days = self._replace_clicks(clicks, p, last)
        expired = [day for kind in (*raw, "clicks") for day in self._expire(kind, p)]
        # Conversions dated after the last as-of have been waiting for this one.
        waiting = [] if last is None else [
            d for d in sinks.stored_dates(self.spark, self.path("stg_conversions"))
            if last["as_of"][:10] <= d <= p.as_of[:10]
        ]
        conversion_days = changes["conversions"].days()
        self._refresh_mart(
            sorted({*changes["impressions"].days(), *conversion_days, *click_days, *expired, *waiting}), p
        )
        self._refresh_credit(changes, conversion_days, waiting, p, first_run=last is None)
        newest = {
            kind: F.lit(self.versions[kind].changed_in(n).agg(F.max(F.unix_micros("_synced_at"))).first()[0])
            for kind in raw
        }
        entry = self.spark.range(1).select(
            F.lit(n).cast("long").alias("run"), F.lit(p.as_of).alias("as_of"),
            *[F.greatest(newest[kind].cast("long"), F.lit(last and last[f"{kind}_upto"]).cast("long")).alias(f"{kind}_upto")
              for kind in raw],
        )
        entry.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(self.path("log"))

    def _merge(self, kind: str, raw: DataFrame, since, n: int, p: Params) -> Change:
        """Changed records of one kind into its versions and into the dates they had and have."""
        table, key = self.versions[kind], _KEY[kind]
        rows = raw.select(*_SCHEMA[kind].names)
        if since is not None:
            # Rows of the same instant may have come after the last run; known versions are no change.
            recent = F.col("_synced_at") >= F.timestamp_micros(F.lit(since))
            rows = rows.where(recent | F.col("_synced_at").isNull())
        table.put_changes(later_versions(table.latest(n, rows), rows, key, version_order(*_ORDER[kind])), n)
        changed = table.changed_in(n)

        def staged(versions: DataFrame) -> DataFrame:
            valid = served_impressions(versions, p) if kind == "impressions" else valid_conversions(versions)
            first = retention_start(p, p.conversion_retention_days if kind == "conversions" else None)
            return valid.where(F.col("event_timestamp") >= first).select(*_SCHEMA[kind].names).withColumn(
                "event_date", period_start("day")
            )

        change = Change(changed.select(key), staged(table.latest(n, changed)), staged(changed))
        days = change.days()
        if days:
            ids = change.ids.withColumnRenamed(key, "_id")
            kept = self._days(kind, days).join(ids, F.col(key).eqNullSafe(F.col("_id")), "left_anti")
            sinks.replace_some_dates(
                kept.unionByName(change.after), self.path(f"stg_{kind}"), days, _CLUSTER[kind]
            )
        return change

    def _expire(self, kind: str, p: Params) -> list[str]:
        """Days of a staged table that are past retention go; the mart may still have them."""
        days = {"conversions": p.conversion_retention_days, "clicks": p.click_retention_days}.get(kind)
        if kind == "clicks" and days is None:
            return []
        first = retention_start(p, days)
        path = self.path(f"stg_{kind}")
        before = sinks.stored_dates(self.spark, path)
        sinks.drop_before(self.spark, path, first)
        return sorted(set(before) - set(sinks.stored_dates(self.spark, path)))

    def _replace_clicks(self, clicks: DataFrame, p: Params, last) -> list[str]:
        """Clicks are kept raw and have no versions: the days that can still get some are replaced."""
        rows = retained_clicks(clicks, p).select(*CLICKS.names).withColumn("event_date", period_start("day"))
        path = self.path("stg_clicks")
        first = None if last is None else sinks.refresh_start(p.with_(as_of=last["as_of"]))
        start = "" if last is None else str(self.spark.range(1).select(first).first()[0])
        before = sinks.stored_dates(self.spark, path)
        sinks.replace_dates(rows, path, first, cluster_by=_CLUSTER["clicks"])
        return [d for d in {*before, *sinks.stored_dates(self.spark, path)} if d >= start]

    def _refresh_mart(self, days: list[str], p: Params) -> None:
        path = self.path("mart_campaign_metrics")
        if days:
            mart = campaign_mart.campaign_metrics(
                self.read_impressions(p, days), self.read_clicks(p, days), self.read_conversions(p, days)
            )
            sinks.replace_some_dates(campaign_mart.with_audit(mart, p), path, days)
        sinks.drop_before(self.spark, path, retention_start(p))

    def _refresh_credit(
        self, changes: dict[str, Change], conversion_days: list[str], waiting: list[str], p: Params, first_run: bool
    ) -> None:
        window = p.attribution_window_days
        conversions = self._all("conversions")
        touched = changes["impressions"]
        # Users and days on which a touch came, went or changed; each concerns the conversions of the
        # user up to the end of its window. Joined by equal days, so a hot user has no pairs.
        concerned = (
            touched.before.unionByName(touched.after).select("user_id", "event_date").distinct()
            .select("user_id", F.explode(F.sequence(
                F.col("event_date"), F.date_add("event_date", window), F.expr("INTERVAL 1 DAY")
            )).alias("event_date")).distinct()
        )
        touch_days = touched.days()
        if first_run:
            again = conversions
        else:
            # Journeys of earlier days are cut off by retention; their credit stays as it is stored.
            whole = F.date_sub(p.today(), p.retention_days - window)
            reach = [d for d in sinks.stored_dates(self.spark, self.path("stg_conversions"))
                     if touch_days and d >= touch_days[0]]
            again = (
                self._days("conversions", reach).where(F.col("event_date") >= whole)
                .join(concerned, ["user_id", "event_date"], "left_semi")
                .select(*conversions.columns)
                .unionByName(changes["conversions"].after).unionByName(self._days("conversions", waiting))
                .dropDuplicates(["conversion_id"])
            )
        days = sorted({*_day_texts(again), *conversion_days})
        if not days:
            return
        ids = again.select("conversion_id").unionByName(changes["conversions"].ids).distinct()
        valid = with_conversion_columns(again, p).where(F.col("event_timestamp") <= p.now())
        lo, hi = F.date_sub(F.lit(days[0]).cast("date"), window + 1), F.lit(days[-1]).cast("date")
        touches = self.read_impressions(p).where(F.col("event_date").between(lo, hi))
        shares = attribution.credit_shares(valid, touches, p, unattributed=True).withColumn(
            "event_date", F.to_date("conversion_ts")
        )
        path = self.path("credit_shares")
        stored = sinks.read_days(self.spark, path, days, shares.schema)
        named = ids.withColumnRenamed("conversion_id", "_id")
        kept = stored.join(named, F.col("conversion_id").eqNullSafe(F.col("_id")), "left_anti")
        sinks.replace_some_dates(kept.unionByName(shares), path, days, ("conversion_id",))

