"""Staged touches and conversions laid out by user, so that attribution joins them as they lie.

Finding what a conversion's window holds starts with two joins by user and block of time (see
`operators.timeline`). Stored in buckets by these two columns, touches and window ends meet
without a shuffle, however many reports start from them; only what some window asks for is
shuffled afterwards, by tile.

A bucket is one task's work, so a user with much of the data must not lie in one. Cells (user
and block) with more than `hot_rows` rows and more than 1 / MOST_HOT of all are counted while
storing and kept in tables of their own without buckets; these are joined by an ordinary
shuffle, which adaptive execution splits.

Blocks are as long as the attribution window: the tables know it and refuse another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.timeline import MOST_HOT, place_touches, place_windows, placed_window_totals
from touchline.params import Params
from touchline.plans.attribution import TOUCH_KEY, credited_conversions, shares_of_totals, touch_columns

CELL = ["user_id", "block"]
WINDOW = "touchline.attribution_window_days"


class NotStored(ValueError):
    """The tables are missing, unfinished, or cut for another attribution window."""


class UserTables:
    """The catalog tables that begin with `name`."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def table(self, part: str) -> str:
        return f"{self.name}_{part}"

    @property
    def _parts(self) -> dict[str, str]:
        kinds = ("touches", "windows", "hot_cells", "hot_touches", "hot_windows", "conversions")
        return {kind: self.table(kind) for kind in kinds}

    def store(
        self, impressions: DataFrame, conversions: DataFrame, p: Params,
        buckets: int | None = None, rows_per_bucket: int = 4_000_000, hot_rows: int = 1_000_000,
    ) -> None:
        """Write the staged events, which are read several times and had better be stored themselves.

        Without `buckets` there are as many as rows ask for, up to the most the session allows. The
        tables are whole once the last step has noted the window they are cut for; until then,
        after a failure too, they are refused.
        """
        self.drop()
        events = credited_conversions(conversions)
        touches, windows = place_touches(touch_columns(impressions), p), place_windows(events, p)
        cells = touches.select(*CELL).unionByName(windows.select(*CELL))
        total = cells.count()
        if buckets is None:
            most = int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
            buckets = min(most, max(1, -(-total // rows_per_bucket)))
        least = max(hot_rows, total / MOST_HOT)
        hot = cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > least)
        hot.write.saveAsTable(self.table("hot_cells"))
        # Fewer than MOST_HOT cells by their definition.
        hot = F.broadcast(self.spark.table(self.table("hot_cells")).select(*CELL))
        any_hot = not self.spark.table(self.table("hot_cells")).isEmpty()
        for kind, rows in (("touches", touches), ("windows", windows)):
            # The same hash deals the rows out and names their buckets: one file each.
            (
                rows.join(hot, CELL, "left_anti").repartition(buckets, *CELL)
                .write.bucketBy(buckets, *CELL).sortBy(*CELL).saveAsTable(self.table(kind))
            )
            if any_hot:
                rows.join(hot, CELL, "left_semi").write.saveAsTable(self.table(f"hot_{kind}"))
        events.write.saveAsTable(self.table("conversions"))
        self.spark.sql(
            f"ALTER TABLE {self.table('touches')} SET TBLPROPERTIES ('{WINDOW}' = '{p.attribution_window_days}')"
        )

    def drop(self) -> None:
        """Drop the tables; those for the cells of many rows may not be there."""
        for table in self._parts.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def _check(self, p: Params) -> None:
        touches = self.table("touches")
        if not self.spark.catalog.tableExists(touches):
            raise NotStored(f"{touches} is not there")
        noted = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {touches}").collect()}
        if noted.get(WINDOW) != str(p.attribution_window_days):
            raise NotStored(f"{touches} is cut for a window of {noted.get(WINDOW, 'unknown length')}, not {p.attribution_window_days} days")

    def window_totals(self, p: Params, by=(), touch_fields=(), keep_unmatched: bool = False) -> DataFrame:
        """`timeline.window_totals` of the stored events."""
        self._check(p)
        read = self.spark.table
        pairs = [(read(self.table("windows")), read(self.table("touches")))]
        if self.spark.catalog.tableExists(self.table("hot_touches")):
            pairs.append((read(self.table("hot_windows")), read(self.table("hot_touches"))))
        conversions = read(self.table("conversions"))
        return placed_window_totals(conversions, pairs, p, by, touch_fields, keep_unmatched)

    def credit_shares(self, p: Params, unattributed: bool = True) -> DataFrame:
        """`attribution.credit_shares` of the stored events."""
        return shares_of_totals(self.window_totals(p, TOUCH_KEY, keep_unmatched=unattributed), p, unattributed)
