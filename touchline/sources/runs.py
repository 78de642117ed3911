"""Tables that are merged batch by batch: log-structured runs of Parquet files.

Batch n of a table writes one run. Whenever runs of equal length stand side by side they are
merged, as carries ripple in a binary counter: after n batches the runs are the binary
digits of n, so there are at most log2(n) + 1 of them, a row is rewritten log2(n) times
however long the table lives, and a batch never reads all batches before it. Which runs
make up the table after n batches follows from n alone: there is no manifest to lose, and a
batch that is retried after a failure writes the same run again.

A run is a folder `run=<first>-<last>`. Those that a merge has made superfluous stay until
the next batch has begun, for readers and retries. One writer at a time; batches are
numbered 0, 1, 2, ... without gaps, as a streaming query numbers them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def runs_after(n: int) -> list[tuple[int, int]]:
    """(first, last) batch of each run after n batches, oldest first."""
    runs, first = [], 0
    for bit in reversed(range(n.bit_length())):
        if n >> bit & 1:
            runs.append((first, first + (1 << bit) - 1))
            first += 1 << bit
    return runs


class Runs:
    """What the two kinds of tables share: folders, merging, partitions."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, partition: str):
        self.spark, self.path, self.partition = spark, path, partition
        self.schema = spark.createDataFrame([], schema).schema

    def combine(self, rows: DataFrame, oldest: bool) -> DataFrame:
        raise NotImplementedError

    def place(self, rows: DataFrame) -> DataFrame:
        """Adds the partition column where it is not among the columns."""
        return rows

    def _folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/run={run[0]}-{run[1]}"

    def _read(self, run: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._folder(run))

    def _files(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _stored(self) -> list[tuple[int, int]]:
        """Runs whose writing was finished: a listing of folders."""
        folder, files = self._files()
        if not files.exists(folder):
            return []
        found = []
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            done = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith("run=") and files.exists(done):
                first, _, last = name.removeprefix("run=").partition("-")
                found.append((int(first), int(last)))
        return found

    def batches(self) -> int:
        """How many batches the table holds."""
        return max((last + 1 for _, last in self._stored()), default=0)

    def put(self, rows: DataFrame, batch: int) -> None:
        """Merge `rows` as batch number `batch` into the table; repeating it changes nothing."""
        folder, files = self._files()
        before, after = runs_after(batch), runs_after(batch + 1)
        for run in self._stored():
            if run not in before:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(run)), True)
        new = after[-1]
        parts = [self._read(run) for run in before if run[0] >= new[0]]
        fresh = self.place(rows).select(*self.schema.names)
        merged = reduce(DataFrame.unionByName, [*parts, fresh])
        if parts:
            merged = self.combine(merged, oldest=new[0] == 0)
        (
            merged.hint("rebalance", F.col(self.partition)).sortWithinPartitions(self.partition)
            .write.mode("overwrite").option("partitionOverwriteMode", "static")
            .partitionBy(self.partition).parquet(self._folder(new))
        )

    def _rows(self, n: int | None, only: Column | None = None) -> DataFrame:
        """All runs' rows after n batches (by default all), in the partitions of `only`."""
        runs = [self._read(run) for run in runs_after(self.batches() if n is None else n)]
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return reduce(DataFrame.unionByName, runs if only is None else [r.where(only) for r in runs])


class KeyedTable(Runs):
    """Rows by key: those of the newest batch that has the key replace all before.

    A key may have several rows in a batch, and NULL is a key like any other. `gone` rows (see
    `put_changes`) stand for a key that has none any more. Rows are spread by a hash of the
    key over `buckets` folders, so a batch that names its keys reads their buckets only.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 64):
        technical = StructType().add("_batch", "long").add("_gone", "boolean").add("_bucket", "integer")
        super().__init__(spark, path, StructType([*schema.fields, *technical.fields]), "_bucket")
        self.columns, self.key, self.buckets = schema.names, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def place(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", self.bucket())

    def combine(self, rows: DataFrame, oldest: bool) -> DataFrame:
        newest = F.max("_batch").over(W.partitionBy("_bucket", self.key))
        kept = rows.withColumn("_newest", newest).where("_batch = _newest").drop("_newest")
        # Nothing older is left that a missing key would have to hide.
        return kept.where("NOT _gone") if oldest else kept

    def put_changes(self, rows: DataFrame, batch: int, gone: DataFrame | None = None) -> None:
        """`rows` replace what their keys had; the keys of `gone` have nothing any more."""
        marked = rows.select(*self.columns).withColumns({"_batch": F.lit(batch).cast("long"), "_gone": F.lit(False)})
        if gone is not None:
            marked = marked.unionByName(
                gone.select(self.key).distinct().withColumns(
                    {"_batch": F.lit(batch).cast("long"), "_gone": F.lit(True)}
                ), allowMissingColumns=True,
            )
        self.put(marked, batch)

    def latest(self, n: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The table after n batches; with `keys` only their rows, read from their buckets."""
        if keys is None:
            rows = self._rows(n)
        else:
            keys = keys.select(self.key).distinct()
            # At most `buckets` numbers.
            touched = [r[0] for r in keys.select(self.bucket()).distinct().collect()]
            rows = self._rows(n, F.col("_bucket").isin(touched))
            wanted = keys.withColumnRenamed(self.key, "_wanted")
            rows = rows.join(wanted, F.col(self.key).eqNullSafe(F.col("_wanted")), "left_semi")
        return self.combine(rows, oldest=True).select(*self.columns)

    def changed_in(self, batch: int) -> DataFrame:
        """The rows batch number `batch` has put, read back from its run."""
        return self._read(runs_after(batch + 1)[-1]).where((F.col("_batch") == batch) & ~F.col("_gone")).select(
            *self.columns
        )


class SummedTable(Runs):
    """Sums by key: batches add signed amounts, and a key whose rows cancel out is no more.

    `rows` among the sums counts what a key stands for. Rows are stored by the date in them,
    so days are read without the others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, sums: Sequence[str],
                 date: str = "event_date"):
        super().__init__(spark, path, schema, date)
        self.sums = list(sums)
        self.keys = [c for c in self.schema.names if c not in sums]

    def combine(self, rows: DataFrame, oldest: bool = True) -> DataFrame:
        added = rows.groupBy(*self.keys).agg(*[
            F.sum(c).cast(self.schema[c].dataType).alias(c) for c in self.sums
        ])
        # All amounts together: a key's rows may be 0 here and amounts still to come off elsewhere.
        return added.where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in self.sums]))

    def totals(self, n: int | None = None, days: Column | None = None) -> DataFrame:
        """Sums after n batches, of keys that stand for something."""
        return self.combine(self._rows(n, days)).where(F.col("rows") > 0)
