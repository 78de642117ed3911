"""What the operators share: reading tables, storing intermediate results, whitespace."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import shared_dir

#: Fixed: the six ASCII white space characters.
SPACES = r"[\x20\x09-\x0D]"
NOT_SPACES = r"[^\x20\x09-\x0D]"
#: Rows that a Python worker works on at once; Spark's batches may be much longer.
ROWS_AT_ONCE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """`df` written once to the cluster's shared folder and read back.

    Cuts the lineage: a lost executor later on costs a read, not the work before. The
    folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """All rows of the batches, in order, at most so many at once: a worker keeps the memory that it took for one
    batch until it ends, and workers outlive the stage."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def first_row(docs: DataFrame, row: str = "row") -> Column:
    """Of rows of `docs`, held as structs in `row`, the one whose text and then other columns (as JSON) sort
    first: the same one whatever the order of arrival."""
    others = [F.col(f"{row}.`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return F.min_by(row, F.struct(F.col(f"{row}.text"), F.to_json(F.struct(F.lit(0).alias("_"), *others))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` worked out once, however often the body uses it."""
    return F.transform(F.array(value), lambda bound: body(bound))[0]


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
