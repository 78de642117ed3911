"""Readers for raw event tables: parquet, ORC, JSON, CSV files and catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from touchline.sources.schemas import OPTIONAL


def conform(rows: DataFrame, schema: StructType) -> DataFrame:
    """Project to `schema`, casting by name. A missing required column fails at once.

    Under ANSI mode a value that cannot be cast fails the job; `split_malformed`
    is the tolerant alternative for text sources.
    """
    have = set(rows.columns)
    missing = [f.name for f in schema if f.name not in have and f.name not in OPTIONAL]
    if missing:
        raise ValueError(f"source lacks required columns: {missing}")
    columns = []
    for f in schema:
        if f.name in have:
            columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "_synced_at":
            columns.append(F.col("event_timestamp").cast(f.dataType).alias(f.name))
        else:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
    return rows.select(*columns)


def read_files(spark: SparkSession, path, schema: StructType, format: str = "parquet") -> DataFrame:
    """Event files with column names: parquet, orc or json."""
    reader = spark.read
    if format == "json":
        reader = reader.schema(schema)
    return conform(reader.format(format).load(path), schema)


def read_table(spark: SparkSession, name: str, schema: StructType) -> DataFrame:
    return conform(spark.table(name), schema)


def read_csv(spark: SparkSession, path, schema: StructType) -> DataFrame:
    """CSV event files whose header names the columns, in any order."""
    return conform(read_csv_text(spark, path), schema)


def read_csv_text(spark: SparkSession, path) -> DataFrame:
    """The same files, every column still text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def split_malformed(text: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows that cast cleanly, rows that do not with the names of their bad columns)."""
    typed = [f for f in schema if f.name in text.columns and f.dataType != StringType()]
    bad = F.filter(
        F.array(*[
            F.when(
                F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(),
                F.lit(f.name),
            )
            for f in typed
        ]),
        lambda name: name.isNotNull(),
    )
    marked = text.withColumn("_bad_columns", bad)
    clean = marked.where(F.size("_bad_columns") == 0).drop("_bad_columns")
    return conform(clean, schema), marked.where(F.size("_bad_columns") > 0)


def stream_files(
    spark: SparkSession,
    path: str,
    schema: StructType,
    format: str = "parquet",
    files_per_trigger: int | None = None,
    name_filter: str | None = None,
) -> DataFrame:
    """Streaming counterpart of `read_files`. `schema` is that of the files."""
    reader = spark.readStream.schema(schema).format(format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.load(path)
