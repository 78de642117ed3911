"""Session settings.

`CLUSTER_CONF` is what a large deployment should start from: adaptive
execution sizes the reduce side (many small initial partitions merged up to the
advisory size), skewed join partitions are split, and executors may be lost and
replaced without losing the job.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

COMMON_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # The attribution summary alone has more generated classes than the default
    # cache of 100 holds; without room they are compiled anew on every run.
    "spark.sql.codegen.cache.maxEntries": "1000",
    "spark.ui.enabled": "false",
}

CLUSTER_CONF = {
    **COMMON_CONF,
    "spark.sql.files.maxPartitionBytes": "256m",
    # Stateful streams take their number of partitions from here, not from adaptive execution.
    "spark.sql.shuffle.partitions": "2000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.shuffle.service.enabled": "true",
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def cluster_session(app: str = "touchline", **conf) -> SparkSession:
    """A session on whatever master the launcher names, with `CLUSTER_CONF`."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**CLUSTER_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: str | int = "*", app: str = "touchline", **conf) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **COMMON_CONF,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder visible to every executor, for written tables and stream state.

    The cluster names it in `spark.checkpoint.dir`. Only a single-machine
    session may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix="touchline-")


def scratch_folder(spark: SparkSession, label: str = "scratch") -> str:
    """A new folder name under `shared_dir`; whatever is there goes when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)  # only paths that exist are remembered
    files.deleteOnExit(folder)
    return path
