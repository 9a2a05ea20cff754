"""Session settings and the one place where scratch space is decided."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# files of an exchange go when the query that made them is over, and not when the driver happens to collect its garbage
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Settings every job of this package relies on. Shuffle parallelism is left to
# the cluster: AQE coalesces small partitions and splits skewed ones at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # exact sums must fail on overflow and never turn into NULL
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # a row of a given table takes some 13 bytes in its file and close to 1000 as chain data in a
    # sort or hash map: what one task reads has to fit its memory there
    "spark.sql.files.maxPartitionBytes": "16m",
    # and so what it takes from an exchange, of which a byte is some ten in a sort
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    FREE_SHUFFLES: "true",
}


SPREAD_BYTES = 64 << 20


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the run-time settings on a session somebody else created."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def free_shuffles(spark: SparkSession) -> SparkSession:
    """From now on a query's exchanges take no disk once it is over. A frame that is run again makes them again."""
    spark.conf.set(FREE_SHUFFLES, "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (local tests) a folder of this machine is taken.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="ledgerloom-")
    sc.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever reused or deleted."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there: the result survives the loss of executors, and
    every later reader sees the same rows. As parquet it also keeps column
    pruning and filter pushdown for those readers.
    """
    path = scratch_path(df.sparkSession, "durable")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Size of ``df`` as the planner estimates it from its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an input of at most ``SPREAD_BYTES``, by the size of its files.

    A small file is often one row group and so one task, however many cores wait.
    Larger inputs are never shuffled for this. The rows are the same either way.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if estimated_bytes(df) <= SPREAD_BYTES else df
