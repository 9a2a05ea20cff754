"""Typed reads of the stored tables.

One folder of parquet per table with its declared schema. Tables that streams keep up to
date are read through :mod:`.keyed`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import u256
from ..schemas import SCHEMAS


def scan(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One parquet table with its declared schema; nothing is inferred."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def store(spark: SparkSession, df: DataFrame, name: str, table: str, path: str, buckets: int = 32) -> DataFrame:
    """Write ``df`` as catalog table ``table`` in the layout of its joins.

    Rows are in ``buckets`` by (chain_id, tx_hash) and sorted inside, so tables of as many
    buckets are joined on the transaction without an exchange. Columns are those declared for
    ``name``; those that ``df`` lacks are null.
    """
    columns = [F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]]
    keys = ["chain_id", "tx_hash"]
    rows = df.select(*columns).repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(table)
    return spark.table(table)


class Tables:
    """``tables(spark, root).token_transfers`` and so on, one folder per table."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        return scan(self._spark, f"{self._root}/{name}", name)


def tables(spark: SparkSession, root: str) -> Tables:
    return Tables(spark, root)


def scan_transactions(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, "transactions")


def scan_blocks(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, "blocks")


def scan_contract_state(spark: SparkSession, path: str, prop: str, at_block: int | None = None) -> DataFrame:
    """Newest read of ``prop`` per wallet at or before a block.

    Property and block reach the scan; the newest value is an aggregate with
    map-side partials.
    """
    from ..operators.reconcile import state_at

    return state_at(scan(spark, path, "contract_state"), prop, at_block)


def contract_state_at(
    spark: SparkSession, path: str, prop: str, targets: DataFrame, direction: str = "backward", tolerance: int | None = None
) -> DataFrame:
    """``targets`` (chain_id, contract, wallet, block_number, ...) with the read of ``prop`` nearest to each.

    One scan of the stored reads answers all targets; the property reaches the scan.
    """
    from ..operators.asof import asof_join

    reads = scan(spark, path, "contract_state").filter(F.col("property") == prop)
    keys = ["chain_id", "contract", "wallet"]
    return asof_join(targets, reads, keys, "block_number", ["value"], direction=direction, tolerance=tolerance)


def as_flag(reads: DataFrame) -> DataFrame:
    """Contract reads of a boolean property."""
    return reads.withColumn("active", ~u256.is_zero(F.col("value"))).drop("value")
