"""The raw log table: layout and pruned scans.

Layout: folders by chain and block bucket, files sorted by address and topic.
A range scan prunes folders by bucket, and inside a folder the row-group
statistics on ``address`` and ``topic0`` skip most of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry as reg
from ..operators.decode import with_topic0

BUCKET_BLOCKS = 100_000


def bucket_of(block):
    return F.floor(block / BUCKET_BLOCKS).cast("long")


def write_logs(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Write logs in the scan layout.

    Rows are range-partitioned by bucket, address and position, so a bucket or
    contract with a third of all logs is cut over many files.
    """
    placed = with_topic0(logs).withColumn("block_bucket", bucket_of(F.col("block_number")))
    (
        placed.repartitionByRange("chain_id", "block_bucket", "address", "block_number", "log_index")
        .sortWithinPartitions("chain_id", "block_bucket", "address", "topic0", "block_number", "log_index")
        .write.mode(mode)
        .partitionBy("chain_id", "block_bucket")
        .parquet(path)
    )


def scan_logs(
    spark: SparkSession, path: str, contract: str | None, from_block: int, to_block: int,
    topic0: str | None = None, chain_id: int | None = None,
) -> DataFrame:
    """Logs of a contract in [from_block, to_block], optionally of one event topic."""
    topics = None if topic0 is None else [topic0]
    return _scan(spark, path, contract, from_block, to_block, topics, chain_id)


def scan_token_logs(
    spark: SparkSession, path: str, token: str, from_block: int, to_block: int,
    topics=(reg.TOPIC["Transfer"], reg.TOPIC["Approval"]), chain_id: int | None = None,
) -> DataFrame:
    """Several event topics of one token from one scan, in (block, log index) order."""
    rows = _scan(spark, path, token, from_block, to_block, list(topics), chain_id)
    return rows.orderBy("block_number", "log_index", "tx_hash")


def _scan(spark, path, contract, from_block, to_block, topics, chain_id) -> DataFrame:
    rows = spark.read.parquet(path)
    if chain_id is not None:
        rows = rows.filter(F.col("chain_id") == chain_id)
    rows = rows.filter(
        F.col("block_bucket").between(from_block // BUCKET_BLOCKS, to_block // BUCKET_BLOCKS)
        & F.col("block_number").between(from_block, to_block)
    )
    if contract:
        rows = rows.filter(F.col("address") == contract.strip().lower())
    if topics is not None:
        rows = rows.filter(F.col("topic0").isin([t.lower() for t in topics]))
    return rows.drop("block_bucket")
