"""Stream cursors: a small table keyed by (chain, stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks, evm
from ..schemas import RULES
from .upsert import upsert

CATCHING_UP_LAG = 10  # fixed value: above this lag a stream is "catching_up"


def save_checkpoint(cursors: DataFrame | None, updates: DataFrame, order=("updated_at",)) -> DataFrame:
    """Cursors after the updates; the last write wins, even a lower block."""
    return upsert(cursors, updates, RULES["sync_checkpoints"], list(order))


def get_checkpoint(cursors: DataFrame, chain_id: int, stream_id: str) -> DataFrame:
    """Zero or one row: block and block hash ('' where none was kept)."""
    return cursors.filter((F.col("chain_id") == chain_id) & (F.col("stream_id") == stream_id)).select(
        "last_indexed_block", F.coalesce("last_block_hash", F.lit("")).alias("last_block_hash")
    )


def clear_checkpoints(cursors: DataFrame, exact=(), prefixes=()) -> DataFrame:
    """Cursors that remain after a reset by exact id and by literal prefix."""
    drop = F.lit(False)
    if exact:
        drop |= F.col("stream_id").isin(*exact)
    for prefix in prefixes:
        drop |= F.col("stream_id").startswith(prefix)
    return cursors.filter(~drop).orderBy("chain_id", "stream_id")


def max_checkpoint(cursors: DataFrame) -> DataFrame:
    """Highest cursor over all streams, 0 without any."""
    return cursors.agg(F.coalesce(F.max("last_indexed_block"), F.lit(0)).alias("latest_block"))


def latest_block(transactions: DataFrame, cursors: DataFrame) -> DataFrame:
    """Highest block seen by transactions or cursors, 0 when both are empty.

    Each side is reduced to one row before the union.
    """
    both = transactions.agg(F.max("block_number").alias("b")).unionByName(
        cursors.agg(F.max("last_indexed_block").alias("b"))
    )
    return both.agg(F.coalesce(F.max("b"), F.lit(0).cast("long")).alias("latest_block"))


def sync_status(cursors: DataFrame, depth: int, token: str | None = None) -> DataFrame:
    """Lag and state of every stream of the cursors' chain.

    "Latest" is the highest cursor of any stream. With a configured token every
    stream without a token in its name reports that token.
    """
    # one value, computed once and joined as a scalar subquery
    latest = max_checkpoint(cursors).scalar()
    last = F.col("last_indexed_block")
    lag = F.greatest(F.col("latest_block") - last, F.lit(0).cast("long"))
    named = F.regexp_extract("stream_id", "^erc20_transfers_(0[xX].*)$", 1)
    own = F.when(named != "", named)
    fallback = F.lit(token) if token else F.lit(None).cast("string")
    return (
        cursors.withColumn("latest_block", latest)
        .withColumn("lag", lag)
        .select(
            "chain_id",
            "stream_id",
            F.coalesce(own, fallback).alias("token"),
            "last_indexed_block",
            "lag",
            F.when(F.col("lag") > CATCHING_UP_LAG, "catching_up")
            .when(F.col("lag") > 0, "syncing")
            .otherwise("synced")
            .alias("status"),
            "latest_block",
            blocks.safe_head(F.col("latest_block"), depth, "status").alias("safe_block"),
        )
    )


def with_confirmations(transactions: DataFrame, latest: DataFrame) -> DataFrame:
    """Confirmations grow with the chain: the larger of stored and latest - block + 1."""
    head = latest.select("latest_block").scalar()
    grown = F.when(head >= F.col("block_number"), head - F.col("block_number") + 1)
    return transactions.withColumn("confirmations", F.greatest(F.col("confirmations"), grown))


def with_explorer_url(transactions: DataFrame, template: str | None = None) -> DataFrame:
    return transactions.withColumn("explorer_url", evm.explorer_url("tx_hash", "chain_id", template))
