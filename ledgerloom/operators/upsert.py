"""Keyed writes as ordered aggregates.

A repeated key keeps its first value in some columns and takes the last value
in others. Both are order statistics, so the whole upsert is one aggregate with
map-side partials: a key with very many copies is reduced before the shuffle
and never gathered in one task. The result does not depend on how the input is
partitioned or in which order it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evm
from ..schemas import RULES, WriteRule


def _order(order) -> Column:
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    return columns[0] if len(columns) == 1 else F.struct(*columns)


def by_key(keys) -> list[Column]:
    """Columns to group by ``keys``: a hash first, so that a sort compares that and hardly ever the long texts of keys."""
    return [F.xxhash64(*keys).alias("_key"), *[F.col(k) if isinstance(k, str) else k for k in keys]]


def latest(deliveries: DataFrame, rule: WriteRule, order) -> DataFrame:
    """Fold deliveries of each key into its current row."""
    aggregates = []
    if rule.first_wins:
        aggregates.append(F.min_by(F.struct(*rule.first_wins), "_order").alias("_first"))
    if rule.last_wins:
        aggregates.append(F.max_by(F.struct(*rule.last_wins), "_order").alias("_last"))
    folded = (
        deliveries.select(*rule.keys, *rule.first_wins, *rule.last_wins, _order(order).alias("_order"))
        .groupBy(*by_key(rule.keys))
        .agg(*aggregates)
    )
    return folded.select(
        *rule.keys,
        *[F.col("_first")[c].alias(c) for c in rule.first_wins],
        *[F.col("_last")[c].alias(c) for c in rule.last_wins],
    )


def upsert(existing: DataFrame | None, incoming: DataFrame, rule: WriteRule, order) -> DataFrame:
    """Merge ``incoming`` into ``existing``; stored rows precede all deliveries."""
    columns = [*rule.keys, *rule.first_wins, *rule.last_wins]
    new = incoming.select(*columns, F.lit(1).alias("_gen"), _order(order).alias("_arrival"))
    if existing is not None:
        arrival = F.lit(None).cast(new.schema["_arrival"].dataType)
        old = existing.select(*columns, F.lit(0).alias("_gen"), arrival.alias("_arrival"))
        new = old.unionByName(new)
    return latest(new, rule, ["_gen", "_arrival"])


def insert_once(existing: DataFrame | None, incoming: DataFrame, keys, columns, order) -> DataFrame:
    """Rows to append: the first delivery of every key that is not stored yet."""
    rule = WriteRule(tuple(keys), tuple(c for c in columns if c not in keys), ())
    fresh = latest(incoming, rule, order)
    if existing is not None:
        fresh = fresh.join(existing.select(*keys), list(keys), "left_anti")
    return fresh


def upsert_transactions(existing, incoming: DataFrame, order) -> DataFrame:
    return upsert(existing, incoming, RULES["transactions"], order)


def upsert_chain_events(existing, incoming: DataFrame, order) -> DataFrame:
    return upsert(existing, incoming, RULES["chain_events"], order)


def upsert_token_transfers(existing, incoming: DataFrame, order) -> DataFrame:
    return upsert(existing, incoming, RULES["token_transfers"], order)


def upsert_escrow_events(existing, incoming: DataFrame, order, mode: str = "batch") -> DataFrame:
    """``batch`` updates six columns; ``single`` keeps event type and escrow id."""
    rule = RULES["escrow_events" if mode == "batch" else "escrow_events_single"]
    return upsert(existing, incoming, rule, order)


def insert_fundings(existing, incoming: DataFrame, order) -> DataFrame:
    rule = RULES["payroll_fundings"]
    return insert_once(existing, incoming, rule.keys, rule.first_wins, order)


def insert_claims(existing, incoming: DataFrame, order) -> DataFrame:
    rule = RULES["salary_claims"]
    return insert_once(existing, incoming, rule.keys, rule.first_wins, order)


def insert_wide_events(existing, incoming: DataFrame, order, text_columns=(), now=None) -> DataFrame:
    """Insert-once of wide ledger rows by (tx_hash, log_index).

    Empty text becomes NULL and a zero block time becomes the load time.
    """
    loaded = now if now is not None else F.current_timestamp()
    cleaned = incoming.withColumns(
        {c: F.nullif(F.col(c), F.lit("")) for c in text_columns}
    ).withColumn(
        "block_timestamp",
        F.when(F.unix_timestamp("block_timestamp") == 0, loaded).otherwise(F.col("block_timestamp")),
    )
    plain = [c for c in cleaned.columns if c not in _order_names(order)]
    return insert_once(existing, cleaned, ["tx_hash", "log_index"], plain, order)


def _order_names(order) -> set[str]:
    return {o for o in order if isinstance(o, str)}


def transaction_rows(metadata: DataFrame) -> DataFrame:
    """Receipts to stored form: status text, empty recipient for contract creation."""
    return metadata.withColumns(
        {
            "status": F.when(F.col("receipt_status") == 0, "failed").otherwise("confirmed"),
            "recipient": F.coalesce(evm.lower_hex("recipient"), F.lit("")),
            "sender": evm.lower_hex("sender"),
            "confirmations": F.lit(1).cast("long"),
        }
    ).drop("receipt_status")


def new_transactions(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct candidate hashes that are not stored yet."""
    keys = ["chain_id", "tx_hash"]
    return candidates.select(*keys).distinct().join(stored.select(*keys), keys, "left_anti")
