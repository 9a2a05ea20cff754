"""Integrity rules as tables of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import MAX_BACKFILL_WIDTH

# Allowed codes.
TX_STATUS = ("pending", "confirmed", "finalized", "failed", "reorged")
SEVERITIES = ("low", "medium", "high", "critical")
EXCEPTION_STATUS = ("open", "resolved")


def event_stats(events: DataFrame, name: str = "event_name") -> DataFrame:
    return events.groupBy("chain_id", name).agg(
        F.count("*").alias("n"),
        F.min("block_number").alias("first_block"),
        F.max("block_number").alias("last_block"),
    )


def duplicate_events(df: DataFrame, keys, id_column: str = "id", order=("block_number", "log_index")) -> DataFrame:
    """Keys stored more than once: count, first row's id, smallest and largest id.

    Only fixed-size values per key, so a key with very many copies stays cheap;
    :func:`duplicate_members` lists the copies themselves.
    """
    first = F.min(F.struct(*order, id_column))
    return (
        df.groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            first[id_column].alias("first_id"),
            F.min(id_column).alias("min_id"),
            F.max(id_column).alias("max_id"),
        )
        .filter(F.col("n") > 1)
    )


def duplicate_members(df: DataFrame, keys) -> DataFrame:
    """Every stored copy of a duplicated key, one row each."""
    doubled = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
    return df.join(doubled, list(keys), "left_semi")


def check_enums(
    transactions: DataFrame | None = None, exceptions: DataFrame | None = None
) -> DataFrame:
    """Rows holding a code outside its allowed set."""
    parts = []
    if transactions is not None:
        parts.append(
            transactions.filter(~F.coalesce(F.col("status").isin(*TX_STATUS), F.lit(False))).select(
                F.lit("transactions.status").alias("rule"),
                F.col("tx_hash").alias("ref"),
                F.col("status").alias("value"),
            )
        )
    if exceptions is not None:
        for column, allowed in (("severity", SEVERITIES), ("status", EXCEPTION_STATUS)):
            parts.append(
                exceptions.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).select(
                    F.lit(f"reconciliation_exceptions.{column}").alias("rule"),
                    F.col("entity_ref").alias("ref"),
                    F.col(column).alias("value"),
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# child table, child column, parent table, parent column
FOREIGN_KEYS = (
    ("employees", "employer", "employers", "wallet"),
    ("chain_events", "tx_hash", "transactions", "tx_hash"),
    ("payroll_fundings", "employer", "employers", "wallet"),
    ("payroll_fundings", "employee", "employees", "wallet"),
    ("payroll_fundings", "tx_hash", "transactions", "tx_hash"),
    ("salary_claims", "employee", "employees", "wallet"),
)


def fk_violations(tables: dict[str, DataFrame], rules=FOREIGN_KEYS) -> DataFrame:
    """Child values without a parent, with the number of child rows.

    Each table is read once: a child gives all its references in one explode, a parent its
    keys, and one aggregate over both counts them by value. Copies of a value are counted
    before the exchange, so one that a third of all rows share crosses it once per task.
    """
    used = [r for r in rules if r[0] in tables and r[2] in tables]
    targets = list(dict.fromkeys((parent, key) for _, _, parent, key in used))
    sides = []
    for name in dict.fromkeys([r[0] for r in used] + [r[2] for r in used]):
        pairs = [
            F.struct(F.lit(targets.index((parent, key))).alias("target"), F.lit(i).alias("rule"), F.col(column).alias("value"))
            for i, (child, column, parent, key) in enumerate(used) if child == name
        ]
        pairs += [
            F.struct(F.lit(t).alias("target"), F.lit(-1).alias("rule"), F.col(key).alias("value"))
            for t, (parent, key) in enumerate(targets) if parent == name
        ]
        sides.append(tables[name].select("chain_id", F.explode(F.array(*pairs)).alias("p")).select("chain_id", "p.*"))
    both = sides[0]
    for side in sides[1:]:
        both = both.unionByName(side)
    rule = F.col("rule")
    counts = both.filter(F.col("value").isNotNull()).groupBy("chain_id", "target", "value").agg(
        F.count_if(rule == -1).alias("held"), *[F.count_if(rule == i).alias(f"n{i}") for i in range(len(used))]
    )
    named = [
        F.struct(F.lit(f"{c}.{column}->{parent}.{key}").alias("rule"), F.col(f"n{i}").alias("n"))
        for i, (c, column, parent, key) in enumerate(used)
    ]
    lost = counts.filter("held = 0").select("chain_id", "value", F.explode(F.array(*named)).alias("r"))
    return lost.filter("r.n > 0").select("r.rule", "chain_id", "value", "r.n")


UNIQUE_KEYS = {
    "transactions": ("chain_id", "tx_hash"),
    "employers": ("chain_id", "wallet"),
    "employees": ("chain_id", "wallet"),
    "chain_events": ("chain_id", "contract_address", "tx_hash", "log_index"),
    "payroll_fundings": ("chain_id", "tx_hash", "log_index"),
    "salary_claims": ("chain_id", "tx_hash", "log_index"),
    "token_transfers": ("chain_id", "token", "tx_hash", "log_index"),
    "escrow_events": ("chain_id", "contract_address", "tx_hash", "log_index"),
}


def unique_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys held by more than one row: table, key as text, number of rows."""
    out = None
    for name, df in tables.items():
        key = F.concat_ws(":", *[F.col(k).cast("string") for k in UNIQUE_KEYS[name]])
        part = (
            df.groupBy(*UNIQUE_KEYS[name])
            .agg(F.count("*").alias("n"))
            .filter("n > 1")
            .select(F.lit(name).alias("table_name"), key.alias("key"), "n")
        )
        out = part if out is None else out.unionByName(part)
    return out


def valid_ranges(requests: DataFrame, backfill: bool = False) -> DataFrame:
    """Adds ``problem``: NULL for an acceptable from/to pair, else the broken rule."""
    lo, hi = F.col("from_block"), F.col("to_block")
    problem = F.when((lo < 0) | (hi < 0), "negative block").when(lo > hi, "from after to")
    if backfill:
        problem = (
            F.when(F.coalesce(lo, F.lit(0)) <= 0, "from must be positive")
            .when(F.coalesce(hi, F.lit(0)) < lo, "from after to")
            .when(hi - lo > MAX_BACKFILL_WIDTH, "range too wide")
        )
    return requests.withColumn("problem", problem)
