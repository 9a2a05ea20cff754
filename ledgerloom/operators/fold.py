"""Current state of employers and employees as an order-based fold of events.

Each event is one or more *effects* on a wallet. What the sequential writer
would leave behind depends only on a few order statistics of those effects
(the first one, the first addition, the last removal, ...), so the fold is a
single aggregate per table: associative, partially aggregated before the
shuffle, independent of partitioning and of replays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evm, u256

ADDED, REMOVED, ENSURED, FUNDED, CLAIMED = "added", "removed", "ensured", "funded", "claimed"


def _at() -> Column:
    return F.struct("block_number", "log_index", "tx_hash")


def _live(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("removed")) if "removed" in events.columns else events


def _employee_effects(events: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("event_name") == "EmployeeAdded", ADDED)
        .when(F.col("event_name") == "EmployeeRemoved", REMOVED)
        .when(F.col("event_name") == "PayrollFunded", FUNDED)
        .when(F.col("event_name") == "SalaryClaimed", CLAIMED)
    )
    return (
        events.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select(
            "chain_id", F.col("employee").alias("wallet"), "kind",
            F.coalesce("employer", F.lit(evm.ZERO_ADDRESS)).alias("employer"),
            "salary", "allocation",
            F.col("block_timestamp").alias("ts"), F.col("tx_hash").alias("tx"), _at().alias("at"),
        )
    )


def _when(kinds, value="at") -> Column:
    return F.when(F.col("kind").isin(*kinds), F.col(value))


def fold_employees(events: DataFrame) -> DataFrame:
    """One row per (chain, employee) with the state after all events."""
    folded = (
        _employee_effects(events)
        .groupBy("chain_id", "wallet")
        .agg(
            F.min_by(F.struct("kind", "employer", "ts", "tx"), "at").alias("first"),
            F.min_by("ts", _when([ADDED])).alias("first_added"),
            F.max_by(F.struct("employer", "salary", "allocation"), _when([ADDED])).alias("terms"),
            F.max_by("kind", _when([ADDED, REMOVED])).alias("last_switch"),
            F.max_by("ts", _when([REMOVED])).alias("removed_at"),
            F.max_by("ts", _when([CLAIMED])).alias("claimed_at"),
            F.max_by("tx", _when([ADDED, REMOVED, CLAIMED])).alias("last_tx"),
        )
    )
    implicit = F.col("first")["kind"].isin(FUNDED, CLAIMED)
    return folded.select(
        "chain_id",
        "wallet",
        F.coalesce(F.col("terms")["employer"], F.col("first")["employer"]).alias("employer"),
        F.coalesce(F.col("terms")["salary"], u256.zero()).alias("salary_per_second"),
        F.unix_timestamp("claimed_at").alias("last_withdraw"),
        F.coalesce(F.col("last_switch") == ADDED, F.lit(True)).alias("active"),
        u256.zero().alias("total_leaves"),
        F.unix_timestamp("removed_at").alias("deactivation_time"),
        F.when(
            F.col("terms").isNotNull(), F.coalesce(F.col("terms")["allocation"], u256.zero())
        ).alias("allocation"),
        F.when(implicit, F.col("first")["ts"]).otherwise(F.col("first_added")).alias("added_at"),
        "removed_at",
        F.coalesce("last_tx", F.col("first")["tx"]).alias("latest_tx_hash"),
    )


def _orphan_claims(events: DataFrame) -> DataFrame:
    """Claims that were the first thing ever heard of an employee.

    Each of them makes the zero address an employer, if it is not one yet.
    """
    return (
        _employee_effects(events)
        .groupBy("chain_id", "wallet")
        .agg(F.min_by(F.struct("kind", "ts", "tx"), "at").alias("first"), F.min("at").alias("at"))
        .filter(F.col("first")["kind"] == CLAIMED)
        .select(
            "chain_id",
            F.lit(evm.ZERO_ADDRESS).alias("wallet"),
            F.lit(ENSURED).alias("kind"),
            F.col("first")["ts"].alias("ts"),
            F.col("first")["tx"].alias("tx"),
            "at",
        )
    )


def fold_employers(events: DataFrame) -> DataFrame:
    """One row per (chain, employer); implicit inserts included."""
    kind = (
        F.when(F.col("event_name") == "EmployerAdded", ADDED)
        .when(F.col("event_name") == "EmployerRemoved", REMOVED)
        .when(F.col("event_name").isin("EmployeeAdded", "EmployeeRemoved", "PayrollFunded"), ENSURED)
    )
    effects = (
        events.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select(
            "chain_id", F.col("employer").alias("wallet"), "kind",
            F.col("block_timestamp").alias("ts"), F.col("tx_hash").alias("tx"), _at().alias("at"),
        )
        .unionByName(_orphan_claims(events))
    )
    folded = effects.groupBy("chain_id", "wallet").agg(
        F.min_by(F.struct("kind", "ts", "tx"), "at").alias("first"),
        F.min_by("ts", _when([ADDED])).alias("first_added"),
        F.max_by(F.struct("kind", "tx"), _when([ADDED, REMOVED])).alias("last"),
        F.max_by("ts", _when([REMOVED])).alias("removed_at"),
    )
    return folded.select(
        "chain_id",
        "wallet",
        u256.zero().alias("funds"),
        u256.zero().alias("total_salary_per_second"),
        F.coalesce(F.col("last")["kind"] == ADDED, F.lit(True)).alias("active"),
        F.unix_timestamp("removed_at").alias("deactivation_time"),
        F.when(F.col("first")["kind"] == ENSURED, F.col("first")["ts"])
        .otherwise(F.col("first_added"))
        .alias("added_at"),
        "removed_at",
        F.coalesce(F.col("last")["tx"], F.col("first")["tx"]).alias("latest_tx_hash"),
    )


def _amount(column: str) -> Column:
    return F.coalesce(F.col(column), u256.zero()).alias(column)


_PLACE = ("tx_hash", "block_number", "block_timestamp", "log_index")


def funding_rows(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_name") == "PayrollFunded").select(
        "chain_id", "employer", "employee", _amount("amount_paid"), _amount("fee"),
        _amount("amount_credited"), *_PLACE,
    )


def claim_rows(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_name") == "SalaryClaimed").select(
        "chain_id", "employee", _amount("amount"), *_PLACE
    )


def rebuild(ledger: DataFrame) -> dict[str, DataFrame]:
    """All projections from the live part of the ledger.

    Removed logs stay in the ledger and leave every projection. Ownership
    transfers are ledger-only.
    """
    from .upsert import insert_claims, insert_fundings

    events = _live(ledger)
    order = [F.col("block_number"), F.col("log_index")]
    return {
        "employers": fold_employers(events),
        "employees": fold_employees(events),
        "payroll_fundings": insert_fundings(None, funding_rows(events), order),
        "salary_claims": insert_claims(None, claim_rows(events), order),
    }


def employer_totals(employees: DataFrame, fundings: DataFrame) -> DataFrame:
    """Derived funds and salary rate per employer.

    The stored columns of the same meaning are constant 0 and stay so; these
    are offered beside them.
    """
    keys = ["chain_id", "employer"]
    rate = (
        employees.filter("active")
        .groupBy(*keys)
        .agg(u256.total(F.col("salary_per_second")).alias("salary_per_second"), F.count("*").alias("active_employees"))
    )
    credited = fundings.groupBy(*keys).agg(u256.total(F.col("amount_credited")).alias("credited"))
    return rate.join(credited, keys, "full").select(
        *keys,
        F.coalesce("salary_per_second", u256.zero()).alias("salary_per_second"),
        F.coalesce("active_employees", F.lit(0)).alias("active_employees"),
        F.coalesce("credited", u256.zero()).alias("credited"),
    )
