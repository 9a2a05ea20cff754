"""Stored rows with seeded faults, next to the authoritative rows they came from.

Every fault is a rule on the row's own number, so several may hit one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import evm, u256
from ..operators import fold
from ..session import durable
from . import sql, views


def _number(column: str):
    return F.conv(F.right(column, F.lit(15)), 16, 10).cast("long")


def _plus_one(column: str, when):
    one = u256.pack(F.lit(0), F.lit(0), F.lit(1))
    return F.when(when, u256.add(F.col(column), one)).otherwise(F.col(column))


def _copies(when):
    return F.explode(F.when(when, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))


def live_transfers(spark, sf_dir) -> DataFrame:
    """The folded live transfers as a stored table, as an audit would find it."""
    rows = views.transfers(spark, sf_dir).filter(~F.col("removed"))
    return durable(rows.withColumn("n", _number("tx_hash")))


def observed_transfers(live: DataFrame) -> DataFrame:
    """Dropped (97), amount + 1 (89), receiver changed (83), block + 1 (79), twice (73)."""
    n = F.col("n")
    token = F.right("token", F.lit(1)).cast("long")
    return (
        live.filter(n % 97 != 0)
        .withColumns(
            {
                "amount": _plus_one("amount", n % 89 == 0),
                "to_address": F.when(n % 83 == 0, evm.address_of(F.lit(4321))).otherwise(F.col("to_address")),
                "block_number": F.when(n % 79 == 0, F.col("block_number") + 1).otherwise(F.col("block_number")),
                "copy": _copies(n % 73 == 0),
            }
        )
        .withColumn("id", ((n * 8 + F.col("log_index")) * 8 + token) * 2 + F.col("copy"))
        .drop("copy")
    )


def observed_payroll(spark, sf_dir, kind: str) -> DataFrame:
    """Dropped (17), first amount + 1 (13), employee changed (11), block + 1 (7), twice (5)."""
    events = views.payroll_events(spark, sf_dir)
    rows = fold.funding_rows(events) if kind == "PayrollFunded" else fold.claim_rows(events)
    amount = "fee" if kind == "PayrollFunded" else "amount"
    n = F.col("n")
    return (
        rows.withColumn("n", F.col("block_number"))
        .filter(n % 17 != 0)
        .withColumns(
            {
                amount: _plus_one(amount, n % 13 == 0),
                "employee": F.when(n % 11 == 0, evm.address_of(F.lit(4321))).otherwise(F.col("employee")),
                "block_number": F.when(n % 7 == 0, n + 1).otherwise(n),
                "copy": _copies(n % 5 == 0),
            }
        )
        .withColumn("id", n * 2 + F.col("copy"))
        .drop("copy")
    )


OTHER = sql.addr("4321")

TRANSFERS = sql.TRANSFERS + f""",
live AS (SELECT *, order_key AS n FROM transfers WHERE NOT removed),
observed AS (
  SELECT chain_id, token, tx_hash, log_index, from_address,
         CASE WHEN n % 83 = 0 THEN {OTHER} ELSE to_address END AS to_address,
         amount + CASE WHEN n % 89 = 0 THEN 1 ELSE 0 END AS amount,
         block_number + CASE WHEN n % 79 = 0 THEN 1 ELSE 0 END AS block_number, n,
         ((n * 8 + log_index) * 8 + CAST(right(token, 1) AS BIGINT)) * 2 + c AS id
  FROM live, (VALUES (0), (1)) v(c)
  WHERE n % 97 <> 0 AND (c = 0 OR n % 73 = 0)),
cut AS (SELECT min(block_number) + (max(block_number) - min(block_number)) * 9 // 10 AS cursor
        FROM live)"""


def payroll_sql(kind: str) -> str:
    amount = "cents // 100" if kind == "PayrollFunded" else "cents"
    return sql.PAYROLL + f""",
live AS (SELECT *, {amount} AS faulty, block_number AS n FROM payroll WHERE event_name = '{kind}'),
observed AS (
  SELECT chain_id, employer, CASE WHEN n % 11 = 0 THEN {OTHER} ELSE employee END AS employee,
         cents, faulty + CASE WHEN n % 13 = 0 THEN 1 ELSE 0 END AS faulty, tx_hash, log_index,
         block_number + CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END AS block_number, n, n * 2 + c AS id
  FROM live, (VALUES (0), (1)) v(c)
  WHERE n % 17 <> 0 AND (c = 0 OR n % 5 = 0)),
cut AS (SELECT min(block_number) + (max(block_number) - min(block_number)) * 9 // 10 AS cursor FROM live)"""
