"""Exact token balances from transfer history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evm, u256
from ..functions.ordered import running_sums
from ..session import durable


def live(df: DataFrame) -> DataFrame:
    """Rows a reorg has not taken back."""
    return df.filter(~F.col("removed"))


def _up_to(df: DataFrame, block) -> DataFrame:
    if block is None:
        return df
    return df.filter(F.col("block_number") <= (block if isinstance(block, Column) else F.lit(block)))


def movements(transfers: DataFrame, block=None, keep_zero: bool = False) -> DataFrame:
    """One credit and one debit row per live transfer, from a single scan."""
    legs = F.explode(
        F.array(
            F.struct(F.col("to_address").alias("address"), F.lit(False).alias("debit")),
            F.struct(F.col("from_address").alias("address"), F.lit(True).alias("debit")),
        )
    )
    rows = (
        _up_to(live(transfers), block)
        .withColumn("leg", legs)
        .select(
            *[c for c in transfers.columns if c not in ("from_address", "to_address", "amount")],
            F.col("leg.address").alias("address"),
            F.col("leg.debit").alias("debit"),
            u256.signed(F.col("amount"), F.col("leg.debit")).alias("delta"),
        )
    )
    return rows if keep_zero else rows.filter(evm.nonzero("address"))


def token_balances(transfers: DataFrame, block=None) -> DataFrame:
    """Net balance per (chain, token, address); may be negative, a self-transfer nets 0.

    Hot wallets are summed map-side first, so they cost one row per task in the
    shuffle.
    """
    return (
        movements(transfers, block)
        .groupBy("chain_id", "token", "address")
        .agg(u256.total(F.col("delta")).alias("balance"))
    )


def wallet_balance(transfers: DataFrame, token: str, wallet: str, block=None) -> DataFrame:
    """One row: credits minus debits of one wallet, 0 without movements.

    The zero address is allowed here. The filter reaches the scan, and the sum
    is a conditional aggregate over one pass.
    """
    w = wallet.strip().lower()
    to_me, from_me = F.col("to_address") == w, F.col("from_address") == w
    rows = _up_to(live(transfers), block).filter(
        evm.eq_ci("token", token) & (to_me | from_me) & (F.col("to_address") != F.col("from_address"))
    )
    total = u256.total(u256.signed(F.col("amount"), from_me))
    return rows.agg(F.coalesce(total, u256.zero()).alias("balance")).select(
        F.lit(w).alias("address"), "balance"
    )


def balances_of(transfers: DataFrame, accounts: DataFrame, block=None) -> DataFrame:
    """:func:`wallet_balance` for a table of (chain_id, token, address), zero address included."""
    keys = ["chain_id", "token", "address"]
    sums = (
        movements(transfers, block, keep_zero=True)
        .groupBy(*keys)
        .agg(u256.total(F.col("delta")).alias("balance"))
    )
    return (
        accounts.select(*keys)
        .join(sums, keys, "left")
        .withColumn("balance", F.coalesce("balance", u256.zero()))
    )


def running_balances(transfers: DataFrame, width: int = 256) -> DataFrame:
    """Balance of each address after each of its movements.

    A window holds an address's movements of ``width`` blocks; what a chain puts into a block is bounded.
    The live transfers are written once: the sums of slices read them beside the rows, and what they come
    from, often a fold of all deliveries, is not done again for that.
    """
    kept = ("chain_id", "token", "from_address", "to_address", "block_number", "tx_hash", "log_index", "removed", "amount")
    moves = movements(durable(live(transfers).select(*kept))).select(
        "chain_id", "token", "address", "block_number", "tx_hash", "log_index", "debit", "delta"
    )
    order = ["block_number", "log_index", "tx_hash", "debit"]
    return running_sums(moves, ["chain_id", "token", "address"], order, "delta", "balance", "block_number", width)


def relevant_addresses(
    transfers: DataFrame, fundings: DataFrame, claims: DataFrame, block=None,
    payroll_contract: str | None = None, chain_id: int | None = None,
) -> DataFrame:
    """Distinct (chain_id, address) of everybody who moved tokens or payroll up to a block.

    Removed transfers count too. Each source is exploded, not scanned once per
    column, and the zero address is left out.
    """

    def people(df: DataFrame, *columns: str) -> DataFrame:
        pair = F.explode(F.array(*[F.col(c) for c in columns])) if len(columns) > 1 else F.col(columns[0])
        return _up_to(df, block).select("chain_id", pair.alias("address"))

    every = (
        people(transfers, "from_address", "to_address")
        .unionByName(people(fundings, "employer", "employee"))
        .unionByName(people(claims, "employee"))
        .filter(evm.nonzero("address"))
    )
    if payroll_contract and not evm.is_zero_address(payroll_contract):
        contract = transfers.sparkSession.range(1).select(
            F.lit(chain_id).cast("long").alias("chain_id"),
            F.lit(payroll_contract.strip().lower()).alias("address"),
        )
        every = every.unionByName(contract)
    return every.distinct()


def in_address_order(addresses: DataFrame) -> DataFrame:
    """Addresses as lists show them."""
    return addresses.orderBy("chain_id", "address")
