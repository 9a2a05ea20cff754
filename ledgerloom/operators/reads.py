"""User-facing reads composed from filters, sorts and joins.

Lists return a :class:`~.paging.Page`. Profiles are relations with one row per
child (an employer's employees, a transaction's events): a nested array of an
unbounded group would have to fit one task. Only bounded lists are nested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import u256
from . import checkpoints as cp
from . import filters as flt
from . import paging

HISTORY = 50  # fixed value: newest fundings and claims in an employee profile


def _text(df: DataFrame, *columns: str) -> DataFrame:
    """Exact amounts as decimal text for output, after sorting by their numeric value."""
    return df.withColumns({c: u256.to_string(F.col(c)) for c in columns})


def list_fundings(
    fundings: DataFrame, chain_id: int, employer=None, employee=None, blocks=(None, None),
    dates=(None, None), sort=None, direction="desc", page=1, size=None, strict=True,
) -> paging.Page:
    rows = flt.of_chain(fundings, chain_id)
    rows = flt.equal_ci(flt.equal_ci(rows, "employer", employer), "employee", employee)
    rows = flt.by_dates(flt.by_blocks(rows, *blocks), *dates)
    order = paging.sort_columns("payroll_fundings", sort, direction, strict, ties=("tx_hash",))
    out = paging.page(rows, order, page, size)
    return paging.Page(_text(out.rows, "amount_paid", "fee", "amount_credited"), out.meta)


def list_claims(
    claims: DataFrame, chain_id: int, employee=None, blocks=(None, None), dates=(None, None),
    sort=None, direction="desc", page=1, size=None, strict=True,
) -> paging.Page:
    rows = flt.equal_ci(flt.of_chain(claims, chain_id), "employee", employee)
    rows = flt.by_dates(flt.by_blocks(rows, *blocks), *dates)
    order = paging.sort_columns("salary_claims", sort, direction, strict, ties=("tx_hash",))
    out = paging.page(rows, order, page, size)
    return paging.Page(_text(out.rows, "amount"), out.meta)


def list_transfers(
    transfers: DataFrame, chain_id: int, token=None, wallet=None, wallet_direction="all",
    blocks=(None, None), dates=(None, None), sort=None, direction="desc", page=1, size=None,
    strict=True,
) -> paging.Page:
    """Includes removed rows, which carry their flag."""
    rows = flt.equal_ci(flt.of_chain(transfers, chain_id), "token", token)
    rows = flt.by_wallet(rows, wallet, wallet_direction)
    rows = flt.by_dates(flt.by_blocks(rows, *blocks), *dates)
    order = paging.sort_columns("token_transfers", sort, direction, strict, ties=("tx_hash", "token"))
    out = paging.page(rows, order, page, size)
    return paging.Page(_text(out.rows, "amount"), out.meta)


def list_exceptions(
    exceptions: DataFrame, severity=None, status=None, type_=None, dates=(None, None), sort=None,
    direction="desc", page=1, size=None, strict=True,
) -> paging.Page:
    """Severity sorts as text, as stored."""
    rows = flt.exceptions_where(exceptions, severity, status, type_, *dates)
    order = paging.sort_columns("reconciliation_exceptions", sort, direction, strict)
    return paging.page(rows, order, page, size)


def escrow_lifecycle(events: DataFrame, escrow_id) -> DataFrame:
    """Events of one escrow in order; :func:`escrow_count` gives a chain's total."""
    return _text(flt.escrow_events_of(events, escrow_id), "escrow_id", "amount")


def escrow_count(events: DataFrame) -> DataFrame:
    return events.groupBy("chain_id").agg(F.count("*").alias("total"))


def transaction_view(transactions: DataFrame, ledger: DataFrame, cursors: DataFrame, template=None) -> DataFrame:
    """Transactions with confirmations, link and one row per event.

    Events are the streamed side, so a transaction with very many of them can
    be split by the skew join; transactions without events follow in a second
    branch with an empty event.
    """
    keys = ["chain_id", "tx_hash"]
    header = cp.with_explorer_url(
        cp.with_confirmations(transactions, cp.latest_block(transactions, cursors)), template
    ).withColumn("recipient", F.nullif("recipient", F.lit("")))
    children = ledger.select(*keys, "event_name", "contract_address", "log_index", "raw_data")
    with_events = children.join(header, keys)
    without = header.join(children.select(*keys).distinct(), keys, "left_anti")
    return with_events.unionByName(without, allowMissingColumns=True)


def transaction_events(transactions: DataFrame, ledger: DataFrame, cursors: DataFrame, template=None) -> DataFrame:
    """:func:`transaction_view` by one outer join, for tables stored in the layout of that join.

    Both sides are read once and in order; there is nothing to exchange, and a transaction
    with very many events is a run of rows in one sorted bucket.
    """
    header = cp.with_explorer_url(
        cp.with_confirmations(transactions, cp.latest_block(transactions, cursors)), template
    ).withColumn("recipient", F.nullif("recipient", F.lit("")))
    children = ledger.select("chain_id", "tx_hash", "event_name", "contract_address", "log_index", "raw_data")
    return header.join(children.hint("merge"), ["chain_id", "tx_hash"], "left")


def employer_profile(employers: DataFrame, employees: DataFrame, wallet: str | None = None) -> DataFrame:
    """Employer columns beside each of its employees, with the active head count.

    Display order is :func:`profile_order`. An employer of a third of all
    employees is counted by partial aggregation and its rows stay spread.
    """
    if wallet:
        employers = flt.equal_ci(employers, "wallet", wallet)
        employees = flt.equal_ci(employees, "employer", wallet)
    keys = ["chain_id", "employer"]
    counts = employees.groupBy(*keys).agg(F.count_if("active").alias("active_employees"))
    header = (
        employers.withColumnRenamed("wallet", "employer")
        .join(counts, keys, "left")
        .select(
            *keys,
            F.col("active").alias("employer_active"),
            u256.to_string(F.col("funds")).alias("funds"),
            u256.to_string(F.col("total_salary_per_second")).alias("total_salary_per_second"),
            F.coalesce("active_employees", F.lit(0)).alias("active_employees"),
            F.col("latest_tx_hash").alias("employer_tx_hash"),
        )
    )
    staff = employees.select(
        *keys,
        F.col("wallet").alias("employee"),
        u256.to_string(F.col("salary_per_second")).alias("salary_per_second"),
        F.col("active").alias("employee_active"),
        F.col("added_at").alias("employee_added_at"),
    )
    alone = header.join(staff.select(*keys).distinct(), keys, "left_anti")
    return staff.join(header, keys).unionByName(alone, allowMissingColumns=True)


def profile_order():
    return [F.col("employee_added_at").desc_nulls_last(), F.col("employee").asc()]


def newest_per_employee(history: DataFrame, n: int = HISTORY) -> DataFrame:
    """The newest ``n`` rows of each employee.

    The rank filter is pushed into the window, so every task sends at most
    ``n`` rows per employee to the shuffle.
    """
    newest = Window.partitionBy("chain_id", "employee").orderBy(
        F.desc("block_number"), F.desc("log_index"), F.col("tx_hash")
    )
    return history.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)


def employee_profile(
    employees: DataFrame, fundings: DataFrame, claims: DataFrame, wallet: str | None = None
) -> DataFrame:
    """Employee columns with two nested lists of at most 50 entries, newest first."""
    if wallet:
        employees = flt.equal_ci(employees, "wallet", wallet)
        fundings = flt.equal_ci(fundings, "employee", wallet)
        claims = flt.equal_ci(claims, "employee", wallet)

    def nested(history: DataFrame, name: str, amounts: tuple[str, ...], *fields) -> DataFrame:
        entry = F.struct("rank", *fields, *amounts, "tx_hash", "block_number", "block_timestamp", "log_index")
        return (
            _text(newest_per_employee(history), *amounts)  # amounts are written out for the newest rows only
            .groupBy("chain_id", F.col("employee").alias("wallet"))
            .agg(F.sort_array(F.collect_list(entry)).alias(name))
        )

    paid = nested(fundings, "funding_history", ("amount_paid", "fee", "amount_credited"), "employer")
    claimed = nested(claims, "claim_history", ("amount",))
    keys = ["chain_id", "wallet"]
    return _text(
        employees.join(paid, keys, "left").join(claimed, keys, "left"),
        "salary_per_second", "total_leaves", "allocation",
    )


def backfill_requests(requests: DataFrame) -> DataFrame:
    """Operator backfill requests with the rule they break, if any."""
    from .quality import valid_ranges

    return valid_ranges(requests, backfill=True)
