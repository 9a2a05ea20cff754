"""Predicates of the list reads.

Stored addresses and hashes are lower-case, so only constants are lowered and
every predicate reaches the scan. ``None`` always means "no condition".
"""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evm

DIRECTIONS = ("in", "out", "all")


def _value(bound) -> Column:
    return bound if isinstance(bound, Column) else F.lit(bound)


def of_chain(df: DataFrame, chain_id: int) -> DataFrame:
    return df.filter(F.col("chain_id") == chain_id)


def equal_ci(df: DataFrame, column: str, value: str | None) -> DataFrame:
    return df if not value else df.filter(evm.eq_ci(column, value))


def by_wallet(df: DataFrame, wallet: str | None, direction: str = "all") -> DataFrame:
    """Transfers to (``in``), from (``out``) or touching (``all``) a wallet."""
    direction = (direction or "all").lower()
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    if not wallet:
        return df
    to_me, from_me = evm.eq_ci("to_address", wallet), evm.eq_ci("from_address", wallet)
    return df.filter({"in": to_me, "out": from_me, "all": to_me | from_me}[direction])


def by_blocks(df: DataFrame, first=None, last=None) -> DataFrame:
    """Inclusive block bounds."""
    if isinstance(first, int) and isinstance(last, int) and first > last:
        raise ValueError(f"from_block ({first}) must not be above to_block ({last})")
    if first is not None:
        df = df.filter(F.col("block_number") >= _value(first))
    if last is not None:
        df = df.filter(F.col("block_number") <= _value(last))
    return df


def read_date(text: str) -> datetime:
    """RFC 3339, ``YYYY-MM-DDThh:mm:ss`` or ``YYYY-MM-DD``; no offset means UTC."""
    try:
        moment = datetime.fromisoformat(text)
    except ValueError as bad:
        raise ValueError(f"unrecognised date {text!r}") from bad
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


def _moment(bound) -> Column:
    if isinstance(bound, Column):
        return bound
    if isinstance(bound, str):
        bound = read_date(bound)
    if isinstance(bound, date) and not isinstance(bound, datetime):
        bound = datetime(bound.year, bound.month, bound.day, tzinfo=UTC)
    if bound.tzinfo is None:
        bound = bound.replace(tzinfo=UTC)
    return F.lit(bound)


def by_dates(df: DataFrame, first=None, last=None, column: str = "block_timestamp") -> DataFrame:
    """Inclusive time bounds."""
    if isinstance(first, str) and isinstance(last, str) and read_date(first) > read_date(last):
        raise ValueError("from_date must be before or equal to to_date")
    if first is not None:
        df = df.filter(F.col(column) >= _moment(first))
    if last is not None:
        df = df.filter(F.col(column) <= _moment(last))
    return df


def exceptions_where(
    exceptions: DataFrame, severity=None, status=None, type_=None, first=None, last=None
) -> DataFrame:
    """Optional severity, status, type (any case) and detection time."""
    for column, value in (("severity", severity), ("status", status), ("type", type_)):
        if value:
            exceptions = exceptions.filter(F.lower(column) == value.strip().lower())
    return by_dates(exceptions, first, last, "detected_at")


def open_exception(exceptions: DataFrame, entity_ref: str) -> DataFrame:
    """The newest open exception of one entity, at most one row."""
    return (
        exceptions.filter((F.col("entity_ref") == entity_ref) & (F.col("status") == "open"))
        .orderBy(F.desc("detected_at"), F.desc("id"))
        .limit(1)
    )


def open_by_prefix(exceptions: DataFrame, prefix: str) -> DataFrame:
    """Open exceptions whose reference starts with ``prefix``, taken literally."""
    return exceptions.filter(
        F.col("entity_ref").startswith(prefix) & (F.col("status") == "open")
    ).orderBy("id")


def escrow_key(escrow_id) -> str:
    """32-byte word of an escrow id given as a number, decimal text or 0x hex text."""
    text = str(escrow_id).strip().lower()
    number = int(text, 16) if text.startswith("0x") else int(text)
    if not 0 <= number < 1 << 256:
        raise ValueError(f"escrow id {escrow_id!r} is not a uint256")
    return format(number, "064x")


def escrow_events_of(events: DataFrame, escrow_id) -> DataFrame:
    """All events of one escrow (hex or decimal id) in chain order."""
    word = escrow_key(escrow_id)
    if "escrow_key" in events.columns:
        mine = F.col("escrow_key") == word
    else:
        mine = F.col("escrow_id") == evm.parse_u256(F.lit("0x" + word))
    return events.filter(mine).orderBy("block_number", "log_index", "tx_hash")


def event_at(events: DataFrame, tx_hash: str, log_index: int) -> DataFrame:
    return events.filter(evm.eq_ci("tx_hash", tx_hash) & (F.col("log_index") == log_index)).limit(1)


def wide_view(events: DataFrame, text=(), numbers=(), times=()) -> DataFrame:
    """Read form of wide rows: NULL text is '', NULL numbers are 0, times are epochs."""
    return events.withColumns(
        {
            **{c: F.coalesce(F.col(c), F.lit("")) for c in text},
            **{c: F.coalesce(F.col(c), F.lit(0)) for c in numbers},
            **{c: F.coalesce(F.unix_timestamp(c), F.lit(0)) for c in times},
        }
    )


def in_range(df: DataFrame, chain_id: int, first, last) -> DataFrame:
    """Audit read of a block range in chain order, removed rows included."""
    return by_blocks(of_chain(df, chain_id), first, last).orderBy("block_number", "log_index", "id")


def transaction(transactions: DataFrame, tx_hash: str) -> DataFrame:
    """One transaction; an empty recipient reads as NULL."""
    return transactions.filter(evm.eq_ci("tx_hash", tx_hash)).withColumn(
        "recipient", F.nullif("recipient", F.lit(""))
    )


def events_of_tx(ledger: DataFrame, tx_hash: str) -> DataFrame:
    return ledger.filter(evm.eq_ci("tx_hash", tx_hash)).orderBy("log_index")


def list_employers(employers: DataFrame, chain_id: int) -> DataFrame:
    return of_chain(employers, chain_id).orderBy("wallet")


def list_employees(employees: DataFrame, chain_id: int) -> DataFrame:
    return of_chain(employees, chain_id).orderBy("wallet")
