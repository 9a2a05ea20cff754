"""Sorted pages.

A page near the front is a top-k: every task keeps offset + size rows. Deep
pages would make that k unbounded, so beyond :data:`DEEP` rows the position of
each row is computed in parallel and the page is a range filter on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import with_position

# Limits of the list reads and the sortable columns per list.
DEFAULT_SIZE = 20
MAX_SIZE = 100
HISTORY_LIMIT = 100
SORTABLE = {
    "payroll_fundings": ("block_number", "block_timestamp", "amount_paid", "amount_credited"),
    "salary_claims": ("block_number", "block_timestamp", "amount"),
    "token_transfers": ("block_number", "block_timestamp", "amount"),
    "reconciliation_exceptions": ("detected_at", "severity", "status"),
}
DEFAULT_SORT = {
    "payroll_fundings": "block_number",
    "salary_claims": "block_number",
    "token_transfers": "block_number",
    "reconciliation_exceptions": "detected_at",
}

DEEP = 100_000


@dataclass(frozen=True)
class Page:
    """Rows of one page, and the size of the whole list as a one-row table."""

    rows: DataFrame
    meta: DataFrame


def sort_columns(table: str, column: str | None, direction: str | None = "desc", strict: bool = True, ties=()):
    """Sort order of a list: whitelisted column, then log index (or id) descending.

    ``strict`` rejects unknown columns; otherwise they fall back to the
    default. ``ties`` are unique columns appended to make the order total.
    """
    column = (column or DEFAULT_SORT[table]).lower()
    direction = (direction or "desc").lower()
    if column not in SORTABLE[table]:
        if strict:
            raise ValueError(f"cannot sort {table} by {column!r}")
        column = DEFAULT_SORT[table]
    if direction not in ("asc", "desc"):
        if strict:
            raise ValueError("sort direction must be asc or desc")
        direction = "desc"
    main = F.col(column)
    second = "id" if table == "reconciliation_exceptions" else "log_index"
    # NULL sorts as the largest value, as in the stored tables' own database
    first = main.asc_nulls_last() if direction == "asc" else main.desc_nulls_first()
    return [first, F.desc(second), *[F.col(t).asc() for t in ties if t not in (column, second)]]


def check_page(page: int | None, size: int | None) -> tuple[int, int]:
    page = 1 if page is None else page
    size = DEFAULT_SIZE if size is None else size
    if page < 1:
        raise ValueError("page must be at least 1")
    if not 1 <= size <= MAX_SIZE:
        raise ValueError(f"page size must be within 1..{MAX_SIZE}")
    return page, size


def window_of(limit: int | None, offset: int | None) -> tuple[int, int]:
    """Lenient form of the repository reads: bad values fall back to defaults."""
    return (limit if limit and limit > 0 else DEFAULT_SIZE), max(offset or 0, 0)


def slice_rows(df: DataFrame, order, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset+limit-1 of ``df`` in ``order``."""
    if offset + limit <= DEEP:
        return df.orderBy(*order).offset(offset).limit(limit)
    placed = with_position(df, order, "_position", start=0)
    return (
        placed.filter(F.col("_position").between(offset, offset + limit - 1))
        .orderBy("_position")
        .drop("_position")
    )


def page(df: DataFrame, order, page: int | None = 1, size: int | None = None) -> Page:
    page, size = check_page(page, size)
    meta = df.agg(F.count("*").alias("total")).select(
        F.lit(page).alias("page"),
        F.lit(size).alias("size"),
        "total",
        (F.lit(page).cast("long") * size < F.col("total")).alias("has_next"),
    )
    return Page(slice_rows(df, order, (page - 1) * size, size), meta)


def page_after(df: DataFrame, block: int, log_index: int, size: int = DEFAULT_SIZE, ties=("tx_hash",)) -> DataFrame:
    """Next rows after a (block, log index) position, ascending; no offset to skip."""
    ahead = (F.col("block_number") > block) | (
        (F.col("block_number") == block) & (F.col("log_index") > log_index)
    )
    return df.filter(ahead).orderBy("block_number", "log_index", *ties).limit(size)


def token_history(transfers: DataFrame, chain_id: int, token: str, limit: int | None = None) -> DataFrame:
    """Oldest transfers of a token, 100 unless told otherwise."""
    n = limit if limit and limit > 0 else HISTORY_LIMIT
    return (
        transfers.filter((F.col("chain_id") == chain_id) & (F.col("token") == token.strip().lower()))
        .orderBy("block_number", "log_index", "tx_hash")
        .limit(n)
    )
