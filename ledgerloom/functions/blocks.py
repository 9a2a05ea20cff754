"""Block arithmetic: finality, resume points and bounded ranges.

Every function takes Python integers (planning one run on the driver) or
columns (planning many streams at once) and returns the same kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of the ingest and audit runs.
DEFAULT_RECON_BATCH = 100
DEFAULT_BALANCE_BATCH = 50
MAX_BACKFILL_WIDTH = 50_000

CHUNK_FANOUT = 4096


def _is_col(*values) -> bool:
    return any(isinstance(v, Column) for v in values)


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("long")


def safe_head(latest, depth: int, variant: str = "zero"):
    """Highest final block.

    ``variant`` says what happens while the chain is shorter than ``depth``:
    ``zero`` (ingest), ``latest`` (token ingest, event audits), ``none``
    (balance audit: no result), ``status`` (status report: also ``latest`` when
    both are equal).
    """
    if variant not in ("zero", "latest", "none", "status"):
        raise ValueError(f"unknown safe head variant {variant!r}")
    short = {"zero": 0, "none": None}.get(variant, latest)
    if _is_col(latest):
        reached = latest > depth if variant == "status" else latest >= depth
        return F.when(reached, latest - depth).otherwise(
            F.lit(None).cast("long") if short is None else _lit(short)
        )
    reached = latest > depth if variant == "status" else latest >= depth
    return latest - depth if reached else short


def resume_block(cursor, start, clamp: bool = True):
    """Next block to read: after the cursor, else the configured start.

    ``clamp`` keeps a cursor before the start from going back behind it (token
    and escrow streams; the payroll stream does not clamp).
    """
    if _is_col(cursor, start):
        after = _lit(cursor) + 1
        if clamp:
            after = F.greatest(after, _lit(start))
        return F.coalesce(after, _lit(start))
    if cursor is None:
        return start
    return max(cursor + 1, start) if clamp else cursor + 1


def split_ranges(df: DataFrame, from_col: str, to_col: str, step: int) -> DataFrame:
    """Explode each [from, to] into consecutive chunks of at most ``step`` blocks.

    Rows with from > to, and any step below 1, give no chunk.
    """
    if step < 1:
        return df.limit(0).withColumns(
            {"chunk_from": F.lit(0).cast("long"), "chunk_to": F.lit(0).cast("long")}
        )
    lo, hi = F.col(from_col), F.col(to_col)
    # two levels keep every generated array short, however long the range
    stride = step * CHUNK_FANOUT
    coarse = df.filter(lo <= hi).withColumn(
        "_from", F.explode(F.sequence(lo, hi, F.lit(stride).cast("long")))
    )
    # ends are compared by distance, so they never overflow
    coarse_end = F.when(hi - F.col("_from") >= stride - 1, F.col("_from") + (stride - 1)).otherwise(hi)
    return (
        coarse.withColumn(
            "chunk_from", F.explode(F.sequence(F.col("_from"), coarse_end, F.lit(step).cast("long")))
        )
        .withColumn(
            "chunk_to",
            F.when(hi - F.col("chunk_from") >= step - 1, F.col("chunk_from") + (step - 1)).otherwise(hi),
        )
        .drop("_from")
    )


def plan_window(start: int, safe: int, window: int) -> tuple[int, int] | None:
    """Most recent ``window`` final blocks, never before ``start``."""
    if safe < start:
        return None
    first = start
    if window > 0 and safe > window:
        first = max(start, safe - window + 1)
    return first, safe


def plan_next(start: int, safe: int, cursor: int | None, batch: int = DEFAULT_RECON_BATCH):
    """Next batch after an audit cursor, or None when nothing final is left."""
    first = cursor + 1 if cursor is not None and cursor >= start else start
    if first > safe:
        return None
    return first, min(first + (batch or DEFAULT_RECON_BATCH) - 1, safe)


def plan_range(mode: str, *, start: int, safe: int, cursor=None, batch=0, window=0, bounds=None):
    """Block range of an event audit for mode ``range``, ``recent`` or ``next``."""
    if mode == "range":
        first, last = bounds
        if first > last:
            raise ValueError(f"invalid block range {first}..{last}")
        return None if first > safe else (first, min(last, safe))
    if mode == "recent":
        return plan_window(start, safe, window)
    if mode == "next":
        return plan_next(start, safe, cursor, batch)
    raise ValueError(f"unknown mode {mode!r}")


def balance_target(mode: str, *, start: int, safe: int, cursor=None, batch=0, window=0, target=0):
    """Requested target block of a balance audit (0 means the newest safe block)."""
    if mode == "target":
        return target
    if mode == "recent":
        return safe - window if safe > window else start
    if mode == "next":
        base = cursor if cursor else start
        return base + (batch or DEFAULT_BALANCE_BATCH)
    raise ValueError(f"unknown mode {mode!r}")


def effective_target(requested, safe, token_cursor, start):
    """Block a balance audit may really look at, or None to skip the run."""
    if _is_col(requested, safe, token_cursor, start):
        wanted = F.when(_lit(requested) > 0, F.least(_lit(requested), _lit(safe))).otherwise(_lit(safe))
        block = F.least(wanted, F.coalesce(_lit(token_cursor), _lit(start)))
        return F.when(block >= _lit(start), block)
    block = min(requested, safe) if requested and requested > 0 else safe
    block = min(block, start if token_cursor is None else token_cursor)
    return None if block < start else block


def stream_id(kind: str, address: str | None = None) -> str:
    """Cursor name of a stream, scoped by contract address where there is one."""
    # Stream names.
    base = {
        "payroll": "monthly_payroll",
        "token": "erc20_transfers",
        "recon_payroll": "reconciliation_payroll_funding",
        "recon_claims": "reconciliation_salary_claim",
        "recon_token": "reconciliation_erc20_transfers",
        "recon_balance": "reconciliation_token_balance",
        "escrow": "escrow_events",
    }[kind]
    scoped = kind not in ("recon_payroll", "recon_claims", "escrow")
    return f"{base}_{address.lower()}" if address and scoped else base
