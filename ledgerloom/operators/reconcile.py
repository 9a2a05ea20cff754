"""Audit of stored rows against authoritative logs and contract reads.

One event audit is one plan: the stored rows are reduced to one row per log
identity (count and first row, with map-side partials, so a key with very many
copies costs one row per task), joined to the authoritative rows on the same
key, and every row yields the mismatches it has. The exception lifecycle is two
more equi-joins on the entity reference.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blocks as blk
from ..functions import evm, u256
from ..session import durable

OPEN, RESOLVED = "open", "resolved"


@dataclass(frozen=True)
class Family:
    """What one kind of audited event compares. Names are fixed values."""

    prefix: str
    entity: tuple[str, ...]
    amounts: tuple[str, ...]
    per_token: bool = False
    keys: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        token = ("token",) if self.per_token else ()
        object.__setattr__(self, "keys", ("chain_id", *token, "tx_hash", "log_index"))


FUNDING = Family(
    "PAYROLL_FUNDING", ("employer", "employee"), ("amount_paid", "fee", "amount_credited")
)
CLAIM = Family("SALARY_CLAIM", ("employee",), ("amount",))
TRANSFER = Family("TOKEN_TRANSFER", ("from_address", "to_address"), ("amount",), per_token=True)

# Exception classes with their severity and reference suffix.
SEVERITY = {
    "MISSING": "high",
    "AMOUNT_MISMATCH": "high",
    "ENTITY_MISMATCH": "critical",
    "DUPLICATE": "high",
    "TX_INCONSISTENCY": "medium",
    "PHANTOM": "medium",
    "TOKEN_BALANCE_MISMATCH": "high",
    "CONTRACT_BALANCE_MISMATCH": "high",
    "CONTRACT_STATE_MISMATCH": "medium",
}


def _text(column: Column, is_amount: bool) -> Column:
    return u256.to_string(F.coalesce(column, u256.zero())) if is_amount else column


def _in(df: DataFrame, first, last) -> DataFrame:
    def bound(v):
        return v if isinstance(v, Column) else F.lit(v)

    if first is not None:
        df = df.filter(F.col("block_number") >= bound(first))
    if last is not None:
        df = df.filter(F.col("block_number") <= bound(last))
    return df


def authoritative_rows(family: Family, decoded: DataFrame, first=None, last=None, token=None) -> DataFrame:
    """Live decoded logs of one family in the audited range."""
    if "removed" in decoded.columns:
        decoded = decoded.filter(~F.col("removed"))
    if token is not None:
        decoded = decoded.filter(evm.eq_ci("token", token))
    columns = [*family.keys, "block_number", *family.entity, *family.amounts]
    return _in(decoded.select(*columns), first, last)


def stored_rows(family: Family, stored: DataFrame, first=None, last=None, token=None) -> DataFrame:
    """Stored rows in the same range; removed transfers are not matched."""
    if "removed" in stored.columns:
        stored = stored.filter(~F.col("removed"))
    if token is not None:
        stored = stored.filter(evm.eq_ci("token", token))
    columns = [*family.keys, "id", "block_number", *family.entity, *family.amounts]
    return _in(stored.select(*columns), first, last)


def match_events(family: Family, authoritative: DataFrame, stored: DataFrame) -> DataFrame:
    """Full join of logs and stored rows on log identity.

    ``chain`` and ``db`` are structs (NULL where a side is missing); ``db`` is
    the first stored row by (block, id) and ``copies`` counts them. Log
    identities are unique on the authoritative side, so the join is one to one.
    """
    fields = ["block_number", *family.entity, *family.amounts]
    grouped = stored.groupBy(*family.keys).agg(
        F.min_by(F.struct(*fields), F.struct("block_number", "id")).alias("db"),
        F.count("*").alias("copies"),
    )
    chain = authoritative.select(*family.keys, F.struct(*fields).alias("chain"))
    return chain.join(grouped, list(family.keys), "full")


def _ref(family: Family, suffix: str) -> Column:
    return F.concat_ws(":", *[F.col(k).cast("string") for k in family.keys], F.lit(suffix))


def _mismatch(kind: str, severity: str, ref: Column, expected: Column, observed: Column, block: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(severity).alias("severity"),
        ref.alias("entity_ref"),
        expected.alias("expected"),
        observed.alias("observed"),
        block.cast("long").alias("block_number"),
    )


def find_mismatches(
    family: Family, matched: DataFrame, safe, cursor, phantoms: bool = False
) -> DataFrame:
    """All mismatches of matched rows; one row may have several.

    A missing row counts only up to the safe head and the ingest cursor
    (``None``: nothing ingested); beyond them it is lag. ``phantoms`` also
    reports stored rows without a log (off by default).
    """
    chain, db = F.col("chain"), F.col("db")
    has_chain, has_db = chain.isNotNull(), db.isNotNull()
    key = {k: F.col(k) for k in family.keys}

    def side(source: Column, *names: str) -> dict[str, Column]:
        return {n: _text(source[n], n in family.amounts) for n in names}

    def row(kind: str, when: Column, expected: dict, observed: dict, block: Column) -> Column:
        suffix = {"MISSING": "missing", "ENTITY_MISMATCH": "entity_mismatch",
                  "AMOUNT_MISMATCH": "amount_mismatch", "TX_INCONSISTENCY": "tx_inconsistency",
                  "DUPLICATE": "duplicate", "PHANTOM": "phantom"}[kind]
        return F.when(
            when,
            _mismatch(
                f"{family.prefix}_{kind}", SEVERITY[kind], _ref(family, suffix),
                evm.json_object(**key, **expected), evm.json_object(**observed), block,
            ),
        )

    def column(v) -> Column:
        return v if isinstance(v, Column) else F.lit(v).cast("long")

    block = chain["block_number"]
    due = F.coalesce(
        (block <= column(safe)) & (block <= column(cursor)), F.lit(False)
    )
    both = has_chain & has_db
    differs = [~chain[n].eqNullSafe(db[n]) for n in (*family.entity, *family.amounts)]
    entity_differs, amount_differs = F.lit(False), F.lit(False)
    for d in differs[: len(family.entity)]:
        entity_differs |= d
    for d in differs[len(family.entity):]:
        amount_differs |= d
    # the token family repeats the parties beside a wrong amount
    amount_context = family.entity if family.per_token else (
        ("employee",) if family is CLAIM else ()
    )
    found = [
        row(
            "MISSING", has_chain & ~has_db & due,
            {"block_number": block, **side(chain, *family.entity, *family.amounts)},
            {"status": F.lit("not_found")}, block,
        ),
        row(
            "ENTITY_MISMATCH", both & entity_differs,
            {"block_number": block, **side(chain, *family.entity)}, side(db, *family.entity), block,
        ),
        row(
            "AMOUNT_MISMATCH", both & amount_differs,
            {"block_number": block, **side(chain, *amount_context, *family.amounts)},
            side(db, *family.amounts), block,
        ),
        row(
            "TX_INCONSISTENCY", both & (block != db["block_number"]),
            {"block_number": block},
            {"block_number": db["block_number"],
             **({"tx_hash": F.col("tx_hash")} if family.per_token else {})},
            block,
        ),
        row(
            "DUPLICATE", F.coalesce(F.col("copies") > 1, F.lit(False)),
            {"block_number": db["block_number"], "count": F.lit(1)},
            {"count": F.col("copies")}, db["block_number"],
        ),
    ]
    if phantoms:
        found.append(
            row(
                "PHANTOM", has_db & ~has_chain,
                {"block_number": db["block_number"]},
                side(db, *family.entity, *family.amounts), db["block_number"],
            )
        )
    return (
        matched.withColumn("m", F.explode(F.array_compact(F.array(*found))))
        .select(*family.keys, F.col("copies"), "m.*")
    )


def duplicate_ids(family: Family, stored: DataFrame) -> DataFrame:
    """(entity_ref, record_id) of every copy of a duplicated row, however many."""
    doubled = stored.groupBy(*family.keys).agg(F.count("*").alias("n")).filter("n > 1")
    return stored.join(doubled.select(*family.keys), list(family.keys), "left_semi").select(
        _ref(family, "duplicate").alias("entity_ref"), F.col("id").alias("record_id")
    )


_MISMATCH_COLUMNS = ("type", "severity", "entity_ref", "expected", "observed", "block_number")


def audit_events(
    family: Family, decoded: DataFrame, stored: DataFrame, *, first, last, safe, cursor,
    token: str | None = None, phantoms: bool = False,
) -> DataFrame:
    """Mismatches of one family in [first, last]; see :func:`find_mismatches`."""
    chain_rows = authoritative_rows(family, decoded, first, last, token)
    db_rows = stored_rows(family, stored, first, last, token)
    found = find_mismatches(family, match_events(family, chain_rows, db_rows), safe, cursor, phantoms)
    return found.select(*_MISMATCH_COLUMNS)


# --- balances and contract state -------------------------------------------------

def state_at(snapshots: DataFrame, prop: str, at_block=None) -> DataFrame:
    """Newest contract read of a property per wallet at or before a block."""
    rows = snapshots.filter(F.col("property") == prop)
    rows = _in(rows, None, at_block)
    return rows.groupBy("chain_id", "contract", "wallet").agg(
        F.max_by("value", "block_number").alias("value")
    )


def match_balances(addresses: DataFrame, stored: DataFrame, reads: DataFrame) -> DataFrame:
    """(chain, token, address) with stored balance (0 if none) and the contract's.

    An address without a contract read fails the job: that is an operational
    error, not a finding.
    """
    keys = ["chain_id", "token", "address"]
    unread = F.raise_error(F.concat(F.lit("no contract read for "), F.col("address")))
    return (
        addresses.select(*keys)
        .join(stored.select(*keys, "balance"), keys, "left")
        .join(reads.select(*keys, F.col("balance").alias("on_chain")), keys, "left")
        .select(
            *keys,
            F.coalesce("balance", u256.zero()).alias("db"),
            F.coalesce("on_chain", unread.cast(u256.U256)).alias("on_chain"),
        )
    )


def _balance_rows(matched: DataFrame, kind: str, ref: Column, who: str, names: tuple[str, str], target) -> DataFrame:
    block = target if isinstance(target, Column) else F.lit(target)
    context = {who: F.col("address"), "token": F.col("token"), "target_block": block}
    matched = matched.withColumn("difference", u256.sub(F.col("on_chain"), F.col("db")))
    return matched.select(
        F.lit(kind).alias("type"),
        F.lit(SEVERITY[kind]).alias("severity"),
        ref.alias("entity_ref"),
        evm.json_object(**{names[0]: u256.to_signed_string(F.col("on_chain"))}, **context).alias("expected"),
        evm.json_object(
            **{names[1]: u256.to_signed_string(F.col("db"))},
            difference=u256.to_signed_string(F.col("difference")),
            **context,
        ).alias("observed"),
        block.cast("long").alias("block_number"),
        (F.col("on_chain") == F.col("db")).alias("matches"),
    )


def audit_balances(matched: DataFrame, target) -> DataFrame:
    """Every checked address with ``matches``; mismatches carry the difference."""
    ref = F.concat_ws(":", F.col("chain_id").cast("string"), "token", "address", F.lit("token_balance_mismatch"))
    return _balance_rows(
        matched.filter(evm.nonzero("address")), "TOKEN_BALANCE_MISMATCH", ref, "wallet",
        ("on_chain_balance", "db_balance"), target,
    )


def audit_contract_balance(matched: DataFrame, target) -> DataFrame:
    """The payroll contract's own token balance."""
    ref = F.concat_ws(":", F.col("chain_id").cast("string"), "address", "token", F.lit("contract_balance_mismatch"))
    return _balance_rows(
        matched.filter(evm.nonzero("address")), "CONTRACT_BALANCE_MISMATCH", ref, "contract",
        ("on_chain_contract_balance", "db_contract_balance"), target,
    )


def audit_states(projection: DataFrame, reads: DataFrame, prop: str, contract: str, target) -> DataFrame:
    """Active flag of every projected wallet against the contract at the target block."""
    keys = ["chain_id", "wallet"]
    block = target if isinstance(target, Column) else F.lit(target)
    unread = F.raise_error(F.concat(F.lit("no contract read for "), F.col("wallet")))
    both = projection.select(*keys, F.col("active").alias("db")).join(
        reads.select(*keys, F.col("active").alias("on_chain")), keys, "left"
    ).withColumn("on_chain", F.coalesce("on_chain", unread.cast("boolean")))
    context = {"property": F.lit(prop), "target_block": block, "wallet": F.col("wallet")}
    return both.select(
        F.lit("CONTRACT_STATE_MISMATCH").alias("type"),
        F.lit(SEVERITY["CONTRACT_STATE_MISMATCH"]).alias("severity"),
        F.concat_ws(
            ":", F.col("chain_id").cast("string"), F.lit(contract.lower()), "wallet", F.lit(prop),
            F.lit("state_mismatch"),
        ).alias("entity_ref"),
        evm.json_object(on_chain_value=F.col("on_chain"), **context).alias("expected"),
        evm.json_object(db_value=F.col("db"), **context).alias("observed"),
        block.cast("long").alias("block_number"),
        (F.col("on_chain") == F.col("db")).alias("matches"),
    )


# --- lifecycle -------------------------------------------------------------------

EXCEPTION_COLUMNS = ("type", "severity", "entity_ref", "expected", "observed", "status", "detected_at", "resolved_at")


@dataclass(frozen=True)
class Lifecycle:
    """``exceptions`` is the table after the run; ``marks`` has one row per outcome."""

    exceptions: DataFrame
    marks: DataFrame


def exception_id(entity_ref: Column, detected_at: Column) -> Column:
    """Id of an exception: what it is about and when it was found decide, so a repeated run gives the same."""
    return F.shiftrightunsigned(F.xxhash64(entity_ref, detected_at.cast("timestamp")), 1)


def _open_refs(exceptions: DataFrame) -> DataFrame:
    return exceptions.filter(F.col("status") == OPEN).select("entity_ref").distinct()


def apply_lifecycle(
    exceptions: DataFrame, active: DataFrame, resolvable: Column | DataFrame, now: Column | None = None
) -> Lifecycle:
    """Merge the mismatches of a run into the exceptions.

    A mismatch whose reference is open is skipped, any other opens a new
    exception. Open exceptions that may be resolved and are not active any more
    become resolved. ``resolvable`` is a condition on exceptions (event
    families, see :func:`in_scope`) or a table of references that matched now
    (balance and state families).
    """
    now = F.current_timestamp() if now is None else now
    # the same reference twice in a run opens one exception
    wanted = active.groupBy("entity_ref").agg(
        F.min_by(F.struct("type", "severity", "expected", "observed"), "type").alias("m")
    )
    opened = wanted.join(_open_refs(exceptions), "entity_ref", "left_anti").select(
        exception_id(F.col("entity_ref"), now).alias("id"),
        F.col("m.type").alias("type"),
        F.col("m.severity").alias("severity"),
        "entity_ref",
        F.col("m.expected").alias("expected"),
        F.col("m.observed").alias("observed"),
        F.lit(OPEN).alias("status"),
        now.alias("detected_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )
    flags = wanted.select("entity_ref", F.lit(True).alias("is_active"))
    judged = exceptions.join(flags, "entity_ref", "left")
    if isinstance(resolvable, DataFrame):
        fixed = resolvable.select("entity_ref").distinct().withColumn("is_fixed", F.lit(True))
        judged = judged.join(fixed, "entity_ref", "left")
        may = F.coalesce("is_fixed", F.lit(False))
    else:
        may = F.coalesce(resolvable, F.lit(False))
    closes = (F.col("status") == OPEN) & F.col("is_active").isNull() & may
    judged = judged.withColumn("closes", closes)
    columns = [c for c in ("id", *EXCEPTION_COLUMNS) if c in exceptions.columns]
    kept = judged.select(
        *[c for c in columns if c not in ("status", "resolved_at")],
        F.when(F.col("closes"), RESOLVED).otherwise(F.col("status")).alias("status"),
        F.when(F.col("closes"), now).otherwise(F.col("resolved_at")).alias("resolved_at"),
    )
    marks = (
        opened.select("entity_ref", F.lit("created").alias("outcome"))
        .unionByName(
            active.join(_open_refs(exceptions), "entity_ref", "left_semi").select(
                "entity_ref", F.lit("skipped").alias("outcome")
            )
        )
        .unionByName(judged.filter("closes").select("entity_ref", F.lit("resolved").alias("outcome")))
    )
    return Lifecycle(kept.unionByName(opened.select(*columns)), marks)


def in_scope(family: Family, chain_id: int, first, last, token: str | None = None) -> Column:
    """Exceptions an event audit of [first, last] may resolve."""

    def column(v) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    prefix = f"{chain_id}:" + (f"{token.lower()}:" if token else "")
    block = F.get_json_object("expected", "$.block_number").try_cast("long")
    return (
        F.col("entity_ref").startswith(prefix)
        & F.col("type").startswith(f"{family.prefix}_")
        & (block >= column(first))
        & (block <= column(last))
    )


def resolve_exceptions(exceptions: DataFrame, ids: DataFrame, now: Column | None = None) -> DataFrame:
    """Close the given ids where they are still open."""
    now = F.current_timestamp() if now is None else now
    hit = exceptions.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    closes = F.coalesce("_hit", F.lit(False)) & (F.col("status") == OPEN)
    return (
        hit.withColumn("_closes", closes)
        .withColumn("resolved_at", F.when(F.col("_closes"), now).otherwise(F.col("resolved_at")))
        .withColumn("status", F.when(F.col("_closes"), RESOLVED).otherwise(F.col("status")))
        .select(*exceptions.columns)
    )


def summary(authoritative: DataFrame, stored: DataFrame, mismatches: DataFrame, marks: DataFrame) -> DataFrame:
    """One row of run counts; every part is aggregated to one row before they meet."""

    def one(df: DataFrame, **counts: Column) -> DataFrame:
        return df.agg(*[c.alias(k) for k, c in counts.items()])

    parts = [
        one(authoritative, on_chain_events=F.count("*")),
        one(stored, db_records=F.count("*")),
        one(mismatches, mismatches_detected=F.count("*")),
        one(
            marks,
            exceptions_created=F.count_if(F.col("outcome") == "created"),
            exceptions_resolved=F.count_if(F.col("outcome") == "resolved"),
            exceptions_skipped=F.count_if(F.col("outcome") == "skipped"),
        ),
    ]
    spark = authoritative.sparkSession
    columns = [p.select(c).scalar().alias(c) for p in parts for c in p.columns]
    return spark.range(1).select(*columns)


@dataclass(frozen=True)
class EventRun:
    lifecycle: Lifecycle
    mismatches: DataFrame
    first: int
    last: int


def reconcile_events(
    family: Family, decoded: DataFrame, stored: DataFrame, exceptions: DataFrame, *, chain_id: int,
    latest: int, depth: int, start: int, mode: str = "next", ingest_cursor: int | None = None,
    recon_cursor: int | None = None, batch: int = 0, window: int = 0, bounds=None, token=None,
    now: Column | None = None,
) -> EventRun | None:
    """One audit pass by mode; None when nothing final is left to look at.

    The caller stores ``last`` as the audit cursor once the exceptions are
    written (mode ``next``).
    """
    safe = blk.safe_head(latest, depth, "latest")
    planned = blk.plan_range(
        mode, start=start, safe=safe, cursor=recon_cursor, batch=batch, window=window, bounds=bounds
    )
    if planned is None:
        return None
    first, last = planned
    # written: the outcomes and every count read the mismatches, the audit behind them is done once
    found = durable(audit_events(
        family, decoded, stored, first=first, last=last, safe=safe, cursor=ingest_cursor, token=token
    ))
    scope = in_scope(family, chain_id, first, last, token)
    return EventRun(apply_lifecycle(exceptions, found, scope, now), found, first, last)


@dataclass(frozen=True)
class BalanceRun:
    """``checked`` has every address looked at, ``target`` is the block it was looked at."""

    lifecycle: Lifecycle
    mismatches: DataFrame
    checked: DataFrame
    target: int


def reconcile_balances(
    checks: Callable[[int], list[DataFrame]], exceptions: DataFrame, *, latest: int, depth: int, start: int,
    mode: str = "next", token_cursor: int | None = None, recon_cursor: int | None = None, batch: int = 0,
    window: int = 0, target: int = 0, now: Column | None = None,
) -> BalanceRun | None:
    """One audit pass of balances and contract states by mode; None when there is no final block to look at.

    ``checks`` gives the checked rows at a block (:func:`audit_balances`,
    :func:`audit_contract_balance`, :func:`audit_states`). What matches may resolve
    its open exception. The caller stores ``target`` as the audit cursor once the
    exceptions are written (mode ``next``).
    """
    safe = blk.safe_head(latest, depth, "latest")
    wanted = blk.balance_target(mode, start=start, safe=safe, cursor=recon_cursor, batch=batch, window=window, target=target)
    block = blk.effective_target(wanted, safe, token_cursor, start)
    if block is None:
        return None
    # written: what matches, what does not and each outcome are read from it, the audit behind it is done once
    checked = durable(reduce(DataFrame.unionByName, [c.select("matches", *_MISMATCH_COLUMNS) for c in checks(block)]))
    found = checked.filter(~F.col("matches")).select(*_MISMATCH_COLUMNS)
    fixed = checked.filter("matches").select("entity_ref")
    return BalanceRun(apply_lifecycle(exceptions, found, fixed, now), found, checked, block)


def reconcile_all(runs: dict[str, Callable[[], EventRun | BalanceRun | None]], kind: str = "all") -> dict:
    """The passes of a combined run, in their fixed order, by family; a pass with nothing to do is left out."""
    done = {name: runs[name]() for name in combined_kinds(kind)}
    return {name: run for name, run in done.items() if run is not None}


def combined_summary(done: dict) -> DataFrame:
    """A row per family of a combined run: where its audit cursor goes, mismatches and outcomes."""

    def row(name: str, run) -> DataFrame:
        counts = run.lifecycle.marks.agg(
            *[F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "resolved", "skipped")]
        )
        cursor = run.target if isinstance(run, BalanceRun) else run.last
        found = run.mismatches.agg(F.count("*").alias("n")).scalar()
        return counts.select(
            F.lit(name).alias("family"), F.lit(cursor).cast("long").alias("cursor"), found.alias("mismatches"),
            "created", "resolved", "skipped",
        )

    return reduce(DataFrame.unionByName, [row(name, run) for name, run in done.items()])


def combined_kinds(kind: str) -> tuple[str, ...]:
    """Audits of one run; ``all`` runs every family."""
    every = ("payroll", "claims", "token", "balance")
    if kind == "all":
        return every
    if kind not in every:
        raise ValueError(f"kind must be one of {every} or 'all'")
    return (kind,)


# needed by callers that declare empty exception tables
EXCEPTION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in EXCEPTION_COLUMNS[:6]],
        T.StructField("detected_at", T.TimestampType()),
        T.StructField("resolved_at", T.TimestampType()),
    ]
)
