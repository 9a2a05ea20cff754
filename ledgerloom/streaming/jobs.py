"""Ingest and projection streams.

Each stream is one StreamingQuery with its own checkpoint, so a failing stream
does not stop the others. Every micro-batch is written through
:func:`~ledgerloom.sources.keyed.commit_batch`: running a batch again after a
failure gives the same rows, and readers never see half of one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.blocks import safe_head
from ..operators import decode, fold
from ..schemas import RULES, WriteRule
from ..sources import keyed

HELD = "held"


@dataclass(frozen=True)
class StreamSpec:
    """What to read and which tables a micro-batch becomes.

    ``order`` has, by table, the columns that order repeated keys inside a batch; where it
    says nothing, a notice of removal is the later one. ``shared`` are steps that several
    tables of a batch go through; their results are kept while the batch is written. ``reread``
    says that the source is files as they are: every step reads the columns it needs of a batch again.
    Other batches are kept too. What is kept is on disk, so a batch may be larger than the memory.
    """

    stream_id: str
    source: DataFrame
    to_tables: Callable[[DataFrame], dict[str, DataFrame]]
    chain_id: int = 1
    order: Mapping[str, tuple] = field(default_factory=dict)
    shared: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    reread: bool = False

    def keep(self, rows: DataFrame) -> list[DataFrame]:
        """The shared steps of a batch, kept until they are unpersisted."""
        return [step(rows).persist(StorageLevel.DISK_ONLY) for step in self.shared]

    def tables(self, frames: dict[str, DataFrame]) -> dict[str, keyed.Table]:
        return {name: stored_table(name, f.schema, self.order.get(name)) for name, f in frames.items()}


def payroll_rule(schema) -> WriteRule:
    """The wide ledger: a log keeps what it first said; the last word on ``removed`` holds."""
    keys, last = ("chain_id", "contract_address", "tx_hash", "log_index"), ("removed", "block_timestamp")
    return WriteRule(keys, tuple(f.name for f in schema.fields if f.name not in (*keys, *last)), last)


def stored_table(name: str, schema, order: tuple | None = None) -> keyed.Table:
    """A streamed table as it is stored."""
    rule = payroll_rule(schema) if name == "payroll_ledger" else RULES[name]
    missing = [c for c in (*rule.first_wins, *rule.last_wins) if c not in schema.fieldNames()]
    if missing:
        drop = lambda names: tuple(c for c in names if c not in missing)
        rule = WriteRule(rule.keys, drop(rule.first_wins), drop(rule.last_wins))
    return keyed.Table(schema, rule, tuple(order) if order else ("removed",))


def current(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """Current rows of a streamed table."""
    return keyed.read_current(spark, root, name, stored_table(name, schema))


def _cursor(batch: DataFrame, chain_id: int) -> DataFrame:
    """Highest block of the batch, known only once its rows are durable."""
    hash_of = F.max_by("block_hash", "block_number") if "block_hash" in batch.columns else F.lit(None)
    return batch.agg(
        F.lit(chain_id).cast("long").alias("chain_id"),
        F.coalesce(F.max("block_number"), F.lit(0).cast("long")).alias("last_indexed_block"),
        hash_of.cast("string").alias("last_block_hash"),
    )


def _gated(batch: DataFrame, spec: StreamSpec, root: str, batch_id: int, depth: int, variant: str):
    """(all rows, final rows, rows that have to wait, safe head) of what was held before and a batch; every step reads them again."""
    held = keyed.Table(batch.schema, None)
    before = keyed.read_before(batch.sparkSession, root, f"{HELD}_{spec.stream_id}", held, spec.stream_id, batch_id)
    pool = before.unionByName(batch)
    head = pool.agg(F.max("block_number")).first()[0]
    safe = None if head is None else safe_head(head, depth, variant)
    final = F.col("block_number") <= F.lit(safe).cast("long")
    return pool, pool.filter(final), pool.filter(~F.coalesce(final, F.lit(False))), safe


def start(
    spec: StreamSpec, root: str, checkpoint: str, interval: str | None = None, depth: int | None = None, variant: str = "zero"
) -> StreamingQuery:
    """Run a stream: continuously every ``interval``, or once over all there is.

    With ``depth`` only final blocks are written. Rows above the safe head (``depth``
    blocks below the highest one seen) are held, as a table that is committed with the
    batch, and are let out by the batch that moves the head past them. A late row of a
    final block passes at once. Only rows of the last ``depth`` blocks are ever held, and the
    cursor is the safe head.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # several tables and the cursor come from what they share of the batch, or from one read of a source that is no file
        kept = []
        if not spec.shared and not spec.reread:
            batch.persist(StorageLevel.DISK_ONLY)
        try:
            clock = batch.select("_received").first()  # one for the batch
            received = clock[0] if clock else None
            rows = batch.drop("_received")
            waiting = {}
            if depth is None:
                cursor = _cursor(rows, spec.chain_id)
            else:
                _, rows, waits, safe = _gated(rows, spec, root, batch_id, depth, variant)
                waiting = {f"{HELD}_{spec.stream_id}": waits}
                cursor = _at_block(_cursor(rows, spec.chain_id), safe or 0)
            kept = spec.keep(rows)
            frames = spec.to_tables(rows)
            tables = spec.tables(frames) | {n: keyed.Table(f.schema, None) for n, f in waiting.items()}
            keyed.commit_batch(root, spec.stream_id, batch_id, frames | waiting, tables, cursor, received=received)
        finally:
            for held in [batch, *kept]:
                held.unpersist()

    # the clock of a micro-batch is kept with its offsets, so it is the same when the batch runs again
    received = spec.source.withColumn("_received", F.unix_micros(F.current_timestamp()))
    writer = (
        received.writeStream.foreachBatch(write)
        .queryName(spec.stream_id)
        .option("checkpointLocation", f"{checkpoint}/{spec.stream_id}")
    )
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def _at_block(cursor: DataFrame, block: int) -> DataFrame:
    """``cursor`` moved to ``block``, with the hash only if that block had a log."""
    own = F.when(F.col("last_indexed_block") == block, F.col("last_block_hash"))
    return cursor.withColumn("last_block_hash", own).withColumn("last_indexed_block", F.lit(block).cast("long"))


def start_live(
    specs: Iterable[StreamSpec], root: str, checkpoint: str, interval: str, depth: int, variant: str = "zero"
) -> list[StreamingQuery]:
    """One independent query per stream, each of which writes final blocks only."""
    return [start(spec, root, checkpoint, interval, depth, variant) for spec in specs]


def run_available(specs: Iterable[StreamSpec], root: str, checkpoint: str) -> dict[str, str | None]:
    """Drain every stream; a failing one is reported and does not stop the others."""
    running = [(spec.stream_id, start(spec, root, checkpoint)) for spec in specs]
    outcome: dict[str, str | None] = {}
    for stream_id, query in running:
        try:
            query.awaitTermination()
            outcome[stream_id] = None
        except Exception as failure:  # noqa: BLE001 - reported per stream
            outcome[stream_id] = str(failure).splitlines()[0]
    return outcome


def dedup_stream(
    deliveries: DataFrame, ttl: str = "30 days", strict_compat: bool = False, received: str | None = None
) -> DataFrame:
    """Drop repeated webhook logs that arrive within ``ttl`` of the first one.

    Time is that of receipt, the clock of the micro-batch, which is kept with the
    batch's offsets and so is the same when the batch runs again. A first delivery
    of an old block is never late. The key is the log identity with its ``removed`` flag, so that a reorg
    notice passes. ``strict_compat`` uses (tx_hash, log_index) alone. Deliveries that carry
    their time of receipt name the column (``received``).
    """
    keys = ["tx_hash", "log_index"] if strict_compat else [
        "chain_id", "contract_address", "tx_hash", "log_index", "removed"
    ]
    at = F.col(received) if received else F.current_timestamp()
    timed = deliveries.withColumn("_received_at", at)
    return timed.withWatermark("_received_at", ttl).dropDuplicatesWithinWatermark(keys).drop("_received_at")


def transfer_tables(batch: DataFrame) -> dict[str, DataFrame]:
    """Raw token logs to transfers and ledger rows, one version per key and batch."""
    transfers = decode.decode_transfers(batch)
    approvals = decode.decode_approvals(batch)
    ledger = decode.ledger_rows(
        transfers.withColumn("event_name", F.lit("Transfer")), decode.transfer_json()
    )
    allowed = decode.ledger_rows(approvals.withColumn("event_name", F.lit("Approval")), decode.approval_json())
    ledger = ledger.unionByName(allowed, allowMissingColumns=True)
    return {"token_transfers": transfers, "chain_events": ledger}


def escrow_tables(batch: DataFrame) -> dict[str, DataFrame]:
    rows = batch.withColumn("raw_data", F.to_json("raw")).drop("raw") if "raw" in batch.columns else batch
    return {"escrow_events": rows}


def payroll_tables(batch: DataFrame) -> dict[str, DataFrame]:
    """Raw payroll logs to the wide payroll ledger."""
    return {"payroll_ledger": decode.decode_payroll(batch)}


def unified_escrow(pulled: DataFrame, pushed: DataFrame) -> DataFrame:
    """Both delivery paths as one stream of escrow rows; keys make the order irrelevant."""
    columns = [
        "chain_id", "contract_address", "event_type", "escrow_id", "amount", "raw", "tx_hash",
        "block_number", "log_index", "removed", "block_timestamp",
    ]
    return pulled.select(*columns).unionByName(pushed.select(*columns))


def live_ledger(spark: SparkSession, root: str, schema) -> DataFrame:
    """Committed payroll ledger with the last word on ``removed``, reorged logs left out."""
    return current(spark, root, "payroll_ledger", schema).filter(~F.col("removed"))


def current_employees(spark: SparkSession, root: str, schema) -> DataFrame:
    """Employees from the whole streamed ledger."""
    return fold.fold_employees(live_ledger(spark, root, schema))


def apply_reorg(existing: DataFrame | None, incoming: DataFrame, table: str, order) -> DataFrame:
    """Re-delivered logs flip ``removed`` on the stored row; nothing is deleted."""
    from ..operators.upsert import upsert

    return upsert(existing, incoming, RULES[table], order)


def reconcile_loop(
    run_once: Callable[[], object], keep_going: Callable[[], bool], wait: Callable[[], None],
    on_error: Callable[[Exception], None],
) -> int:
    """First pass at once, then one pass per wait; a failed pass is reported, not fatal."""
    passes = 0
    while True:
        try:
            run_once()
        except Exception as failure:  # noqa: BLE001 - reported per pass
            on_error(failure)
        passes += 1
        if not keep_going():
            return passes
        wait()


def notification_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append escrow notifications to files, one folder per channel."""
    from ..operators.notify import notifications

    return (
        notifications(events)
        .writeStream.format("parquet")
        .partitionBy("channel")
        .option("path", path)
        .option("checkpointLocation", f"{checkpoint}/notifications")
        .trigger(availableNow=True)
        .start()
    )


def finalized(rows: DataFrame, depth: int, variant: str = "zero") -> DataFrame:
    """Rows at or below the safe head of the table itself.

    Ingest lands everything; consumers that must not see reorgs read through
    this filter. What is above the head now is simply seen by a later read, so
    no state is carried between micro-batches.
    """
    head = rows.agg(F.max("block_number").alias("b")).select(safe_head(F.col("b"), depth, variant).alias("s"))
    return rows.filter(F.col("block_number") <= head.scalar())


def backfill(
    spec: StreamSpec, logs: DataFrame, root: str, *, target: int, start_block: int,
    commit_blocks: int | None = None, clamp: bool = True,
) -> tuple[int, int] | None:
    """One historical run from the stream's cursor to ``target``.

    The whole range is one distributed job with one commit. ``commit_blocks``
    cuts it into several commits where a failure must not lose everything;
    commits made before a failure stay, and the next run resumes after them.
    Returns the covered range, or None when there is nothing to do.
    """
    from ..functions.blocks import resume_block

    spark, writer = logs.sparkSession, f"{spec.stream_id}-backfill"
    row = (
        keyed.cursors(spark, root)
        .filter((F.col("stream_id") == spec.stream_id) & (F.col("chain_id") == spec.chain_id))
        .first()
    )
    first = resume_block(None if row is None else row["last_indexed_block"], start_block, clamp)
    if target < start_block or first > target:
        return None
    width, low = commit_blocks or target - first + 1, first
    while low <= target:
        high = min(low + width - 1, target)
        part = logs.filter(F.col("block_number").between(low, high))
        kept = spec.keep(part)
        try:
            frames = spec.to_tables(part)
            keyed.commit_batch(
                root, spec.stream_id, keyed.next_batch(spark, root, writer), frames, spec.tables(frames),
                _at_block(_cursor(part, spec.chain_id), high), writer, keyed.now(),
            )
        finally:
            for held in kept:
                held.unpersist()
        low = high + 1
    return first, target


EMPLOYEES = WriteRule(
    ("chain_id", "wallet"), (),
    ("employer", "salary_per_second", "last_withdraw", "active", "total_leaves", "deactivation_time", "allocation",
     "added_at", "removed_at", "latest_tx_hash", "present"),
)


def start_employees(spec: StreamSpec, root: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep the table of current employees from a stream of raw payroll logs by keyed state.

    A micro-batch updates the state of the wallets it names and writes those rows only;
    neither the ledger nor older rows of other wallets are read.
    """
    from . import stateful

    stream_id = f"{spec.stream_id}-employees"

    def write(batch: DataFrame, batch_id: int) -> None:
        # a row of each wallet the batch names, kept: every further reading would take the batch through the state again
        batch.persist()
        try:
            tables = {"employees": keyed.Table(batch.schema, EMPLOYEES)}
            keyed.commit_batch(root, stream_id, batch_id, {"employees": batch}, tables)
        finally:
            batch.unpersist()

    states = stateful.employee_states(decode.decode_payroll(spec.source))
    with stateful.state_store(states.sparkSession):
        writer = (
            states.writeStream.outputMode("update").foreachBatch(write).queryName(stream_id)
            .option("checkpointLocation", f"{checkpoint}/{stream_id}")
        )
        return writer.trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()


def projected_employees(spark: SparkSession, root: str) -> DataFrame:
    """Employees that :func:`start_employees` has kept; a wallet without live logs is none."""
    from . import stateful

    table = keyed.Table(stateful.ROW, EMPLOYEES)
    return keyed.read_current(spark, root, "employees", table).filter("present").drop("present")
