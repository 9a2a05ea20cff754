"""Current employees as keyed state: order statistics of a wallet's logs, kept log by log.

What a wallet's row says hangs on a few logs only: the first one, the first and the last
addition, the last removal, the last claim, the last switch. The state holds these with
their places, and beside them every log of the wallet in a map of its own, which stays on
disk. A new log is compared with the places. A log that is taken back changes nothing unless
it is one of those few; then they are found again from the wallet's own map.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import evm, u256
from ..operators.fold import ADDED, CLAIMED, FUNDED, REMOVED
from ..schemas import EMPLOYEES

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KINDS = {"EmployeeAdded": ADDED, "EmployeeRemoved": REMOVED, "PayrollFunded": FUNDED, "SalaryClaimed": CLAIMED}

#: Statistic: (whether the last one counts, the kinds it is about)
_STATS = {
    "first": (False, (ADDED, REMOVED, FUNDED, CLAIMED)),
    "first_added": (False, (ADDED,)),
    "terms": (True, (ADDED,)),
    "switch": (True, (ADDED, REMOVED)),
    "removed": (True, (REMOVED,)),
    "claimed": (True, (CLAIMED,)),
    "last_tx": (True, (ADDED, REMOVED, CLAIMED)),
}
_STATE = (
    "chain_id long, wallet string, employer string, salary string, allocation string, active boolean, claimed_at long, "
    "added_at long, removed_at long, latest_tx_hash string, present boolean"
)
NAMES = [c.split()[0] for c in _STATE.split(", ")]
ROW = T.StructType(list(EMPLOYEES.fields)).add("present", T.BooleanType())


#: Logs of a wallet in one entry of its map, about
CHUNK = 128
#: Rows of a wallet that are taken from a batch at a time
ROWS = 10_000


@contextmanager
def state_store(spark: SparkSession):
    """Queries that start inside keep their state in the store that maps of state need.

    Every partition of state is opened and committed in every batch, so a new query gets two a
    core and no more; the partitions of a query that has run before are those of its checkpoint.
    """
    partitions = min(int(spark.conf.get(PARTITIONS)), 2 * spark.sparkContext.defaultParallelism)
    settings = {PROVIDER: ROCKS, PARTITIONS: str(partitions)}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class WalletState(StatefulProcessor):
    """(chain, wallet): its logs and the few that its row is made of."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.logs = handle.getMapState("logs", "chunk int", "value string")
        self.stats = handle.getValueState("stats", "value string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.stats.get()
        stats = json.loads(held[0]) if held else {"logs": 0, "chunks": 1}
        again, rows = False, iter(rows)
        while part := list(islice(rows, ROWS)):
            self._split(stats, len(part))
            # inside a batch a notice of removal is the later one
            part.sort(key=lambda r: (r.removed, r.block_number, r.log_index))
            for chunk, named in _by_chunk(((_name(r), r) for r in part), stats["chunks"]).items():
                again |= self._merge(stats, chunk, named)
        if again:
            stats = {"logs": stats["logs"], "chunks": stats["chunks"]}
            for _, value in self.logs.iterator():
                for log in json.loads(value[0]).values():
                    if log["live"]:
                        _add(stats, log)
        self.stats.update((json.dumps(stats),))
        yield Row(*NAMES)(*_row(key, stats))

    def _chunk(self, chunk: int) -> dict:
        held = self.logs.getValue((chunk,))
        return json.loads(held[0]) if held else {}

    def _split(self, stats: dict, more: int) -> None:
        """As many chunks as the wallet's logs and ``more`` of them need; a chunk's logs are dealt to its own heirs."""
        before, chunks = stats["chunks"], stats["chunks"]
        while chunks * CHUNK < stats["logs"] + more:
            chunks *= 2
        stats["chunks"] = chunks
        if chunks == before or not stats["logs"]:
            return
        for chunk in range(before):
            held = _by_chunk(self._chunk(chunk).items(), chunks)
            for heir in {chunk, *held}:
                self.logs.updateValue((heir,), (json.dumps(dict(held.get(heir, ()))),))

    def _merge(self, stats: dict, chunk: int, named: list) -> bool:
        """Take the rows of one chunk in; whether one of the few logs was taken back or moved in time."""
        logs, again = (self._chunk(chunk) if stats["logs"] else {}), False
        known = len(logs)
        for name, r in named:
            log = logs.get(name)
            if log:
                was, time = log["live"], log["ts"]
                log["live"], log["ts"] = not r.removed, r.ts
                again |= was and (not log["live"] or time != log["ts"]) and _counts(stats, log)
            else:
                was, log = False, {
                    "at": [r.block_number, r.log_index, r.tx], "kind": r.kind, "employer": r.employer,
                    "salary": r.salary, "allocation": r.allocation, "ts": r.ts, "tx": r.tx, "live": not r.removed,
                }
                logs[name] = log
            if log["live"] and not was:
                _add(stats, log)
        stats["logs"] += len(logs) - known
        self.logs.updateValue((chunk,), (json.dumps(logs),))
        return again

    def close(self) -> None:
        pass


def _name(row: Row) -> str:
    return f"{row.contract_address}|{row.tx}|{row.log_index}"


def _by_chunk(named: Iterable[tuple], chunks: int) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for name, value in named:
        out.setdefault(zlib.crc32(name.encode()) % chunks, []).append((name, value))
    return out


def _add(stats: dict, log: dict) -> None:
    for name, (last, kinds) in _STATS.items():
        if log["kind"] in kinds and (name not in stats or (log["at"] > stats[name]["at"]) == last):
            stats[name] = log


def _counts(stats: dict, log: dict) -> bool:
    return any(stats[name]["at"] == log["at"] for name in _STATS if name in stats)


def _row(key, stats: dict) -> tuple:
    if "first" not in stats:
        return (key[0], key[1], None, None, None, None, None, None, None, None, False)
    first, terms = stats["first"], stats.get("terms")
    of = lambda name, field: stats[name][field] if name in stats else None
    implicit = first["kind"] in (FUNDED, CLAIMED)
    return (
        key[0], key[1], (terms or first)["employer"], terms["salary"] if terms and terms["salary"] else "0",
        (terms["allocation"] or "0") if terms else None, stats["switch"]["kind"] == ADDED if "switch" in stats else True,
        of("claimed", "ts"), first["ts"] if implicit else of("first_added", "ts"), of("removed", "ts"),
        of("last_tx", "tx") or first["tx"], True,
    )


def employee_states(events: DataFrame) -> DataFrame:
    """The row of every wallet that a micro-batch of decoded payroll events names."""
    kind = F.lit(None).cast("string")
    for event, short in _KINDS.items():
        kind = F.when(F.col("event_name") == event, short).otherwise(kind)
    text = lambda c: F.when(F.col(c).isNotNull(), u256.to_string(F.col(c))).alias(c)
    effects = events.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        "chain_id", F.col("employee").alias("wallet"), "kind", F.coalesce("employer", F.lit(evm.ZERO_ADDRESS)).alias("employer"),
        text("salary"), text("allocation"), F.unix_micros("block_timestamp").alias("ts"), F.col("tx_hash").alias("tx"),
        "contract_address", "block_number", "log_index", "removed",
    )
    states = effects.groupBy("chain_id", "wallet").transformWithState(
        WalletState(), outputStructType=_STATE, outputMode="Update", timeMode="None"
    )
    seconds = lambda c: F.floor(F.col(c) / 1_000_000).cast("long")
    number = lambda c: F.when(F.col(c).isNotNull(), u256.from_string(F.col(c)))
    return states.select(
        "chain_id", "wallet", "employer", number("salary").alias("salary_per_second"), seconds("claimed_at").alias("last_withdraw"),
        "active", u256.zero().alias("total_leaves"), seconds("removed_at").alias("deactivation_time"),
        number("allocation").alias("allocation"), F.timestamp_micros("added_at").alias("added_at"),
        F.timestamp_micros("removed_at").alias("removed_at"), "latest_tx_hash", "present",
    )
