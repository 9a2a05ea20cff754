"""The given tables seen as chain data.

Deterministic projections: every column is an expression over one source row,
so filters and column pruning reach the parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry
from ..functions import evm, u256
from ..operators import upsert as up
from ..schemas import RULES
from ..session import apply_settings, spread

CHAIN = 1
PAYROLL_CONTRACT = "0x" + format(7777, "040x")
ESCROW_CONTRACT = "0x" + format(8888, "040x")

ARRIVAL = (
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus",
)


_DEALT: ContextVar[tuple[int, dict[str, str]] | None] = ContextVar("_DEALT", default=None)


@contextmanager
def dealt(parts: int, by: dict[str, str] | None = None) -> Iterator[None]:
    """Tables come in ``parts`` parts meanwhile, by range of their column in ``by`` if it names one.

    A row of a table takes a tenth of what it takes as chain data, so it is dealt out before it becomes that.
    """
    token = _DEALT.set((parts, by or {}))
    try:
        yield
    finally:
        _DEALT.reset(token)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_settings(spark)
    rows, deal = spark.read.parquet(f"{sf_dir}/{name}.parquet"), _DEALT.get()
    if deal is None:
        return spread(rows)
    parts, by = deal
    return rows.repartitionByRange(parts, by[name]) if name in by else rows.repartition(parts)


def _chain():
    return F.lit(CHAIN).cast("long")


def _days(column: str):
    return F.datediff(F.to_date(F.col(column)), F.lit("1992-01-01").cast("date")).cast("long")


def deliveries_from(lineitem: DataFrame) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return lineitem.select(
        _chain().alias("chain_id"),
        evm.address_of(F.col("l_suppkey") % 4 + 1).alias("token"),
        evm.address_of(F.col("l_suppkey") % 97).alias("from_address"),
        evm.address_of(F.col("l_partkey") % 97).alias("to_address"),
        cents.alias("cents"),
        u256.pack(F.lit(0), F.lit(0), cents).alias("amount"),
        evm.hash_of("l_orderkey").alias("tx_hash"),
        F.col("l_linenumber").cast("int").alias("log_index"),
        (_days("l_shipdate") + 11_000_000).alias("block_number"),
        F.col("l_shipdate").cast("timestamp").alias("block_timestamp"),
        (F.col("l_returnflag") == "R").alias("removed"),
        F.col("l_orderkey").alias("order_key"),
        F.struct(*ARRIVAL).alias("arrival"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token transfer deliveries, with repeated keys, in arrival order ``arrival``."""
    return deliveries_from(table(spark, sf_dir, "lineitem"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current transfer rows: the deliveries folded by key."""
    return up.latest(deliveries(spark, sf_dir), RULES["token_transfers"], ["arrival"])


def transfer_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delivery as a raw Transfer log."""
    d = deliveries(spark, sf_dir)
    return _as_log(
        d,
        address=F.col("token"),
        topics=[F.lit(registry.TOPIC["Transfer"]), _pad("from_address"), _pad("to_address")],
        words=[evm.word_of("cents")],
        extra=["arrival"],
    )


def approval_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as an Approval log of token ``o_orderkey % 4 + 1``."""
    o = table(spark, sf_dir, "orders").select(
        _chain().alias("chain_id"),
        evm.address_of(F.col("o_orderkey") % 4 + 1).alias("token"),
        evm.address_of(F.col("o_custkey") % 97).alias("owner"),
        evm.address_of(F.col("o_orderkey") % 89).alias("spender"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        evm.hash_of("o_orderkey").alias("tx_hash"),
        F.lit(0).alias("log_index"),
        (_days("o_orderdate") + 11_000_000).alias("block_number"),
        F.lit(False).alias("removed"),
    )
    return _as_log(
        o,
        address=F.col("token"),
        topics=[F.lit(registry.TOPIC["Approval"]), _pad("owner"), _pad("spender")],
        words=[evm.word_of("cents")],
    )


def _pad(column: str):
    return F.concat(F.lit("0x" + "0" * 24), F.substring(F.col(column), 3, 40))


def _as_log(df: DataFrame, address, topics, words, extra=()) -> DataFrame:
    return df.select(
        "chain_id",
        address.alias("address"),
        topics[0].alias("topic0"),
        F.array_compact(F.array(*topics)).alias("topics"),
        F.concat(F.lit("0x"), *words).alias("data"),
        "block_number",
        "tx_hash",
        "log_index",
        "removed",
        *extra,
    )


def payroll_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded payroll events, one per row of ``events``."""
    e = table(spark, sf_dir, "events")
    kind, eid = F.col("event_type"), F.col("event_id")
    name = (
        F.when((kind == "view") & (eid % 5 == 0), "EmployerRemoved")
        .when(kind == "view", "EmployerAdded")
        .when(kind == "signup", "EmployeeAdded")
        .when(kind == "error", "EmployeeRemoved")
        .when(kind == "purchase", "PayrollFunded")
        .otherwise("SalaryClaimed")
    )
    cents = F.round(F.col("value") * 100).cast("long")
    base = e.select(
        _chain().alias("chain_id"),
        F.lit(PAYROLL_CONTRACT).alias("contract_address"),
        name.alias("event_name"),
        evm.address_of(F.col("user_id") % 10 + 1).alias("employer_all"),
        evm.address_of(F.col("user_id") + 1000).alias("employee_all"),
        cents.alias("cents"),
        evm.hash_of("event_id").alias("tx_hash"),
        eid.alias("block_number"),
        F.col("ts").cast("timestamp").alias("block_timestamp"),
        F.lit(0).alias("log_index"),
        F.lit(False).alias("removed"),
    )

    def where(names, value):
        return F.when(F.col("event_name").isin(*names), value)

    added, funded = ["EmployeeAdded"], ["PayrollFunded"]
    fee = F.floor(F.col("cents") / 100).cast("long")
    return base.select(
        "chain_id", "contract_address", "event_name",
        where(
            ["EmployerAdded", "EmployerRemoved", "EmployeeAdded", "EmployeeRemoved", "PayrollFunded"],
            F.col("employer_all"),
        ).alias("employer"),
        where(
            ["EmployeeAdded", "EmployeeRemoved", "PayrollFunded", "SalaryClaimed"],
            F.col("employee_all"),
        ).alias("employee"),
        where(added, _small("cents")).alias("salary"),
        where(added, u256.pack(F.lit(0), F.lit(0), F.col("cents") * 2)).alias("allocation"),
        where(funded, _small("cents")).alias("amount_paid"),
        where(funded, u256.pack(F.lit(0), F.lit(0), fee)).alias("fee"),
        where(funded, u256.pack(F.lit(0), F.lit(0), F.col("cents") - fee)).alias("amount_credited"),
        where(["SalaryClaimed"], _small("cents")).alias("amount"),
        "tx_hash", "block_number", "block_timestamp", "log_index", "removed",
    )


def _small(column: str):
    return u256.pack(F.lit(0), F.lit(0), F.col(column))


def payroll_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payroll events encoded as raw logs."""
    p = payroll_events(spark, sf_dir)
    name = F.col("event_name")
    topic0 = F.lit(None).cast("string")
    for event in registry.EVENTS:
        if event.family == registry.PAYROLL:
            topic0 = F.when(name == event.name, event.topic0).otherwise(topic0)
    funded = name == "PayrollFunded"

    def word(column):
        # every amount of this view is below 2^63
        return F.lpad(F.lower(F.hex(F.col(column)["lo"].cast("long"))), 64, "0")

    data = (
        F.when(name == "EmployeeAdded", F.concat(word("salary"), word("allocation")))
        .when(funded, F.concat(word("amount_paid"), word("fee"), word("amount_credited")))
        .when(name == "SalaryClaimed", word("amount"))
        .otherwise(F.lit(""))
    )
    employer, employee = _pad("employer"), _pad("employee")
    first = F.when(funded | name.isin("EmployerAdded", "EmployerRemoved"), employer).otherwise(employee)
    second = F.when(funded, employee).when(name.isin("EmployeeAdded", "EmployeeRemoved"), employer)
    return _as_log(
        p, address=F.col("contract_address"), topics=[topic0, first, second], words=[data],
        extra=["block_timestamp"],
    )


def ownership_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change of ownership per supplier, as raw logs of the payroll contract."""
    s = table(spark, sf_dir, "supplier").select(
        _chain().alias("chain_id"), evm.address_of("s_suppkey").alias("old"), evm.address_of(F.col("s_nationkey") + 500).alias("new"),
        F.col("s_suppkey").cast("long").alias("block_number"), evm.hash_of("s_suppkey").alias("tx_hash"),
        F.lit(3).alias("log_index"), F.lit(False).alias("removed"),
    )
    topics = [F.lit(registry.TOPIC["OwnershipTransferred"]), _pad("old"), _pad("new")]
    return _as_log(s, address=F.lit(PAYROLL_CONTRACT), topics=topics, words=[F.lit("")])


def escrow_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two escrow events per order in plain form: creation and one follow-up."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    follow = F.element_at(
        F.array(
            *[
                F.lit(n)
                for n in (
                    "EscrowReleased", "EscrowRefunded", "DisputeResolved", "DeliveryAcknowledged",
                    "DisputeRaised",
                )
            ]
        ),
        (key % 5 + 1).cast("int"),
    )
    block = _days("o_orderdate") + 12_000_000
    second_value = (
        F.when(key % 5 < 2, cents)
        .when(key % 5 == 2, F.floor(cents / 2).cast("long"))
        .when(key % 5 == 3, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
        .otherwise(F.floor(cents / 100).cast("long"))
    )

    def event(index, name, value, at, removed):
        return F.struct(
            F.lit(index).alias("log_index"), name.alias("event_type"), value.alias("value"),
            at.alias("block_number"), removed.alias("removed"),
        )

    pair = F.explode(
        F.array(
            event(0, F.lit("EscrowCreated"), cents, block, F.lit(False)),
            event(1, follow, second_value, block + 1 + key % 7, F.col("o_orderstatus") == "P"),
        )
    )
    return o.withColumn("e", pair).select(
        _chain().alias("chain_id"),
        F.lit(ESCROW_CONTRACT).alias("contract_address"),
        F.col("e.event_type").alias("event_type"),
        key.alias("escrow_number"),
        evm.address_of("o_custkey").alias("buyer"),
        evm.address_of(key % 97).alias("seller"),
        F.col("e.value").alias("value"),
        evm.hash_of(key * 2 + F.col("e.log_index")).alias("tx_hash"),
        F.col("e.log_index").cast("int").alias("log_index"),
        F.col("e.block_number").alias("block_number"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("e.removed").alias("removed"),
    )


def escrow_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = escrow_plain(spark, sf_dir)
    name = F.col("event_type")
    topic0 = F.lit(None).cast("string")
    for event in registry.EVENTS:
        if event.family == registry.ESCROW:
            topic0 = F.when(name == event.name, event.topic0).otherwise(topic0)
    third = F.when(name.isin("EscrowCreated", "DisputeResolved"), _pad("buyer")).when(
        name == "DisputeRaised", _pad("seller")
    )
    fourth = F.when(name == "EscrowCreated", _pad("seller"))
    return _as_log(
        p,
        address=F.col("contract_address"),
        topics=[topic0, F.concat(F.lit("0x"), evm.word_of("escrow_number")), third, fourth],
        words=[evm.word_of("value")],
        extra=["created_at"],
    )


def webhook_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON delivery per escrow log, as text.

    Even escrows carry a hex block number on the log; odd ones leave it to the
    block, in decimal. Every third log gives its contract only as an account.
    """
    logs = escrow_logs(spark, sf_dir)
    escrow = F.conv(F.right(F.element_at("topics", 2), F.lit(15)), 16, 10).cast("long")
    even = escrow % 2 == 0
    log = F.struct(
        F.col("tx_hash").alias("transactionHash"),
        F.col("log_index").alias("logIndex"),
        F.lit(0).alias("transactionIndex"),
        F.when(even, F.concat(F.lit("0x"), F.lower(F.hex("block_number")))).otherwise("").alias("blockNumber"),
        F.when(escrow % 3 == 0, "").otherwise(F.col("address")).alias("address"),
        F.col("data"),
        F.col("topics"),
        F.struct(F.col("address").alias("address")).alias("account"),
        F.col("removed"),
    )
    block = F.struct(
        F.col("block_number").cast("string").alias("number"),
        F.lit("").alias("hash"),
        F.lit("").alias("timestamp"),
        F.array(log).alias("logs"),
    )
    body = F.struct(
        F.lit("wh").alias("webhookId"),
        F.col("tx_hash").alias("id"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"),
        F.lit("LOG").alias("type"),
        F.struct(F.struct(block.alias("block")).alias("data")).alias("event"),
    )
    return logs.select(F.to_json(body).alias("value"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction metadata, one per order."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        evm.hash_of(key).alias("tx_hash"),
        _chain().alias("chain_id"),
        (_days("o_orderdate") + 11_000_000).alias("block_number"),
        evm.address_of("o_custkey").alias("sender"),
        F.when(key % 13 != 0, evm.address_of(key % 4 + 1)).alias("recipient"),
        (key % 1000 + 21_000).alias("gas_used"),
        F.when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(1).alias("receipt_status"),
        F.col("o_orderdate").cast("timestamp").alias("first_seen_at"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.transaction_rows(receipts(spark, sf_dir))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header per day on which something was shipped."""
    number = _days("l_shipdate") + 11_000_000
    return (
        table(spark, sf_dir, "lineitem")
        .select(number.alias("block_number"), F.col("l_shipdate").cast("timestamp").alias("ts"))
        .groupBy("block_number")
        .agg(F.min("ts").alias("ts"))
        .select(
            _chain().alias("chain_id"),
            "block_number",
            evm.hash_of("block_number").alias("hash"),
            evm.hash_of(F.col("block_number") - 1).alias("parent_hash"),
            F.unix_timestamp("ts").alias("timestamp"),
        )
    )
