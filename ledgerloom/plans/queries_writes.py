"""Keyed writes, cursors and integrity rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import blocks as blk
from ..functions import evm, u256
from ..functions.ordered import number_by_block
from ..operators import checkpoints as cp
from ..operators import decode, fold, quality
from ..operators import upsert as up
from ..session import scratch_path
from ..sources import keyed
from . import sql, views
from .book import Book

BOOK = Book()


def _time(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@BOOK.add("upsert_transfers_latest", sql.cte(sql.TRANSFERS) + f"""
SELECT token, tx_hash, log_index, from_address, to_address, CAST(amount AS VARCHAR) AS amount,
       block_number, removed, {sql.ts('block_timestamp')} AS block_timestamp FROM transfers""")
def upsert_transfers_latest(spark, sf_dir):
    return views.transfers(spark, sf_dir).select(
        "token", "tx_hash", "log_index", "from_address", "to_address",
        u256.to_string(F.col("amount")).alias("amount"), "block_number", "removed",
        _time("block_timestamp"),
    )


@BOOK.add("upsert_transfers_incremental", sql.cte(sql.TRANSFERS) + """
SELECT token, tx_hash, log_index, from_address, to_address, CAST(amount AS VARCHAR) AS amount,
       block_number, removed FROM transfers""")
def upsert_transfers_incremental(spark, sf_dir):
    """Deliveries of early and late ships merged one after the other: same table."""
    d = views.deliveries(spark, sf_dir)
    early = F.col("block_number") < 11_001_500
    stored = up.upsert_token_transfers(None, d.filter(early), ["arrival"])
    merged = up.upsert_token_transfers(stored, d.filter(~early), ["arrival"])
    return merged.select(
        "token", "tx_hash", "log_index", "from_address", "to_address",
        u256.to_string(F.col("amount")).alias("amount"), "block_number", "removed",
    )


@BOOK.add("upsert_chain_events", sql.cte(sql.TRANSFERS) + f"""
SELECT token AS contract_address, tx_hash, log_index, block_number, removed,
       {sql.ts('block_timestamp')} AS block_timestamp,
       '{{"amount":"' || amount || '","from":"' || from_address || '","to":"' || to_address || '"}}' AS raw_data
FROM transfers""")
def upsert_chain_events(spark, sf_dir):
    d = views.deliveries(spark, sf_dir).withColumn("event_name", F.lit("Transfer"))
    ledger = decode.ledger_rows(d, decode.transfer_json())
    return up.upsert_chain_events(None, ledger, ["arrival"]).select(
        "contract_address", "tx_hash", "log_index", "block_number", "removed",
        _time("block_timestamp"), "raw_data",
    )


ESCROW_VERSIONS = sql.ESCROW_DECODED + """,
versions AS (
  SELECT *, row_number() OVER (PARTITION BY escrow_id, log_index ORDER BY block_number) AS v FROM (
    SELECT *, event_type AS kind FROM escrow_decoded
    UNION ALL
    SELECT chain_id, contract_address, event_type || '2', tx_hash, log_index, block_number + 5,
           true, created_at, escrow_id, amount, raw_data, event_type
    FROM escrow_decoded WHERE CAST(escrow_id AS BIGINT) % 3 = 0))"""


def _escrow_versions(spark, sf_dir):
    """Escrow rows; every third escrow is delivered again later, flagged removed."""
    rows = decode.decode_escrow(views.escrow_logs(spark, sf_dir)).withColumns(
        {"raw_data": decode.escrow_json(), "block_timestamp": F.col("created_at")}
    )
    number = F.conv(F.right("escrow_key", F.lit(15)), 16, 10).cast("long")
    again = rows.filter(number % 3 == 0).withColumns(
        {
            "event_type": F.concat("event_type", F.lit("2")),
            "block_number": F.col("block_number") + 5,
            "removed": F.lit(True),
        }
    )
    return rows.unionByName(again)


def _escrow_latest(name: str):
    return f"""
SELECT tx_hash, log_index, min(block_number) AS block_number,
       arg_{name}(event_type, v) AS event_type, arg_max(removed, v) AS removed,
       arg_max(amount, v) AS amount, arg_max(escrow_id, v) AS escrow_id
FROM versions GROUP BY tx_hash, log_index"""


@BOOK.add("upsert_escrow_batch", sql.cte(ESCROW_VERSIONS) + _escrow_latest("max"))
def upsert_escrow_batch(spark, sf_dir):
    return _escrow_out(up.upsert_escrow_events(None, _escrow_versions(spark, sf_dir), ["block_number"]))


@BOOK.add("upsert_escrow_single", sql.cte(ESCROW_VERSIONS) + _escrow_latest("min"))
def upsert_escrow_single(spark, sf_dir):
    return _escrow_out(
        up.upsert_escrow_events(None, _escrow_versions(spark, sf_dir), ["block_number"], "single")
    )


def _escrow_out(df):
    return df.select(
        "tx_hash", "log_index", "block_number", "event_type", "removed",
        u256.to_string(F.col("amount")).alias("amount"),
        u256.to_string(F.col("escrow_id")).alias("escrow_id"),
    )


@BOOK.add("upsert_transactions", sql.cte(sql.TX) + f"""
SELECT tx_hash, sender, recipient, status, gas_used + CASE WHEN order_key % 4 = 0 THEN 1 ELSE 0 END AS gas_used,
       block_number + CASE WHEN order_key % 4 = 0 THEN 1 ELSE 0 END AS block_number, confirmations,
       {sql.ts('first_seen_at')} AS first_seen_at FROM tx""")
def upsert_transactions(spark, sf_dir):
    """Every fourth transaction is seen again one block later with other gas."""
    first = views.receipts(spark, sf_dir)
    again = first.filter(F.col("gas_used") % 4 == 0).withColumns(
        {
            "gas_used": F.col("gas_used") + 1,
            "block_number": F.col("block_number") + 1,
            "first_seen_at": F.col("first_seen_at") + F.expr("INTERVAL 1 DAY"),
        }
    )
    stored = up.upsert_transactions(None, up.transaction_rows(first), ["block_number"])
    merged = up.upsert_transactions(stored, up.transaction_rows(again), ["block_number"])
    return merged.select(
        "tx_hash", "sender", "recipient", "status", "gas_used", "block_number", "confirmations",
        _time("first_seen_at"),
    )


FUNDING_SQL = """
SELECT employer, employee, CAST(cents AS VARCHAR) AS amount_paid,
       CAST(cents // 100 AS VARCHAR) AS fee, CAST(cents - cents // 100 AS VARCHAR) AS amount_credited,
       tx_hash, log_index, block_number FROM payroll WHERE event_name = 'PayrollFunded'"""


@BOOK.add("insert_once_fundings", sql.cte(sql.PAYROLL) + FUNDING_SQL)
def insert_once_fundings(spark, sf_dir):
    """Stored half plus a full re-delivery with other amounts: the first delivery stays."""
    rows = fold.funding_rows(views.payroll_events(spark, sf_dir))
    order = ["block_number", "log_index", "try"]
    first = rows.withColumn("try", F.lit(1))
    again = rows.withColumns({"try": F.lit(2), "fee": u256.zero()})
    half = up.insert_fundings(None, first.filter(F.col("block_number") % 2 == 0), order)
    added = up.insert_fundings(half, again.unionByName(first), order)
    return half.unionByName(added).select(
        "employer", "employee",
        *[u256.to_string(F.col(c)).alias(c) for c in ("amount_paid", "fee", "amount_credited")],
        "tx_hash", "log_index", "block_number",
    )


@BOOK.add("insert_once_claims", sql.cte(sql.PAYROLL) + """
SELECT employee, CAST(cents AS VARCHAR) AS amount, tx_hash, log_index, block_number
FROM payroll WHERE event_name = 'SalaryClaimed'""")
def insert_once_claims(spark, sf_dir):
    rows = fold.claim_rows(views.payroll_events(spark, sf_dir))
    twice = rows.unionByName(rows)
    return up.insert_claims(None, twice, ["block_number", "log_index"]).select(
        "employee", u256.to_string(F.col("amount")).alias("amount"), "tx_hash", "log_index",
        "block_number",
    )


@BOOK.add("insert_once_wide_events", sql.cte(sql.ESCROW_DECODED) + f"""
SELECT tx_hash, log_index, event_type, NULLIF(CASE WHEN removed THEN '' ELSE raw_data END, '') AS raw_data,
       CASE WHEN event_type = 'DisputeRaised' THEN '2030-01-01 00:00:00'
            ELSE {sql.ts('created_at')} END AS block_timestamp
FROM escrow_decoded""")
def insert_once_wide_events(spark, sf_dir):
    rows = decode.decode_escrow(views.escrow_logs(spark, sf_dir)).select(
        "tx_hash", "log_index", "event_type", "block_number",
        F.when(F.col("removed"), "").otherwise(decode.escrow_json()).alias("raw_data"),
        F.when(F.col("event_type") == "DisputeRaised", F.timestamp_seconds(F.lit(0)))
        .otherwise(F.col("created_at")).alias("block_timestamp"),
    )
    # every row is delivered twice, and decoded once
    twice = rows.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    out = up.insert_wide_events(
        None, twice, ["block_number"], ["raw_data"],
        now=F.lit("2030-01-01 00:00:00").cast("timestamp"),
    )
    return out.select("tx_hash", "log_index", "event_type", "raw_data", _time("block_timestamp"))


@BOOK.add("new_transactions", sql.cte(sql.DELIVERIES, sql.TX) + """
SELECT DISTINCT tx_hash FROM deliveries
WHERE tx_hash NOT IN (SELECT tx_hash FROM tx WHERE order_key % 3 <> 0)""")
def new_transactions(spark, sf_dir):
    """Transfer transactions whose metadata is not stored; a third of it is missing."""
    number = F.conv(F.right("tx_hash", F.lit(15)), 16, 10).cast("long")
    stored = views.transactions(spark, sf_dir).filter(number % 3 != 0)
    return up.new_transactions(views.deliveries(spark, sf_dir), stored).select("tx_hash")


@BOOK.add("atomic_batches", sql.cte(sql.TRANSFERS) + """
SELECT token, tx_hash, log_index, from_address, to_address, CAST(amount AS VARCHAR) AS amount,
       block_number, removed FROM transfers""")
def atomic_batches(spark, sf_dir):
    """Two committed batches, the second one run again, and a third that dies before its commit."""
    root = scratch_path(spark, "store")
    d = views.deliveries(spark, sf_dir).drop("order_key", "cents")
    early = F.col("block_number") < 11_001_500
    cursor = d.agg(F.max("chain_id").alias("chain_id"), F.max("block_number").alias("last_indexed_block"))
    cursor = cursor.withColumn("last_block_hash", F.lit(None).cast("string"))
    tables = {"token_transfers": keyed.table_of(d, schemas.RULES["token_transfers"], ["arrival"])}
    for batch_id, rows in ((0, d.filter(early)), (1, d.filter(~early)), (1, d.filter(~early))):
        keyed.commit_batch(root, "erc20", batch_id, {"token_transfers": rows}, tables, cursor)
    taken_back = d.withColumn("removed", ~F.col("removed"))
    keyed.write_table(root, "token_transfers", tables["token_transfers"], taken_back, "erc20", 2)
    return keyed.read_current(spark, root, "token_transfers", tables["token_transfers"]).select(
        "token", "tx_hash", "log_index", "from_address", "to_address",
        u256.to_string(F.col("amount")).alias("amount"), "block_number", "removed",
    )


@BOOK.add("deterministic_ids", sql.cte(sql.TRANSFERS) + """
SELECT token, tx_hash, log_index,
       row_number() OVER (ORDER BY chain_id, block_number, log_index, tx_hash, token) AS id
FROM transfers""")
def deterministic_ids(spark, sf_dir):
    order = ["chain_id", "block_number", "log_index", "tx_hash", "token"]
    return number_by_block(views.transfers(spark, sf_dir), order, "id").select(
        "token", "tx_hash", "log_index", "id"
    )


# --- cursors ---------------------------------------------------------------------

CURSORS = sql.TRANSFERS + """,
cursors AS (
  SELECT chain_id, 'erc20_transfers_' || token AS stream_id,
         max(block_number) - (CAST(right(token, 1) AS INTEGER) - 1) * 4 AS last_indexed_block,
         token AS last_block_hash
  FROM transfers GROUP BY chain_id, token
  UNION ALL
  SELECT 1, 'monthly_payroll', max(event_id), NULL FROM events)"""


def cursors(spark, sf_dir, transfers=None):
    """One cursor per token stream, a few blocks apart, and one payroll cursor."""
    t = views.transfers(spark, sf_dir) if transfers is None else transfers
    per_token = t.groupBy("chain_id", "token").agg(F.max("block_number").alias("b")).select(
        "chain_id",
        F.concat(F.lit("erc20_transfers_"), "token").alias("stream_id"),
        (F.col("b") - (F.right("token", F.lit(1)).cast("int") - 1) * 4).cast("long").alias("last_indexed_block"),
        F.col("token").alias("last_block_hash"),
    )
    payroll = views.table(spark, sf_dir, "events").agg(F.max("event_id").alias("b")).select(
        F.lit(views.CHAIN).cast("long").alias("chain_id"),
        F.lit(blk.stream_id("payroll")).alias("stream_id"),
        F.col("b").alias("last_indexed_block"),
        F.lit(None).cast("string").alias("last_block_hash"),
    )
    return per_token.unionByName(payroll)


@BOOK.add("save_checkpoints", sql.cte(CURSORS) + """
SELECT stream_id, last_indexed_block - CASE WHEN stream_id LIKE 'erc20%' THEN 0 ELSE 7 END
       AS last_indexed_block FROM cursors""")
def save_checkpoints(spark, sf_dir):
    """A later write wins, even with a lower block."""
    base = cursors(spark, sf_dir)
    at = F.lit("2024-01-01").cast("timestamp")
    first = base.withColumn("updated_at", at)
    later = base.filter(~F.col("stream_id").startswith("erc20")).withColumns(
        {
            "updated_at": at + F.expr("INTERVAL 1 HOUR"),
            "last_indexed_block": F.col("last_indexed_block") - 7,
        }
    )
    stored = cp.save_checkpoint(None, first)
    return cp.save_checkpoint(stored, later).select("stream_id", "last_indexed_block")


@BOOK.add("get_checkpoint", sql.cte(CURSORS) + """
SELECT last_indexed_block, coalesce(last_block_hash, '') AS last_block_hash
FROM cursors WHERE stream_id = 'monthly_payroll'""")
def get_checkpoint(spark, sf_dir):
    return cp.get_checkpoint(cursors(spark, sf_dir), views.CHAIN, "monthly_payroll")


@BOOK.add("clear_checkpoints", sql.cte(CURSORS) + """
SELECT stream_id, last_indexed_block FROM cursors WHERE stream_id <> 'monthly_payroll'
  AND NOT starts_with(stream_id, 'erc20_transfers_0x0000000000000000000000000000000000000003')""")
def clear_checkpoints(spark, sf_dir):
    kept = cp.clear_checkpoints(
        cursors(spark, sf_dir), ["monthly_payroll"],
        [blk.stream_id("token", "0x" + format(3, "040x"))],
    )
    return kept.select("stream_id", "last_indexed_block")


# --- integrity -------------------------------------------------------------------

def _domain(spark, sf_dir):
    events = views.payroll_events(spark, sf_dir)
    return {
        "employers": fold.fold_employers(events),
        "employees": fold.fold_employees(events),
        "payroll_fundings": fold.funding_rows(events),
        "salary_claims": fold.claim_rows(events),
        "transactions": views.transactions(spark, sf_dir),
        "chain_events": events,
    }


@BOOK.add("fk_violations", sql.cte(sql.PAYROLL, sql.TX) + """
SELECT 'chain_events.tx_hash->transactions.tx_hash' AS rule, tx_hash AS value, count(*) AS n
FROM payroll WHERE tx_hash NOT IN (SELECT tx_hash FROM tx WHERE status <> 'failed') GROUP BY tx_hash
UNION ALL
SELECT 'payroll_fundings.tx_hash->transactions.tx_hash', tx_hash, count(*)
FROM payroll WHERE event_name = 'PayrollFunded' AND tx_hash NOT IN
  (SELECT tx_hash FROM tx WHERE status <> 'failed') GROUP BY tx_hash""")
def fk_violations(spark, sf_dir):
    """All six references; failed transactions count as not stored."""
    t = _domain(spark, sf_dir)
    t["transactions"] = t["transactions"].filter(F.col("status") != "failed")
    return quality.fk_violations(t).select("rule", "value", "n")


@BOOK.add("fk_violations_missing_staff", sql.cte(sql.PAYROLL) + """,
staff AS (SELECT DISTINCT employee FROM payroll
          WHERE employee IS NOT NULL AND right(employee, 1) NOT IN ('0', '5', 'a'))
SELECT 'payroll_fundings.employee->employees.wallet' AS rule, employee AS value, count(*) AS n
FROM payroll WHERE event_name = 'PayrollFunded' AND employee NOT IN (SELECT employee FROM staff)
GROUP BY employee
UNION ALL
SELECT 'salary_claims.employee->employees.wallet', employee, count(*)
FROM payroll WHERE event_name = 'SalaryClaimed' AND employee NOT IN (SELECT employee FROM staff)
GROUP BY employee""")
def fk_violations_missing_staff(spark, sf_dir):
    """The same audit after some employees were lost."""
    t = _domain(spark, sf_dir)
    kept = t["employees"].filter(~F.right("wallet", F.lit(1)).isin("0", "5", "a"))
    return quality.fk_violations(
        {"employees": kept, "payroll_fundings": t["payroll_fundings"], "salary_claims": t["salary_claims"]}
    ).select("rule", "value", "n")


@BOOK.add("unique_violations", sql.cte(sql.DELIVERIES) + """
SELECT 'token_transfers' AS table_name,
       chain_id || ':' || token || ':' || tx_hash || ':' || log_index AS key, count(*) AS n
FROM deliveries GROUP BY chain_id, token, tx_hash, log_index HAVING count(*) > 1""")
def unique_violations(spark, sf_dir):
    """Raw deliveries break the transfer key; the payroll history does not."""
    t = _domain(spark, sf_dir)
    return quality.unique_violations(
        {
            "token_transfers": views.deliveries(spark, sf_dir),
            **{k: t[k] for k in ("payroll_fundings", "salary_claims", "transactions", "employers", "employees")},
        }
    )


@BOOK.add("duplicate_events", sql.cte(sql.DELIVERIES) + """
SELECT token, tx_hash, log_index, count(*) AS n, min(block_number) AS first_block,
       min(order_key) AS min_id, max(order_key) AS max_id
FROM deliveries GROUP BY token, tx_hash, log_index HAVING count(*) > 1""")
def duplicate_events(spark, sf_dir):
    d = views.deliveries(spark, sf_dir).withColumn("id", F.col("order_key"))
    found = quality.duplicate_events(d, ["token", "tx_hash", "log_index"])
    first = d.groupBy("token", "tx_hash", "log_index").agg(F.min("block_number").alias("first_block"))
    return found.join(first, ["token", "tx_hash", "log_index"]).select(
        "token", "tx_hash", "log_index", "n", "first_block", "min_id", "max_id"
    )


@BOOK.add("enum_violations", """
SELECT 'transactions.status' AS rule, o_orderstatus AS value, count(*) AS n
FROM orders WHERE o_orderstatus NOT IN ('F') GROUP BY o_orderstatus""")
def enum_violations(spark, sf_dir):
    """Order status read as transaction status: only 'F' (as failed) is allowed."""
    tx = views.table(spark, sf_dir, "orders").select(
        evm.hash_of("o_orderkey").alias("tx_hash"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise(F.col("o_orderstatus")).alias("status"),
    )
    return quality.check_enums(tx).groupBy("rule", "value").agg(F.count("*").alias("n"))


@BOOK.add("valid_addresses", """
SELECT l_linenumber % 5 AS form, l_linenumber % 5 < 2 AS valid, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def valid_addresses(spark, sf_dir):
    """Plain, padded and upper-case, too short, not hex, and without prefix."""
    rows = views.table(spark, sf_dir, "lineitem")
    form = F.col("l_linenumber") % 5
    address = evm.address_of("l_orderkey")
    text = (
        F.when(form == 0, address)
        .when(form == 1, F.concat(F.lit("  0X"), F.upper(F.substring(address, 3, 40)), F.lit(" ")))
        .when(form == 2, F.substring(address, 1, 41))
        .when(form == 3, F.concat(F.substring(address, 1, 41), F.lit("g")))
        .otherwise(F.substring(address, 3, 40))
    )
    return (
        rows.select(form.alias("form"), evm.valid_address(text).alias("valid"))
        .groupBy("form", "valid").agg(F.count("*").alias("n"))
    )


@BOOK.add("valid_hashes", """
SELECT l_linenumber % 3 AS form, l_linenumber % 3 = 0 AS valid, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def valid_hashes(spark, sf_dir):
    form = F.col("l_linenumber") % 3
    h = evm.hash_of("l_orderkey")
    text = F.when(form == 0, h).when(form == 1, F.concat(h, F.lit("0"))).otherwise(
        F.concat(F.lit("0y"), F.substring(h, 3, 64))
    )
    return (
        views.table(spark, sf_dir, "lineitem")
        .select(form.alias("form"), evm.valid_hash(text).alias("valid"))
        .groupBy("form", "valid").agg(F.count("*").alias("n"))
    )


@BOOK.add("backfill_requests", """
SELECT problem, count(*) AS n FROM (
  SELECT CASE WHEN l_partkey % 50 = 0 THEN 'from must be positive'
              WHEN l_orderkey < l_partkey % 50 THEN 'from after to'
              WHEN l_orderkey - l_partkey % 50 > 50000 THEN 'range too wide'
              ELSE 'accepted' END AS problem FROM lineitem) GROUP BY problem""")
def backfill_requests(spark, sf_dir):
    from ..operators.reads import backfill_requests as check

    requests = views.table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 50).alias("from_block"), F.col("l_orderkey").alias("to_block")
    )
    return (
        check(requests).select(F.coalesce("problem", F.lit("accepted")).alias("problem"))
        .groupBy("problem").agg(F.count("*").alias("n"))
    )


@BOOK.add("valid_block_ranges", """
SELECT problem, count(*) AS n FROM (
  SELECT CASE WHEN l_suppkey > l_partkey THEN 'from after to' ELSE 'accepted' END AS problem
  FROM lineitem) GROUP BY problem""")
def valid_block_ranges(spark, sf_dir):
    requests = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("from_block"), F.col("l_partkey").alias("to_block")
    )
    return (
        quality.valid_ranges(requests).select(F.coalesce("problem", F.lit("accepted")).alias("problem"))
        .groupBy("problem").agg(F.count("*").alias("n"))
    )
