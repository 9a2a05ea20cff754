"""Raw logs and webhook deliveries decoded back into typed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registry as reg
from ..functions import evm, u256
from ..operators import decode
from ..session import scratch_path
from ..sources import logs as log_source
from ..sources import deliveries
from ..sources.deliveries import parse_deliveries
from . import sql, views
from .book import Book

BOOK = Book()
TOKEN = "0x" + format(2, "040x")
FROM_BLOCK, TO_BLOCK = 11_001_000, 11_001_600


@BOOK.add("decode_transfers", sql.cte(sql.DELIVERIES) + """
SELECT token, from_address, to_address, CAST(amount AS VARCHAR) AS amount, tx_hash, log_index,
       block_number, removed FROM deliveries""")
def decode_transfers(spark, sf_dir):
    rows = decode.decode_transfers(views.transfer_logs(spark, sf_dir))
    return rows.select(
        "token", "from_address", "to_address", u256.to_string(F.col("amount")).alias("amount"),
        "tx_hash", "log_index", "block_number", "removed",
    )


APPROVALS = f"""
SELECT {sql.addr('o_orderkey % 4 + 1')} AS token, {sql.addr('o_custkey % 97')} AS owner,
       {sql.addr('o_orderkey % 89')} AS spender,
       CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS amount,
       {sql.hash_('o_orderkey')} AS tx_hash,
       CAST(11000000 + {sql.days('o_orderdate')} AS BIGINT) AS block_number
FROM orders"""


@BOOK.add("decode_approvals", APPROVALS)
def decode_approvals(spark, sf_dir):
    rows = decode.decode_approvals(views.approval_logs(spark, sf_dir))
    return rows.select(
        "token", "owner", "spender", u256.to_string(F.col("amount")).alias("amount"), "tx_hash",
        "block_number",
    )


def _payroll_sql(columns: str) -> str:
    return sql.cte(sql.PAYROLL) + f"""
SELECT {columns} FROM (
  SELECT *, CASE WHEN event_name = 'EmployeeAdded' THEN cents END AS salary,
         CASE WHEN event_name = 'EmployeeAdded' THEN cents * 2 END AS allocation,
         CASE WHEN event_name = 'PayrollFunded' THEN cents END AS amount_paid,
         CASE WHEN event_name = 'PayrollFunded' THEN cents // 100 END AS fee,
         CASE WHEN event_name = 'PayrollFunded' THEN cents - cents // 100 END AS amount_credited,
         CASE WHEN event_name = 'SalaryClaimed' THEN cents END AS amount
  FROM payroll)"""


_NUMBERS = ("salary", "allocation", "amount_paid", "fee", "amount_credited", "amount")


@BOOK.add("decode_payroll", _payroll_sql(
    "event_name, employer, employee, "
    + ", ".join(f"CAST({n} AS VARCHAR) AS {n}" for n in _NUMBERS)
    + ", tx_hash, block_number, log_index"))
def decode_payroll(spark, sf_dir):
    rows = decode.decode_payroll(views.payroll_logs(spark, sf_dir))
    return rows.select(
        "event_name", "employer", "employee",
        *[u256.to_string(F.col(n)).alias(n) for n in _NUMBERS],
        "tx_hash", "block_number", "log_index",
    )


@BOOK.add("decode_escrow", sql.cte(sql.ESCROW_DECODED) + f"""
SELECT event_type, escrow_id, amount, raw_data, tx_hash, log_index, block_number, removed,
       {sql.ts('created_at')} AS created_at FROM escrow_decoded""")
def decode_escrow(spark, sf_dir):
    rows = decode.decode_escrow(views.escrow_logs(spark, sf_dir))
    return rows.select(
        "event_type",
        u256.to_string(F.col("escrow_id")).alias("escrow_id"),
        u256.to_string(F.col("amount")).alias("amount"),
        decode.escrow_json().alias("raw_data"),
        "tx_hash", "log_index", "block_number", "removed",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


@BOOK.add("webhook_escrow_events", sql.cte(sql.ESCROW_DECODED) + f"""
SELECT contract_address, event_type, escrow_id, amount, raw_data, tx_hash, log_index, block_number,
       removed, {sql.ts('created_at')} AS block_timestamp FROM escrow_decoded""")
def webhook_escrow_events(spark, sf_dir):
    parsed = parse_deliveries(views.webhook_text(spark, sf_dir))
    rows = decode.deliveries_to_escrow_events(parsed, views.ESCROW_CONTRACT, views.CHAIN)
    return rows.select(
        "contract_address", "event_type",
        u256.to_string(F.col("escrow_id")).alias("escrow_id"),
        u256.to_string(F.col("amount")).alias("amount"),
        decode.escrow_json().alias("raw_data"),
        "tx_hash", "log_index", "block_number", "removed",
        F.date_format("block_timestamp", "yyyy-MM-dd HH:mm:ss").alias("block_timestamp"),
    )


@BOOK.add("webhook_other_contract", "SELECT CAST(0 AS BIGINT) AS n")
def webhook_other_contract(spark, sf_dir):
    """Every delivery is of another contract than the expected one: all are dropped."""
    parsed = parse_deliveries(views.webhook_text(spark, sf_dir))
    return decode.filter_contract(parsed, views.PAYROLL_CONTRACT).agg(F.count("*").alias("n"))


def _every_log(spark, sf_dir):
    columns = ["chain_id", "address", "topic0", "topics", "data", "block_number", "tx_hash", "log_index", "removed"]
    return (
        views.transfer_logs(spark, sf_dir).select(*columns)
        .unionByName(views.approval_logs(spark, sf_dir).select(*columns))
        .unionByName(views.payroll_logs(spark, sf_dir).select(*columns))
        .unionByName(views.escrow_logs(spark, sf_dir).select(*columns))
    )


@BOOK.add("classify_logs", sql.cte(sql.PAYROLL, sql.ESCROW) + """
SELECT 'payroll' AS family, event_name, count(*) AS n FROM payroll GROUP BY event_name
UNION ALL SELECT 'escrow', event_type, count(*) FROM escrow GROUP BY event_type
UNION ALL SELECT 'erc20', 'Transfer', count(*) FROM lineitem
UNION ALL SELECT 'erc20', 'Approval', count(*) FROM orders""")
def classify_logs(spark, sf_dir):
    logs = decode.classify_logs(_every_log(spark, sf_dir), reg.event_registry(spark), "fail")
    return logs.groupBy("family", "event_name").agg(F.count("*").alias("n"))


@BOOK.add("classify_unknown", """
SELECT CASE WHEN l_orderkey % 10 = 0 THEN 'Unknown' ELSE 'Transfer' END AS event_name, count(*) AS n
FROM lineitem GROUP BY 1""")
def classify_unknown(spark, sf_dir):
    """Every tenth order's logs carry a topic nobody declared."""
    odd = F.conv(F.right("tx_hash", F.lit(15)), 16, 10).cast("long") % 10 == 0
    logs = views.transfer_logs(spark, sf_dir).withColumn(
        "topic0", F.when(odd, evm.hash_of(F.lit(77))).otherwise(F.col("topic0"))
    )
    named = decode.classify_logs(logs, reg.event_registry(spark), "unknown")
    return named.groupBy("event_name").agg(F.count("*").alias("n"))


@BOOK.add("quarantine_logs", """
SELECT CASE WHEN l_linenumber = 1 THEN 'no topics' WHEN l_linenumber = 2 THEN 'short data'
            WHEN l_linenumber = 3 THEN 'not hex' ELSE 'fine' END AS damage,
       l_linenumber > 3 AS accepted, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def quarantine_logs(spark, sf_dir):
    """Logs damaged by line number: no topics, short data, non-hex data."""
    line = F.col("log_index")
    logs = views.transfer_logs(spark, sf_dir)
    damaged = logs.withColumns(
        {
            "topics": F.when(line == 1, F.array().cast("array<string>")).otherwise(F.col("topics")),
            "data": F.when(line == 2, F.substring("data", 1, 60))
            .when(line == 3, F.concat(F.lit("0xzz"), F.substring("data", 5, 62)))
            .otherwise(F.col("data")),
            "damage": F.when(line == 1, "no topics").when(line == 2, "short data")
            .when(line == 3, "not hex").otherwise("fine"),
        }
    )
    ok, bad = decode.split_valid(damaged)
    both = ok.select("damage", F.lit(True).alias("accepted")).unionByName(
        bad.select("damage", F.lit(False).alias("accepted"))
    )
    return both.groupBy("damage", "accepted").agg(F.count("*").alias("n"))


@BOOK.add("scan_log_range", sql.cte(sql.DELIVERIES) + f"""
SELECT tx_hash, log_index, block_number, token AS address FROM deliveries
WHERE token = '{TOKEN}' AND block_number BETWEEN {FROM_BLOCK} AND {TO_BLOCK}""")
def scan_log_range(spark, sf_dir):
    """Write the log table in its layout, then scan one contract and range of it."""
    path = scratch_path(spark, "logs")
    log_source.write_logs(views.transfer_logs(spark, sf_dir).drop("arrival"), path)
    rows = log_source.scan_logs(
        spark, path, TOKEN, FROM_BLOCK, TO_BLOCK, reg.TOPIC["Transfer"], views.CHAIN
    )
    return rows.select("tx_hash", "log_index", "block_number", "address")


@BOOK.add("scan_token_topics", sql.cte(sql.DELIVERIES, "approvals AS (" + APPROVALS + ")") + f"""
SELECT tx_hash, log_index, block_number, 'Transfer' AS event_name FROM deliveries
WHERE token = '{TOKEN}' AND block_number BETWEEN {FROM_BLOCK} AND {TO_BLOCK}
UNION ALL
SELECT tx_hash, 0, block_number, 'Approval' FROM approvals
WHERE token = '{TOKEN}' AND block_number BETWEEN {FROM_BLOCK} AND {TO_BLOCK}""")
def scan_token_topics(spark, sf_dir):
    path = scratch_path(spark, "logs")
    both = views.transfer_logs(spark, sf_dir).drop("arrival").unionByName(
        views.approval_logs(spark, sf_dir)
    )
    log_source.write_logs(both, path)
    rows = log_source.scan_token_logs(spark, path, TOKEN, FROM_BLOCK, TO_BLOCK, chain_id=views.CHAIN)
    return decode.classify_logs(rows, reg.event_registry(spark)).select(
        "tx_hash", "log_index", "block_number", "event_name"
    )


@BOOK.add("logs_with_block_time", sql.cte(sql.DELIVERIES) + f"""
SELECT tx_hash, log_index, block_number, {sql.ts('block_timestamp')} AS block_timestamp
FROM deliveries""")
def logs_with_block_time(spark, sf_dir):
    rows = decode.with_block_time(views.transfer_logs(spark, sf_dir), views.blocks(spark, sf_dir))
    return rows.select(
        "tx_hash", "log_index", "block_number",
        F.date_format("block_timestamp", "yyyy-MM-dd HH:mm:ss").alias("block_timestamp"),
    )


@BOOK.add("logs_with_transaction", sql.cte(sql.DELIVERIES, sql.TX) + """
SELECT d.tx_hash, d.log_index, d.token, t.sender, t.recipient, t.status, t.gas_used
FROM deliveries d JOIN tx t ON d.tx_hash = t.tx_hash""")
def logs_with_transaction(spark, sf_dir):
    rows = decode.with_tx(
        views.deliveries(spark, sf_dir).select("chain_id", "tx_hash", "log_index", "token"),
        views.transactions(spark, sf_dir),
    )
    return rows.select("tx_hash", "log_index", "token", "sender", "recipient", "status", "gas_used")


@BOOK.add("ledger_json", sql.cte(sql.DELIVERIES) + """
SELECT token AS contract_address, 'Transfer' AS event_name, tx_hash, log_index,
       '{"amount":"' || amount || '","from":"' || from_address || '","to":"' || to_address || '"}' AS raw_data
FROM deliveries""")
def ledger_json(spark, sf_dir):
    rows = decode.decode_transfers(views.transfer_logs(spark, sf_dir))
    named = rows.withColumn("event_name", F.lit("Transfer"))
    return decode.ledger_rows(named, decode.transfer_json()).select(
        "contract_address", "event_name", "tx_hash", "log_index", "raw_data"
    )


@BOOK.add("payroll_ledger_json", _payroll_sql("""tx_hash, event_name, CASE event_name
  WHEN 'EmployeeAdded' THEN '{"Allocation":' || allocation || ',"Employee":"' || employee
       || '","Employer":"' || employer || '","Salary":' || salary || '}'
  WHEN 'PayrollFunded' THEN '{"AmountCredited":' || amount_credited || ',"AmountPaid":' || amount_paid
       || ',"Employee":"' || employee || '","Employer":"' || employer || '","Fee":' || fee || '}'
  WHEN 'SalaryClaimed' THEN '{"Amount":' || amount || ',"Employee":"' || employee || '"}'
  WHEN 'EmployeeRemoved' THEN '{"Employee":"' || employee || '","Employer":"' || employer || '"}'
  ELSE '{"Employer":"' || employer || '"}' END AS raw_data"""))
def payroll_ledger_json(spark, sf_dir):
    rows = decode.decode_payroll(views.payroll_logs(spark, sf_dir))
    return decode.ledger_rows(rows, decode.payroll_json()).select("tx_hash", "event_name", "raw_data")


@BOOK.add("block_numbers", """
SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p,
       CASE l_orderkey % 4 WHEN 3 THEN 0 ELSE l_orderkey + 11000000 END AS block_number
FROM lineitem""")
def block_numbers(spark, sf_dir):
    """Hex, decimal, missing (block's own number) and malformed block numbers."""
    rows = views.table(spark, sf_dir, "lineitem")
    number = F.col("l_orderkey") + 11_000_000
    kind = F.col("l_orderkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("0x"), F.lower(F.hex(number))))
        .when(kind == 1, F.concat(F.lit(" "), number.cast("string")))
        .when(kind == 2, "")
        .otherwise("0xnope")
    )
    return rows.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
        evm.parse_block_number(text, number.cast("string")).alias("block_number"),
    )


@BOOK.add("registry_rules", "SELECT 'none' AS event_name, 'none' AS rule WHERE false")
def registry_rules(spark, sf_dir):
    """Topics seen in the data against the registry's own rules: no violation."""
    used = _every_log(spark, sf_dir).select("topic0").distinct()
    return reg.validate_registry(reg.event_registry(spark).join(used, "topic0", "left_semi"))


@BOOK.add("registry_topics_used", sql.cte(sql.PAYROLL, sql.ESCROW) + """
SELECT event_name FROM payroll UNION SELECT event_type FROM escrow
UNION SELECT 'Transfer' UNION SELECT 'Approval'""")
def registry_topics_used(spark, sf_dir):
    used = _every_log(spark, sf_dir).select("topic0").distinct()
    return reg.event_registry(spark).join(used, "topic0", "left_semi").select("event_name")


@BOOK.add("rejected_deliveries", sql.cte(sql.ESCROW) + """
SELECT tx_hash, CAST('0x' || right(tx_hash, 15) AS BIGINT) % 3 <> 0 AS accepted FROM escrow""")
def rejected_deliveries(spark, sf_dir):
    """Every third delivery has its log index as hex text: rejected as a whole, never log 0."""
    text = views.webhook_text(spark, sf_dir)
    tx = F.get_json_object("value", "$.id")
    number = F.conv(F.right(tx, F.lit(15)), 16, 10).cast("long")
    hexed = F.regexp_replace("value", '"logIndex":([0-9]+)', '"logIndex":"0x$1"')
    damaged = text.select(F.when(number % 3 == 0, hexed).otherwise(F.col("value")).alias("value"))
    accepted = parse_deliveries(damaged).select("tx_hash", F.lit(True).alias("accepted"))
    rejected = deliveries.rejected_deliveries(damaged).select(tx.alias("tx_hash"), F.lit(False).alias("accepted"))
    return accepted.unionByName(rejected)


@BOOK.add("logs_without_header", sql.cte(sql.DELIVERIES) + """
SELECT tx_hash, log_index, block_number FROM deliveries WHERE block_number % 5 = 0""")
def logs_without_header(spark, sf_dir):
    """Logs to be held back while every fifth header is not there."""
    headers = views.blocks(spark, sf_dir).filter(F.col("block_number") % 5 != 0)
    return decode.without(views.transfer_logs(spark, sf_dir), headers).select("tx_hash", "log_index", "block_number")


@BOOK.add("logs_without_tx", sql.cte(sql.DELIVERIES) + """
SELECT tx_hash, log_index FROM deliveries WHERE order_key % 3 = 0""")
def logs_without_tx(spark, sf_dir):
    number = F.conv(F.right("tx_hash", F.lit(15)), 16, 10).cast("long")
    known = views.transactions(spark, sf_dir).filter(number % 3 != 0)
    return decode.without(views.transfer_logs(spark, sf_dir), known, ("chain_id", "tx_hash")).select("tx_hash", "log_index")


@BOOK.add("explorer_links", f"""
SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p,
       CASE WHEN l_linenumber % 2 = 0 THEN 'https://sepolia.etherscan.io/tx/' ELSE 'https://etherscan.io/tx/' END
         || {sql.hash_('l_orderkey')} AS link,
       'https://scan.example/t/' || {sql.hash_('l_orderkey')} || '?from=l' AS own FROM lineitem""")
def explorer_links(spark, sf_dir):
    """By chain, and by a template of the caller's."""
    rows = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
        evm.hash_of("l_orderkey").alias("tx_hash"), F.when(F.col("l_linenumber") % 2 == 0, 11155111).otherwise(1).alias("chain_id"),
    )
    return rows.select(
        "k", "n", "p", evm.explorer_url("tx_hash", "chain_id").alias("link"),
        evm.explorer_url("tx_hash", "chain_id", "https://scan.example/t/%s?from=l").alias("own"),
    )


@BOOK.add("unique_violations_ledger", sql.cte(sql.DELIVERIES) + """
SELECT t AS table_name, '1:' || token || ':' || tx_hash || ':' || log_index AS key, count(*) AS n
FROM deliveries, (VALUES ('chain_events'), ('escrow_events')) v(t) GROUP BY ALL HAVING count(*) > 1""")
def unique_violations_ledger(spark, sf_dir):
    """Raw deliveries taken for the stored ledger and escrow tables: every repeat is a violation."""
    from ..operators import quality

    rows = views.deliveries(spark, sf_dir).select("chain_id", F.col("token").alias("contract_address"), "tx_hash", "log_index")
    return quality.unique_violations({"chain_events": rows, "escrow_events": rows})


# Fixed value: topic of an event that the built-in registry does not have (any 32 bytes will do here).
PLACED = "0x" + "ab12" * 16


@BOOK.add("decode_by_registry", f"""
SELECT 'OrderPlaced' AS event_name, CAST(o_orderkey AS VARCHAR) AS order_id, {sql.addr('o_custkey')} AS customer,
       CAST(CAST(round(o_totalprice * 100) AS BIGINT) - 20000000 AS VARCHAR) AS delta,
       CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS done, o_orderpriority || ' é' AS note,
       '0x' || lower(hex(o_orderpriority)) AS raw, '0x' || lower(hex(o_orderstatus)) || '000000' AS tag
FROM orders
UNION ALL SELECT 'Approval', NULL, {sql.addr('o_custkey % 97')}, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR),
       NULL, NULL, NULL, NULL FROM orders""")
def decode_by_registry(spark, sf_dir):
    """Logs of a contract that only the passed registry rows know, dynamic and signed words among them, beside known ones."""
    own = reg.EventDef(
        "shop", "OrderPlaced", PLACED, (("orderId", "uint256"), ("customer", "address")),
        (("delta", "int256"), ("done", "bool"), ("note", "string"), ("raw", "bytes"), ("tag", "bytes4")),
    )
    registry = reg.event_registry(spark, [own, *[e for e in reg.EVENTS if e.name == "Approval"]])
    cents = F.round(F.col("o_totalprice") * 100).cast("long") - 20_000_000
    low = F.lpad(F.lower(F.hex(cents)), 16, "0")
    number = F.concat(F.when(cents < 0, F.lit("f" * 48)).otherwise(F.lit("0" * 48)), low)

    def dynamic(value):
        body = F.lower(F.hex(value))
        chars = F.ceil(F.length(body) / 64).cast("int") * 64
        size = F.lpad(F.lower(F.hex((F.length(body) / 2).cast("long"))), 64, "0")
        return F.concat(size, F.rpad(body, chars, "0"))

    word = lambda n: F.lpad(F.lower(F.hex(n)), 64, "0")
    note, raw = F.concat(F.col("o_orderpriority"), F.lit(" é")).cast("binary"), F.col("o_orderpriority").cast("binary")
    head = 5 * 32
    second = F.lit(head) + 32 + F.ceil(F.octet_length(note) / 32) * 32
    tag = F.rpad(F.lower(F.hex(F.col("o_orderstatus").cast("binary"))), 64, "0")
    data = F.concat(
        F.lit("0X"), number, F.when(F.col("o_orderstatus") == "F", F.lit("0" * 63 + "1")).otherwise(F.lit("0" * 64)),
        word(F.lit(head).cast("long")), word(second.cast("long")), tag, dynamic(note), dynamic(raw),
    )
    placed = views.table(spark, sf_dir, "orders").select(
        F.lit(views.CHAIN).cast("long").alias("chain_id"), F.lit("0x" + "5" * 40).alias("address"), F.lit(PLACED).alias("topic0"),
        F.array(F.lit(PLACED), F.concat(F.lit("0x"), word(F.col("o_orderkey"))), F.concat(F.lit("0x"), word(F.col("o_custkey")))).alias("topics"),
        data.alias("data"), F.col("o_orderkey").alias("block_number"), evm.hash_of("o_orderkey").alias("tx_hash"),
        F.lit(0).alias("log_index"), F.lit(False).alias("removed"),
    )
    logs = placed.unionByName(views.approval_logs(spark, sf_dir)).unionByName(views.transfer_logs(spark, sf_dir).drop("arrival"))
    out = decode.decode_by_registry(logs, registry)
    field = lambda name: F.col("fields")[name]
    return out.select(
        "event_name", field("orderId").alias("order_id"), F.coalesce(field("customer"), field("owner")).alias("customer"),
        F.coalesce(field("delta"), field("value")).alias("delta"), field("done").alias("done"), field("note").alias("note"),
        field("raw").alias("raw"), field("tag").alias("tag"),
    )
