"""Filtered, sorted and paged lists; transactions; stream status."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import blocks as blk
from ..functions import evm, u256
from ..operators import balances as bal
from ..operators import checkpoints as cp
from ..operators import decode, filters, fold, notify, paging, reads
from ..operators.dedup import dedup_deliveries as dedup_exact
from ..session import estimated_bytes, scratch_path
from ..sources import tables
from . import sql, views
from .book import Book
from .queries_payroll import STAFF
from .queries_writes import CURSORS, cursors

BOOK = Book()
TOKEN = "0x" + format(2, "040x")
WALLETS_TOKEN = "0x" + format(4, "040x")
WALLET = "0x" + format(7, "040x")
EMPLOYEE = "0x" + format(1007, "040x")
EMPLOYER = "0x" + format(3, "040x")


def _time(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


TRANSFER_COLUMNS = f"""token, from_address, to_address, CAST(amount AS VARCHAR) AS amount, tx_hash,
  block_number, {sql.ts('block_timestamp')} AS block_timestamp, log_index, removed"""


def _transfers_out(df):
    return df.select(
        "token", "from_address", "to_address", "amount", "tx_hash", "block_number",
        _time("block_timestamp"), "log_index", "removed",
    )


def _transfer_page_sql(where: str, order: str, offset: int, limit: int) -> str:
    return sql.cte(sql.TRANSFERS) + f"""
SELECT {TRANSFER_COLUMNS} FROM (SELECT * FROM transfers WHERE {where}
  ORDER BY {order} LIMIT {limit} OFFSET {offset})"""


@BOOK.add("transfers_in_page", _transfer_page_sql(
    f"to_address = '{WALLET}'", "block_number DESC, log_index DESC, tx_hash, token", 0, 20))
def transfers_in_page(spark, sf_dir):
    out = reads.list_transfers(
        views.transfers(spark, sf_dir), views.CHAIN, wallet=WALLET.upper().replace("X", "x"),
        wallet_direction="in",
    )
    return _transfers_out(out.rows)


@BOOK.add("transfers_out_page", _transfer_page_sql(
    f"from_address = '{WALLET}' AND token = '{WALLETS_TOKEN}'",
    "amount ASC, log_index DESC, tx_hash, token", 10, 10))
def transfers_out_page(spark, sf_dir):
    out = reads.list_transfers(
        views.transfers(spark, sf_dir), views.CHAIN, token=WALLETS_TOKEN, wallet=WALLET,
        wallet_direction="out", sort="amount", direction="asc", page=2, size=10,
    )
    return _transfers_out(out.rows)


@BOOK.add("transfers_all_page", _transfer_page_sql(
    f"(from_address = '{WALLET}' OR to_address = '{WALLET}') AND block_number BETWEEN 11000500 AND 11002500",
    "block_timestamp DESC, log_index DESC, tx_hash, token", 100, 50))
def transfers_all_page(spark, sf_dir):
    out = reads.list_transfers(
        views.transfers(spark, sf_dir), views.CHAIN, wallet=WALLET, wallet_direction="all",
        blocks=(11_000_500, 11_002_500), sort="block_timestamp", page=3, size=50,
    )
    return _transfers_out(out.rows)


@BOOK.add("transfers_page_meta", sql.cte(sql.TRANSFERS) + f"""
SELECT 3 AS page, 50 AS size, count(*) AS total, 150 < count(*) AS has_next FROM transfers
WHERE from_address = '{WALLET}' OR to_address = '{WALLET}'""")
def transfers_page_meta(spark, sf_dir):
    return reads.list_transfers(
        views.transfers(spark, sf_dir), views.CHAIN, wallet=WALLET, page=3, size=50
    ).meta


@BOOK.add("transfers_deep_page", _transfer_page_sql(
    "true", "block_number DESC, log_index DESC, tx_hash, token", 20000, 100))
def transfers_deep_page(spark, sf_dir):
    """The distributed path for deep pages, on an offset small enough to check."""
    order = paging.sort_columns("token_transfers", None, "desc", ties=("tx_hash", "token"))
    rows = paging.with_position(views.transfers(spark, sf_dir), order, "_position", start=0)
    page = rows.filter(F.col("_position").between(20_000, 20_099))
    return _transfers_out(page.withColumn("amount", u256.to_string(F.col("amount"))))


@BOOK.add("transfers_after_position", sql.cte(sql.TRANSFERS) + f"""
SELECT {TRANSFER_COLUMNS} FROM (SELECT * FROM transfers
  WHERE block_number > 11001000 OR (block_number = 11001000 AND log_index > 3)
  ORDER BY block_number, log_index, tx_hash, token LIMIT 20)""")
def transfers_after_position(spark, sf_dir):
    rows = paging.page_after(views.transfers(spark, sf_dir), 11_001_000, 3, ties=("tx_hash", "token"))
    return _transfers_out(rows.withColumn("amount", u256.to_string(F.col("amount"))))


@BOOK.add("token_history", sql.cte(sql.TRANSFERS) + f"""
SELECT {TRANSFER_COLUMNS} FROM (SELECT * FROM transfers WHERE token = '{TOKEN}'
  ORDER BY block_number, log_index, tx_hash LIMIT 100)""")
def token_history(spark, sf_dir):
    rows = paging.token_history(views.transfers(spark, sf_dir), views.CHAIN, TOKEN)
    return _transfers_out(rows.withColumn("amount", u256.to_string(F.col("amount"))))


@BOOK.add("transfers_by_dates", sql.cte(sql.TRANSFERS) + """
SELECT token, count(*) AS n FROM transfers
WHERE block_timestamp BETWEEN '1995-01-01' AND '1996-06-30 12:00:00' GROUP BY token""")
def transfers_by_dates(spark, sf_dir):
    rows = filters.by_dates(views.transfers(spark, sf_dir), "1995-01-01", "1996-06-30T14:00:00+02:00")
    return rows.groupBy("token").agg(F.count("*").alias("n"))


@BOOK.add("parse_dates", """
SELECT l_linenumber % 4 AS form, count(*) AS n,
       count(CASE WHEN l_linenumber % 4 <> 3 THEN 1 END) AS parsed,
       min(CASE l_linenumber % 4 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d 00:00:00')
                WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d 10:20:30')
                WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%d 08:20:30') END) AS first
FROM lineitem GROUP BY 1""")
def parse_dates(spark, sf_dir):
    form, day = F.col("l_linenumber") % 4, F.date_format("l_shipdate", "yyyy-MM-dd")
    text = (
        F.when(form == 0, day)
        .when(form == 1, F.concat(day, F.lit("T10:20:30Z")))
        .when(form == 2, F.concat(day, F.lit("T10:20:30+02:00")))
        .otherwise(F.date_format("l_shipdate", "dd.MM.yyyy"))
    )
    return (
        views.table(spark, sf_dir, "lineitem")
        .select(form.alias("form"), evm.parse_date(text).alias("at"))
        .groupBy("form")
        .agg(
            F.count("*").alias("n"), F.count("at").alias("parsed"),
            F.date_format(F.min("at"), "yyyy-MM-dd HH:mm:ss").alias("first"),
        )
    )


def _payroll_page_sql(kind: str, columns: str, where: str, order: str, offset: int, limit: int) -> str:
    return sql.cte(sql.PAYROLL) + f"""
SELECT {columns} FROM (SELECT * FROM payroll WHERE event_name = '{kind}' AND {where}
  ORDER BY {order} LIMIT {limit} OFFSET {offset})"""


@BOOK.add("fundings_page", _payroll_page_sql(
    "PayrollFunded",
    "employer, employee, CAST(cents AS VARCHAR) AS amount_paid, CAST(cents - cents // 100 AS VARCHAR) AS amount_credited, tx_hash, block_number",
    f"employer = '{EMPLOYER}'", "cents - cents // 100 DESC, log_index DESC, tx_hash", 0, 20))
def fundings_page(spark, sf_dir):
    rows = fold.funding_rows(views.payroll_events(spark, sf_dir))
    out = reads.list_fundings(rows, views.CHAIN, employer=EMPLOYER, sort="amount_credited")
    return out.rows.select("employer", "employee", "amount_paid", "amount_credited", "tx_hash", "block_number")


@BOOK.add("claims_page", _payroll_page_sql(
    "SalaryClaimed", "employee, CAST(cents AS VARCHAR) AS amount, tx_hash, block_number",
    f"employee = '{EMPLOYEE}'", "block_number DESC, log_index DESC, tx_hash", 5, 5))
def claims_page(spark, sf_dir):
    rows = fold.claim_rows(views.payroll_events(spark, sf_dir))
    out = reads.list_claims(rows, views.CHAIN, employee=EMPLOYEE, page=2, size=5)
    return out.rows.select("employee", "amount", "tx_hash", "block_number")


@BOOK.add("fundings_in_range", _payroll_page_sql(
    "PayrollFunded", "employer, employee, tx_hash, block_number", "block_number BETWEEN 200 AND 800",
    "block_number", 0, 1000000))
def fundings_in_range(spark, sf_dir):
    rows = fold.funding_rows(views.payroll_events(spark, sf_dir)).withColumn("id", F.col("block_number"))
    return filters.in_range(rows, views.CHAIN, 200, 800).select(
        "employer", "employee", "tx_hash", "block_number"
    )


# --- escrow ----------------------------------------------------------------------

def _escrow(spark, sf_dir):
    return decode.decode_escrow(views.escrow_logs(spark, sf_dir))


@BOOK.add("escrow_lifecycle", sql.cte(sql.ESCROW_DECODED) + """
SELECT escrow_id, event_type, amount, block_number, log_index, removed
FROM escrow_decoded WHERE escrow_id = '42'""")
def escrow_lifecycle(spark, sf_dir):
    """Looked up by hex id 0x2a."""
    return reads.escrow_lifecycle(_escrow(spark, sf_dir), "0x2a").select(
        "escrow_id", "event_type", "amount", "block_number", "log_index", "removed"
    )


@BOOK.add("escrow_count", sql.cte(sql.ESCROW) + "SELECT chain_id, count(*) AS total FROM escrow GROUP BY chain_id")
def escrow_count(spark, sf_dir):
    return reads.escrow_count(_escrow(spark, sf_dir))


@BOOK.add("escrow_event_at", sql.cte(sql.ESCROW_DECODED) + f"""
SELECT event_type, escrow_id, amount FROM escrow_decoded WHERE tx_hash = {sql.hash_('85')} AND log_index = 1""")
def escrow_event_at(spark, sf_dir):
    tx = "0x" + format(85, "064X")
    return filters.event_at(_escrow(spark, sf_dir), tx, 1).select(
        "event_type", u256.to_string(F.col("escrow_id")).alias("escrow_id"),
        u256.to_string(F.col("amount")).alias("amount"),
    )


@BOOK.add("escrow_wide_view", sql.cte(sql.ESCROW_DECODED) + f"""
SELECT event_type, tx_hash, coalesce(amount, '') AS amount_text, {sql.epoch('created_at')} AS created_at
FROM escrow_decoded""")
def escrow_wide_view(spark, sf_dir):
    rows = _escrow(spark, sf_dir).withColumn("amount_text", u256.to_string(F.col("amount")))
    return filters.wide_view(rows, text=["amount_text"], times=["created_at"]).select(
        "event_type", "tx_hash", "amount_text", "created_at"
    )


@BOOK.add("notifications", sql.cte(sql.ESCROW_DECODED) + """
SELECT channel, '{"amount":"' || coalesce(amount, '') || '","escrowId":"' || escrow_id
       || '","eventType":"' || event_type || '","txHash":"' || tx_hash || '"}' AS value
FROM escrow_decoded, (VALUES ('chain:events'), ('chain:settled')) c(channel)""")
def notifications(spark, sf_dir):
    return notify.notifications(_escrow(spark, sf_dir)).select("channel", "value")


# --- transactions ----------------------------------------------------------------

LATEST = """,
head AS (SELECT coalesce(max(b), 0) AS latest_block FROM (
  SELECT max(block_number) AS b FROM tx UNION ALL SELECT max(last_indexed_block) FROM cursors))"""


@BOOK.add("latest_block", sql.cte(CURSORS, sql.TX) + LATEST + "SELECT latest_block FROM head")
def latest_block(spark, sf_dir):
    return cp.latest_block(views.transactions(spark, sf_dir), cursors(spark, sf_dir))


@BOOK.add("max_checkpoint", sql.cte(CURSORS) + "SELECT max(last_indexed_block) AS latest_block FROM cursors")
def max_checkpoint(spark, sf_dir):
    return cp.max_checkpoint(cursors(spark, sf_dir))


@BOOK.add("tx_confirmations", sql.cte(CURSORS, sql.TX) + LATEST + """
SELECT tx_hash, status, greatest(confirmations, latest_block - block_number + 1) AS confirmations,
       'https://etherscan.io/tx/' || tx_hash AS explorer_url
FROM tx, head""")
def tx_confirmations(spark, sf_dir):
    tx = views.transactions(spark, sf_dir)
    out = cp.with_confirmations(tx, cp.latest_block(tx, cursors(spark, sf_dir)))
    return cp.with_explorer_url(out).select("tx_hash", "status", "confirmations", "explorer_url")


@BOOK.add("tx_events", sql.cte(CURSORS, sql.TX) + LATEST + """
SELECT t.tx_hash, t.sender, nullif(t.recipient, '') AS recipient, t.status,
       greatest(t.confirmations, latest_block - t.block_number + 1) AS confirmations,
       e.token AS contract_address, e.log_index
FROM head, tx t LEFT JOIN transfers e ON e.tx_hash = t.tx_hash""")
def tx_events(spark, sf_dir):
    tx = views.transactions(spark, sf_dir)
    ledger = decode.ledger_rows(
        views.transfers(spark, sf_dir).withColumn("event_name", F.lit("Transfer")), decode.transfer_json()
    )
    return reads.transaction_view(tx, ledger, cursors(spark, sf_dir)).select(
        "tx_hash", "sender", "recipient", "status", "confirmations", "contract_address", "log_index"
    )


@BOOK.add("tx_by_hash", sql.cte(sql.TX) + f"""
SELECT tx_hash, sender, nullif(recipient, '') AS recipient, gas_used FROM tx
WHERE tx_hash = {sql.hash_('26')}""")
def tx_by_hash(spark, sf_dir):
    tx = "0x" + format(26, "064X")
    return filters.transaction(views.transactions(spark, sf_dir), tx).select(
        "tx_hash", "sender", "recipient", "gas_used"
    )


@BOOK.add("events_of_tx", sql.cte(sql.TRANSFERS) + f"""
SELECT token AS contract_address, log_index FROM transfers WHERE tx_hash = {sql.hash_('26')}""")
def events_of_tx(spark, sf_dir):
    ledger = decode.ledger_rows(
        views.transfers(spark, sf_dir).withColumn("event_name", F.lit("Transfer")), decode.transfer_json()
    )
    return filters.events_of_tx(ledger, "0x" + format(26, "064x")).select("contract_address", "log_index")


# --- streams' state --------------------------------------------------------------

@BOOK.add("sync_status", sql.cte(CURSORS) + f"""
SELECT stream_id, CASE WHEN starts_with(stream_id, 'erc20_transfers_0x') THEN substr(stream_id, 17)
            ELSE '{TOKEN}' END AS token,
       last_indexed_block, m - last_indexed_block AS lag,
       CASE WHEN m - last_indexed_block > 10 THEN 'catching_up'
            WHEN m - last_indexed_block > 0 THEN 'syncing' ELSE 'synced' END AS status,
       m AS latest_block, m - 5 AS safe_block
FROM cursors, (SELECT max(last_indexed_block) AS m FROM cursors)""")
def sync_status(spark, sf_dir):
    return cp.sync_status(cursors(spark, sf_dir), 5, TOKEN).drop("chain_id")


@BOOK.add("safe_blocks", sql.cte(sql.TRANSFERS) + """
SELECT token, tx_hash, log_index, block_number FROM transfers
WHERE block_number <= (SELECT max(block_number) FROM transfers) - 400""")
def safe_blocks(spark, sf_dir):
    """Only rows below the head by the confirmation depth."""
    t = views.transfers(spark, sf_dir)
    head = t.agg(F.max("block_number").alias("b")).select(
        blk.safe_head(F.col("b"), 400, "zero").alias("safe")
    )
    return t.filter(F.col("block_number") <= head.scalar()).select(
        "token", "tx_hash", "log_index", "block_number"
    )


@BOOK.add("split_ranges", sql.cte(CURSORS) + """,
spans AS (SELECT stream_id, CASE WHEN stream_id = 'monthly_payroll' THEN 0 ELSE 11000000 END AS lo,
                 last_indexed_block AS hi FROM cursors)
SELECT stream_id, f AS chunk_from, least(f + 49, hi) AS chunk_to
FROM (SELECT stream_id, hi, unnest(range(lo, hi + 1, 50)) AS f FROM spans)""")
def split_ranges(spark, sf_dir):
    """Each stream's whole range in chunks of 50 blocks."""
    spans = cursors(spark, sf_dir).select(
        "stream_id",
        F.when(F.col("stream_id") == "monthly_payroll", 0).otherwise(11_000_000).cast("long").alias("lo"),
        F.col("last_indexed_block").alias("hi"),
    )
    return blk.split_ranges(spans, "lo", "hi", 50).select("stream_id", "chunk_from", "chunk_to")


@BOOK.add("resume_points", sql.cte(CURSORS) + """
SELECT stream_id, greatest(last_indexed_block + 1, 11002000) AS clamped, last_indexed_block + 1 AS plain
FROM cursors""")
def resume_points(spark, sf_dir):
    last = F.col("last_indexed_block")
    return cursors(spark, sf_dir).select(
        "stream_id",
        blk.resume_block(last, F.lit(11_002_000)).alias("clamped"),
        blk.resume_block(last, F.lit(11_002_000), clamp=False).alias("plain"),
    )


@BOOK.add("audit_targets", sql.cte(CURSORS) + """
SELECT stream_id, CASE WHEN least(m - 100, last_indexed_block) >= 5000
                       THEN least(m - 100, last_indexed_block) END AS target
FROM cursors, (SELECT max(last_indexed_block) AS m FROM cursors)""")
def audit_targets(spark, sf_dir):
    """Block a balance audit of each stream may look at; NULL means skip."""
    c = cursors(spark, sf_dir)
    head = cp.max_checkpoint(c).scalar()
    safe = blk.safe_head(F.col("head"), 100, "none")
    return c.withColumn("head", head).select(
        "stream_id",
        blk.effective_target(F.lit(0), safe, F.col("last_indexed_block"), F.lit(5000)).alias("target"),
    )


@BOOK.add("dedup_deliveries", """
WITH RECURSIVE d AS (
  SELECT l_orderkey AS k, l_linenumber AS n, l_shipdate AS t FROM lineitem),
accepted AS (
  SELECT k, n, min(t) AS t FROM d GROUP BY k, n
  UNION ALL
  SELECT a.k, a.n, (SELECT min(d.t) FROM d WHERE d.k = a.k AND d.n = a.n
                    AND d.t >= a.t + INTERVAL 30 DAY) AS t
  FROM accepted a WHERE a.t IS NOT NULL)
SELECT k, n, strftime(t, '%Y-%m-%d') AS t FROM accepted WHERE t IS NOT NULL""")
def dedup_deliveries(spark, sf_dir):
    """First delivery of a log wins for 30 days; later ones are let through again."""
    rows = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
        F.col("l_shipdate").cast("timestamp").alias("t"),
    )
    return dedup_exact(rows, ["k", "n"], "t", "30 days").select(
        "k", "n", F.date_format("t", "yyyy-MM-dd").alias("t")
    )


def _placed(rows):
    """A sorted, bounded list with each row's place in it."""
    at = rows.withColumn("_at", F.monotonically_increasing_id())
    return at.withColumn("place", F.row_number().over(Window.orderBy("_at"))).drop("_at")


RANGE = (11_001_500, 11_001_520)


@BOOK.add("transfers_of_range", sql.cte(sql.TRANSFERS) + f"""
SELECT tx_hash, log_index, token, removed, CAST(block_number AS BIGINT) AS block_number,
       CAST(row_number() OVER (ORDER BY block_number, log_index, tx_hash, token) AS INTEGER) AS place
FROM transfers WHERE block_number BETWEEN {RANGE[0]} AND {RANGE[1]}""")
def transfers_of_range(spark, sf_dir):
    """Audit read of a block range in chain order; removed rows are in it."""
    rows = views.transfers(spark, sf_dir).withColumn("id", F.concat("tx_hash", "token"))
    read = filters.in_range(rows, views.CHAIN, *RANGE)
    return _placed(read).select("tx_hash", "log_index", "token", "removed", "block_number", "place")


@BOOK.add("claims_of_range", sql.cte(sql.PAYROLL) + """
SELECT employee, CAST(cents AS VARCHAR) AS amount, tx_hash, block_number,
       CAST(row_number() OVER (ORDER BY block_number, log_index, tx_hash) AS INTEGER) AS place
FROM payroll WHERE event_name = 'SalaryClaimed' AND block_number BETWEEN 100 AND 900""")
def claims_of_range(spark, sf_dir):
    claims = fold.claim_rows(views.payroll_events(spark, sf_dir)).withColumn("id", F.col("tx_hash"))
    read = _placed(filters.in_range(claims, views.CHAIN, 100, 900))
    return read.select("employee", u256.to_string(F.col("amount")).alias("amount"), "tx_hash", "block_number", "place")


@BOOK.add("employer_profile_sorted", sql.cte(STAFF) + f"""
SELECT wallet AS employee, strftime(added_at, '%Y-%m-%d %H:%M:%S') AS employee_added_at,
       CAST(row_number() OVER (ORDER BY added_at DESC NULLS LAST, wallet) AS INTEGER) AS place
FROM employees WHERE employer = '{EMPLOYER}'""")
def employer_profile_sorted(spark, sf_dir):
    """The staff of one employer, newest first, those without a date last."""
    events = views.payroll_events(spark, sf_dir)
    profile = reads.employer_profile(fold.fold_employers(events), fold.fold_employees(events), EMPLOYER)
    return _placed(profile.orderBy(*reads.profile_order())).select("employee", _time("employee_added_at"), "place")


@BOOK.add("relevant_addresses_sorted", sql.cte(sql.TRANSFERS) + f""",
a AS (SELECT from_address AS address FROM transfers UNION SELECT to_address FROM transfers)
SELECT address, CAST(row_number() OVER (ORDER BY address) AS INTEGER) AS place FROM a WHERE address <> {sql.ZERO}""")
def relevant_addresses_sorted(spark, sf_dir):
    none = views.payroll_events(spark, sf_dir).limit(0)
    every = bal.relevant_addresses(views.transfers(spark, sf_dir), none, none)
    return _placed(bal.in_address_order(every)).select("address", "place")


@BOOK.add("ownership_events", f"""
SELECT {sql.addr('s_suppkey')} AS previous_owner, {sql.addr('s_nationkey + 500')} AS new_owner, {sql.hash_('s_suppkey')} AS tx_hash,
       s_suppkey AS block_number, true AS kept, (SELECT count(*) FROM (SELECT DISTINCT user_id FROM events WHERE
         event_type IN ('signup', 'error', 'purchase') OR event_type NOT IN ('view', 'signup', 'error', 'purchase'))) AS staff
FROM supplier""")
def ownership_events(spark, sf_dir):
    """Ownership changes stay in the ledger and change no projection."""
    payroll = views.payroll_logs(spark, sf_dir)
    owned = views.ownership_logs(spark, sf_dir)
    ledger = decode.decode_payroll(payroll.unionByName(owned, allowMissingColumns=True))
    staff = fold.rebuild(ledger)["employees"].agg(F.count("*").alias("n"))
    kept = ledger.filter(F.col("event_name") == "OwnershipTransferred")
    return kept.select("previous_owner", "new_owner", "tx_hash", "block_number", (~F.col("removed")).alias("kept"), staff.scalar().alias("staff"))


@BOOK.add("tx_events_stored", sql.cte(CURSORS, sql.TX) + LATEST + """
SELECT t.tx_hash, t.sender, nullif(t.recipient, '') AS recipient, t.status,
       greatest(t.confirmations, latest_block - t.block_number + 1) AS confirmations,
       e.token AS contract_address, e.log_index
FROM head, tx t LEFT JOIN transfers e ON e.tx_hash = t.tx_hash""")
def tx_events_stored(spark, sf_dir):
    """The transaction view over stored tables in the layout of the join: no exchange below it."""
    root = scratch_path(spark, "stored")
    stored = stored_ledger(spark, sf_dir, root)
    # the cursors stand where the stored transfers end; the deliveries are not folded again for them
    seen = stored["chain_events"].select("chain_id", F.col("contract_address").alias("token"), "block_number")
    return reads.transaction_events(stored["transactions"], stored["chain_events"], cursors(spark, sf_dir, seen)).select(
        "tx_hash", "sender", "recipient", "status", "confirmations", "contract_address", "log_index"
    )


BUCKET_BYTES = 16 << 20


def stored_ledger(spark, sf_dir, root: str) -> dict:
    """Transactions and their ledger rows as bucketed tables, under names of their own."""
    ledger = decode.ledger_rows(
        views.transfers(spark, sf_dir).withColumn("event_name", F.lit("Transfer")), decode.transfer_json()
    )
    suffix = root.rsplit("-", 1)[1]
    # a bucket is sorted and joined by one task: their number grows with the deliveries
    buckets = max(8, estimated_bytes(views.table(spark, sf_dir, "lineitem")) // BUCKET_BYTES)
    return {
        name: tables.store(spark, df, name, f"{name}_{suffix}", f"{root}/{name}", buckets=buckets)
        for name, df in (("transactions", views.transactions(spark, sf_dir)), ("chain_events", ledger))
    }


@BOOK.add("stored_tables_read", sql.cte(sql.TX) + """,
d AS (SELECT CAST(11000000 + date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS b FROM lineitem)
SELECT b AS block_number, count(DISTINCT tx_hash) AS transactions,
       CAST(count(DISTINCT tx_hash) FILTER (status = 'failed') AS BIGINT) AS failed
FROM (SELECT DISTINCT b FROM d) LEFT JOIN tx ON tx.block_number = b GROUP BY b""")
def stored_tables_read(spark, sf_dir):
    """Typed scans of stored headers and transactions: what each known block holds."""
    root = scratch_path(spark, "tables")
    views.blocks(spark, sf_dir).write.parquet(f"{root}/blocks")
    views.transactions(spark, sf_dir).write.parquet(f"{root}/transactions")
    headers = tables.scan_blocks(spark, f"{root}/blocks")
    sent = tables.tables(spark, root).transactions
    known = tables.scan_transactions(spark, f"{root}/transactions").filter(F.col("status") == "failed")
    failed = known.groupBy("block_number").agg(F.count("*").alias("failed"))
    sent = sent.groupBy("block_number").agg(F.count("*").alias("transactions")).join(failed, "block_number", "left")
    rows = headers.select("block_number").join(sent, "block_number", "left")
    return rows.select("block_number", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("transactions", "failed")])
