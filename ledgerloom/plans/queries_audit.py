"""Reconciliation of stored rows against authoritative ones, with seeded faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evm, u256
from ..operators import balances as bal
from ..operators import decode, fold
from ..operators import reconcile as rec
from ..operators import asof
from ..session import durable, scratch_path
from ..sources.tables import as_flag, contract_state_at
from . import faults, sql, views
from .book import Book

BOOK = Book()
TOKEN = "0x" + format(2, "040x")
CONTRACT = "0x" + format(7, "040x")
FIRST, LAST = 11_000_500, 11_002_000
TARGET = 11_002_200


def _cursor(rows):
    """Block at nine tenths of the covered range, as a scalar subquery."""
    low, high = F.min("block_number"), F.max("block_number")
    return rows.select((low + F.floor((high - low) * 9 / 10)).cast("long").alias("c")).scalar()


def _transfer_audit(spark, sf_dir, live=None, **options):
    live = faults.live_transfers(spark, sf_dir) if live is None else live
    stored = faults.observed_transfers(live)
    arguments = {"first": None, "last": None, "safe": 99_999_999, "cursor": _cursor(live), **options}
    return rec.audit_events(rec.TRANSFER, live, stored, **arguments)


def _of(kind):
    return F.col("type") == f"TOKEN_TRANSFER_{kind}"


REF = "l.chain_id || ':' || l.token || ':' || l.tx_hash || ':' || l.log_index || ':"
HEAD = (
    '\'{"chain_id":1,"from_address":"\' || l.from_address'
    ' || \'","log_index":\' || l.log_index || \',"to_address":"\' || l.to_address'
    ' || \'","token":"\' || l.token || \'","tx_hash":"\' || l.tx_hash || \'"}\''
)
FIRSTS = """,
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token, tx_hash, log_index
           ORDER BY block_number, id) AS r FROM observed) WHERE r = 1)"""
JOIN = "FROM live l JOIN firsts o ON o.token = l.token AND o.tx_hash = l.tx_hash AND o.log_index = l.log_index"

MISSING_SQL = f"""
SELECT 'TOKEN_TRANSFER_MISSING' AS type, 'high' AS severity, {REF}missing' AS entity_ref,
  '{{"amount":"' || l.amount || '","block_number":' || l.block_number || ',"chain_id":1,"from_address":"'
  || l.from_address || '","log_index":' || l.log_index || ',"to_address":"' || l.to_address
  || '","token":"' || l.token || '","tx_hash":"' || l.tx_hash || '"}}' AS expected,
  '{{"status":"not_found"}}' AS observed
FROM live l, cut WHERE l.n % 97 = 0 AND l.block_number <= cursor"""
ENTITY_SQL = f"""
SELECT 'TOKEN_TRANSFER_ENTITY_MISMATCH' AS type, 'critical' AS severity, {REF}entity_mismatch' AS entity_ref,
  '{{"block_number":' || l.block_number || ',"chain_id":1,"from_address":"' || l.from_address
  || '","log_index":' || l.log_index || ',"to_address":"' || l.to_address || '","token":"' || l.token
  || '","tx_hash":"' || l.tx_hash || '"}}' AS expected,
  '{{"from_address":"' || o.from_address || '","to_address":"' || o.to_address || '"}}' AS observed
{JOIN} WHERE l.from_address <> o.from_address OR l.to_address <> o.to_address"""
AMOUNT_SQL = f"""
SELECT 'TOKEN_TRANSFER_AMOUNT_MISMATCH' AS type, 'high' AS severity, {REF}amount_mismatch' AS entity_ref,
  '{{"amount":"' || l.amount || '","block_number":' || l.block_number || ',"chain_id":1,"from_address":"'
  || l.from_address || '","log_index":' || l.log_index || ',"to_address":"' || l.to_address
  || '","token":"' || l.token || '","tx_hash":"' || l.tx_hash || '"}}' AS expected,
  '{{"amount":"' || o.amount || '"}}' AS observed
{JOIN} WHERE l.amount <> o.amount"""
BLOCK_SQL = f"""
SELECT 'TOKEN_TRANSFER_TX_INCONSISTENCY' AS type, 'medium' AS severity, {REF}tx_inconsistency' AS entity_ref,
  '{{"block_number":' || l.block_number || ',"chain_id":1,"log_index":' || l.log_index || ',"token":"'
  || l.token || '","tx_hash":"' || l.tx_hash || '"}}' AS expected,
  '{{"block_number":' || o.block_number || ',"tx_hash":"' || o.tx_hash || '"}}' AS observed
{JOIN} WHERE l.block_number <> o.block_number"""
DUPLICATE_SQL = f"""
SELECT 'TOKEN_TRANSFER_DUPLICATE' AS type, 'high' AS severity, {REF}duplicate' AS entity_ref,
  '{{"block_number":' || l.block_number || ',"chain_id":1,"count":1,"log_index":' || l.log_index
  || ',"token":"' || l.token || '","tx_hash":"' || l.tx_hash || '"}}' AS expected,
  '{{"count":' || count(*) || '}}' AS observed
FROM observed l GROUP BY l.chain_id, l.token, l.tx_hash, l.log_index, l.block_number HAVING count(*) > 1"""


def _register(name, kind, text):
    @BOOK.add(name, sql.cte(faults.TRANSFERS + FIRSTS) + text)
    def run(spark, sf_dir):
        return _transfer_audit(spark, sf_dir).filter(_of(kind)).select(
            "type", "severity", "entity_ref", "expected", "observed"
        )

    return run


recon_missing = _register("recon_missing", "MISSING", MISSING_SQL)
recon_entity = _register("recon_entity", "ENTITY_MISMATCH", ENTITY_SQL)
recon_amount = _register("recon_amount", "AMOUNT_MISMATCH", AMOUNT_SQL)
recon_block = _register("recon_block", "TX_INCONSISTENCY", BLOCK_SQL)
recon_duplicates = _register("recon_duplicates", "DUPLICATE", DUPLICATE_SQL)

ALL_SQL = " UNION ALL ".join([MISSING_SQL, ENTITY_SQL, AMOUNT_SQL, BLOCK_SQL, DUPLICATE_SQL])


@BOOK.add("recon_transfers", sql.cte(faults.TRANSFERS + FIRSTS) + ALL_SQL)
def recon_transfers(spark, sf_dir):
    """Every class of every token in one plan."""
    return _transfer_audit(spark, sf_dir).select("type", "severity", "entity_ref", "expected", "observed")


IN_RANGE = faults.TRANSFERS.replace(
    "live AS (SELECT *, order_key AS n FROM transfers WHERE NOT removed)",
    f"live0 AS (SELECT *, order_key AS n FROM transfers WHERE NOT removed AND token = '{TOKEN}'),\n"
    f"live AS (SELECT * FROM live0 WHERE block_number BETWEEN {FIRST} AND {LAST})",
).replace("FROM live, (VALUES", "FROM live0 live, (VALUES").replace("FROM live)", "FROM live0)")
IN_RANGE_ROWS = IN_RANGE + f""",
stored AS (SELECT * FROM observed WHERE block_number BETWEEN {FIRST} AND {LAST}),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token, tx_hash, log_index
           ORDER BY block_number, id) AS r FROM stored) WHERE r = 1),
found AS (
  SELECT 'MISSING' AS type, {REF}missing' AS entity_ref
  FROM live l LEFT JOIN firsts o ON o.tx_hash = l.tx_hash AND o.log_index = l.log_index
  WHERE o.id IS NULL AND l.block_number <= {LAST - 300}
  UNION ALL SELECT 'ENTITY_MISMATCH', {REF}entity_mismatch'
  FROM live l JOIN firsts o ON o.tx_hash = l.tx_hash AND o.log_index = l.log_index
  WHERE o.to_address <> l.to_address
  UNION ALL SELECT 'AMOUNT_MISMATCH', {REF}amount_mismatch'
  FROM live l JOIN firsts o ON o.tx_hash = l.tx_hash AND o.log_index = l.log_index
  WHERE o.amount <> l.amount
  UNION ALL SELECT 'TX_INCONSISTENCY', {REF}tx_inconsistency'
  FROM live l JOIN firsts o ON o.tx_hash = l.tx_hash AND o.log_index = l.log_index
  WHERE o.block_number <> l.block_number
  UNION ALL SELECT 'DUPLICATE', {REF}duplicate' FROM stored l
  GROUP BY l.chain_id, l.token, l.tx_hash, l.log_index HAVING count(*) > 1)"""


def _window_audit(spark, sf_dir, live=None):
    """One token, one block range, cursor 300 blocks behind its end."""
    return _transfer_audit(
        spark, sf_dir, live, first=FIRST, last=LAST, safe=LAST, cursor=LAST - 300, token=TOKEN
    )


@BOOK.add("recon_window", sql.cte(IN_RANGE_ROWS) + "SELECT 'TOKEN_TRANSFER_' || type AS type, entity_ref FROM found")
def recon_window(spark, sf_dir):
    return _window_audit(spark, sf_dir).select("type", "entity_ref")


@BOOK.add("recon_phantoms", sql.cte(faults.TRANSFERS) + f"""
SELECT DISTINCT {REF}phantom' AS entity_ref FROM observed l WHERE l.n % 3 = 0""")
def recon_phantoms(spark, sf_dir):
    """Stored rows whose log is gone: the authoritative side lost every third order."""
    live = faults.live_transfers(spark, sf_dir)
    found = rec.audit_events(
        rec.TRANSFER, live.filter(F.col("n") % 3 != 0), faults.observed_transfers(live), first=None, last=None,
        safe=99_999_999, cursor=99_999_999, phantoms=True,
    )
    return found.filter(_of("PHANTOM")).select("entity_ref")


@BOOK.add("recon_duplicate_ids", sql.cte(faults.TRANSFERS) + f"""
SELECT {REF}duplicate' AS entity_ref, l.id AS record_id FROM observed l WHERE l.n % 73 = 0""")
def recon_duplicate_ids(spark, sf_dir):
    stored = rec.stored_rows(
        rec.TRANSFER, faults.observed_transfers(faults.live_transfers(spark, sf_dir))
    )
    return rec.duplicate_ids(rec.TRANSFER, stored)


def _payroll_audit(spark, sf_dir, family, kind):
    decoded = decode.decode_payroll(views.payroll_logs(spark, sf_dir)).filter(F.col("event_name") == kind)
    return rec.audit_events(
        family, decoded, faults.observed_payroll(spark, sf_dir, kind), first=None, last=None,
        safe=99_999_999, cursor=_cursor(decoded),
    ).select("type", "severity", "entity_ref", "expected", "observed")


def _payroll_sql(prefix: str, entity: dict, amounts: dict, observed_amounts: dict, amount_context: dict) -> str:
    """Oracle of a payroll family; the dictionaries map JSON names to SQL values."""
    ref = "l.chain_id || ':' || l.tx_hash || ':' || l.log_index || ':"
    key = {"chain_id": "l.chain_id", "tx_hash": "l.tx_hash", "log_index": "l.log_index"}
    block = {"block_number": "l.block_number"}

    def json(fields: dict) -> str:
        inside = ", ".join(f'"{k}" := {fields[k]}' for k in sorted(fields))
        return f"CAST(to_json(struct_pack({inside})) AS VARCHAR)"

    def text(fields: dict) -> dict:
        return {k: f"CAST({v} AS VARCHAR)" for k, v in fields.items()}

    o_entity = {k: v.replace("l.", "o.") for k, v in entity.items()}
    join = "FROM live l JOIN firsts o ON o.tx_hash = l.tx_hash AND o.log_index = l.log_index"
    amounts, observed_amounts = text(amounts), text(observed_amounts)
    return f""",
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tx_hash, log_index
           ORDER BY block_number, id) AS r FROM observed) WHERE r = 1)
SELECT '{prefix}_MISSING' AS type, 'high' AS severity, {ref}missing' AS entity_ref,
  {json({**key, **block, **entity, **amounts})} AS expected, '{{"status":"not_found"}}' AS observed
FROM live l, cut WHERE l.n % 17 = 0 AND l.block_number <= cursor
UNION ALL
SELECT '{prefix}_ENTITY_MISMATCH', 'critical', {ref}entity_mismatch',
  {json({**key, **block, **entity})}, {json(o_entity)} {join} WHERE l.employee <> o.employee
UNION ALL
SELECT '{prefix}_AMOUNT_MISMATCH', 'high', {ref}amount_mismatch',
  {json({**key, **block, **amount_context, **amounts})}, {json(observed_amounts)}
{join} WHERE l.faulty <> o.faulty
UNION ALL
SELECT '{prefix}_TX_INCONSISTENCY', 'medium', {ref}tx_inconsistency',
  {json({**key, **block})}, {json({"block_number": "o.block_number"})}
{join} WHERE l.block_number <> o.block_number
UNION ALL
SELECT '{prefix}_DUPLICATE', 'high', {ref}duplicate',
  {json({**key, **block, "count": "1"})},
  '{{"count":' || count(*) || '}}'
FROM observed l GROUP BY l.chain_id, l.tx_hash, l.log_index, l.block_number HAVING count(*) > 1"""


@BOOK.add("recon_fundings", sql.cte(faults.payroll_sql("PayrollFunded")) + _payroll_sql(
    "PAYROLL_FUNDING", {"employer": "l.employer", "employee": "l.employee"},
    {"amount_paid": "l.cents", "fee": "l.cents // 100", "amount_credited": "l.cents - l.cents // 100"},
    {"amount_paid": "o.cents", "fee": "o.faulty", "amount_credited": "o.cents - o.cents // 100"}, {}))
def recon_fundings(spark, sf_dir):
    return _payroll_audit(spark, sf_dir, rec.FUNDING, "PayrollFunded")


@BOOK.add("recon_claims", sql.cte(faults.payroll_sql("SalaryClaimed")) + _payroll_sql(
    "SALARY_CLAIM", {"employee": "l.employee"}, {"amount": "l.cents"}, {"amount": "o.faulty"},
    {"employee": "l.employee"}))
def recon_claims(spark, sf_dir):
    return _payroll_audit(spark, sf_dir, rec.CLAIM, "SalaryClaimed")


# --- lifecycle -------------------------------------------------------------------

def _earlier_exceptions(live):
    """Left by earlier runs: real missing rows (97), healed amounts (101), both open,
    and amounts (89) that were closed before and are wrong again now."""
    rows = live.filter(F.col("token") == TOKEN)
    n = F.col("n")

    def make(when, kind, suffix, status, shift):
        ref = F.concat_ws(":", F.lit("1"), "token", "tx_hash", F.col("log_index").cast("string"), F.lit(suffix))
        return rows.filter(when).select(
            ((n * 8 + F.col("log_index")) * 4 + shift).alias("id"),
            F.lit(f"TOKEN_TRANSFER_{kind}").alias("type"),
            F.lit("high").alias("severity"),
            ref.alias("entity_ref"),
            evm.json_object(block_number=F.col("block_number")).alias("expected"),
            F.lit("{}").alias("observed"),
            F.lit(status).alias("status"),
            F.lit("2024-01-01").cast("timestamp").alias("detected_at"),
            F.lit(None).cast("timestamp").alias("resolved_at"),
        )

    return (
        make(n % 97 == 0, "MISSING", "missing", "open", 0)
        .unionByName(make(n % 101 == 0, "AMOUNT_MISMATCH", "amount_mismatch", "open", 1))
        .unionByName(make((n % 89 == 0) & (n % 101 != 0), "AMOUNT_MISMATCH", "amount_mismatch", "resolved", 2))
    )


EARLIER = IN_RANGE_ROWS + f""",
earlier AS (
  SELECT 'MISSING' AS type, {REF}missing' AS entity_ref, 'open' AS status, l.block_number FROM live0 l WHERE n % 97 = 0
  UNION ALL SELECT 'AMOUNT_MISMATCH', {REF}amount_mismatch', 'open', l.block_number FROM live0 l WHERE n % 101 = 0
  UNION ALL SELECT 'AMOUNT_MISMATCH', {REF}amount_mismatch', 'resolved', l.block_number FROM live0 l
  WHERE n % 89 = 0 AND n % 101 <> 0),
opens AS (SELECT * FROM earlier WHERE status = 'open'),
outcomes AS (
  SELECT entity_ref, CASE WHEN entity_ref IN (SELECT entity_ref FROM opens) THEN 'skipped'
                          ELSE 'created' END AS outcome, type FROM found
  UNION ALL
  SELECT entity_ref, 'resolved', type FROM opens
  WHERE block_number BETWEEN {FIRST} AND {LAST} AND entity_ref NOT IN (SELECT entity_ref FROM found))"""


def _lifecycle(spark, sf_dir, live=None, found=None):
    live = faults.live_transfers(spark, sf_dir) if live is None else live
    found = durable(_window_audit(spark, sf_dir, live)) if found is None else found
    scope = rec.in_scope(rec.TRANSFER, views.CHAIN, FIRST, LAST, TOKEN)
    return rec.apply_lifecycle(_earlier_exceptions(live), found, scope)


@BOOK.add("recon_lifecycle", sql.cte(EARLIER) + "SELECT entity_ref, outcome FROM outcomes")
def recon_lifecycle(spark, sf_dir):
    return _lifecycle(spark, sf_dir).marks


@BOOK.add("recon_exceptions_after", sql.cte(EARLIER) + """
SELECT 'TOKEN_TRANSFER_' || e.type AS type, e.entity_ref,
       CASE WHEN e.status = 'open' AND e.entity_ref IN
         (SELECT entity_ref FROM outcomes WHERE outcome = 'resolved') THEN 'resolved' ELSE e.status END AS status
FROM earlier e
UNION ALL
SELECT 'TOKEN_TRANSFER_' || type, entity_ref, 'open' FROM outcomes WHERE outcome = 'created'""")
def recon_exceptions_after(spark, sf_dir):
    return _lifecycle(spark, sf_dir).exceptions.select("type", "entity_ref", "status")


@BOOK.add("recon_summary", sql.cte(EARLIER) + """
SELECT (SELECT count(*) FROM live) AS on_chain_events, (SELECT count(*) FROM stored) AS db_records,
       (SELECT count(*) FROM found) AS mismatches_detected,
       count(*) FILTER (outcome = 'created') AS exceptions_created,
       count(*) FILTER (outcome = 'resolved') AS exceptions_resolved,
       count(*) FILTER (outcome = 'skipped') AS exceptions_skipped
FROM outcomes""")
def recon_summary(spark, sf_dir):
    live = faults.live_transfers(spark, sf_dir)
    chain_rows = rec.authoritative_rows(rec.TRANSFER, live, FIRST, LAST, TOKEN)
    stored = rec.stored_rows(rec.TRANSFER, faults.observed_transfers(live), FIRST, LAST, TOKEN)
    found = durable(_window_audit(spark, sf_dir, live))
    return rec.summary(chain_rows, stored, found, _lifecycle(spark, sf_dir, live, found).marks)


@BOOK.add("exceptions_page", sql.cte(EARLIER) + """
SELECT type, entity_ref, status FROM (
  SELECT 'TOKEN_TRANSFER_' || type AS type, entity_ref, status, block_number,
         (n * 8 + li) * 4 + CASE WHEN type = 'MISSING' THEN 0 WHEN status = 'open' THEN 1 ELSE 2 END AS id
  FROM (SELECT e.*, l.n, l.log_index AS li FROM earlier e JOIN live0 l
        ON e.entity_ref LIKE '%' || l.tx_hash || ':' || l.log_index || ':%')
  WHERE status = 'open' ORDER BY id DESC LIMIT 20)""")
def exceptions_page(spark, sf_dir):
    """Open exceptions sorted by severity (all equal), newest id first."""
    from ..operators import reads

    out = reads.list_exceptions(_earlier_exceptions(faults.live_transfers(spark, sf_dir)), status="OPEN", sort="severity")
    return out.rows.select("type", "entity_ref", "status")


@BOOK.add("exceptions_by_prefix", sql.cte(EARLIER) + f"""
SELECT entity_ref FROM earlier WHERE status = 'open' AND starts_with(entity_ref, '1:{TOKEN}:')""")
def exceptions_by_prefix(spark, sf_dir):
    from ..operators import filters

    return filters.open_by_prefix(_earlier_exceptions(faults.live_transfers(spark, sf_dir)), f"1:{TOKEN}:").select("entity_ref")


# --- balances and states ---------------------------------------------------------

def _addresses(spark, sf_dir, stored):
    events = views.payroll_events(spark, sf_dir)
    return bal.relevant_addresses(
        stored, fold.funding_rows(events), fold.claim_rows(events), TARGET, CONTRACT, views.CHAIN
    ).withColumn("token", F.lit(TOKEN))


def _balance_snapshots(live, addresses):
    """balanceOf of every address at two blocks, from the authoritative transfers."""
    live = live.withColumn("removed", F.lit(False)).filter(F.col("token") == TOKEN)

    def at(block):
        return bal.balances_of(live, addresses, block).select(
            "chain_id", F.col("token").alias("contract"), F.col("address").alias("wallet"),
            F.lit("balance_of").alias("property"), F.lit(block).cast("long").alias("block_number"),
            F.col("balance").alias("value"),
        )

    return at(TARGET - 700).unionByName(at(TARGET))


def _stored_transfers(live):
    stored = faults.observed_transfers(live).withColumn("removed", F.lit(False))
    return stored.filter(F.col("token") == TOKEN)


BALANCE_SQL = faults.TRANSFERS + "," + sql.PAYROLL + f""",
chain AS (SELECT address, sum(d) AS v FROM (
  SELECT to_address AS address, amount AS d FROM live WHERE token = '{TOKEN}' AND block_number <= {TARGET}
  UNION ALL SELECT from_address, -amount FROM live WHERE token = '{TOKEN}' AND block_number <= {TARGET})
  GROUP BY address),
db AS (SELECT address, sum(d) AS v FROM (
  SELECT to_address AS address, amount AS d FROM observed WHERE token = '{TOKEN}' AND block_number <= {TARGET}
  UNION ALL SELECT from_address, -amount FROM observed WHERE token = '{TOKEN}' AND block_number <= {TARGET})
  GROUP BY address),
people AS (SELECT DISTINCT address FROM (
  SELECT from_address AS address FROM observed WHERE token = '{TOKEN}' AND block_number <= {TARGET}
  UNION SELECT to_address FROM observed WHERE token = '{TOKEN}' AND block_number <= {TARGET}
  UNION SELECT employer FROM payroll WHERE event_name = 'PayrollFunded'
  UNION SELECT employee FROM payroll WHERE event_name IN ('PayrollFunded', 'SalaryClaimed')
  UNION SELECT '{CONTRACT}') WHERE address <> {sql.ZERO}),
sides AS (SELECT p.address, coalesce(c.v, 0) AS c, coalesce(d.v, 0) AS d
          FROM people p LEFT JOIN chain c ON c.address = p.address LEFT JOIN db d ON d.address = p.address)"""


def _balance_rows_sql(kind, ref, who, names, where):
    return f"""
SELECT '{kind}' AS type, 'high' AS severity, {ref} AS entity_ref, c = d AS matches,
  CAST(to_json(struct_pack({_sorted_pack({names[0]: 'CAST(c AS VARCHAR)', 'target_block': str(TARGET), who: 'address', 'token': f"'{TOKEN}'"})})) AS VARCHAR) AS expected,
  CAST(to_json(struct_pack({_sorted_pack({names[1]: 'CAST(d AS VARCHAR)', 'difference': 'CAST(c - d AS VARCHAR)', 'target_block': str(TARGET), who: 'address', 'token': f"'{TOKEN}'"})})) AS VARCHAR) AS observed
FROM sides {where}"""


def _sorted_pack(fields: dict) -> str:
    return ", ".join(f'"{k}" := {fields[k]}' for k in sorted(fields))


@BOOK.add("balance_audit", sql.cte(BALANCE_SQL) + _balance_rows_sql(
    "TOKEN_BALANCE_MISMATCH", f"'1:{TOKEN}:' || address || ':token_balance_mismatch'", "wallet",
    ("on_chain_balance", "db_balance"), ""))
def balance_audit(spark, sf_dir):
    live = faults.live_transfers(spark, sf_dir)
    stored = _stored_transfers(live)
    addresses = _addresses(spark, sf_dir, stored)
    reads = rec.state_at(_balance_snapshots(live, addresses), "balance_of", TARGET).select(
        "chain_id", F.col("contract").alias("token"), F.col("wallet").alias("address"),
        F.col("value").alias("balance"),
    )
    matched = rec.match_balances(addresses, bal.token_balances(stored, TARGET), reads)
    return rec.audit_balances(matched, TARGET).drop("block_number")


@BOOK.add("contract_balance_audit", sql.cte(BALANCE_SQL) + _balance_rows_sql(
    "CONTRACT_BALANCE_MISMATCH", f"'1:' || address || ':{TOKEN}:contract_balance_mismatch'", "contract",
    ("on_chain_contract_balance", "db_contract_balance"), f"WHERE address = '{CONTRACT}'"))
def contract_balance_audit(spark, sf_dir):
    live = faults.live_transfers(spark, sf_dir)
    stored = _stored_transfers(live)
    account = spark.range(1).select(
        F.lit(views.CHAIN).cast("long").alias("chain_id"), F.lit(TOKEN).alias("token"),
        F.lit(CONTRACT).alias("address"),
    )
    db = bal.wallet_balance(stored, TOKEN, CONTRACT, TARGET).select(
        F.lit(views.CHAIN).cast("long").alias("chain_id"), F.lit(TOKEN).alias("token"), "address", "balance"
    )
    reads = rec.state_at(_balance_snapshots(live, account), "balance_of", TARGET).select(
        "chain_id", F.col("contract").alias("token"), F.col("wallet").alias("address"),
        F.col("value").alias("balance"),
    )
    matched = rec.match_balances(account, db, reads)
    return rec.audit_contract_balance(matched, TARGET).drop("block_number")


def _state_snapshots(spark, sf_dir, fold_fn):
    """Active flags read early and late; the late read is wrong for wallets ending in 3."""
    events = views.payroll_events(spark, sf_dir)

    def at(rows, block, flip):
        flag = F.col("active") != flip
        return fold_fn(rows).select(
            "chain_id", F.lit(views.PAYROLL_CONTRACT).alias("contract"), "wallet",
            F.lit("is_active").alias("property"), F.lit(block).cast("long").alias("block_number"),
            u256.pack(F.lit(0), F.lit(0), flag.cast("int")).alias("value"),
        )

    early = at(events.filter(F.col("block_number") < 100), 99, F.lit(False))
    return early.unionByName(at(events, 900_000, F.right("wallet", F.lit(1)) == "3"))


def _state_sql(prop: str, table: str) -> str:
    from .queries_payroll import STAFF

    return sql.cte(STAFF) + f"""
SELECT 'CONTRACT_STATE_MISMATCH' AS type, 'medium' AS severity,
  '1:' || {sql.PAYROLL_CONTRACT} || ':' || wallet || ':{prop}:state_mismatch' AS entity_ref,
  right(wallet, 1) <> '3' AS matches,
  '{{"on_chain_value":' || (active <> (right(wallet, 1) = '3')) || ',"property":"{prop}","target_block":900000,"wallet":"'
  || wallet || '"}}' AS expected,
  '{{"db_value":' || active || ',"property":"{prop}","target_block":900000,"wallet":"' || wallet || '"}}' AS observed
FROM {table}"""


def _state_audit(spark, sf_dir, prop, fold_fn):
    reads = as_flag(rec.state_at(_state_snapshots(spark, sf_dir, fold_fn), "is_active", 900_000))
    projection = fold_fn(views.payroll_events(spark, sf_dir))
    return rec.audit_states(projection, reads, prop, views.PAYROLL_CONTRACT, 900_000).drop("block_number")


STATES_SQL = f"""
reads AS (SELECT {sql.addr('o_orderkey % 4 + 1')} AS contract, {sql.addr('o_custkey % 97')} AS wallet,
                 CAST(11000000 + {sql.days('o_orderdate')} AS BIGINT) AS b, CAST(round(o_totalprice * 100) AS BIGINT) AS v
          FROM orders WHERE o_orderkey % 3 = 0),
targets AS (SELECT c_custkey AS ask, {sql.addr('c_custkey % 4 + 1')} AS contract, {sql.addr('c_custkey % 97')} AS wallet,
                   CAST(11000000 + (c_custkey * 7 + k * 611) % 2500 AS BIGINT) AS b
            FROM customer, (SELECT unnest(range(4)) AS k)),
near AS (SELECT ask, t.contract, t.wallet, t.b, max(r.b) FILTER (r.b <= t.b) AS back, min(r.b) FILTER (r.b >= t.b) AS ahead
         FROM targets t LEFT JOIN reads r ON r.contract = t.contract AND r.wallet = t.wallet GROUP BY ALL),
best AS (SELECT contract, wallet, b, CAST(max(v) AS VARCHAR) AS v FROM reads GROUP BY ALL)"""


@BOOK.add("states_asof", sql.cte(STATES_SQL) + """
SELECT DISTINCT ask, n.b AS block_number, CASE WHEN n.b - back <= 20 THEN p.v END AS before,
       CASE WHEN n.b - back <= 20 THEN back END AS before_at, f.v AS after, ahead AS after_at
FROM near n LEFT JOIN best p ON p.contract = n.contract AND p.wallet = n.wallet AND p.b = back
LEFT JOIN best f ON f.contract = n.contract AND f.wallet = n.wallet AND f.b = ahead""")
def states_asof(spark, sf_dir):
    """Stored contract reads before (20 blocks at most) and after four target blocks of every customer's wallet."""
    path = scratch_path(spark, "contract_state")
    chain, cents = F.lit(views.CHAIN).cast("long").alias("chain_id"), F.round(F.col("o_totalprice") * 100).cast("long")
    key = F.col("o_orderkey")
    views.table(spark, sf_dir, "orders").filter(key % 3 == 0).select(
        chain, evm.address_of(key % 4 + 1).alias("contract"), evm.address_of(F.col("o_custkey") % 97).alias("wallet"),
        F.lit("balance_of").alias("property"), (views._days("o_orderdate") + 11_000_000).alias("block_number"),
        u256.pack(F.lit(0), F.lit(0), cents).alias("value"),
    ).write.parquet(path)
    ask = F.col("c_custkey")
    targets = views.table(spark, sf_dir, "customer").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        ask.alias("ask"), chain, evm.address_of(ask % 4 + 1).alias("contract"), evm.address_of(ask % 97).alias("wallet"),
        ((ask * 7 + F.col("k") * 611) % 2500 + 11_000_000).cast("long").alias("block_number"),
    ).distinct()
    before = contract_state_at(spark, path, "balance_of", targets, tolerance=20)
    before = before.withColumnsRenamed({"value": "before", "block_number_found": "before_at"})
    both = contract_state_at(spark, path, "balance_of", before, direction="forward")
    return both.select(
        "ask", "block_number", u256.to_string(F.col("before")).alias("before"), "before_at",
        u256.to_string(F.col("value")).alias("after"), F.col("block_number_found").alias("after_at"),
    )


@BOOK.add("balance_audit_targets", sql.cte(sql.MOVEMENTS) + f""",
spans AS (SELECT address, min(block_number) AS low, max(block_number) AS high FROM movements WHERE token = '{TOKEN}' GROUP BY address),
targets AS (SELECT address, low + k * (high - low) // 3 AS b FROM spans, (SELECT unnest(range(4)) AS k)),
db AS (SELECT t.address, t.b, sum(delta) AS d FROM targets t JOIN movements m
       ON m.token = '{TOKEN}' AND m.address = t.address AND m.block_number <= t.b GROUP BY ALL),
chain AS (SELECT address, b, d + CASE WHEN right(address, 1) = '3' AND b % 2 = 0 THEN 1 ELSE 0 END AS c, d FROM db)
SELECT address, b AS block_number, CAST(c AS VARCHAR) AS on_chain, CAST(d AS VARCHAR) AS db FROM chain WHERE c <> d""")
def balance_audit_targets(spark, sf_dir):
    """Wallets audited at four blocks each in one run: stored balances as of, against reads as of."""
    transfers = views.transfers(spark, sf_dir)
    moves = bal.movements(transfers, keep_zero=True).filter(F.col("token") == TOKEN)
    spans = moves.groupBy("chain_id", "token", "address").agg(F.min("block_number").alias("low"), F.max("block_number").alias("high"))
    step = F.floor(F.col("k") * (F.col("high") - F.col("low")) / 3).cast("long")
    targets = spans.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).select(
        "chain_id", "token", "address", (F.col("low") + step).alias("block_number")
    ).distinct()
    stored = asof.balances_asof(transfers, targets)
    off = ((F.right("address", F.lit(1)) == "3") & (F.col("block_number") % 2 == 0)).cast("int")
    lo = F.col("balance")["lo"].cast(u256.WIDE) + off
    reads = stored.select(
        "chain_id", "token", "address", "block_number", u256.normalise_parts(F.col("balance")["hi"], F.col("balance")["mid"].cast(u256.WIDE), lo).alias("on_chain")
    )
    both = asof.asof_join(stored, reads, ["chain_id", "token", "address"], "block_number", ["on_chain"], tolerance=0)
    wrong = both.filter(F.col("on_chain") != F.col("balance"))
    return wrong.select(
        "address", "block_number", u256.to_signed_string(F.col("on_chain")).alias("on_chain"), u256.to_signed_string(F.col("balance")).alias("db")
    )


@BOOK.add("state_audit_employees", _state_sql("is_employee_active", "employees"))
def state_audit_employees(spark, sf_dir):
    return _state_audit(spark, sf_dir, "is_employee_active", fold.fold_employees)


@BOOK.add("state_audit_employers", _state_sql("is_employer_active", "employers"))
def state_audit_employers(spark, sf_dir):
    return _state_audit(spark, sf_dir, "is_employer_active", fold.fold_employers)


@BOOK.add("state_audit_lifecycle", _state_sql("is_employee_active", "employees").replace(
    "SELECT 'CONTRACT_STATE_MISMATCH' AS type", "SELECT outcome, count(*) AS n FROM (SELECT CASE "
    "WHEN right(wallet, 1) = '3' AND wallet LIKE '%13' THEN 'skipped' WHEN right(wallet, 1) = '3' THEN 'created' "
    "WHEN wallet LIKE '%15' THEN 'resolved' END AS outcome, 'CONTRACT_STATE_MISMATCH' AS type", 1)
    + ") WHERE outcome IS NOT NULL GROUP BY outcome")
def state_audit_lifecycle(spark, sf_dir):
    """Exceptions open for wallets ending in 13 (still wrong) and 15 (right again)."""
    checked = _state_audit(spark, sf_dir, "is_employee_active", fold.fold_employees).withColumn(
        "block_number", F.lit(900_000).cast("long")
    )
    wallet = F.get_json_object("expected", "$.wallet")
    earlier = checked.filter(wallet.endswith("13") | wallet.endswith("15")).select(
        F.xxhash64("entity_ref").alias("id"), "type", "severity", "entity_ref", "expected", "observed",
        F.lit("open").alias("status"), F.lit("2024-01-01").cast("timestamp").alias("detected_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )
    done = rec.apply_lifecycle(earlier, checked.filter(~F.col("matches")), checked.filter("matches"))
    return done.marks.groupBy("outcome").agg(F.count("*").alias("n"))


_AFTER = EARLIER + """,
after AS (
  SELECT e.type, e.entity_ref, CASE WHEN e.status = 'open' AND e.entity_ref IN
    (SELECT entity_ref FROM outcomes WHERE outcome = 'resolved') THEN 'resolved' ELSE e.status END AS status FROM earlier e
  UNION ALL SELECT type, entity_ref, 'open' FROM outcomes WHERE outcome = 'created')"""


def _created(exceptions):
    return exceptions.filter(F.col("detected_at") > F.lit("2024-01-02").cast("timestamp"))


@BOOK.add("exceptions_created", sql.cte(EARLIER) + """
SELECT count(*) AS n, count(*) AS ids, count(DISTINCT entity_ref) AS entities FROM outcomes WHERE outcome = 'created'""")
def exceptions_created(spark, sf_dir):
    """Every exception a run opens has an id of its own."""
    opened = _created(_lifecycle(spark, sf_dir).exceptions)
    return opened.agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("entity_ref").alias("entities")
    )


@BOOK.add("exceptions_resolved_by_id", sql.cte(_AFTER) + """
SELECT 'TOKEN_TRANSFER_' || type AS type, entity_ref,
       CASE WHEN type = 'MISSING' AND entity_ref IN (SELECT entity_ref FROM outcomes WHERE outcome = 'created')
            THEN 'resolved' ELSE status END AS status FROM after""")
def exceptions_resolved_by_id(spark, sf_dir):
    """The missing rows of a run, closed by the ids the run gave them."""
    after = durable(_lifecycle(spark, sf_dir).exceptions)
    ids = _created(after).filter(_of("MISSING")).select("id")
    return rec.resolve_exceptions(after, ids).select("type", "entity_ref", "status")


@BOOK.add("open_exception_of_ref", sql.cte(_AFTER) + """
SELECT 'TOKEN_TRANSFER_' || type AS type, entity_ref, status FROM after
WHERE status = 'open' AND entity_ref = (SELECT min(entity_ref) FROM after WHERE status = 'open')""")
def open_exception_of_ref(spark, sf_dir):
    from ..operators import filters as flt

    after = durable(_lifecycle(spark, sf_dir).exceptions)
    ref = after.filter("status = 'open'").agg(F.min("entity_ref")).first()[0] or ""
    return flt.open_exception(after, ref).select("type", "entity_ref", "status")


@BOOK.add("exceptions_filtered", sql.cte(EARLIER) + """
SELECT 'TOKEN_TRANSFER_' || type AS type, entity_ref FROM earlier WHERE type = 'MISSING' AND status = 'open'""")
def exceptions_filtered(spark, sf_dir):
    """By severity, status, type and time of detection, each in another case than stored."""
    from ..operators import filters as flt

    rows = _earlier_exceptions(faults.live_transfers(spark, sf_dir))
    late = rows.withColumn("detected_at", F.lit("2025-06-01").cast("timestamp"))
    both = rows.unionByName(late)
    return flt.exceptions_where(
        both, "HIGH", "Open", "token_transfer_missing", "2023-12-31", "2024-12-31"
    ).select("type", "entity_ref")


@BOOK.add("exception_enum_violations", sql.cte(EARLIER) + """
SELECT 'reconciliation_exceptions.severity' AS rule, entity_ref AS ref, 'urgent' AS value FROM earlier WHERE block_number % 3 = 0
UNION ALL
SELECT 'reconciliation_exceptions.status', entity_ref, 'waiting' FROM earlier WHERE block_number % 5 = 0""")
def exception_enum_violations(spark, sf_dir):
    """Exceptions with a severity or a status that there is not."""
    from ..operators import quality

    block = F.get_json_object("expected", "$.block_number").cast("long")
    rows = _earlier_exceptions(faults.live_transfers(spark, sf_dir)).withColumns({
        "severity": F.when(block % 3 == 0, "urgent").otherwise(F.col("severity")),
        "status": F.when(block % 5 == 0, "waiting").otherwise(F.col("status")),
    })
    return quality.check_enums(exceptions=rows)


# --- runs --------------------------------------------------------------------------

_BALANCE_ROWS = _balance_rows_sql(
    "TOKEN_BALANCE_MISMATCH", f"'1:{TOKEN}:' || address || ':token_balance_mismatch'", "wallet",
    ("on_chain_balance", "db_balance"), "")


def _no_exceptions(spark):
    return spark.createDataFrame([], rec.EXCEPTION_SCHEMA)


def _balance_run(spark, sf_dir, exceptions=None, live=None, **plan):
    live = faults.live_transfers(spark, sf_dir) if live is None else live
    stored = _stored_transfers(live)

    def checks(block):
        addresses = _addresses(spark, sf_dir, stored)
        reads = rec.state_at(_balance_snapshots(live, addresses), "balance_of", block).select(
            "chain_id", F.col("contract").alias("token"), F.col("wallet").alias("address"),
            F.col("value").alias("balance"),
        )
        matched = rec.match_balances(addresses, bal.token_balances(stored, block), reads)
        return [rec.audit_balances(matched, block)]

    exceptions = _no_exceptions(spark) if exceptions is None else exceptions
    return rec.reconcile_balances(checks, exceptions, depth=12, start=11_000_000, **plan)


@BOOK.add("balance_run_next", sql.cte(BALANCE_SQL) + f"""
SELECT entity_ref, 'created' AS outcome, CAST({TARGET} AS BIGINT) AS cursor FROM ({_BALANCE_ROWS}) WHERE NOT matches""")
def balance_run_next(spark, sf_dir):
    """The next batch after the audit cursor; its target becomes the cursor."""
    run = _balance_run(
        spark, sf_dir, latest=TARGET + 5000, mode="next", token_cursor=TARGET + 900, recon_cursor=TARGET - 50, batch=50
    )
    return run.lifecycle.marks.select("entity_ref", "outcome", F.lit(run.target).cast("long").alias("cursor"))


@BOOK.add("balance_run_recent", sql.cte(BALANCE_SQL) + f""",
checked AS ({_BALANCE_ROWS}), open_ AS (SELECT entity_ref FROM checked WHERE right(entity_ref, 25) LIKE '%0:token_balance_mismatch')
SELECT entity_ref, CASE WHEN matches THEN 'resolved' WHEN entity_ref IN (SELECT entity_ref FROM open_) THEN 'skipped'
                        ELSE 'created' END AS outcome
FROM checked WHERE NOT matches OR entity_ref IN (SELECT entity_ref FROM open_)""")
def balance_run_recent(spark, sf_dir):
    """The recent window, limited by the token cursor, over exceptions that are already open."""
    live = faults.live_transfers(spark, sf_dir)
    rows = _balance_run(spark, sf_dir, live=live, latest=TARGET + 12, mode="target", token_cursor=TARGET, target=TARGET).checked
    open_ = rows.filter(F.col("entity_ref").endswith("0:token_balance_mismatch")).select(
        F.lit(1).cast("long").alias("id"), "type", "severity", "entity_ref", "expected", "observed", F.lit("open").alias("status"),
        F.lit("2024-01-01").cast("timestamp").alias("detected_at"), F.lit(None).cast("timestamp").alias("resolved_at"),
    )
    run = _balance_run(
        spark, sf_dir, durable(open_), live, latest=TARGET + 800 + 12, mode="recent", token_cursor=TARGET, window=100
    )
    return run.lifecycle.marks.select("entity_ref", "outcome")


def _counted(family: str, cursor: int, text: str) -> str:
    return f"""SELECT '{family}' AS family, CAST({cursor} AS BIGINT) AS cursor, count(*) AS mismatches,
  count(DISTINCT entity_ref) AS created, CAST(0 AS BIGINT) AS resolved, CAST(0 AS BIGINT) AS skipped FROM ({text})"""


END = 99_999_987


@BOOK.add("combined_run_summary", " UNION ALL ".join([
    _counted("payroll", END, BOOK["recon_fundings"].sql), _counted("claims", END, BOOK["recon_claims"].sql),
    _counted("token", END, BOOK["recon_transfers"].sql),
    _counted("balance", TARGET, sql.cte(BALANCE_SQL) + f"SELECT * FROM ({_BALANCE_ROWS}) WHERE NOT matches")]))
def combined_run_summary(spark, sf_dir):
    """All four families in one run, each over its own rows."""

    def events(family, decoded, stored):
        return lambda: rec.reconcile_events(
            family, decoded, stored, _no_exceptions(spark), chain_id=views.CHAIN, latest=END + 12, depth=12, start=0,
            mode="range", bounds=(0, END), ingest_cursor=_cursor(decoded),
        )

    def payroll(family, kind):
        decoded = decode.decode_payroll(views.payroll_logs(spark, sf_dir)).filter(F.col("event_name") == kind)
        return events(family, decoded, faults.observed_payroll(spark, sf_dir, kind))

    live = faults.live_transfers(spark, sf_dir)
    done = rec.reconcile_all({
        "payroll": payroll(rec.FUNDING, "PayrollFunded"),
        "claims": payroll(rec.CLAIM, "SalaryClaimed"),
        "token": events(rec.TRANSFER, live, faults.observed_transfers(live)),
        "balance": lambda: _balance_run(
            spark, sf_dir, live=live, latest=TARGET + 12, mode="target", token_cursor=TARGET, target=TARGET
        ),
    })
    return rec.combined_summary(done)
