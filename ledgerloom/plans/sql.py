"""Shared fragments of the oracle SQL: the views of :mod:`.views` in DuckDB's dialect.

The oracle is written the other way round where it can be: window functions for
the ordered folds, UNION ALL for the exploded legs, HUGEINT for the limbs.
"""

from __future__ import annotations

ZERO = "'0x" + "0" * 40 + "'"


def addr(n: str) -> str:
    return f"('0x' || lpad(lower(to_hex(CAST({n} AS BIGINT))), 40, '0'))"


def hash_(n: str) -> str:
    return f"('0x' || lpad(lower(to_hex(CAST({n} AS BIGINT))), 64, '0'))"


def ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def epoch(column: str) -> str:
    return f"CAST(floor(epoch({column})) AS BIGINT)"


def days(column: str) -> str:
    return f"date_diff('day', DATE '1992-01-01', CAST({column} AS DATE))"


PAYROLL_CONTRACT = "'0x" + format(7777, "040x") + "'"
ESCROW_CONTRACT = "'0x" + format(8888, "040x") + "'"

DELIVERIES = f"""
deliveries AS (
  SELECT CAST(1 AS BIGINT) AS chain_id,
         {addr('l_suppkey % 4 + 1')} AS token,
         {addr('l_suppkey % 97')} AS from_address,
         {addr('l_partkey % 97')} AS to_address,
         CAST(round(l_extendedprice * 100) AS HUGEINT) AS amount,
         {hash_('l_orderkey')} AS tx_hash,
         l_linenumber AS log_index,
         CAST(11000000 + {days('l_shipdate')} AS BIGINT) AS block_number,
         l_shipdate AS block_timestamp,
         l_returnflag = 'R' AS removed,
         l_orderkey AS order_key,
         row_number() OVER w AS arrival,
         count(*) OVER (PARTITION BY l_suppkey % 4, l_orderkey, l_linenumber) AS copies
  FROM lineitem
  WINDOW w AS (PARTITION BY l_suppkey % 4, l_orderkey, l_linenumber
               ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                        l_discount, l_tax, l_returnflag, l_linestatus)
)"""

TRANSFERS = f"""{DELIVERIES},
transfers AS (
  SELECT f.chain_id, f.token, f.tx_hash, f.log_index, f.from_address, f.to_address, f.amount,
         f.block_number, l.removed, l.block_timestamp, f.order_key
  FROM deliveries f JOIN deliveries l
    ON f.token = l.token AND f.tx_hash = l.tx_hash AND f.log_index = l.log_index
  WHERE f.arrival = 1 AND l.arrival = l.copies
)"""

MOVEMENTS = f"""{TRANSFERS},
movements AS (
  SELECT chain_id, token, to_address AS address, amount AS delta, block_number, log_index,
         tx_hash, 0 AS debit
  FROM transfers WHERE NOT removed
  UNION ALL
  SELECT chain_id, token, from_address, -amount, block_number, log_index, tx_hash, 1
  FROM transfers WHERE NOT removed
)"""

_E = "event_type"
PAYROLL = f"""
payroll AS (
  SELECT *,
         CASE WHEN event_name IN ('EmployerAdded','EmployerRemoved','EmployeeAdded',
                                  'EmployeeRemoved','PayrollFunded') THEN employer_all END AS employer,
         CASE WHEN event_name IN ('EmployeeAdded','EmployeeRemoved','PayrollFunded',
                                  'SalaryClaimed') THEN employee_all END AS employee
  FROM (
    SELECT CAST(1 AS BIGINT) AS chain_id,
           CASE WHEN {_E} = 'view' AND event_id % 5 = 0 THEN 'EmployerRemoved'
                WHEN {_E} = 'view' THEN 'EmployerAdded'
                WHEN {_E} = 'signup' THEN 'EmployeeAdded'
                WHEN {_E} = 'error' THEN 'EmployeeRemoved'
                WHEN {_E} = 'purchase' THEN 'PayrollFunded'
                ELSE 'SalaryClaimed' END AS event_name,
           {addr('user_id % 10 + 1')} AS employer_all,
           {addr('user_id + 1000')} AS employee_all,
           CAST(round(value * 100) AS BIGINT) AS cents,
           {hash_('event_id')} AS tx_hash,
           event_id AS block_number, ts AS block_timestamp, CAST(0 AS INTEGER) AS log_index
    FROM events)
)"""

ESCROW = f"""
escrow AS (
  SELECT CAST(1 AS BIGINT) AS chain_id, {ESCROW_CONTRACT} AS contract_address,
         'EscrowCreated' AS event_type, o_orderkey AS escrow_number,
         {addr('o_custkey')} AS buyer, {addr('o_orderkey % 97')} AS seller,
         CAST(round(o_totalprice * 100) AS BIGINT) AS value,
         {hash_('o_orderkey * 2')} AS tx_hash, CAST(0 AS INTEGER) AS log_index,
         CAST(12000000 + {days('o_orderdate')} AS BIGINT) AS block_number,
         o_orderdate AS created_at, false AS removed
  FROM orders
  UNION ALL
  SELECT 1, {ESCROW_CONTRACT},
         CASE o_orderkey % 5 WHEN 0 THEN 'EscrowReleased' WHEN 1 THEN 'EscrowRefunded'
              WHEN 2 THEN 'DisputeResolved' WHEN 3 THEN 'DeliveryAcknowledged'
              ELSE 'DisputeRaised' END,
         o_orderkey, {addr('o_custkey')}, {addr('o_orderkey % 97')},
         CASE WHEN o_orderkey % 5 < 2 THEN CAST(round(o_totalprice * 100) AS BIGINT)
              WHEN o_orderkey % 5 = 2 THEN CAST(round(o_totalprice * 100) AS BIGINT) // 2
              WHEN o_orderkey % 5 = 3 THEN {epoch('o_orderdate')}
              ELSE CAST(round(o_totalprice * 100) AS BIGINT) // 100 END,
         {hash_('o_orderkey * 2 + 1')}, 1,
         CAST(12000000 + {days('o_orderdate')} + 1 + o_orderkey % 7 AS BIGINT), o_orderdate,
         o_orderstatus = 'P'
  FROM orders
)"""

# escrow_id, amount and raw JSON as the decoder must give them
ESCROW_DECODED = f"""{ESCROW},
escrow_decoded AS (
  SELECT chain_id, contract_address, event_type, tx_hash, log_index, block_number, removed,
         created_at, CAST(escrow_number AS VARCHAR) AS escrow_id,
         CASE WHEN event_type NOT IN ('DeliveryAcknowledged', 'DisputeRaised')
              THEN CAST(value AS VARCHAR) END AS amount,
         CASE event_type
           WHEN 'EscrowCreated' THEN '{{"amount":"' || value || '","buyer":"' || buyer
                || '","escrowId":"' || escrow_number || '","seller":"' || seller || '"}}'
           WHEN 'DisputeResolved' THEN '{{"amount":"' || value || '","amountReleased":"' || value
                || '","escrowId":"' || escrow_number || '","winner":"' || buyer || '"}}'
           WHEN 'DeliveryAcknowledged' THEN '{{"deliveryTime":"' || value || '","escrowId":"'
                || escrow_number || '"}}'
           WHEN 'DisputeRaised' THEN '{{"disputeFee":"' || value || '","escrowId":"'
                || escrow_number || '","raisedBy":"' || seller || '"}}'
           ELSE '{{"amount":"' || value || '","escrowId":"' || escrow_number || '"}}' END AS raw_data
  FROM escrow
)"""

TX = f"""
tx AS (
  SELECT {hash_('o_orderkey')} AS tx_hash, CAST(1 AS BIGINT) AS chain_id,
         CAST(11000000 + {days('o_orderdate')} AS BIGINT) AS block_number,
         {addr('o_custkey')} AS sender,
         CASE WHEN o_orderkey % 13 <> 0 THEN {addr('o_orderkey % 4 + 1')} ELSE '' END AS recipient,
         o_orderkey % 1000 + 21000 AS gas_used,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' ELSE 'confirmed' END AS status,
         CAST(1 AS BIGINT) AS confirmations, o_orderdate AS first_seen_at, o_orderkey AS order_key
  FROM orders
)"""


def cte(*parts: str) -> str:
    """WITH clause of the given fragments."""
    return "WITH " + ",".join(parts)
