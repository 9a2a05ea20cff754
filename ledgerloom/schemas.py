"""Table schemas, keys and which columns an update may change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .functions.u256 import U256


def _s(*fields) -> T.StructType:
    kinds = {
        "s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(),
        "b": T.BooleanType(), "t": T.TimestampType(), "u": U256,
        "a": T.ArrayType(T.StringType()),
    }
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split(":") for f in fields)])


LOGS = _s(
    "chain_id:l", "address:s", "topic0:s", "topics:a", "data:s", "block_number:l",
    "tx_hash:s", "log_index:i", "removed:b",
)
BLOCKS = _s("chain_id:l", "block_number:l", "hash:s", "parent_hash:s", "timestamp:l")
TRANSACTIONS = _s(
    "tx_hash:s", "chain_id:l", "block_number:l", "sender:s", "recipient:s", "gas_used:l",
    "status:s", "confirmations:l", "error_data:s", "first_seen_at:t", "finalized_at:t",
)
EMPLOYERS = _s(
    "chain_id:l", "wallet:s", "funds:u", "total_salary_per_second:u", "active:b",
    "deactivation_time:l", "added_at:t", "removed_at:t", "latest_tx_hash:s",
)
EMPLOYEES = _s(
    "chain_id:l", "wallet:s", "employer:s", "salary_per_second:u", "last_withdraw:l", "active:b",
    "total_leaves:u", "deactivation_time:l", "allocation:u", "added_at:t", "removed_at:t",
    "latest_tx_hash:s",
)
CHAIN_EVENTS = _s(
    "event_id:l", "chain_id:l", "contract_address:s", "event_name:s", "tx_hash:s",
    "block_number:l", "block_timestamp:t", "log_index:i", "removed:b", "raw_data:s",
    "created_at:t",
)
FUNDINGS = _s(
    "id:l", "chain_id:l", "employer:s", "employee:s", "amount_paid:u", "fee:u",
    "amount_credited:u", "tx_hash:s", "block_number:l", "block_timestamp:t", "log_index:i",
)
CLAIMS = _s(
    "id:l", "chain_id:l", "employee:s", "amount:u", "tx_hash:s", "block_number:l",
    "block_timestamp:t", "log_index:i",
)
TRANSFERS = _s(
    "id:l", "chain_id:l", "token:s", "from_address:s", "to_address:s", "amount:u", "tx_hash:s",
    "block_number:l", "block_timestamp:t", "log_index:i", "removed:b", "created_at:t",
)
ESCROW_EVENTS = _s(
    "id:l", "chain_id:l", "contract_address:s", "event_type:s", "tx_hash:s", "block_number:l",
    "block_timestamp:t", "log_index:i", "removed:b", "escrow_id:u", "amount:u", "raw_data:s",
    "created_at:t",
)
CHECKPOINTS = _s(
    "chain_id:l", "stream_id:s", "last_indexed_block:l", "last_block_hash:s", "updated_at:t"
)
EXCEPTIONS = _s(
    "id:l", "type:s", "severity:s", "entity_ref:s", "expected:s", "observed:s", "status:s",
    "detected_at:t", "resolved_at:t",
)
CONTRACT_STATE = _s(
    "chain_id:l", "contract:s", "wallet:s", "property:s", "block_number:l", "value:u"
)

_LOG = T.StructType(
    [
        T.StructField("transactionHash", T.StringType()),
        T.StructField("logIndex", T.IntegerType()),
        T.StructField("transactionIndex", T.IntegerType()),
        T.StructField("blockNumber", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("account", T.StructType([T.StructField("address", T.StringType())])),
        T.StructField("removed", T.BooleanType()),
    ]
)
DELIVERY = T.StructType(
    [
        T.StructField("webhookId", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("createdAt", T.TimestampType()),
        T.StructField("type", T.StringType()),
        T.StructField(
            "event",
            T.StructType(
                [
                    T.StructField(
                        "data",
                        T.StructType(
                            [
                                T.StructField(
                                    "block",
                                    T.StructType(
                                        [
                                            T.StructField("number", T.StringType()),
                                            T.StructField("hash", T.StringType()),
                                            T.StructField("timestamp", T.StringType()),
                                            T.StructField("logs", T.ArrayType(_LOG)),
                                        ]
                                    ),
                                )
                            ]
                        ),
                    )
                ]
            ),
        ),
    ]
)

SCHEMAS = {
    "logs": LOGS, "blocks": BLOCKS, "transactions": TRANSACTIONS, "employers": EMPLOYERS,
    "employees": EMPLOYEES, "chain_events": CHAIN_EVENTS, "payroll_fundings": FUNDINGS,
    "salary_claims": CLAIMS, "token_transfers": TRANSFERS, "escrow_events": ESCROW_EVENTS,
    "sync_checkpoints": CHECKPOINTS, "reconciliation_exceptions": EXCEPTIONS,
    "contract_state": CONTRACT_STATE,
}


@dataclass(frozen=True)
class WriteRule:
    """Key of a table and, on a repeated key, whose value each column keeps."""

    keys: tuple[str, ...]
    first_wins: tuple[str, ...]
    last_wins: tuple[str, ...]


LOG_KEY = ("chain_id", "contract_address", "tx_hash", "log_index")

# Keys and update rules of the stored tables.
RULES = {
    "transactions": WriteRule(
        ("chain_id", "tx_hash"),
        ("first_seen_at", "confirmations"),
        ("block_number", "sender", "recipient", "gas_used", "status"),
    ),
    "chain_events": WriteRule(
        LOG_KEY, ("event_name", "block_number", "raw_data"), ("removed", "block_timestamp")
    ),
    "token_transfers": WriteRule(
        ("chain_id", "token", "tx_hash", "log_index"),
        ("from_address", "to_address", "amount", "block_number"),
        ("removed", "block_timestamp"),
    ),
    "escrow_events": WriteRule(
        LOG_KEY,
        ("block_number", "created_at"),
        ("event_type", "removed", "block_timestamp", "escrow_id", "amount", "raw_data"),
    ),
    "escrow_events_single": WriteRule(
        LOG_KEY,
        ("event_type", "escrow_id", "block_number", "created_at"),
        ("removed", "block_timestamp", "amount", "raw_data"),
    ),
    "payroll_fundings": WriteRule(
        ("chain_id", "tx_hash", "log_index"),
        ("employer", "employee", "amount_paid", "fee", "amount_credited", "block_number",
         "block_timestamp"),
        (),
    ),
    "salary_claims": WriteRule(
        ("chain_id", "tx_hash", "log_index"),
        ("employee", "amount", "block_number", "block_timestamp"),
        (),
    ),
    "sync_checkpoints": WriteRule(
        ("chain_id", "stream_id"), (), ("last_indexed_block", "last_block_hash", "updated_at")
    ),
}
