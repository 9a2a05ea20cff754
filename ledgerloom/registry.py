"""Event registry: which topic means which event, and where its fields sit.

Rows of the same shape passed to :func:`event_registry` extend what dispatch knows
and what the checks look at; ``decode.decode_by_registry`` decodes by such rows alone, the
typed decoders are those of the built-in events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAYROLL, ESCROW, ERC20 = "payroll", "escrow", "erc20"


@dataclass(frozen=True)
class EventDef:
    family: str
    name: str
    topic0: str
    indexed: tuple[tuple[str, str], ...]  # (field, type) of topics[1..]
    data: tuple[tuple[str, str], ...]  # (field, type) of the 32-byte data words


# Topic hashes and field layout of the decoded contracts.
EVENTS: tuple[EventDef, ...] = (
    EventDef(
        PAYROLL, "EmployerAdded",
        "0x5a8f2961260f818d9667b25560811fd29da53292f5479e674f27c6f0db898fd4",
        (("employer", "address"),), (),
    ),
    EventDef(
        PAYROLL, "EmployerRemoved",
        "0xba41c03c14e5c6511d4d0b64cbef2f6f35c915bd15aee993def2d0f34e4492ed",
        (("employer", "address"),), (),
    ),
    EventDef(
        PAYROLL, "EmployeeAdded",
        "0x266a42fa6ee6753f3f82ed49557eac6c579e85b59ab82b8ad735952c75f13911",
        (("employee", "address"), ("employer", "address")),
        (("salary", "uint256"), ("allocation", "uint256")),
    ),
    EventDef(
        PAYROLL, "EmployeeRemoved",
        "0xd4716fe84fe9b9e8ad0e74be0042e8275c0d826a6d7aa655d88db0caa85c928f",
        (("employee", "address"), ("employer", "address")), (),
    ),
    EventDef(
        PAYROLL, "PayrollFunded",
        "0x21a7701ca573ef5b3dccc19c950e85341c6fc193ebf82c8938be418b56c93e79",
        (("employer", "address"), ("employee", "address")),
        (("amountPaid", "uint256"), ("fee", "uint256"), ("amountCredited", "uint256")),
    ),
    EventDef(
        PAYROLL, "SalaryClaimed",
        "0x07b0f419660716c996d55c94e77e89f46ad73e2952dd7affd063f8b8781c9e4c",
        (("employee", "address"),), (("amount", "uint256"),),
    ),
    EventDef(
        PAYROLL, "OwnershipTransferred",
        "0x8be0079c531659141344cd1fd0a4f28419497f9722a3daafe3b4186f6b6457e0",
        (("previousOwner", "address"), ("newOwner", "address")), (),
    ),
    EventDef(
        ESCROW, "EscrowCreated",
        "0x9405ad0a6208539879349284d71265479b1623846f70303da1f9890d6e8c10a7",
        (("escrowId", "uint256"), ("buyer", "address"), ("seller", "address")),
        (("amount", "uint256"),),
    ),
    EventDef(
        ESCROW, "EscrowReleased",
        "0x10ce17ae7e78eb775b13182ea618b201c2c81afc8fee55c287291f8686f17eac",
        (("escrowId", "uint256"),), (("amount", "uint256"),),
    ),
    EventDef(
        ESCROW, "EscrowRefunded",
        "0x8e09fed7623ad9f8d5a701dd9f3233197147d0043c564dfb1a6c0023ab568c20",
        (("escrowId", "uint256"),), (("amount", "uint256"),),
    ),
    EventDef(
        ESCROW, "DisputeResolved",
        "0xdf0baf5489595ea17a097d16827d60793e2f57f3b85a982e5d7e02838b841ee6",
        (("escrowId", "uint256"), ("winner", "address")), (("amountReleased", "uint256"),),
    ),
    EventDef(
        ESCROW, "DeliveryAcknowledged",
        "0x56f374d542ae03669d32ab9defbebfc87cfe94f6cf83f46cdb60822b744af892",
        (("escrowId", "uint256"),), (("deliveryTime", "uint256"),),
    ),
    EventDef(
        ESCROW, "DisputeRaised",
        "0xe0e58e9cc5ed7ef092d3e14cff6136d23ebf75a16cf3c8257ef8804811d8b0f3",
        (("escrowId", "uint256"), ("raisedBy", "address")), (("disputeFee", "uint256"),),
    ),
    EventDef(
        ERC20, "Transfer",
        "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef",
        (("from", "address"), ("to", "address")), (("value", "uint256"),),
    ),
    EventDef(
        ERC20, "Approval",
        "0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925",
        (("owner", "address"), ("spender", "address")), (("value", "uint256"),),
    ),
)

TOPIC = {e.name: e.topic0 for e in EVENTS}
BY_NAME = {e.name: e for e in EVENTS}

_SLOT = T.ArrayType(
    T.StructType([T.StructField("field", T.StringType()), T.StructField("type", T.StringType())])
)
SCHEMA = T.StructType(
    [
        T.StructField("family", T.StringType(), False),
        T.StructField("event_name", T.StringType(), False),
        T.StructField("topic0", T.StringType(), False),
        T.StructField("indexed", _SLOT, False),
        T.StructField("data", _SLOT, False),
    ]
)


def event_registry(spark: SparkSession, events=EVENTS) -> DataFrame:
    """The registry as a table; its size is the number of declared events."""
    rows = [(e.family, e.name, e.topic0, list(e.indexed), list(e.data)) for e in events]
    return spark.createDataFrame(rows, SCHEMA)


def validate_registry(registry: DataFrame) -> DataFrame:
    """Rows that break a registry rule, with the rule's name.

    A token contract needs a Transfer event with two indexed addresses and
    exactly one unsigned data word; topics must be unique 32-byte hashes.
    """
    shape = registry.filter(
        (F.col("family") == ERC20)
        & (F.col("event_name") == "Transfer")
        & ~(
            (F.size("indexed") >= 2)
            & (F.element_at("indexed", 1)["type"] == "address")
            & (F.element_at("indexed", 2)["type"] == "address")
            & (F.size("data") == 1)
            & (F.element_at("data", 1)["type"].startswith("uint"))
        )
    ).select("event_name", F.lit("transfer_shape").alias("rule"))
    bad_topic = registry.filter(~F.col("topic0").rlike("^0x[0-9a-f]{64}$")).select(
        "event_name", F.lit("topic_format").alias("rule")
    )
    doubled = (
        registry.groupBy("topic0")
        .agg(F.count("*").alias("n"), F.min("event_name").alias("event_name"))
        .filter("n > 1")
        .select("event_name", F.lit("topic_unique").alias("rule"))
    )
    no_transfer = (
        registry.agg(F.count_if(F.col("event_name") == "Transfer").alias("n"))
        .filter("n = 0")
        .select(F.lit("Transfer").alias("event_name"), F.lit("transfer_required").alias("rule"))
    )
    return shape.unionByName(bad_topic).unionByName(doubled).unionByName(no_transfer)
