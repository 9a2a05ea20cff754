"""Decoding of hand-made logs."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom import registry as reg
from ledgerloom.functions import u256
from ledgerloom.operators import decode
from ledgerloom.sources.deliveries import parse_deliveries, rejected_deliveries

A, B = "0x" + "a" * 40, "0x" + "b" * 40
MAX = 2**256 - 1


def pad(address):
    return "0x" + "0" * 24 + address[2:]


def word(n):
    return format(n, "064x")


def logs(spark, *rows, address=A):
    data = [(1, address, topics, data, 115, "0x" + word(i), i, False) for i, (topics, data) in enumerate(rows)]
    return spark.createDataFrame(
        data, "chain_id long, address string, topics array<string>, data string, block_number long, "
        "tx_hash string, log_index int, removed boolean")


@pytest.mark.parametrize("event,extra,value,amount,raw", [
    ("EscrowCreated", [A, B], 1000, "1000", {"amount": "1000", "buyer": A, "escrowId": "42", "seller": B}),
    ("EscrowReleased", [], 1000, "1000", {"amount": "1000", "escrowId": "42"}),
    ("EscrowRefunded", [], 1000, "1000", {"amount": "1000", "escrowId": "42"}),
    ("DisputeResolved", [B], 1000, "1000", {"amount": "1000", "amountReleased": "1000", "escrowId": "42", "winner": B}),
    ("DeliveryAcknowledged", [], 1700000000, None, {"deliveryTime": "1700000000", "escrowId": "42"}),
    ("DisputeRaised", [A], 50, None, {"disputeFee": "50", "escrowId": "42", "raisedBy": A}),
])
def test_escrow_events(spark, event, extra, value, amount, raw):
    topics = [reg.TOPIC[event], "0x" + word(42), *[pad(a) for a in extra]]
    out = decode.decode_escrow(logs(spark, (topics, "0x" + word(value)))).select(
        "*", u256.to_string(F.col("escrow_id")).alias("id"), u256.to_string(F.col("amount")).alias("a")).first()
    assert (out.event_type, out.id, out.a, out.raw) == (event, "42", amount, raw)


def test_escrow_without_id_topic_or_data(spark):
    out = decode.decode_escrow(logs(spark, ([reg.TOPIC["EscrowReleased"]], "0x"))).first()
    assert out.escrow_id is None and out.amount is None and out.raw == {}


def test_transfer_of_the_largest_value(spark):
    topics = [reg.TOPIC["Transfer"], pad(A), pad(B)]
    df = decode.decode_transfers(logs(spark, (topics, "0x" + word(MAX))))
    out = df.select("from_address", "to_address", u256.to_string(F.col("amount")).alias("v")).first()
    assert tuple(out) == (A, B, str(MAX))


def test_transfer_needs_topics_data_and_token(spark):
    t = reg.TOPIC["Transfer"]
    df = logs(spark, ([t, pad(A)], "0x" + word(1)), ([t, pad(A), pad(B)], "0x12"), ([t, pad(A), pad(B)], "0x" + word(1)))
    assert decode.decode_transfers(df).count() == 1
    assert decode.decode_transfers(df, token=A.upper().replace("X", "x")).count() == 1
    assert decode.decode_transfers(df, token=B).count() == 0


def test_payroll_words(spark):
    topics = [reg.TOPIC["PayrollFunded"], pad(A), pad(B)]
    out = decode.decode_payroll(logs(spark, (topics, "0x" + word(10**30) + word(5) + word(10**30 - 5)))).select(
        "employer", "employee", *[u256.to_string(F.col(c)).alias(c) for c in ("amount_paid", "fee", "amount_credited")]).first()
    assert tuple(out) == (A, B, str(10**30), "5", str(10**30 - 5))
    owner = decode.decode_payroll(logs(spark, ([reg.TOPIC["OwnershipTransferred"], pad(A), pad(B)], "0x"))).first()
    assert (owner.event_name, owner.previous_owner, owner.new_owner) == ("OwnershipTransferred", A, B)


def test_unknown_topics(spark):
    df = logs(spark, (["0x" + word(1)], "0x"))
    registry = reg.event_registry(spark)
    assert decode.classify_logs(df, registry, "skip").count() == 0
    assert decode.classify_logs(df, registry, "unknown").first().event_name == "Unknown"
    with pytest.raises(PySparkException, match="unknown event topic"):
        decode.classify_logs(df, registry, "fail").collect()


def test_registry_rules(spark):
    assert reg.validate_registry(reg.event_registry(spark)).count() == 0
    bad = [reg.EventDef(reg.ERC20, "Transfer", "0x12", (("from", "uint256"), ("to", "address")), ())]
    rules = sorted(r.rule for r in reg.validate_registry(reg.event_registry(spark, bad)).collect())
    assert rules == ["topic_format", "transfer_shape"]
    none = [e for e in reg.EVENTS if e.name != "Transfer"]
    assert [r.rule for r in reg.validate_registry(reg.event_registry(spark, none)).collect()] == ["transfer_required"]


def test_contract_filter(spark):
    df = spark.createDataFrame([(A.upper().replace("0X", "0x"), None), ("", A), ("", ""), (B, A)],
                               "address string, account_address string")
    assert decode.filter_contract(df, A).count() == 3
    assert decode.filter_contract(df, "0x" + "0" * 40).count() == 4
    assert decode.filter_contract(df, "").count() == 4


def test_malformed_deliveries_are_rejected(spark):
    good = '{"id":"1","createdAt":"2024-01-01T00:00:00Z","event":{"data":{"block":{"number":"7","logs":[{"transactionHash":"0x1","logIndex":3}]}}}}'
    hexed = good.replace('"logIndex":3', '"logIndex":"0x3"')
    df = spark.createDataFrame([(good,), (hexed,), ("not json",)], "value string")
    assert rejected_deliveries(df).count() == 2
    assert [r.log_index for r in parse_deliveries(df).collect()] == [3]
    absent = spark.createDataFrame([(good.replace(',"logIndex":3', ""),)], "value string")
    assert rejected_deliveries(absent).count() == 0 and parse_deliveries(absent).first().log_index == 0


def test_logs_without_metadata_are_never_dropped(spark):
    logs = spark.createDataFrame([(1, 5, "0xa"), (1, 6, "0xb")], "chain_id long, block_number long, tx_hash string")
    headers = spark.createDataFrame([(1, 5, 100)], "chain_id long, block_number long, timestamp long")
    held = decode.without(logs, headers)
    assert [r.block_number for r in held.collect()] == [6]
    assert decode.with_block_time(logs.filter("block_number = 5"), headers).count() == 1
    with pytest.raises(Exception, match="no header of block 6"):
        decode.with_block_time(logs, headers).collect()
    known = spark.createDataFrame([(1, "0xa", A, B, 1, "ok", 5)],
                                  "chain_id long, tx_hash string, sender string, recipient string, gas_used long, status string, block_number long")
    with pytest.raises(Exception, match="no transaction 0xb"):
        decode.with_tx(logs, known).collect()
    assert decode.without(logs, known, ("chain_id", "tx_hash")).first().tx_hash == "0xb"


def test_slots_of_every_type(spark):
    word = lambda n: format(n % 2**256, "064x")
    text = "é" * 40
    body = text.encode().hex()
    data = "0x" + word(-5) + word(-(2**255)) + word(2**256 - 1) + word(7 * 32) + word(0) + word(2**200) + word(1) + word(len(body) // 2) + body.ljust(192, "0")
    own = reg.EventDef("x", "E", "0x" + "e" * 64, (("who", "address"), ("name", "string")), (
        ("a", "int256"), ("b", "int256"), ("c", "uint256"), ("s", "string"), ("f", "bool"), ("far", "bytes"), ("t", "bool")))
    topics = [own.topic0, "0x" + "0" * 24 + "AB" * 20, "0x" + "1" * 64]
    rows = [(1, "0xc", topics, data, 1, "0x1", 0, False), (1, "0xc", topics[:2], "0x" + word(1)[:40], 2, "0x2", 0, False), (1, "0xc", [reg.TOPIC["Transfer"]], "0x", 3, "0x3", 0, False)]
    logs = spark.createDataFrame(rows, "chain_id long, address string, topics array<string>, data string, block_number long, tx_hash string, log_index int, removed boolean")
    for small in (10_000, 0):
        decode.SMALL_REGISTRY, kept = small, decode.SMALL_REGISTRY
        try:
            got = {r.tx_hash: r.fields for r in decode.decode_by_registry(logs, reg.event_registry(spark, [own])).collect()}
        finally:
            decode.SMALL_REGISTRY = kept
        assert got["0x1"] == {"who": "0x" + "ab" * 20, "name": "0x" + "1" * 64, "a": "-5", "b": str(-(2**255)), "c": str(2**256 - 1),
                              "s": text, "f": "false", "far": None, "t": "true"}
        assert got["0x2"] == {"who": "0x" + "ab" * 20, "name": None, **dict.fromkeys("abcs"), "f": None, "far": None, "t": None}
        assert set(got) == {"0x1", "0x2"}


def test_registry_numbers_of_every_width_and_sign(spark):
    """Words around the limits of a long, of a limb and of the type, signed and unsigned, beside a malformed one."""
    kind = reg.EventDef("own", "Both", "0x" + "cd" * 32, (), (("n", "uint256"), ("s", "int256")))
    near = {m + d for e in (0, 59, 60, 63, 64, 86, 87, 255, 256) for m in (1 << e, -(1 << e)) for d in (-1, 0, 1)} | {10**26, 10**52}
    numbers = sorted(n % 2**256 for n in near)
    rows = [(1, "0xc", kind.topic0, [kind.topic0], "0x" + format(n, "064x") * 2, 1, "0xt", i, False) for i, n in enumerate(numbers)]
    rows.append((1, "0xc", kind.topic0, [kind.topic0], "0x" + "zz" * 32 + "00" * 8, 1, "0xt", len(numbers), False))
    names = "chain_id long, address string, topic0 string, topics array<string>, data string, block_number long, tx_hash string, log_index int, removed boolean"
    out = decode.decode_by_registry(spark.createDataFrame(rows, names), reg.event_registry(spark, [kind]))
    got = {r["log_index"]: r["fields"] for r in out.collect()}
    for i, n in enumerate(numbers):
        assert got[i] == {"n": str(n), "s": str(n if n < 2**255 else n - 2**256)}
    assert got[len(numbers)] == {"n": None, "s": None}


def test_registry_decoding_parses_a_word_once(spark):
    """However often a slot's number is used, its text has one parse of a word and one of a negated word."""
    text = str(decode._slot_text(F.col("kind"), F.col("word"), F.col("data"))._jc)
    assert text.count("aggregate(") == 2


def test_a_delivery_is_parsed_once(spark):
    """Neither what is accepted nor what is rejected has a second parse pushed below the first."""
    text = spark.createDataFrame([], "value string")
    for rows in (parse_deliveries(text), rejected_deliveries(text)):
        plan = rows._jdf.queryExecution().optimizedPlan()
        parsers = sum(str(plan.apply(i).expressions()).count("from_json(") for i in range(plan.treeString().count("\n")))
        assert parsers <= 1


def test_malformed_deliveries_are_told_from_those_without_logs(spark):
    whole = '{"id":"%s","event":{"data":{"block":{"number":"7","logs":[%s]}}}}'
    log = '{"transactionHash":"%s","logIndex":%s}'
    text = spark.createDataFrame(
        [(whole % ("a", log % ("0xa", 1) + "," + log % ("0xb", 2)),), (whole % ("b", log % ("0xc", 1) + "," + log % ("0xd", '"x"')),),
         (whole % ("c", ""),), ("{",), (None,)], "value string",
    )
    assert sorted(r["tx_hash"] for r in parse_deliveries(text).collect()) == ["0xa", "0xb"]
    bad = [r["value"] for r in rejected_deliveries(text).collect()]
    assert len(bad) == 2 and "{" in bad and rejected_deliveries(text).columns == ["value"]
