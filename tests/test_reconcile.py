"""Audit scenarios, each for all three event families."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.functions import evm, u256
from ledgerloom.operators import balances as bal
from ledgerloom.operators import reconcile as rec

A, B, C = ("0x" + format(n, "040x") for n in (1, 2, 3))
TOKEN, OTHER_TOKEN = "0x" + format(100, "040x"), "0x" + format(101, "040x")
TX = "0x" + format(5, "064x")
FAMILIES = {"funding": rec.FUNDING, "claim": rec.CLAIM, "transfer": rec.TRANSFER}


@pytest.fixture(params=list(FAMILIES))
def family(request):
    return FAMILIES[request.param]


def rows(spark, family, *events, stored=False):
    """Events as dicts with optional block, party, amount, removed, id, token, log."""
    data = []
    for e in events:
        parties = [e.get("party", A), B][: len(family.entity)]
        amount = e.get("amount", "10")
        data.append(
            (1, e.get("token", TOKEN), TX, e.get("log", 0), e.get("block", 50), *parties,
             *[amount] * len(family.amounts), e.get("removed", False), e.get("id", 1))
        )
    names = ["chain_id", "token", "tx_hash", "log_index", "block_number", *family.entity, *family.amounts, "removed", "id"]
    kinds = ["long", "string", "string", "int", "long"] + ["string"] * (len(family.entity) + len(family.amounts)) + ["boolean", "long"]
    df = spark.createDataFrame(data, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    df = df.withColumns({c: u256.from_string(F.col(c)) for c in family.amounts})
    if not family.per_token:
        df = df.drop("token")
    if stored and not family.per_token:
        df = df.drop("removed")  # histories of payroll have no such flag
    return df if stored else df.drop("id")


def empty(spark):
    return spark.createDataFrame([], rec.EXCEPTION_SCHEMA)


def audit(spark, family, chain, db, exceptions=None, **options):
    arguments = {"chain_id": 1, "latest": 105, "depth": 5, "start": 0, "mode": "range", "bounds": (0, 100),
                 "ingest_cursor": 100, **options}
    if family.per_token:
        arguments.setdefault("token", TOKEN)
    return rec.reconcile_events(
        family, rows(spark, family, *chain), rows(spark, family, *db, stored=True),
        empty(spark) if exceptions is None else exceptions, **arguments,
    )


def kinds(run, family):
    return sorted(r.type.removeprefix(family.prefix + "_") for r in run.mismatches.collect())


def test_match(spark, family):
    assert kinds(audit(spark, family, [{}], [{}]), family) == []


def test_missing(spark, family):
    run = audit(spark, family, [{}], [])
    found = run.mismatches.collect()
    assert [r.severity for r in found] == ["high"]
    token = f"{TOKEN}:" if family.per_token else ""
    assert found[0].entity_ref == f"1:{token}{TX}:0:missing"
    assert found[0].observed == '{"status":"not_found"}'


def test_missing_beyond_cursor_is_lag(spark, family):
    assert kinds(audit(spark, family, [{}], [], ingest_cursor=49), family) == []
    assert kinds(audit(spark, family, [{}], [], ingest_cursor=50), family) == ["MISSING"]
    assert kinds(audit(spark, family, [{}], [], ingest_cursor=None), family) == []


def test_amount_entity_and_block(spark, family):
    run = audit(spark, family, [{}], [{"amount": str(2**255), "party": C, "block": 51}])
    assert kinds(run, family) == ["AMOUNT_MISMATCH", "ENTITY_MISMATCH", "TX_INCONSISTENCY"]
    severities = {r.type.removeprefix(family.prefix + "_"): r.severity for r in run.mismatches.collect()}
    assert severities["ENTITY_MISMATCH"] == "critical" and severities["TX_INCONSISTENCY"] == "medium"


def test_null_amount_is_a_mismatch(spark, family):
    run = audit(spark, family, [{}], [{"amount": None}])
    assert kinds(run, family) == ["AMOUNT_MISMATCH"]
    assert '"0"' in run.mismatches.collect()[0].observed


def test_duplicate_lists_ids_in_order(spark, family):
    run = audit(spark, family, [{}], [{"id": 9}, {"id": 4}])
    assert [r.observed for r in run.mismatches.collect()] == ['{"count":2}']


def test_every_copy_of_a_duplicate_has_its_id_as_a_row(spark, family):
    copies = [{"id": i} for i in range(10)]
    run = audit(spark, family, [{}], copies)
    assert [r.observed for r in run.mismatches.collect()] == ['{"count":10}']
    ids = rec.duplicate_ids(family, rec.stored_rows(family, rows(spark, family, *copies, stored=True)))
    assert sorted(r.record_id for r in ids.collect()) == list(range(10))


def test_removed_logs_are_not_expected(spark, family):
    assert kinds(audit(spark, family, [{"removed": True}], []), family) == []


def test_unfinalized_range_is_skipped(spark, family):
    assert audit(spark, family, [{"block": 103}], [], bounds=(101, 104)) is None
    run = audit(spark, family, [{"block": 103}], [], bounds=(90, 104))
    assert run.last == 100 and kinds(run, family) == []


def test_run_twice_skips_then_fix_resolves(spark, family):
    first = audit(spark, family, [{}], [])
    table = first.lifecycle.exceptions
    table = table.sparkSession.createDataFrame(table.collect(), table.schema)  # as stored
    assert [r.outcome for r in first.lifecycle.marks.collect()] == ["created"]
    assert table.filter("id is null").count() == 0
    closed = rec.resolve_exceptions(table, table.select("id")).collect()
    assert [r.status for r in closed] == ["resolved"]
    again = audit(spark, family, [{}], [], exceptions=table)
    assert [r.outcome for r in again.lifecycle.marks.collect()] == ["skipped"]
    assert again.lifecycle.exceptions.count() == 1
    fixed = audit(spark, family, [{}], [{}], exceptions=table)
    assert [r.outcome for r in fixed.lifecycle.marks.collect()] == ["resolved"]
    row = fixed.lifecycle.exceptions.collect()[0]
    assert row.status == "resolved" and row.resolved_at is not None
    reopened = audit(spark, family, [{}], [], exceptions=fixed.lifecycle.exceptions)
    assert sorted(r.status for r in reopened.lifecycle.exceptions.collect()) == ["open", "resolved"]


def test_exceptions_outside_the_range_stay_open(spark, family):
    table = audit(spark, family, [{}], []).lifecycle.exceptions
    other = audit(spark, family, [], [], exceptions=table, bounds=(60, 100))
    assert other.lifecycle.marks.count() == 0
    assert [r.status for r in other.lifecycle.exceptions.collect()] == ["open"]


def test_lagging_row_closes_its_open_exception(spark, family):
    table = audit(spark, family, [{}], []).lifecycle.exceptions
    lag = audit(spark, family, [{}], [], exceptions=table, ingest_cursor=10)
    assert [r.outcome for r in lag.lifecycle.marks.collect()] == ["resolved"]


def test_windows_and_batches(spark, family):
    run = audit(spark, family, [{"block": 95}, {"block": 20, "log": 1}], [], mode="recent", window=10)
    assert (run.first, run.last) == (91, 100) and kinds(run, family) == ["MISSING"]
    run = audit(spark, family, [{"block": 20}], [], mode="next", recon_cursor=9, batch=30)
    assert (run.first, run.last) == (10, 39) and kinds(run, family) == ["MISSING"]
    assert audit(spark, family, [], [], mode="next", recon_cursor=100) is None


def test_other_tokens_are_left_alone(spark):
    run = audit(spark, rec.TRANSFER, [{"token": OTHER_TOKEN}], [])
    assert kinds(run, rec.TRANSFER) == []
    gone = audit(spark, rec.TRANSFER, [{}], [{"removed": True}])
    assert kinds(gone, rec.TRANSFER) == ["MISSING"]


def test_phantoms_are_opt_in(spark, family):
    chain, db = rows(spark, family), rows(spark, family, {}, stored=True)
    options = {"first": 0, "last": 100, "safe": 100, "cursor": 100}
    assert rec.audit_events(family, chain, db, **options).count() == 0
    found = rec.audit_events(family, chain, db, phantoms=True, **options).collect()
    assert [r.type for r in found] == [f"{family.prefix}_PHANTOM"]


# --- balances --------------------------------------------------------------------

def transfers(spark, *moves):
    data = [(1, m.get("token", TOKEN), m["frm"], m["to"], str(m["amount"]), TX, m.get("block", 10), i,
             m.get("removed", False)) for i, m in enumerate(moves)]
    df = spark.createDataFrame(data, "chain_id long, token string, from_address string, to_address string, "
                               "amount string, tx_hash string, block_number long, log_index int, removed boolean")
    return df.withColumn("amount", u256.from_string(F.col("amount")))


def balances(df, block=None):
    out = bal.token_balances(df, block).filter(F.col("token") == TOKEN)
    return {r.address: int(r.b) for r in out.select("address", u256.to_signed_string(F.col("balance")).alias("b")).collect()}


def test_mint_burn_self_transfer_and_reorg(spark):
    zero = evm.ZERO_ADDRESS
    df = transfers(
        spark, {"frm": zero, "to": A, "amount": 1000}, {"frm": A, "to": zero, "amount": 300, "block": 20},
        {"frm": A, "to": A, "amount": 50}, {"frm": A, "to": B, "amount": 5, "removed": True},
        {"frm": zero, "to": A, "amount": 9, "token": OTHER_TOKEN},
    )
    assert balances(df) == {A: 700}
    assert balances(df, 15) == {A: 1000}
    def one(who):
        return int(bal.wallet_balance(df, TOKEN, who).select(u256.to_signed_string(F.col("balance"))).first()[0])

    assert (one(A), one(C), one(zero)) == (700, 0, -700)


def test_large_balance_is_exact(spark):
    df = transfers(spark, {"frm": C, "to": A, "amount": 10**27}, {"frm": C, "to": A, "amount": 2**255})
    assert balances(df)[A] == 10**27 + 2**255


def balance_frame(spark, **values):
    df = spark.createDataFrame([(1, TOKEN, w, str(v)) for w, v in values.items()], "chain_id long, token string, address string, v string")
    return df.withColumn("balance", u256.from_string(F.col("v"))).drop("v")


def test_balance_mismatch_and_resolution(spark):
    addresses = balance_frame(spark, **{A: 0, B: 0, evm.ZERO_ADDRESS: 0})
    db, chain = balance_frame(spark, **{A: 7}), balance_frame(spark, **{A: 5, B: 0, evm.ZERO_ADDRESS: 3})
    checked = rec.audit_balances(rec.match_balances(addresses, db, chain), 50)
    out = {r.entity_ref: r for r in checked.collect()}
    ref = f"1:{TOKEN}:{A}:token_balance_mismatch"
    assert set(out) == {ref, f"1:{TOKEN}:{B}:token_balance_mismatch"}
    assert not out[ref].matches and '"difference":"-2"' in out[ref].observed
    assert out[f"1:{TOKEN}:{B}:token_balance_mismatch"].matches
    done = rec.apply_lifecycle(empty(spark), checked.filter(~F.col("matches")), checked.filter("matches"))
    assert [r.entity_ref for r in done.exceptions.collect()] == [ref]
    healed = rec.audit_balances(rec.match_balances(addresses, balance_frame(spark, **{A: 5}), chain), 60)
    after = rec.apply_lifecycle(done.exceptions, healed.filter(~F.col("matches")), healed.filter("matches"))
    assert [r.status for r in after.exceptions.collect()] == ["resolved"]


def test_missing_contract_read_fails_the_run(spark):
    addresses = balance_frame(spark, **{A: 0})
    matched = rec.match_balances(addresses, addresses, addresses.filter("false"))
    with pytest.raises(PySparkException, match="no contract read"):
        rec.audit_balances(matched, 50).collect()


def test_newest_snapshot_at_or_before_the_target(spark):
    df = spark.createDataFrame([(1, C, A, "p", 10, "1"), (1, C, A, "p", 20, "2"), (1, C, A, "p", 30, "3"), (1, C, A, "q", 20, "9")],
                               "chain_id long, contract string, wallet string, property string, block_number long, v string")
    df = df.withColumn("value", u256.from_string(F.col("v")))
    got = rec.state_at(df, "p", 25).select(u256.to_string(F.col("value"))).collect()
    assert [r[0] for r in got] == ["2"]


def test_resolve_only_open_ids(spark):
    table = spark.createDataFrame([(1, "open"), (2, "resolved"), (3, "open")], "id long, status string").withColumn(
        "resolved_at", F.lit(None).cast("timestamp"))
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    got = {r.id: (r.status, r.resolved_at is not None) for r in rec.resolve_exceptions(table, ids).collect()}
    assert got == {1: ("resolved", True), 2: ("resolved", False), 3: ("open", False)}


def test_combined_kinds():
    assert rec.combined_kinds("all") == ("payroll", "claims", "token", "balance")
    with pytest.raises(ValueError):
        rec.combined_kinds("other")
