"""The aggregate folds against a step-by-step model of the sequential writer."""

import random

from pyspark.sql import functions as F

from ledgerloom.functions import evm, u256
from ledgerloom.operators import fold

KINDS = ["EmployerAdded", "EmployerRemoved", "EmployeeAdded", "EmployeeRemoved", "PayrollFunded", "SalaryClaimed"]
SCHEMA = (
    "chain_id long, event_name string, employer string, employee string, salary long, allocation long, "
    "amount long, tx_hash string, block_number long, block_timestamp timestamp, log_index int"
)


def sequential(events):
    employers, employees = {}, {}

    def ensure_employer(key, e):
        employers.setdefault(key, {"active": True, "added": e["block"], "removed": None, "tx": e["tx"]})

    for e in events:
        chain, boss, worker = e["chain"], (e["chain"], e["employer"]), (e["chain"], e["employee"])
        kind = e["kind"]
        if kind == "EmployerAdded":
            row = employers.setdefault(boss, {"added": None, "removed": None})
            row.update(active=True, added=e["block"] if row["added"] is None else row["added"], tx=e["tx"])
        elif kind == "EmployerRemoved":
            row = employers.setdefault(boss, {"added": None})
            row.update(active=False, removed=e["block"], tx=e["tx"])
        elif kind == "EmployeeAdded":
            ensure_employer(boss, e)
            row = employees.setdefault(worker, {"added": None, "removed": None, "claimed": None})
            row.update(
                employer=e["employer"], salary=e["amount"], allocation=e["amount"] * 2, active=True,
                added=e["block"] if row["added"] is None else row["added"], tx=e["tx"],
            )
        elif kind == "EmployeeRemoved":
            ensure_employer(boss, e)
            row = employees.setdefault(
                worker, {"employer": e["employer"], "salary": 0, "allocation": None, "added": None, "claimed": None}
            )
            row.update(active=False, removed=e["block"], tx=e["tx"])
        else:
            if kind == "PayrollFunded":
                ensure_employer(boss, e)
                owner = e["employer"]
            else:
                owner = evm.ZERO_ADDRESS
                if worker not in employees:
                    ensure_employer((chain, owner), e)
            employees.setdefault(
                worker,
                {"employer": owner, "salary": 0, "allocation": None, "active": True, "added": e["block"],
                 "removed": None, "claimed": None, "tx": e["tx"]},
            )
            if kind == "SalaryClaimed":
                employees[worker].update(claimed=e["block"], tx=e["tx"])
    return employers, employees


def test_folds_equal_the_sequential_writer(spark):
    random.seed(11)
    events, rows = [], []
    for chain in range(300):  # 300 independent histories
        for block in range(random.randint(1, 14)):
            e = {
                "chain": chain, "kind": random.choice(KINDS), "block": block, "tx": f"0x{chain:x}-{block:x}",
                "employer": random.choice(["0xa", "0xb", evm.ZERO_ADDRESS]),
                "employee": random.choice(["0x1", "0x2", "0x3"]), "amount": random.randint(0, 9),
            }
            events.append(e)
    for e in events:
        boss = None if e["kind"] == "SalaryClaimed" else e["employer"]
        worker = None if e["kind"].startswith("Employer") else e["employee"]
        rows.append((e["chain"], e["kind"], boss, worker, e["amount"], e["amount"] * 2, e["amount"], e["tx"],
                     e["block"], None, 0))
    random.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {
            "block_timestamp": F.timestamp_seconds("block_number"),
            "salary": u256.from_small(F.col("salary")),
            "allocation": u256.from_small(F.col("allocation")),
        }
    ).repartition(5)
    employers, employees = sequential(events)

    got = {
        (r.chain_id, r.wallet): (r.active, r.added, r.deactivation_time, r.latest_tx_hash)
        for r in fold.fold_employers(df).withColumn("added", F.unix_timestamp("added_at")).collect()
    }
    assert got == {k: (v["active"], v["added"], v["removed"], v["tx"]) for k, v in employers.items()}

    out = fold.fold_employees(df).withColumns(
        {
            "added": F.unix_timestamp("added_at"),
            "salary": u256.to_string(F.col("salary_per_second")).cast("long"),
            "alloc": u256.to_string(F.col("allocation")).cast("long"),
        }
    )
    got = {
        (r.chain_id, r.wallet): (r.employer, r.salary, r.alloc, r.active, r.added, r.deactivation_time,
                                 r.last_withdraw, r.latest_tx_hash)
        for r in out.collect()
    }
    assert got == {
        k: (v["employer"], v["salary"], v["allocation"], v["active"], v["added"], v["removed"], v["claimed"], v["tx"])
        for k, v in employees.items()
    }
