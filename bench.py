"""Headline queries on one machine: prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query runs to completion into the no-op sink, so all columns of all rows
are computed and nothing is collected. The first run of a query is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.plans import catalog  # noqa: E402
from ledgerloom.session import SETTINGS  # noqa: E402

HEADLINE = (
    "balances_all", "balances_at_block", "running_balance", "relevant_addresses",
    "decode_transfers", "decode_payroll", "decode_escrow", "webhook_escrow_events",
    "upsert_transfers_latest", "insert_once_fundings", "new_transactions",
    "employees_current", "employers_current", "employer_profile", "employee_profile",
    "transfers_all_page", "tx_events", "sync_status",
    "recon_transfers", "recon_lifecycle", "balance_audit", "state_audit_employees",
    "unique_violations", "fk_violations", "stream_transfers",
)


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerloom-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    registered = catalog.queries()
    chosen = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in chosen:
        for _ in range(2):
            began = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
