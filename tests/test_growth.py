"""Work that must not be done twice on large tables."""

from pyspark.sql import functions as F

from ledgerloom.plans import catalog, faults
from ledgerloom.sources import keyed

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_running_balances_do_not_fold_the_deliveries_again(spark):
    assert "min_by" not in _plan(catalog.queries()["running_balance"](spark, SF))


def test_cursors_of_the_stored_view_do_not_fold_the_deliveries_again(spark):
    assert "min_by" not in _plan(catalog.queries()["tx_events_stored"](spark, SF))


def test_twice_delivered_wide_events_are_decoded_once(spark):
    assert _plan(catalog.queries()["insert_once_wide_events"](spark, SF)).count("Relation") == 1


def _folds(monkeypatch, spark, name):
    calls, fold = [], faults.live_transfers
    monkeypatch.setattr(faults, "live_transfers", lambda *a: calls.append(1) or fold(*a))
    return catalog.queries()[name](spark, SF), len(calls)


def test_balance_runs_share_their_transfers_and_read_what_was_checked(monkeypatch, spark):
    out, folds = _folds(monkeypatch, spark, "balance_run_recent")
    assert folds == 1 and _plan(out).count("sum(") == 0


def test_the_families_of_a_combined_run_share_their_transfers(monkeypatch, spark):
    out, folds = _folds(monkeypatch, spark, "combined_run_summary")
    assert folds == 1 and "min_by(named_struct(employer" not in _plan(out)


def test_what_one_task_reads_fits_its_memory_as_chain_data(spark):
    catalog.queries()["unique_violations"](spark, SF)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16m"


def test_a_table_of_one_writer_is_read_without_a_fold(spark, tmp_path):
    from ledgerloom.schemas import RULES

    rows = spark.createDataFrame([(1, "s", 5), (1, "t", 6)], "chain_id long, stream_id string, last_indexed_block long")
    rows = rows.selectExpr("*", "cast(null as string) as last_block_hash", "timestamp '2024-01-01' as updated_at")
    table = keyed.table_of(rows, RULES["sync_checkpoints"])
    keyed.commit_batch(str(tmp_path), "a", 0, {"t": rows}, {"t": table})
    one = keyed.read_current(spark, str(tmp_path), "t", table)
    assert "max_by" not in _plan(one) and one.count() == 2
    later = rows.filter("stream_id = 's'").selectExpr("chain_id", "stream_id", "9L as last_indexed_block", "last_block_hash", "updated_at")
    keyed.commit_batch(str(tmp_path), "b", 1, {"t": later}, {"t": table})
    two = keyed.read_current(spark, str(tmp_path), "t", table)
    assert {(r["stream_id"], r["last_indexed_block"]) for r in two.collect()} == {("s", 9), ("t", 6)}


def test_tables_are_dealt_before_their_rows_become_logs(spark):
    from ledgerloom.plans import queries_streams, views

    sf = "/root/testdata/sf0.001"
    with views.dealt(6, queries_streams.BY_DATE):
        logs = views.transfer_logs(spark, sf)
    assert logs.rdd.getNumPartitions() == 6
    assert sorted(map(str, logs.collect())) == sorted(map(str, views.transfer_logs(spark, sf).collect()))
    blocks = logs.select("block_number", F.spark_partition_id().alias("p")).groupBy("p").agg(F.min("block_number").alias("a"), F.max("block_number").alias("b"))
    ends = [(r["a"], r["b"]) for r in blocks.orderBy("a").collect()]
    assert all(b <= a for (_, b), (a, _) in zip(ends, ends[1:], strict=False))


def test_deliveries_sent_again_are_parsed_once(spark):
    from ledgerloom.plans import queries_streams, views
    from ledgerloom.sources.deliveries import parse_deliveries

    sent = queries_streams._sent_again(parse_deliveries(views.webhook_text(spark, "/root/testdata/sf0.001")))
    assert sent._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    rows = sent.groupBy("tx_hash", "log_index").agg(F.count("*").alias("n"), F.sum(F.col("removed").cast("int")).alias("gone")).collect()
    assert {r["n"] for r in rows} == {2, 3} and all(r["gone"] in (0, 2) or r["n"] == 3 for r in rows)


def test_sessions_free_exchanges_and_merges_sort_by_a_hash(spark):
    from ledgerloom.operators.upsert import latest
    from ledgerloom.schemas import WriteRule
    from ledgerloom.session import apply_settings

    apply_settings(spark)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    rows = spark.range(100).selectExpr("cast(id % 7 as string) k", "id v")
    out = latest(rows, WriteRule(("k",), (), ("v",)), ["v"])
    assert "xxhash64(k" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.columns == ["k", "v"] and {(r["k"], r["v"]) for r in out.collect()} == {(str(n % 7), n) for n in range(93, 100)}
