"""Streams: restart, isolation, replays and finality."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerloom import registry as reg
from ledgerloom.functions import u256
from ledgerloom.operators import decode
from ledgerloom.sources import keyed
from ledgerloom.sources import logs as log_source
from ledgerloom.streaming import jobs

A, B, T = ("0x" + c * 40 for c in "abc")
SCHEMA = ("chain_id long, address string, topic0 string, topics array<string>, data string, block_number long, "
          "tx_hash string, log_index int, removed boolean, block_timestamp timestamp")


def pad(a):
    return "0x" + "0" * 24 + a[2:]


def transfer(block, amount, removed=False, log=0):
    topic = reg.TOPIC["Transfer"]
    return (1, T, topic, [topic, pad(A), pad(B)], "0x" + format(amount, "064x"), block, "0x" + format(block, "064x"),
            log, removed, None)


def write(spark, path, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(path)


def spec(spark, path, fn=jobs.transfer_tables, name="erc20"):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return jobs.StreamSpec(name, source, fn)


def current(spark, root):
    schema = decode.decode_transfers(spark.createDataFrame([], SCHEMA)).schema
    out = jobs.current(spark, root, "token_transfers", schema).select("block_number", u256.to_string(F.col("amount")).alias("a"), "removed")
    return sorted((r.block_number, r.a, r.removed) for r in out.collect())


def test_restart_replay_and_reorg(spark, tmp_path):
    root, cp, src = (f"{tmp_path}/{n}" for n in ("out", "cp", "in"))
    write(spark, src, transfer(1, 10), transfer(2, 20))
    jobs.start(spec(spark, src), root, cp).awaitTermination()
    write(spark, src, transfer(2, 99), transfer(3, 30))  # a replay with another amount
    jobs.start(spec(spark, src), root, cp).awaitTermination()
    assert current(spark, root) == [(1, "10", False), (2, "20", False), (3, "30", False)]
    write(spark, src, transfer(1, 10, removed=True))
    jobs.start(spec(spark, src), root, cp).awaitTermination()
    assert current(spark, root)[0] == (1, "10", True)
    assert [(r.writer, r.batch_id) for r in keyed.commits(spark, root).collect()] == [("erc20", 2)]


def test_failed_batch_is_invisible_and_is_retried(spark, tmp_path):
    root, cp, src = (f"{tmp_path}/{n}" for n in ("out", "cp", "in"))
    write(spark, src, transfer(1, 10))

    def broken(batch):
        frames = jobs.transfer_tables(batch)
        frames["chain_events"] = frames["chain_events"].withColumn("raw_data", F.raise_error(F.lit("disk full")).cast("string"))
        return frames

    outcome = jobs.run_available([spec(spark, src, broken)], root, cp)
    assert outcome["erc20"]
    assert keyed.cursors(spark, root).count() == 0
    jobs.start(spec(spark, src), root, cp).awaitTermination()
    assert current(spark, root) == [(1, "10", False)]
    assert keyed.cursors(spark, root).first().last_indexed_block == 1


def test_one_failing_stream_does_not_stop_the_other(spark, tmp_path):
    root, cp, src = (f"{tmp_path}/{n}" for n in ("out", "cp", "in"))
    write(spark, src, transfer(5, 50))

    def broken(batch):
        raise RuntimeError("no such table")

    outcome = jobs.run_available(
        [spec(spark, src, broken, "bad"), spec(spark, src, jobs.transfer_tables, "good")], root, cp)
    assert outcome["bad"] and outcome["good"] is None
    assert current(spark, root) == [(5, "50", False)]


def test_finalized_holds_back_the_head(spark):
    df = spark.range(1, 11).select(F.col("id").alias("block_number"))
    assert jobs.finalized(df, 3).count() == 7
    assert jobs.finalized(df, 30, "zero").count() == 0
    assert jobs.finalized(df, 30, "latest").count() == 10


def test_backfill_resumes_and_respects_the_start(spark, tmp_path):
    df = spark.createDataFrame([transfer(b, b) for b in range(1, 21)], SCHEMA)
    job = jobs.StreamSpec("erc20", df, jobs.transfer_tables)
    root = str(tmp_path)
    assert jobs.backfill(job, df, root, target=3, start_block=5) is None
    assert jobs.backfill(job, df, root, target=10, start_block=5, commit_blocks=4) == (5, 10)
    assert jobs.backfill(job, df, root, target=10, start_block=5) is None
    assert jobs.backfill(job, df, root, target=12, start_block=5) == (11, 12)
    assert [b for b, _, _ in current(spark, root)] == list(range(5, 13))


def test_log_scan_prunes_and_pushes_down(spark, tmp_path):
    df = spark.createDataFrame([transfer(b, 1) for b in (5, 150_000, 250_000)], SCHEMA)
    log_source.write_logs(df, str(tmp_path / "logs"))
    got = log_source.scan_logs(spark, str(tmp_path / "logs"), T, 100_000, 200_000, reg.TOPIC["Transfer"], 1)
    assert [r.block_number for r in got.collect()] == [150_000]
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = got.select("*")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chain_id" in plan
    assert "EqualTo(address" in plan and "EqualTo(topic0" in plan


def test_reconcile_loop_survives_a_failing_pass():
    calls, errors = [], []

    def once():
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("node down")

    passes = jobs.reconcile_loop(once, lambda: len(calls) < 4, lambda: None, errors.append)
    assert passes == 4 and [str(e) for e in errors] == ["node down"]


def test_strict_dedup_drops_a_reorg_notice(spark, tmp_path):
    rows = [("0x1", 0, False), ("0x1", 0, False), ("0x1", 0, True)]
    df = spark.createDataFrame(rows, "tx_hash string, log_index int, removed boolean").withColumns(
        {"chain_id": F.lit(1), "contract_address": F.lit(A), "block_timestamp": F.lit("2024-01-01").cast("timestamp")})
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    counts = {}
    for strict in (False, True):
        source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        out = f"{tmp_path}/out-{strict}"
        jobs.dedup_stream(source, strict_compat=strict).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", f"{tmp_path}/cp-{strict}").trigger(availableNow=True).start().awaitTermination()
        counts[strict] = spark.read.parquet(out).count()
    assert counts == {False: 2, True: 1}


def test_first_delivery_of_an_old_block_is_not_late(spark, tmp_path):
    days = ["2024-03-01", "2024-01-01", "2023-06-01", "2024-03-01"]  # newest first, the last one a repeat
    for i, day in enumerate(days):
        spark.createDataFrame([(1, A, f"0x{day}", 0, False, day)],
                              "chain_id long, contract_address string, tx_hash string, log_index int, removed boolean, day string"
                              ).withColumn("block_timestamp", F.to_timestamp("day")).coalesce(1).write.parquet(f"{tmp_path}/in/n={i}")
    schema = spark.read.parquet(f"{tmp_path}/in").drop("n").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    jobs.dedup_stream(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.day for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(set(days))


def test_a_repeat_passes_once_its_time_is_over(spark, tmp_path):
    """A first delivery, a repeat in time, another log 61 days on, and then the repeat once more."""
    days = [("0x1", 100), ("0x1", 110), ("0x2", 161), ("0x1", 162), ("0x1", 163)]
    names = "chain_id long, contract_address string, tx_hash string, log_index int, removed boolean, day int"
    schema = spark.createDataFrame([], names).withColumn("at", F.lit(None).cast("timestamp")).schema
    out = f"{tmp_path}/out"
    for i, (tx, day) in enumerate(days):
        frame = spark.createDataFrame([(1, A, tx, 0, False, day)], names).withColumn("at", F.timestamp_seconds(F.col("day") * 86400))
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        jobs.dedup_stream(source, received="at").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.tx_hash, r.day) for r in spark.read.schema(schema).parquet(out).collect()) == [("0x1", 100), ("0x1", 162), ("0x2", 161)]


def test_cursor_carries_the_hash_of_its_block(spark, tmp_path):
    root, cp, src = (f"{tmp_path}/{n}" for n in ("out", "cp", "in"))
    frame = spark.createDataFrame([transfer(3, 1), transfer(7, 1)], SCHEMA)
    frame.withColumn("block_hash", F.concat(F.lit("0xhash"), "block_number")).coalesce(1).write.parquet(src)
    source = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    jobs.start(jobs.StreamSpec("erc20", source, jobs.transfer_tables), root, cp).awaitTermination()
    row = keyed.cursors(spark, root).first()
    assert (row.last_indexed_block, row.last_block_hash) == (7, "0xhash7")


def test_wallet_without_live_logs_leaves_the_projection(spark, tmp_path):
    from ledgerloom.operators import fold
    from ledgerloom.plans import views

    logs = views.payroll_logs(spark, "/root/testdata/sf0.001").limit(400)
    root, cp, src = (f"{tmp_path}/{n}" for n in ("out", "cp", "in"))
    logs.coalesce(1).write.parquet(src)
    logs = spark.read.parquet(src)
    ledger = decode.decode_payroll(logs)
    job = jobs.StreamSpec("payroll", spark.readStream.schema(logs.schema).parquet(src), jobs.payroll_tables)

    def rows(df):
        amounts = ("salary_per_second", "allocation", "total_leaves")
        return sorted(df.withColumns({c: u256.to_string(F.col(c)) for c in amounts}).collect(), key=lambda r: r.wallet)

    jobs.start_employees(job, root, cp).awaitTermination()
    before = {r.wallet for r in jobs.projected_employees(spark, root).collect()}
    assert rows(jobs.projected_employees(spark, root)) == rows(fold.fold_employees(ledger))
    gone = min(before)
    keys = ledger.filter(F.col("employee") == gone).select("tx_hash", "log_index").distinct()
    back = logs.join(keys, ["tx_hash", "log_index"], "left_semi").select(*logs.columns)
    back.withColumn("removed", F.lit(True)).select(*logs.columns).coalesce(1).write.mode("append").parquet(src)
    jobs.start_employees(job, root, cp).awaitTermination()
    assert {r.wallet for r in jobs.projected_employees(spark, root).collect()} == before - {gone}
    back.coalesce(1).write.mode("append").parquet(src)  # mined again
    jobs.start_employees(job, root, cp).awaitTermination()
    assert rows(jobs.projected_employees(spark, root)) == rows(fold.fold_employees(ledger))


def test_rows_above_the_head_wait_and_late_ones_pass(spark, tmp_path):
    root, cp, src = (f"{tmp_path}/{n}" for n in ("out", "cp", "in"))
    cursor = lambda: [r.last_indexed_block for r in keyed.cursors(spark, root).collect()]
    write(spark, src, transfer(1, 1), transfer(12, 12))
    (query,) = jobs.start_live([spec(spark, src)], root, cp, "0 seconds", 5)
    query.processAllAvailable()
    assert [r[0] for r in current(spark, root)] == [1] and cursor() == [7]
    write(spark, src, transfer(12, 12, removed=True), transfer(9, 9))  # a notice for a waiting row, no new head
    query.processAllAvailable()
    assert [r[0] for r in current(spark, root)] == [1] and cursor() == [7]
    query.stop()
    write(spark, src, transfer(3, 3))  # late, of a final block; the stream starts again
    (query,) = jobs.start_live([spec(spark, src)], root, cp, "0 seconds", 5)
    query.processAllAvailable()
    assert [r[0] for r in current(spark, root)] == [1, 3] and cursor() == [7]
    write(spark, src, transfer(17, 17))
    query.processAllAvailable()
    query.stop()
    assert current(spark, root) == [(1, "1", False), (3, "3", False), (9, "9", False), (12, "12", True)] and cursor() == [12]


@pytest.mark.parametrize("again", [0, 2])
def test_a_batch_run_again_changes_nothing(spark, tmp_path, again):
    """Also one that had been committed before the stream noticed."""
    root = str(tmp_path)
    frames = [spark.createDataFrame([transfer(b, b * 10) for b in blocks], SCHEMA) for blocks in ((1, 2), (2, 3, 9), (4, 12))]
    job = jobs.StreamSpec("erc20", frames[0], jobs.transfer_tables)

    def run(n):
        rows = frames[n].persist()
        pool, final, waits, safe = jobs._gated(rows, job, root, n, 5, "latest")
        out = jobs.transfer_tables(final) | {"held_erc20": waits}
        tables = job.tables(jobs.transfer_tables(final)) | {"held_erc20": keyed.Table(waits.schema, None)}
        keyed.commit_batch(root, "erc20", n, out, tables, jobs._at_block(jobs._cursor(final, 1), safe), received=n)

    for n in range(3):
        run(n)
        seen = current(spark, root)
        if n == again:
            run(n)
            assert current(spark, root) == seen
    assert [r[0] for r in current(spark, root)] == [1, 2, 3, 4]


def test_two_streams_on_one_table_lose_nothing(spark, tmp_path):
    root = str(tmp_path)
    frame = lambda rows: spark.createDataFrame([transfer(*r) for r in rows], SCHEMA)
    one, two = (jobs.StreamSpec(n, None, jobs.transfer_tables) for n in ("one", "two"))
    first = {n: jobs.transfer_tables(frame(rows)) for n, rows in (("one", [(1, 10), (2, 20)]), ("two", [(2, 99), (3, 30)]))}
    # both read the store before either of them writes its commit
    for job in (one, two):
        for name, f in first[job.stream_id].items():
            keyed.write_table(root, name, job.tables(first[job.stream_id])[name], f, job.stream_id, 0, F.lit(5 if job is one else 6))
    assert current(spark, root) == []
    keyed.commit(spark, root, "two", "two", 0)
    assert [r[0] for r in current(spark, root)] == [2, 3]
    keyed.commit(spark, root, "one", "one", 0)
    assert current(spark, root) == [(1, "10", False), (2, "20", False), (3, "30", False)]


@pytest.fixture(autouse=True)
def _no_leftover_streams(spark):
    yield
    for query in spark.streams.active:
        query.stop()


def test_input_files_grow_in_number_with_the_input(spark, tmp_path, monkeypatch):
    from ledgerloom.plans import queries_streams

    rows = spark.range(10_000).toDF("n")
    for limit, each in ((1 << 30, 1), (8_000, 5)):
        monkeypatch.setattr(queries_streams, "FILE_BYTES", limit)
        for order in ("n", None):
            path = tmp_path / f"{each}-{order}"
            assert queries_streams._files(rows, str(path), 2, order) == each
            assert len(list(path.glob("part-*"))) == 2 * each
            assert spark.read.parquet(str(path)).distinct().count() == 10_000


class Kept:
    """A wallet's state without a store; counts what goes to it."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getMapState(self, *_):  # noqa: N802
        return self

    def getValueState(self, *_):  # noqa: N802
        return Kept.One()

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.held[key] = value

    def iterator(self):
        return iter(self.held.items())

    class One:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value


def test_wallet_state_reads_a_chunk_once_for_all_logs_of_a_batch():
    from pyspark.sql import Row

    from ledgerloom.streaming import stateful

    def log(n, removed=False):
        return Row(contract_address="0xc", tx=f"0x{n}", log_index=0, block_number=n, kind=stateful.CLAIMED, employer="0xe",
                   salary=None, allocation=None, ts=n, removed=removed)

    def run(*batches):
        handle, state = Kept(), stateful.WalletState()
        state.init(handle)
        for batch in batches:
            (row,) = state.handleInputRows((1, "0xw"), iter(batch), None)
        return handle, row

    logs = [log(n) for n in range(3000)]
    handle, row = run(logs)
    assert handle.calls <= 100 and (row.claimed_at, row.added_at, row.latest_tx_hash) == (2999, 0, "0x2999")
    # grown chunk by chunk, the last and the first taken back, the last mined again
    steps = [logs[i : i + 50] for i in range(0, 3000, 50)]
    _, row = run(*steps, [log(2999, True), log(0, True)])
    assert (row.claimed_at, row.added_at, row.latest_tx_hash) == (2998, 1, "0x2998")
    handle, row = run(*steps, [log(2999, True)], [log(2999)])
    assert (row.claimed_at, row.latest_tx_hash) == (2999, "0x2999")
    assert sum(len(json.loads(v[0])) for v in handle.held.values()) == 3000
    assert max(len(json.loads(v[0])) for v in handle.held.values()) <= 2 * stateful.CHUNK
    assert not run([log(1)], [log(1, True)])[1].present


def test_employee_states_go_through_the_state_once_a_batch_in_few_partitions(spark, tmp_path):
    from ledgerloom.plans import views

    root, cp, src = (f"{tmp_path}/{n}" for n in ("out", "cp", "in"))
    views.payroll_logs(spark, "/root/testdata/sf0.001").limit(100).coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        query = jobs.start_employees(jobs.StreamSpec("payroll", spark.readStream.schema(schema).parquet(src), jobs.payroll_tables), root, cp)
        query.awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "60"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    (operator,) = query.lastProgress["stateOperators"]
    assert operator["numShufflePartitions"] <= 2 * spark.sparkContext.defaultParallelism
    wallets = spark.read.parquet(src).transform(decode.decode_payroll).select("employee").na.drop().distinct().count()
    assert query.lastProgress["numInputRows"] == 100
    assert jobs.projected_employees(spark, root).count() == wallets


@pytest.mark.parametrize("how", ["plain", "shared", "reread", "gated"])
def test_no_batch_is_kept_in_memory(spark, tmp_path, monkeypatch, how):
    root, cp, src = (f"{tmp_path}/{n}" for n in ("out", "cp", "in"))
    write(spark, src, transfer(1, 1), transfer(12, 12))
    levels, frame = [], type(spark.range(0))
    persist = frame.persist

    def recorded(self, *level):
        out = persist(self, *level)
        levels.append(self.storageLevel)
        return out

    monkeypatch.setattr(frame, "persist", recorded)
    job = replace(spec(spark, src), shared=(decode.decode_transfers,) if how == "shared" else (), reread=how in ("reread", "gated"))
    jobs.start(job, root, cp, depth=0 if how == "gated" else None).awaitTermination()
    assert [r[0] for r in current(spark, root)] == [1, 12]
    assert not [level for level in levels if level.useMemory] and len(levels) == (how in ("plain", "shared"))


def test_a_backfill_decodes_a_range_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(value):
        made.add(1)
        return value

    counted = F.udf(seen, "string")

    def step(batch):
        return decode.decode_transfers(batch.withColumn("tx_hash", counted("tx_hash")))

    def tables(batch):
        return {"token_transfers": step(batch)}

    logs = spark.createDataFrame([transfer(b, b) for b in range(1, 9)], SCHEMA)
    job = jobs.StreamSpec("erc20", logs, tables, shared=(step,))
    assert jobs.backfill(job, logs, str(tmp_path), target=8, start_block=1) == (1, 8)
    assert [r[0] for r in current(spark, str(tmp_path))] == list(range(1, 9)) and made.value == 8
