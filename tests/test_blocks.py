"""Block arithmetic, validation and page rules."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import blocks as blk
from ledgerloom.functions import evm
from ledgerloom.operators import filters, paging


@pytest.mark.parametrize("latest,depth,safe", [
    (11724800, 5, 11724795), (11724800, 0, 11724800), (4, 5, 0), (5, 5, 0), (100, 1, 99)])
def test_safe_head(latest, depth, safe):
    assert blk.safe_head(latest, depth) == safe


def test_safe_head_variants():
    assert blk.safe_head(4, 5, "latest") == 4
    assert blk.safe_head(4, 5, "none") is None
    assert (blk.safe_head(5, 5, "status"), blk.safe_head(6, 5, "status")) == (5, 1)


def test_resume():
    assert blk.resume_block(11724713, 1) == 11724714
    assert blk.resume_block(None, 11717931) == 11717931
    assert blk.resume_block(10, 50) == 50
    assert blk.resume_block(10, 50, clamp=False) == 11


def test_plans():
    assert blk.plan_range("recent", start=100, safe=1000, window=50) == (951, 1000)
    assert blk.plan_range("recent", start=980, safe=1000, window=50) == (980, 1000)
    assert blk.plan_range("recent", start=2000, safe=1000, window=50) is None
    assert blk.plan_range("next", start=100, safe=1000, cursor=300) == (301, 400)
    assert blk.plan_range("next", start=100, safe=1000, cursor=1000) is None
    assert blk.plan_range("range", start=0, safe=90, bounds=(10, 100)) == (10, 90)
    assert blk.plan_range("range", start=0, safe=90, bounds=(95, 100)) is None
    with pytest.raises(ValueError):
        blk.plan_range("range", start=0, safe=90, bounds=(5, 4))
    assert blk.balance_target("recent", start=7, safe=100, window=30) == 70
    assert blk.balance_target("recent", start=7, safe=20, window=30) == 7
    assert blk.balance_target("next", start=7, safe=100, cursor=None) == 57


def test_effective_target():
    assert blk.effective_target(0, 100, 80, 10) == 80
    assert blk.effective_target(50, 100, 80, 10) == 50
    assert blk.effective_target(0, 100, None, 10) == 10
    assert blk.effective_target(5, 100, 80, 10) is None


def test_split_ranges(spark):
    top = 2**63 - 1
    df = spark.createDataFrame(
        [("a", 0, 10), ("b", 5, 4), ("c", 7, 7), ("d", top - 3, top), ("e", 0, 50000)], "s string, lo long, hi long"
    )
    got = {}
    for r in blk.split_ranges(df, "lo", "hi", 4).collect():
        got.setdefault(r.s, []).append((r.chunk_from, r.chunk_to))
    assert sorted(got["a"]) == [(0, 3), (4, 7), (8, 10)]
    assert got["c"] == [(7, 7)] and got["d"] == [(top - 3, top)] and "b" not in got
    assert sorted(got["e"]) == [(i, min(i + 3, 50000)) for i in range(0, 50001, 4)]
    assert blk.split_ranges(df, "lo", "hi", 0).count() == 0


def test_stream_ids():
    assert blk.stream_id("token", "0xAB") == "erc20_transfers_0xab"
    assert blk.stream_id("recon_claims", "0xAB") == "reconciliation_salary_claim"


def test_pages_and_sorts_are_checked():
    assert paging.check_page(None, None) == (1, 20)
    for bad in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            paging.check_page(*bad)
    assert paging.window_of(0, -5) == (20, 0)
    with pytest.raises(ValueError):
        paging.sort_columns("token_transfers", "to_address")
    assert paging.sort_columns("token_transfers", "to_address", "sideways", strict=False)
    with pytest.raises(ValueError):
        filters.by_wallet(None, "0x1", "sideways")
    with pytest.raises(ValueError):
        filters.by_blocks(None, 5, 4)
    with pytest.raises(ValueError):
        filters.by_dates(None, "2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        filters.read_date("01.02.2024")


def test_deep_page_equals_plain_page(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").alias("n"))
    plain = [r.n for r in paging.slice_rows(df, [F.desc("n")], 500, 7).collect()]
    monkeypatch.setattr(paging, "DEEP", 10)
    assert [r.n for r in paging.slice_rows(df, [F.desc("n")], 500, 7).collect()] == plain


def test_prefix_lookup_is_literal(spark):
    df = spark.createDataFrame([(1, "1:0xa_b:x", "open"), (2, "1:0xaXb:x", "open"), (3, "1:0xa_b:y", "resolved")],
                               "id long, entity_ref string, status string")
    assert [r.id for r in filters.open_by_prefix(df, "1:0xa_b").collect()] == [1]


def test_block_number_forms(spark):
    df = spark.createDataFrame(
        [("0x112233", "9"), ("12345678", "9"), ("", "77"), (None, "0x10"), ("abc", "9"), ("0xzz", "9"), ("-5", "1")],
        "own string, block string",
    )
    got = [r[0] for r in df.select(evm.parse_block_number("own", "block")).collect()]
    assert got == [0x112233, 12345678, 77, 16, 0, 0, -5]
