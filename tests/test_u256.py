"""Exact arithmetic against Python integers."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import evm, u256

MAX = 2**256 - 1
EDGES = [0, 1, 10**26 - 1, 10**26, 10**27, 10**52, 2**96 - 1, 2**96, 2**128, 10**77, MAX]


def test_parse_render_and_hex(spark):
    random.seed(7)
    values = EDGES + [random.getrandbits(random.randint(1, 256)) for _ in range(2000)]
    df = spark.createDataFrame([(str(v), format(v, "064x")) for v in values], "d string, h string")
    df = u256.with_words(df, {"v": F.col("h")}).withColumns(
        {"text": u256.from_string(F.col("d")), "horner": u256.from_hex(F.col("h"))}
    )
    bad = df.filter(
        (u256.to_string(F.col("v")) != F.col("d"))
        | (u256.to_string(F.col("text")) != F.col("d"))
        | (F.col("v") != F.col("horner"))
        | F.col("v").isNull()
    )
    assert bad.count() == 0


def test_malformed_words_and_numbers_are_null(spark):
    df = spark.createDataFrame(
        [("0x" + "1" * 64,), ("0x" + "1" * 63,), ("0x" + "g" * 64,), ("0x",), (None,)], "data string"
    )
    rows = u256.with_words(df, {"v": evm.data_word("data", 0)}).select("v").collect()
    assert [r.v is None for r in rows] == [False, True, True, True, True]
    texts = spark.createDataFrame([("12",), (" 7 ",), ("",), ("-1",), ("1" * 79,)], "t string")
    got = [r.v for r in texts.select(u256.to_string(u256.from_string(F.col("t"))).alias("v")).collect()]
    assert got == ["12", "7", None, None, None]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, MAX), st.booleans(), st.integers(0, 2)), min_size=1, max_size=60))
def test_signed_sums(spark, rows):
    df = spark.createDataFrame([(str(v), neg, g) for v, neg, g in rows], "d string, neg boolean, g int")
    sums = (
        df.withColumn("v", u256.from_string(F.col("d")))
        .groupBy("g").agg(u256.total(u256.signed(F.col("v"), F.col("neg"))).alias("s"))
        .select("g", u256.to_signed_string(F.col("s")).alias("s"),
                u256.to_signed_string(u256.negate(F.col("s"))).alias("minus"))
    )
    want = {}
    for v, neg, g in rows:
        want[g] = want.get(g, 0) + (-v if neg else v)
    for r in sums.collect():
        assert int(r.s) == want[r.g]
        assert int(r.minus) == -want[r.g]


def test_add_sub_and_order(spark):
    random.seed(3)
    pairs = [(random.getrandbits(200), random.getrandbits(random.choice([10, 199, 200]))) for _ in range(300)]
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string").select(
        "a", "b", u256.from_string(F.col("a")).alias("x"), u256.from_string(F.col("b")).alias("y")
    )
    out = df.select(
        "a", "b", (F.col("x") < F.col("y")).alias("less"),
        u256.to_signed_string(u256.add(F.col("x"), F.col("y"))).alias("add"),
        u256.to_signed_string(u256.sub(F.col("x"), F.col("y"))).alias("sub"),
    )
    for r in out.collect():
        a, b = int(r.a), int(r.b)
        assert (int(r.add), int(r["sub"]), r.less) == (a + b, a - b, a < b)


def test_sums_stay_in_hash_aggregates(spark):
    df = spark.range(10).select(F.lit(1).alias("g"), u256.from_small(F.col("id")).alias("v"))
    plan = df.groupBy("g").agg(u256.total(F.col("v")).alias("s"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_text_of_every_length_and_of_no_number(spark):
    digits = "9876543210" * 8
    texts = [digits[:n] for n in range(1, 79)] + ["0" * 78, "0", " 7 ", digits[:79], "", "+1", "1e5", "1.5", "-3", "12a", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", u256.from_string(F.col("t")).alias("n"))
    got = [r[1] for r in rows.select("i", u256.to_string(F.col("n"))).orderBy("i").collect()]
    assert got == [str(int(t)) for t in texts[:81]] + [None] * 8


def test_the_round_trip_parses_a_text_once(spark):
    from ledgerloom.plans import catalog

    plan = catalog.queries()["u256_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(") == 1
