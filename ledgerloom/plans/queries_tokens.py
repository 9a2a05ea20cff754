"""Balances, addresses and exact arithmetic over token transfers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evm, u256
from ..operators import asof
from ..operators import balances as bal
from . import sql, views
from .book import Book

BOOK = Book()
AT_BLOCK = 11_002_000
TOKEN = "0x" + format(2, "040x")
WALLET = "0x" + format(7, "040x")


def _balance_text(df):
    return df.withColumn("balance", u256.to_signed_string(F.col("balance")))


@BOOK.add("balances_all", sql.cte(sql.MOVEMENTS) + f"""
SELECT chain_id, token, address, CAST(sum(delta) AS VARCHAR) AS balance
FROM movements WHERE address <> {sql.ZERO} GROUP BY chain_id, token, address""")
def balances_all(spark, sf_dir):
    return _balance_text(bal.token_balances(views.transfers(spark, sf_dir)))


@BOOK.add("balances_at_block", sql.cte(sql.MOVEMENTS) + f"""
SELECT chain_id, token, address, CAST(sum(delta) AS VARCHAR) AS balance
FROM movements WHERE address <> {sql.ZERO} AND block_number <= {AT_BLOCK}
GROUP BY chain_id, token, address""")
def balances_at_block(spark, sf_dir):
    return _balance_text(bal.token_balances(views.transfers(spark, sf_dir), AT_BLOCK))


@BOOK.add("balances_beyond_128_bits", sql.cte(sql.MOVEMENTS) + f"""
SELECT token, address,
       CASE WHEN sum(delta) = 0 THEN '0'
            ELSE CAST(sum(delta) AS VARCHAR) || repeat('0', 40) END AS balance
FROM movements WHERE address <> {sql.ZERO} GROUP BY token, address""")
def balances_beyond_128_bits(spark, sf_dir):
    """The same balances with every amount scaled by 10^40, as a real limb sum."""
    scaled = views.transfers(spark, sf_dir).withColumn(
        "amount",
        u256.from_string(F.concat(F.col("amount")["lo"].cast("string"), F.lit("0" * 40))),
    )
    return _balance_text(bal.token_balances(scaled)).drop("chain_id")


@BOOK.add("balance_wallet", sql.cte(sql.MOVEMENTS) + f"""
SELECT '{WALLET}' AS address, CAST(coalesce(sum(delta), 0) AS VARCHAR) AS balance
FROM movements WHERE address = '{WALLET}' AND token = '{TOKEN}' AND block_number <= {AT_BLOCK}""")
def balance_wallet(spark, sf_dir):
    return _balance_text(
        bal.wallet_balance(views.transfers(spark, sf_dir), TOKEN, WALLET, AT_BLOCK)
    )


@BOOK.add("balance_zero_address", sql.cte(sql.MOVEMENTS) + f"""
SELECT {sql.ZERO} AS address, CAST(coalesce(sum(delta), 0) AS VARCHAR) AS balance
FROM movements WHERE address = {sql.ZERO} AND token = '{TOKEN}'""")
def balance_zero_address(spark, sf_dir):
    return _balance_text(
        bal.wallet_balance(views.transfers(spark, sf_dir), TOKEN, evm.ZERO_ADDRESS)
    )


@BOOK.add("running_balance", sql.cte(sql.MOVEMENTS) + f"""
SELECT token, address, block_number, tx_hash, log_index, debit = 1 AS debit,
       CAST(sum(delta) OVER (PARTITION BY token, address
            ORDER BY block_number, log_index, tx_hash, debit
            ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS balance
FROM movements WHERE address <> {sql.ZERO}""")
def running_balance(spark, sf_dir):
    return _balance_text(bal.running_balances(views.transfers(spark, sf_dir))).select(
        "token", "address", "block_number", "tx_hash", "log_index", "debit", "balance"
    )


ASKED = f"""
asked AS (SELECT o_orderkey AS ask, {sql.addr('o_orderkey % 4 + 1')} AS token, {sql.addr('o_custkey % 97')} AS address,
                 CAST(11000000 + {sql.days('o_orderdate')} AS BIGINT) AS block_number FROM orders)"""


def _asked(spark, sf_dir):
    """One request an order: a token's balance of a wallet at the order's day, the zero address among them."""
    return views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ask"), F.lit(views.CHAIN).cast("long").alias("chain_id"),
        evm.address_of(F.col("o_orderkey") % 4 + 1).alias("token"), evm.address_of(F.col("o_custkey") % 97).alias("address"),
        (views._days("o_orderdate") + 11_000_000).alias("block_number"),
    )


@BOOK.add("balances_asof", sql.cte(sql.MOVEMENTS, ASKED) + """
SELECT ask, a.token, a.address, a.block_number, CAST(coalesce(sum(delta), 0) AS VARCHAR) AS balance
FROM asked a LEFT JOIN movements m ON m.token = a.token AND m.address = a.address AND m.block_number <= a.block_number
GROUP BY ALL""")
def balances_asof(spark, sf_dir):
    """Balances of a hundred thousand (wallet, block) pairs from one scan of the transfers."""
    asked = asof.balances_asof(views.transfers(spark, sf_dir), _asked(spark, sf_dir))
    return _balance_text(asked).select("ask", "token", "address", "block_number", "balance")


@BOOK.add("movements_union", sql.cte(sql.MOVEMENTS) + f"""
SELECT token, address, debit = 1 AS debit, count(*) AS n, CAST(sum(delta) AS VARCHAR) AS delta
FROM movements WHERE address <> {sql.ZERO} GROUP BY token, address, debit""")
def movements_union(spark, sf_dir):
    return (
        bal.movements(views.transfers(spark, sf_dir))
        .groupBy("token", "address", "debit")
        .agg(F.count("*").alias("n"), u256.total(F.col("delta")).alias("delta"))
        .withColumn("delta", u256.to_signed_string(F.col("delta")))
    )


@BOOK.add("relevant_addresses", sql.cte(sql.TRANSFERS, sql.PAYROLL) + f"""
SELECT DISTINCT address FROM (
  SELECT from_address AS address FROM transfers WHERE block_number <= {AT_BLOCK}
  UNION SELECT to_address FROM transfers WHERE block_number <= {AT_BLOCK}
  UNION SELECT employer FROM payroll WHERE event_name = 'PayrollFunded' AND block_number <= {AT_BLOCK}
  UNION SELECT employee FROM payroll WHERE event_name IN ('PayrollFunded', 'SalaryClaimed')
        AND block_number <= {AT_BLOCK}
  UNION SELECT {sql.PAYROLL_CONTRACT})
WHERE address <> {sql.ZERO}""")
def relevant_addresses(spark, sf_dir):
    from ..operators import fold

    events = views.payroll_events(spark, sf_dir)
    return bal.relevant_addresses(
        views.transfers(spark, sf_dir),
        fold.funding_rows(events),
        fold.claim_rows(events),
        AT_BLOCK,
        views.PAYROLL_CONTRACT,
        views.CHAIN,
    ).select("address")


@BOOK.add("u256_roundtrip", """
SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q,
       CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)
         || lpad(CAST(l_orderkey AS VARCHAR), 30, '0')
         || lpad(CAST(l_partkey AS VARCHAR), 30, '0') AS digits
FROM lineitem""")
def u256_roundtrip(spark, sf_dir):
    """Decimal text of about 68 digits to limbs and back."""
    text = F.concat(
        F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
        F.lpad(F.col("l_orderkey").cast("string"), 30, "0"),
        F.lpad(F.col("l_partkey").cast("string"), 30, "0"),
    )
    plain = [F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q")]
    # a projection a step: inside one expression every mention of the text and of the number is computed again
    rows = views.table(spark, sf_dir, "lineitem").select(*plain, text.alias("text"))
    rows = rows.select("k", "n", "q", u256.from_string(F.col("text")).alias("number"))
    return rows.select("k", "n", "q", u256.to_string(F.col("number")).alias("digits"))


@BOOK.add("u256_sum", """
SELECT l_returnflag AS flag,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGNUM)) AS VARCHAR)
         || repeat('0', 60) AS total
FROM lineitem GROUP BY l_returnflag""")
def u256_sum(spark, sf_dir):
    text = F.concat(
        F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), F.lit("0" * 60)
    )
    return (
        views.table(spark, sf_dir, "lineitem")
        .select(F.col("l_returnflag").alias("flag"), u256.from_string(text).alias("v"))
        .groupBy("flag")
        .agg(u256.total(F.col("v")).alias("total"))
        .withColumn("total", u256.to_string(F.col("total")))
    )


@BOOK.add("u256_from_hex_words", """
SELECT l_orderkey AS k, l_partkey AS p, l_linenumber AS n,
       CAST(CAST(l_orderkey AS HUGEINT) * 18446744073709551616 + CAST(l_partkey AS HUGEINT) * 4294967296
            + l_suppkey AS VARCHAR) AS digits
FROM lineitem""")
def u256_from_hex_words(spark, sf_dir):
    """A word built from three keys at bit offsets 64, 32 and 0."""
    word = F.concat(
        F.lit("0" * 32),
        F.lpad(F.lower(F.hex("l_orderkey")), 16, "0"),
        F.lpad(F.lower(F.hex("l_partkey")), 8, "0"),
        F.lpad(F.lower(F.hex("l_suppkey")), 8, "0"),
    )
    rows = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n"),
        word.alias("word"),
    )
    return u256.with_words(rows, {"digits": F.col("word")}).select(
        "k", "p", "n", u256.to_string(F.col("digits")).alias("digits")
    )


@BOOK.add("event_stats", sql.cte(sql.PAYROLL) + """
SELECT event_name, count(*) AS n, min(block_number) AS first_block, max(block_number) AS last_block
FROM payroll GROUP BY event_name""")
def event_stats(spark, sf_dir):
    from ..operators import quality

    return quality.event_stats(views.payroll_events(spark, sf_dir)).drop("chain_id")
