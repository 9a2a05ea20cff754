"""Global order without a single task: slices or ranges plus their offsets.

A window without PARTITION BY, or one over a hot key, puts all its rows into
one task. Along blocks, rows are cut into slices by a plain expression, ordered inside a
slice and lifted by the totals of the slices before it; a hot key is as many windows as
it has slices. Other orders are range-partitioned, numbered inside each partition and
shifted by the totals of the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from . import u256

_POS_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def range_ordered(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """Rows in global order with ``_part`` (range) and ``_pos`` (row in the range).

    The result is durable: range bounds come from sampling, so two evaluations
    could cut differently, and everything computed from it must see one cut.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    numbered = ranged.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return durable(
        numbered.select(
            *df.columns,
            F.shiftright("_id", _POS_BITS).cast("int").alias("_part"),
            F.col("_id").bitwiseAND((1 << _POS_BITS) - 1).alias("_pos"),
        )
    )


def with_position(df: DataFrame, order: list[Column], name: str = "position", start: int = 1) -> DataFrame:
    """Dense global row number in ``order`` (which must be unique per row)."""
    ranged = range_ordered(df, order)
    # one row per range: bounded by the number of shuffle partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return ranged.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_before") + F.col("_pos") + start).alias(name)
    )


SLICE = 1 << 16
_LIMBS = ("hi", "mid", "lo")


def slice_of(block: str, width: int = SLICE) -> Column:
    """Blocks cut into slices of ``width``; a plain expression, the same in every evaluation."""
    return F.floor(F.col(block) / width).cast("long")


def running_sums(rows: DataFrame, keys: list[str], order: list[str], amount: str, name: str, at: str, width: int) -> DataFrame:
    """``rows`` with ``name``: the exact sum of signed ``amount`` of the key's rows up to each one in ``order``.

    ``order`` begins with ``at``; rows without an amount (null) add nothing. One exchange of
    the rows; the sums of slices are aggregated before they are exchanged.
    """
    sliced = rows.withColumn("_slice", slice_of(at, width))
    along = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = u256.with_running(sliced, amount, along, "_local")
    per_slice = sliced.groupBy(*keys, "_slice").agg(F.struct(*[F.sum(F.col(amount)[k]).alias(k) for k in _LIMBS]).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = u256.with_running(per_slice, "_sum", earlier, "_carry").filter(F.col("_carry_lo").isNotNull())
    carry = carry.select(*keys, "_slice", *[f"_carry_{k}" for k in _LIMBS])
    both = inside.join(carry, [*keys, "_slice"], "left")
    total = [
        (F.coalesce(f"_local_{k}", F.lit(0)).cast(u256.WIDE) + F.coalesce(f"_carry_{k}", F.lit(0)).cast(u256.WIDE)).cast(u256.WIDE)
        for k in _LIMBS
    ]
    return both.select(*rows.columns, u256.normalise_parts(*total).alias(name))


def number_by_block(df: DataFrame, order: list[str], name: str = "position", at: str = "block_number", width: int = 64) -> DataFrame:
    """Dense number from 1 in ``order``, which is unique and begins with ``chain_id`` and ``at``.

    Rows are numbered inside slices of ``width`` blocks and lifted by the rows of earlier
    slices: one row per slice, summed chain by chain.
    """
    sliced = df.withColumn("_slice", slice_of(at, width))
    inside = sliced.withColumn("_n", F.row_number().over(Window.partitionBy("chain_id", "_slice").orderBy(*order)))
    counts = sliced.groupBy("chain_id", "_slice").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("chain_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    chains = counts.groupBy("chain_id").agg(F.sum("_rows").alias("_all"))
    # chains are few
    earlier = Window.orderBy("chain_id").rowsBetween(Window.unboundedPreceding, -1)
    chains = chains.select("chain_id", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_chain"))
    offsets = counts.join(chains, "chain_id").select("chain_id", "_slice", (F.col("_before") + F.col("_chain")).alias("_offset"))
    placed = inside.join(offsets, ["chain_id", "_slice"])
    return placed.select(*df.columns, (F.col("_offset") + F.col("_n")).alias(name))
