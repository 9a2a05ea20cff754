"""Gapless numbers and running sums inside groups of any size, with native windows.

A group is cut into ``BUCKETS`` hash or range buckets. Windows run inside a
(group, bucket), and what a group has in earlier buckets is added from one row
per (group, bucket), so a group with a third of all rows is many small windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def hash_bucket(*columns: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def with_offset(df: DataFrame, keys: list[str], bucket: str, amount: Column, name: str) -> DataFrame:
    """``name``: the sum of ``amount`` in earlier buckets of the row's group. ``keys`` are not null."""
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(F.sum(amount).alias("_in_bucket"))
    totals = totals.select(*keys, bucket, F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)).alias(name))
    return df.join(totals, [*keys, bucket])


def with_number(df: DataFrame, keys: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """``name``: 0, 1, 2 ... without gaps inside each group, by bucket and ``order``."""
    shifted = with_offset(df, keys, bucket, F.lit(1), "_before")
    inside = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    return shifted.withColumn(name, (F.col("_before") + inside - 1).cast("long")).drop("_before")
