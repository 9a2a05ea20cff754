"""Exact time-to-live deduplication of a delivered batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .asof import asof_join

DAY = 86_400_000_000  # microseconds


def dedup_deliveries(deliveries: DataFrame, keys, time: str, ttl: str = "30 days") -> DataFrame:
    """Times at which a key is let through: the first delivery, then the first one
    at least ``ttl`` after the last accepted.

    Whether a delivery passes depends on the one accepted before it. Every delivery
    first gets the one that would follow it (an as-of join, one per key and time), whether
    it passes itself or not. What can be reached from a key's first delivery is then found by
    doubling: a round knows the jumps of 1, 2, 4 ... steps and applies them to all times
    reached so far. A key that is let through n times needs log2(n) rounds, and the
    rounds of all keys are the same jobs. Joins are on key and time, so a key with very
    many deliveries is no hot spot.
    """
    keys = list(keys)
    types = {k: f"_k{i}" for i, k in enumerate(keys)}  # null keys are keys like any other
    own = [F.struct(F.col(k).isNull().alias("none"), F.col(k).alias("value")).alias(n) for k, n in types.items()]
    names = list(types.values())
    due = F.unix_micros(F.col(time) + F.expr(f"INTERVAL {ttl}"))
    times = deliveries.filter(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.count("*").alias("_copies"))
    times = durable(times.select(*own, F.unix_micros(time).alias("_at"), due.alias("_due")))
    facts = times.select(*names, F.col("_at").alias("_due"), F.col("_at").alias("_next"))
    jumps = asof_join(times, facts, names, "_due", ["_next"], direction="forward", width=DAY)
    jumps = durable(jumps.filter("_next IS NOT NULL").select(*names, "_at", "_next"))
    reached = durable(times.groupBy(*names).agg(F.min("_at").alias("_at")))
    while not jumps.isEmpty():
        ahead = reached.join(jumps, [*names, "_at"]).select(*names, F.col("_next").alias("_at"))
        reached = durable(reached.unionByName(ahead))
        further = jumps.select(*names, F.col("_at").alias("_next"), F.col("_next").alias("_far"))
        jumps = durable(jumps.join(further, [*names, "_next"]).select(*names, "_at", F.col("_far").alias("_next")))
    plain = [F.col(n)["value"].alias(k) for k, n in types.items()]
    return reached.select(*plain, F.timestamp_micros("_at").cast(deliveries.schema[time].dataType).alias(time))
