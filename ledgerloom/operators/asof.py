"""As-of joins: for many (key, block) requests the facts before or after each of them.

Requests and facts of a key go into one sorted union and the last fact is carried along
it. A key is cut into slices of ``SLICE`` blocks by a plain expression on the block, so
neither its place nor its neighbours depend on sampling. Facts and requests are first
reduced to one row per key and block: a slice has at most twice ``SLICE`` rows, however hot
its key. What a slice needs from earlier ones is one row per key and slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import u256
from ..functions.ordered import SLICE, running_sums, slice_of
from .balances import movements

def _both(requests: DataFrame, facts: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Distinct requests (``_asks``) and facts in one relation."""
    asked = requests.select(*keys, at).filter(F.col(at).isNotNull()).distinct().withColumn("_asks", F.lit(True))
    return facts.withColumn("_asks", F.lit(False)).unionByName(asked, allowMissingColumns=True)


def asof_join(
    requests: DataFrame, facts: DataFrame, keys: list[str], at: str, values: list[str], tie: list[str] | None = None,
    direction: str = "backward", tolerance: int | None = None, width: int = SLICE,
) -> DataFrame:
    """``requests`` with ``values`` of the fact nearest in ``direction`` and ``{at}_found``, its block.

    ``backward`` takes the newest fact at or before a request's ``at``, ``forward`` the oldest
    one at or after it. A fact farther away than ``tolerance`` is none, and then the added
    columns are null; no request is dropped. Of facts of one key and block the one with the
    largest ``tie`` counts (default: the largest values). Null keys match nothing.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    found = f"{at}_found"
    fact = F.struct(F.col(at).alias("at"), *values)
    one = facts.groupBy(*keys, at).agg(F.max_by(F.struct(*values), F.struct(*(tie or values))).alias("_v"))
    one = one.select(*keys, at, *[F.col("_v")[v].alias(v) for v in values]).withColumn("_fact", fact).drop(*values)
    both = _both(requests, one, keys, at).withColumn("_slice", slice_of(at, width))
    order = (lambda c: F.col(c).asc()) if direction == "backward" else (lambda c: F.col(c).desc())
    along = Window.partitionBy(*keys, "_slice").orderBy(order(at), F.col("_asks").asc())
    inside = both.withColumn("_near", F.last("_fact", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    # the farthest fact of a slice is what later slices see
    told = F.when(~F.col("_asks"), F.col(at))
    far = F.max_by("_fact", told) if direction == "backward" else F.min_by("_fact", told)
    edge = both.groupBy(*keys, "_slice").agg(far.alias("_edge"))
    slices = Window.partitionBy(*keys).orderBy(order("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.select(*keys, "_slice", F.last("_edge", ignorenulls=True).over(slices).alias("_carry"))
    near = inside.filter("_asks").join(carry.filter("_carry IS NOT NULL"), [*keys, "_slice"], "left")
    near = near.select(*keys, at, F.coalesce("_near", "_carry").alias("_near"))
    close = F.lit(True) if tolerance is None else F.abs(F.col("_near.at") - F.col(at)) <= tolerance
    near = near.select(*keys, at, F.when(close, F.col("_near")).alias("_near"))
    return requests.join(near, [*keys, at], "left").select(
        *requests.columns, *[F.col("_near")[v].alias(v) for v in values], F.col("_near.at").alias(found)
    )


def balances_asof(transfers: DataFrame, requests: DataFrame, width: int = SLICE) -> DataFrame:
    """``requests`` (chain_id, token, address, block_number, ...) with the exact ``balance`` after that block.

    All requests are answered by one scan of the transfers. An address without movements
    has 0; the zero address is answered too. Requests with a null in their key or block have a
    null balance.
    """
    keys, at = ["chain_id", "token", "address"], "block_number"
    moves = movements(transfers, keep_zero=True).groupBy(*keys, at).agg(u256.total(F.col("delta")).alias("delta"))
    both = _both(requests, moves, keys, at)
    sums = running_sums(both, keys, [at, "_asks"], "delta", "balance", at, width)
    answers = sums.filter("_asks").select(*keys, at, "balance")
    return requests.join(answers, [*keys, at], "left")
