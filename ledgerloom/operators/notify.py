"""Event notifications as messages for a channel sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import u256

CHANNELS = ("chain:events", "chain:settled")


def notifications(events: DataFrame, channels=CHANNELS) -> DataFrame:
    """One message per escrow event and channel: ``channel``, ``value`` (JSON).

    Missing id and amount are sent as empty text.
    """
    body = F.to_json(
        F.struct(
            F.coalesce(u256.to_string(F.col("amount")), F.lit("")).alias("amount"),
            F.coalesce(u256.to_string(F.col("escrow_id")), F.lit("")).alias("escrowId"),
            F.col("event_type").alias("eventType"),
            F.col("tx_hash").alias("txHash"),
        )
    )
    each = F.explode(F.array(*[F.lit(c) for c in channels]))
    return events.select(body.alias("value"), F.col("tx_hash").alias("key")).select(
        each.alias("channel"), "key", "value"
    )
