"""Webhook deliveries: nested JSON text to one row per log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DELIVERY


def parse_deliveries(text: DataFrame, column: str = "value") -> DataFrame:
    """Rows of JSON text to logs; malformed deliveries are left out.

    A delivery with a member of the wrong type is malformed as a whole; an absent
    log index is 0. Use :func:`rejected_deliveries` to see what was left out.
    """
    body = text.select(_parsed(column).alias("d"))
    # the outer form, filtered afterwards on what it yields: a condition on the array or on the
    # mark of malformed ones would be pushed below the parser and parse every document twice
    logs = F.when(F.col("d._corrupt").isNull(), F.col("d.event.data.block.logs"))
    return (
        body.select(
            F.col("d.createdAt").alias("created_at"),
            F.col("d.event.data.block.number").alias("block_number_fallback"),
            F.explode_outer(logs).alias("log"),
        )
        .filter(F.col("log").isNotNull())
        .select(
            F.col("log.transactionHash").alias("tx_hash"),
            F.coalesce("log.logIndex", F.lit(0)).alias("log_index"),
            F.col("log.blockNumber").alias("block_number"),
            "block_number_fallback",
            F.col("log.address").alias("address"),
            F.col("log.account.address").alias("account_address"),
            F.col("log.data").alias("data"),
            F.col("log.topics").alias("topics"),
            F.coalesce("log.removed", F.lit(False)).alias("removed"),
            "created_at",
        )
    )


def rejected_deliveries(text: DataFrame, column: str = "value") -> DataFrame:
    """Deliveries that do not parse: not JSON, or a member of the wrong type."""
    # as in parse_deliveries, the condition is on what an outer form yields
    marked = text.select("*", F.explode_outer(F.array(_parsed(column)["_corrupt"])).alias("_corrupt"))
    return marked.filter(F.col("_corrupt").isNotNull()).drop("_corrupt")


def _parsed(column: str) -> Column:
    schema = T.StructType([*DELIVERY.fields, T.StructField("_corrupt", T.StringType())])
    return F.from_json(F.col(column), schema, {"columnNameOfCorruptRecord": "_corrupt"})


def read_deliveries(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Landed delivery files, one JSON document per line, as a batch or a stream."""
    reader = spark.readStream if streaming else spark.read
    return parse_deliveries(reader.text(path))
