"""Sharding by a hierarchical weighted hash tree, in native expressions only.

A tree has regions, racks in regions and shards in racks. From the root down, a
row draws one number for every child, ``-ln(u) / weight`` with ``u`` hashed from
the row's id, the level and the child's name, and descends to the smallest
draw; a node weighs as much as its leaves. A child is chosen in proportion to
its weight. When weights change, draws of the other children stay what they
were, so rows move only to or from the subtrees whose weight changed.

``grow`` adds a shard as a region of its own (with one rack). No weight of the
old nodes changes then, so every row that moves moves to the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def balanced_tree(shards: int, shards_per_rack: int = 2, racks_per_region: int = 2) -> list[Leaf]:
    """Equal weights; racks and regions are filled in the order of the shard numbers."""
    racks = [s // shards_per_rack for s in range(shards)]
    return [Leaf(r // racks_per_region, r, s) for s, r in enumerate(racks)]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """``tree`` and one more shard, in a new rack of a new region."""
    new = Leaf(*(max(getattr(x, n) for x in tree) + 1 for n in ("region", "rack", "shard")), weight)
    return [*tree, new]


def _draw(key: Column, level: str, name: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.concat_ws("/", F.lit(level), F.lit(str(name)), key)), 11)
    return -F.ln((bits.cast("double") + 0.5) / float(1 << 53)) / F.lit(float(weight))


def _winner(key: Column, level: str, weights: dict[int, float]) -> Column:
    """Name of the child with the smallest draw (ties to the smaller name)."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = [F.struct(_draw(key, level, n, w).alias("draw"), F.lit(n).alias("name")) for n, w in weights.items()]
    return F.least(*draws)["name"]


def with_place(df: DataFrame, tree: list[Leaf], key: Column, prefix: str) -> DataFrame:
    """Adds ``<prefix>region``, ``<prefix>rack`` and ``<prefix>shard``; the levels below read the one above."""
    def weights(level: str, parent: str | None = None, name: int | None = None) -> dict[int, float]:
        out: dict[int, float] = {}
        for leaf in tree:
            if (parent is None or getattr(leaf, parent) == name) and leaf.weight > 0:
                out[getattr(leaf, level)] = out.get(getattr(leaf, level), 0.0) + leaf.weight
        return out

    df = df.withColumn(f"{prefix}region", _winner(key, "region", weights("region")))
    for level, parent in (("rack", "region"), ("shard", "rack")):
        at, out = F.col(f"{prefix}{parent}"), None
        for name in weights(parent):
            here = _winner(key, level, weights(level, parent, name))
            out = (F if out is None else out).when(at == name, here)
        df = df.withColumn(f"{prefix}{level}", out)
    return df


def shard_documents(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tree: list[Leaf] | None = None
) -> DataFrame:
    """Per row: id, ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``law``, ``shard``, ``slot``,
    ``grown_shard`` (with one more shard), ``region`` and ``rack``.

    The law is ``key``: the id and the tree decide, nothing else. Rows with a null
    id share one place. A null text has size 1 and a null checksum. Slots number
    the rows of a shard from 0 without gaps; repeated rows each get a slot. Other
    columns are ignored. An empty table gives an empty result.
    """
    tree = tree or balanced_tree(shards)
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"),
    )
    rows = with_place(rows, tree, key, "")
    rows = with_place(rows, grow(tree), key, "grown_")
    rows = rows.withColumn("_bucket", ranks.hash_bucket("id", "text_crc32"))
    rows = ranks.with_number(rows, ["shard"], "_bucket", [F.col("id"), F.col("size"), F.col("text_crc32")], "slot")
    return rows.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.col("grown_shard").cast("int").alias("grown_shard"), F.col("region").cast("int").alias("region"),
        F.col("rack").cast("int").alias("rack"),
    )
