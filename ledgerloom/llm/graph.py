"""Connected components of an edge table: local contraction, then large and small stars.

Edges never leave the executors. Every task first joins the edges it holds (about
``PER_TASK`` of them) to a forest of stars around the smallest node; then the forests
of different tasks are tied by alternating large and small stars, each a grouped
minimum and a join, until every node hangs on one root. An iteration is written to
the shared folder. A node with very many edges is reduced in its task and by partial
minima before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

PER_TASK = 250_000


def forest(pairs: list[tuple]) -> dict:
    """Root of every node that is not a root itself; a root is the smallest of its component."""
    root: dict = {}

    def find(x):
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x], x = top, up
        return top

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a task's edges; one that has more than was meant keeps only their forests."""
    pairs: list[tuple] = []
    kind = None

    def flush() -> pa.RecordBatch:
        tied = forest(pairs)
        pairs.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(tied), kind), pa.array(list(tied.values()), kind)], names=["u", "v"])

    for batch in batches:
        kind = batch.schema.field(0).type
        pairs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(pairs) > 4 * PER_TASK:
            yield flush()
    if pairs:
        yield flush()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a root, and no root has one itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root"))
    )
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return sums.filter("up > 1 or up = 1 and root = 1").isEmpty()  # a repeated edge only costs a round


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``, a written table; root is the smallest node reachable.

    Edges with a null end and loops are ignored; repeated edges count once. An
    empty table gives an empty result. Nodes may be of any ordered type.
    """
    edges = edges.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    kind = edges.schema["u"].dataType.simpleString()
    tasks = -(-edges.count() // PER_TASK) or 1
    edges = durable(edges.coalesce(tasks).mapInArrow(_contract, f"u {kind}, v {kind}"))
    while not _stars(edges):
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = edges.union(turned).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: the larger neighbours of u are tied to the least neighbour of u
        large = turned.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # small star: u and its smaller neighbours are tied to the least of them
        large = durable(large.distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.select("u", F.col("m").alias("v")).union(tied).distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
