"""Approximate nearest neighbours by cross-polytope hashing.

A table turns a unit vector by three pseudo-rotations (random signs, then the fast
Hadamard transform) and names it by the nearest signed axis: the coordinate of
the largest size and its sign. A query looks into the buckets of its ``probes``
nearest axes in each of ``tables`` tables. Every row is indexed; buckets are
divided into blocks by their measured size, so a bucket that holds a third of all
rows is many tasks, and nothing is capped.

Inside a block, queries and rows meet in one matrix product of the original vectors
in double precision; the best ``k`` of each query leave the block, and the best of
all blocks are the result. Largest inner product is asked and angles are hashed, so
rows are banded by length: inside a band angles order nearly as products do. A band of
few rows (outliers in length among them) is compared with every query, and so are all
rows with a query that the tables gave fewer than ``k``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from . import vectors

BLOCK = 8192
TABLES = 12
PROBES = 12
BAND = 1.25  # lengths of a band, longest by shortest
EXACT = 4096  # a band of fewer rows is compared with all queries
QUERIES = 512  # of one product


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotations(width: int, tables: int, seed: int = 5) -> np.ndarray:
    """Random signs of three rounds for each table."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, width))


def padded(rows: np.ndarray) -> np.ndarray:
    """Rows filled with zeros to a power of two."""
    out = np.zeros((len(rows), 1 << (rows.shape[1] - 1).bit_length()))
    out[:, : rows.shape[1]] = rows
    return out


def axes(x: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of every row, nearest first, ties to the smaller one."""
    for s in signs:
        x = hadamard(x * s)
    order = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :probes]
    return order * 2 + (np.take_along_axis(x, order, axis=1) < 0)


def nearest(
    embeddings: DataFrame, queries: F.Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    tables: int = TABLES, probes: int = PROBES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query.

    ``queries`` is a condition on the rows of ``embeddings`` that are queries;
    candidates are all rows but those with the query's own id. Ties go to the smaller
    id. Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null id, take no part; vectors meet only others of their length. A
    repeated id is one candidate, with its best score; a query id that is repeated
    searches with the vector of each row and keeps the best. Other columns are
    ignored. An empty table gives an empty result.
    """
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), queries.alias("q")
    )
    rows = rows.filter(vectors.usable("v") & F.col("id").isNotNull()).select("id", "v", F.coalesce("q", F.lit(False)).alias("q"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    # rounded, so that vectors of length 1 are in the middle of a band; squares may leave the range of doubles
    band = F.round(F.log(F.least(F.greatest(norm, F.lit(1e-300)), F.lit(1e300))) / (2 * math.log(BAND))).cast("int")
    rows = durable(rows.withColumn("dim", F.size("v")).withColumn("band", band))
    sizes = rows.groupBy("dim", "band").agg(F.count("*").alias("n"), F.count_if("q").alias("asks")).collect()  # lengths are few
    few = {(r["dim"], r["band"]) for r in sizes if r["n"] < EXACT}
    hashed = {r["dim"] for r in sizes if r["n"] >= EXACT}
    asks = sum(r["asks"] for r in sizes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, bands = batch.column("dim").to_numpy(), batch.column("band").to_numpy()
            small = np.array([(int(d), int(c)) in few for d, c in zip(dims, bands, strict=True)], dtype=bool)
            for dim in np.unique(dims[np.isin(dims, list(hashed))]):
                at = np.flatnonzero(dims == dim)
                own = batch.take(pa.array(at))
                x = vectors.matrix(own.column("v"))
                blobs = [v.tobytes() for v in x]
                flat, indexed = padded(x), np.flatnonzero(~small[at])
                asks = np.flatnonzero(own.column("q").to_numpy(zero_copy_only=False))
                ids = own.column("id").to_numpy()
                for t, signs in enumerate(rotations(flat.shape[1], tables)):
                    home = axes(flat[indexed], signs, 1)[:, 0]
                    probed = axes(flat[asks], signs, probes) if len(asks) else np.zeros((0, 1), np.int64)
                    who = np.concatenate([indexed, np.repeat(asks, probed.shape[1])])
                    yield pa.RecordBatch.from_pydict({
                        "dim": pa.array(np.full(len(who), dim), pa.int32()), "bucket_table": pa.array(np.full(len(who), t), pa.int32()),
                        "bucket": pa.array(np.concatenate([home, probed.ravel()]), pa.int32()),
                        "asks": pa.array(np.arange(len(who)) >= len(indexed)), "id": pa.array(ids[who], pa.int64()),
                        "vector": pa.array([blobs[i] for i in who], pa.binary()),
                    })

    key = ["dim", "bucket_table", "bucket"]
    placed = rows.mapInArrow(place, "dim int, bucket_table int, bucket int, asks boolean, id long, vector binary")
    # blocks of a bucket by its rows; a row per table and axis
    blocks = placed.filter("not asks").groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(F.broadcast(durable(blocks)), key) if hashed else placed.withColumn("blocks", F.lit(1))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("block", F.explode(F.when(F.col("asks"), every).otherwise(own))).drop("blocks")

    def best(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        out = []
        if asks.any() and not asks.all():
            held = group[~asks].sort_values("id", kind="stable")
            ids, x = held["id"].to_numpy(), vectors.stacked(list(held["vector"]))
            looking = group[asks]
            for at in range(0, len(looking), QUERIES):
                part = looking.iloc[at : at + QUERIES]
                mine = part["id"].to_numpy()
                score = vectors.stacked(list(part["vector"])) @ x.T
                score[mine[:, None] == ids[None, :]] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]  # columns ascend by id, so ties do
                row = np.repeat(np.arange(len(part)), top.shape[1])
                got = score[row, top.ravel()]
                real = got > -np.inf
                out.append(pd.DataFrame({"query_id": mine[row][real], "vec_id": ids[top.ravel()][real], "score": got[real]}))
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return pd.concat(out) if out else empty

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            column, blobs = batch.column(2), []
            values, cuts = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), pa.compute.list_value_length(column)
            for n in cuts.to_pylist():
                blobs.append(values[at : at + n].tobytes())
                at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["dim", "id", "vector"])

    blobs = lambda some: some.select("dim", "id", "v").mapInArrow(flat, "dim int, id long, vector binary")

    def compared(held: DataFrame, looking: DataFrame, held_rows: int, parts: int) -> DataFrame:
        """Every row with every query of its length: blocks of rows by parts of queries."""
        across = -(-max(1, held_rows) // BLOCK)
        own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        held = blobs(held).withColumn("asks", F.lit(False)).withColumn("block", own(across)).withColumn("part", all_of(parts))
        looking = blobs(looking).withColumn("asks", F.lit(True)).withColumn("part", own(parts)).withColumn("block", all_of(across))
        both = held.unionByName(looking)
        return both.groupBy("dim", "block", "part").applyInPandas(best, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    in_few = F.lit(False)
    for dim in sorted({d for d, _ in few}):
        in_few = in_few | ((F.col("dim") == dim) & F.col("band").isin([c for d, c in sorted(few) if d == dim]))
    found = []
    if few:
        n = sum(r["n"] for r in sizes if (r["dim"], r["band"]) in few)
        found.append(compared(rows.filter(in_few), rows.filter("q"), n, -(-max(1, asks) // BLOCK)))
    if hashed:
        found.append(dealt.groupBy(*key, "block").applyInPandas(best, "query_id long, vec_id long, score double"))
    if not found:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = ranked(found[0] if len(found) == 1 else found[0].unionByName(found[1]))
    if not hashed:
        return first
    first = durable(first)
    full = first.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    short = durable(rows.filter("q").filter(F.col("dim").isin(sorted(hashed))).join(full, F.col("id") == F.col("query_id"), "left_anti"))
    lacking = short.count()
    if not lacking:
        return first
    n = sum(r["n"] for r in sizes if (r["dim"], r["band"]) not in few)
    more = compared(rows.filter(~in_few), short, n, -(-lacking // BLOCK))
    return ranked(first.select("query_id", "vec_id", "score").unionByName(more))
