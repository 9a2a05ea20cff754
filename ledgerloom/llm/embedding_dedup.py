"""Embedding near-dedup: spherical k-means cells and blocked cosine products inside them.

1. Equal vectors of a label are one row with a count.
2. Spherical k-means on a bounded sample gives the cells; every vector is at home in
   the cell whose centre is nearest by cosine.
3. A vector is also a guest in each cell where a vector near enough to link with it
   can be at home. Where such a partner y sits nearer to centre c than to x's own
   centre h, ``x.(h - c) <= chord * |h - c|`` holds, with ``chord`` the length between
   unit vectors at the threshold. So no link is lost at the borders of cells.
4. Inside a label and cell, the home vectors are multiplied with all members in
   blocks, in double precision. A block gives each home vector's links (a vector's
   counts come from its home cell only) and a spanning forest of the links; links
   themselves are never written out. A large cell is many blocks.
5. The forests are joined by the distributed components of ``graph``; the smallest
   id of each is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import vectors
from .graph import components

BLOCK = 4096  # home vectors of one block; columns are four times as many
STEP = 1024  # rows of one product
PER_CELL = 4096  # vectors of a cell, about
MAX_CELLS = 4096  # centres are sent to all tasks
SAMPLE = 20_000
SCORES = 1 << 20  # products with centres that are held at once
SENT = 8192  # rows of a batch of assigned vectors


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Unit centres; an emptied cell keeps its last centre."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    start = np.random.default_rng(seed).choice(len(unit), min(cells, len(unit)), replace=False)
    centres = unit[np.sort(start)]
    step = max(1, SCORES // max(1, len(centres)))
    for _ in range(rounds):
        home = np.concatenate([np.argmax(unit[i : i + step] @ centres.T, axis=1) for i in range(0, len(unit), step)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def cells_of(unit: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, at home) for the home cell and the cells where a partner may be at home."""
    near = unit @ centres.T
    home = np.argmax(near, axis=1)
    chord = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres[home] @ centres.T))
    inside = near[np.arange(len(unit)), home][:, None] - near <= chord * apart + 1e-9
    inside[np.arange(len(unit)), home] = True
    row, cell = np.nonzero(inside)
    return row, cell, cell == home[row]


def assigned(unit: np.ndarray, centres: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, cell, at home) of many vectors, some at once: a vector may be in every cell, however many there are."""
    step = max(1, SCORES // len(centres))
    for first in range(0, len(unit), step):
        row, cell, home = cells_of(unit[first : first + step], centres, threshold)
        for i in range(0, len(row), SENT):
            yield row[i : i + SENT] + first, cell[i : i + SENT], home[i : i + SENT]


def _united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels (smallest member) after also joining the pairs (i, j)."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            deeper = label[label]
            if (deeper == label).all():
                break
            label = deeper


def _linked(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        side = group["row"].to_numpy()
        names, at = np.unique(group["rep"].to_numpy().astype(str), return_inverse=True)
        rows, columns = np.flatnonzero(side), np.flatnonzero(~side)
        unit, copies = vectors.stacked(list(group["unit"])), group["copies"].to_numpy()
        links, label = np.zeros(len(rows), dtype=np.int64), np.arange(len(names))
        for i in range(0, len(rows), STEP):
            for j in range(0, len(columns), BLOCK):
                own, other = rows[i : i + STEP], columns[j : j + BLOCK]
                hit = unit[own] @ unit[other].T >= threshold
                links[i : i + STEP] += hit @ copies[other]
                a, b = np.nonzero(hit)
                label = _united(label, at[own[a]], at[other[b]])
        tied = np.flatnonzero(label != np.arange(len(names)))
        return pd.DataFrame({
            "rep": np.concatenate([names[at[rows]], names[tied]]),
            "n_links": pd.array([*links, *[None] * len(tied)], dtype="Int64"),
            "root": np.concatenate([names[at[rows]], names[label[tied]]]),
        })

    return run


def near_duplicates(
    embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    threshold: float = 0.93, sample_rows: int = SAMPLE,
) -> DataFrame:
    """Per row: id, ``n_links``, ``component_id`` and ``kept`` (the row names its component).

    Rows link when their labels are equal and not null and their cosine in double
    precision is at least ``threshold``. A vector that is null, empty, zero or has
    null or non-finite components links with nothing, nor does one of another
    length than its label's others (vectors of each length are compared among
    themselves). Repeated ids are rows of their own and link when their vectors do.
    Rows with a null id take part and are never ``kept``. Other columns are ignored.
    An empty table gives an empty result. Centres are fitted on about ``sample_rows``
    vectors; all are assigned and compared.
    """
    rows = embeddings.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v")
    ).withColumn("ok", vectors.usable("v") & F.col("label").isNotNull())
    rows = durable(rows.withColumn("dim", F.size("v")))
    classes = rows.filter("ok").groupBy("label", "dim", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    # a class is named by a hash of what it holds, so a null or repeated id does no harm
    classes = durable(classes.withColumn("rep", F.sha2(F.to_json(F.struct("label", "v")), 256)))

    found = None
    for dim in sorted(r["dim"] for r in classes.select("dim").distinct().collect()):
        own = classes.filter(F.col("dim") == dim)
        part = durable(_products(own, threshold, sample_rows))
        found = part if found is None else found.unionByName(part)
    kind = rows.schema["id"].dataType.simpleString()
    if found is None:
        return rows.select(
            F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
            F.col("id").isNotNull().alias("kept"),
        )
    nodes = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    # a vector is in its own row of the product; that is no link
    counts = found.filter("n_links is not null").groupBy("rep").agg((F.sum("n_links") - 1).alias("n_links"))
    named = classes.join(counts, "rep").join(nodes, F.col("rep") == F.col("node"), "left")
    named = named.select("label", "v", "least", "n_links", F.coalesce("root", "rep").alias("root"))
    least = named.groupBy("root").agg(F.min("least").cast(kind).alias("component_id"))
    named = named.join(least, "root").select("label", "v", "n_links", "component_id", F.lit(True).alias("ok"))
    out = rows.join(named, ["label", "v", "ok"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _products(classes: DataFrame, threshold: float, sample_rows: int) -> DataFrame:
    """(rep, n_links of a block or null, root) of vectors of one length."""
    count = classes.count()
    centres = spherical_kmeans(vectors.sample(classes, "rep", "v", sample_rows), min(MAX_CELLS, -(-count // PER_CELL)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = vectors.matrix(batch.column("v"))
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
            for row, cell, home in assigned(unit, centres, threshold):
                take = pa.array(row)
                yield pa.RecordBatch.from_pydict({
                    "label": batch.column("label").take(take), "cell": pa.array(cell, pa.int32()), "home": pa.array(home),
                    "rep": batch.column("rep").take(take), "copies": batch.column("copies").take(take),
                    "unit": vectors.blobs(unit[row]),
                })

    kind = classes.schema["label"].dataType.simpleString()
    cells = classes.select("label", "rep", "copies", "v").mapInArrow(
        assign, f"label {kind}, cell int, home boolean, rep string, copies long, unit binary"
    )
    # blocks of a cell by its rows and columns; a row per label and cell
    blocks = cells.groupBy("label", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).cast("int").alias("parts"),
        F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("others"),
    )
    blocks = durable(blocks.filter("parts > 0"))  # a cell nobody is at home in needs no product
    cells = cells.join(blocks, ["label", "cell"])
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    seat = lambda part, other, row: F.struct(part.alias("part"), other.alias("other"), F.lit(row).alias("row"))
    seats = F.concat(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("others") - 1), lambda _: F.col("home")), lambda o: seat(own("parts"), o, True)),
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: seat(p, own("others"), False)),
    )
    dealt = cells.select("label", "cell", "rep", "copies", "unit", F.explode(seats).alias("s"))
    dealt = dealt.select("label", "cell", "s.part", "s.other", "s.row", "rep", "copies", "unit")
    return dealt.groupBy("label", "cell", "part", "other").applyInPandas(_linked(threshold), "rep string, n_links long, root string")
