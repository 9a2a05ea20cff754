"""Whitening of embeddings with components found by contour integration.

1. Entries become integers, ``floor(64 * c) + 1000000``; counts and sums are exact.
2. The covariance is summed from entries centred at the integer nearest to the mean, as
   exact integers; what the rounding left is taken off exactly too. So large means cost
   no digits. A task sends one triangle of sums, never vectors.
3. The driver cuts the spectrum into intervals by inertia counts; each interval is a task
   that integrates around it (``feast``). A last Rayleigh-Ritz step over all of them
   makes the components orthogonal across intervals.
4. Every vector is projected where it is read.

The matrix has the square of the vectors' length in entries and does not grow with the
rows; longer vectors than ``MAX_DIM`` are refused. Vectors are read four times and are
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import feast

COMPONENTS = 32
MAX_DIM = 4096
STEP, BASE = 64, 1_000_000
_LARGEST = 1 << 61  # entries are held within this distance from the base
_ROWS = 2048  # of one product


def _vectors(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, entries - BASE as int64) of the vectors of each length, at most ``_ROWS`` rows at once."""
    lists = batch.column(column)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry becomes nan
    starts = np.concatenate([[0], np.cumsum(sizes)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    usable = (sizes > 0) & (bad[starts[1:]] == bad[starts[:-1]])
    for dim in np.unique(sizes[usable]):
        rows = np.flatnonzero(usable & (sizes == dim))
        for i in range(0, len(rows), _ROWS):
            own = rows[i : i + _ROWS]
            entries = np.floor(np.clip(flat[starts[own][:, None] + np.arange(dim)], -(2.0**55), 2.0**55) * STEP)
            yield own, np.clip(entries, -float(_LARGEST), float(_LARGEST)).astype(np.int64)


def _exact(values: np.ndarray, bound: int) -> np.ndarray:
    """``values`` as they are if results up to ``bound`` fit 64 bits, else as unbounded integers."""
    return values if bound < 1 << 62 else values.astype(object)


def _largest(values: np.ndarray) -> int:
    return max(-int(values.min()), int(values.max()), 1)


def _sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length of vector: how many, and the exact sums of their entries less ``BASE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for own, x in _vectors(batch, "v"):
                entry = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1], dtype=object)])
                entry[0] += len(own)
                entry[1] += _exact(x, _largest(x) * len(x)).sum(axis=0)
        for dim, (n, s) in total.items():
            yield _entries(dim, [-1, *range(dim)], [0] * (dim + 1), [n, *s])

    out: dict[int, tuple[int, list[int]]] = {}
    got = rows.select("v").mapInArrow(run, _ENTRY).groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect()
    for r in sorted(got, key=lambda r: (r["dim"], r["i"])):  # lengths times entries
        if r["i"] < 0:
            out[r["dim"]] = (int(r["value"]), [])
        else:
            out[r["dim"]][1].append(int(r["value"]))
    return out


_ENTRY = "dim int, i int, j int, value decimal(38,0)"


def _entries(dim: int, i, j, values) -> pa.RecordBatch:
    numbers = pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))
    return pa.RecordBatch.from_pydict({"dim": pa.array([dim] * len(numbers), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "value": numbers})


def _covariances(rows: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Covariance of the entries by length of vector, each entry rounded once."""
    middle = {dim: np.array([_nearest(s, n) for s in total], dtype=np.int64) for dim, (n, total) in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for own, x in _vectors(batch, "v"):
                y = x - middle[x.shape[1]]
                most = _largest(y) ** 2 * len(own)
                if most < 1 << 53:  # all sums are whole numbers that doubles hold exactly
                    part = (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64).astype(object)
                else:
                    part = y.T.astype(object) @ y.astype(object)
                dim = x.shape[1]
                total[dim] = total[dim] + part if dim in total else part
        for dim, part in total.items():
            i, j = np.triu_indices(dim)
            yield _entries(dim, i, j, part[i, j])

    out = {dim: np.zeros((dim, dim)) for dim in sums}
    for r in rows.select("v").mapInArrow(run, _ENTRY).groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect():
        n, total = sums[r["dim"]]
        i, j = r["i"], r["j"]
        left = [total[c] - n * int(middle[r["dim"]][c]) for c in (i, j)]
        out[r["dim"]][i, j] = out[r["dim"]][j, i] = (n * int(r["value"]) - left[0] * left[1]) / (n * n)
    return out


def _nearest(a: int, b: int) -> int:
    return (2 * a + b) // (2 * b)


def components(spark, covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and their unit eigenvectors, one a row."""
    dim, trace = len(covariance), float(np.trace(covariance))
    if trace <= 0:
        return np.zeros(min(most, dim)), np.eye(dim)[:most]
    scaled = covariance / trace
    cut = feast.intervals(scaled, min(most, dim))
    tasks = spark.createDataFrame([(k, *c) for k, c in enumerate(cut)], "k int, low double, high double, n int")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                _, x = feast.inside(scaled, r.low, r.high, r.n, r.k)
                yield pd.DataFrame({"k": r.k, "vector": list(x)})

    found = tasks.repartition(len(cut), "k").mapInPandas(run, "k int, vector array<double>").collect()
    q, _ = np.linalg.qr(np.array([r["vector"] for r in sorted(found, key=lambda r: r["k"])]).T)
    if q.shape[1] != sum(c[2] for c in cut):
        raise RuntimeError("not as many components as the inertia counts")
    values, small = np.linalg.eigh(q.T @ scaled @ q)
    vectors = (q @ small).T[::-1][:most]
    vectors *= np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)
    return values[::-1][:most] * trace, vectors


def whiten(embeddings: DataFrame, components_most: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    Rows whose vector is null or holds null, NaN or infinite entries are left out; so are
    empty vectors, which have no component. Vectors of another length are a fit of their
    own. Repeated rows and rows with a null id count and are returned like any other.
    Entries beyond 2**55 count as 2**55. A component without variance (constant rows, a
    single row) has a null ``whitened`` and counts in no ``identity_error``; ``explained``
    is null where nothing varies, and a ``deviation`` that no long holds is null. Of
    opposite eigenvectors the one whose largest entry is positive is taken. Other columns
    are ignored. An empty table gives an empty result.
    """
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    sums = _sums(rows)
    if any(dim > MAX_DIM for dim in sums):
        raise ValueError(f"vectors of more than {MAX_DIM} entries")
    fits = {}
    for dim, v in _covariances(rows, sums).items():
        values, vectors = components(embeddings.sparkSession, v, components_most)
        n, total = sums[dim]
        trace = float(np.trace(v))
        varies = values > 8 * dim * np.finfo(float).eps * trace
        middle = [_nearest(s, n) for s in total]
        left = [s - n * m for s, m in zip(total, middle, strict=True)]
        onto = vectors[varies].T / np.sqrt(values[varies])
        explained = np.maximum(values, 0) / trace if trace > 0 else np.full(len(values), np.nan)
        fits[dim] = (n, np.array(middle, dtype=np.int64), left, onto, varies, explained)

    def projected(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, middle, left, onto, _, _ = fits[x.shape[1]]
        y = x - middle
        return y, (y - np.array([r / n for r in left])) @ onto

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _vectors(batch, "v"):
                z = projected(x)[1]
                total[x.shape[1]] = total.get(x.shape[1], 0) + z.T @ z
        for dim, part in total.items():
            i, j = np.triu_indices(len(part))
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array(np.full(len(i), dim), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "value": part[i, j],
            })

    off: dict[int, float] = {}
    got = rows.select("v").mapInArrow(gram, "dim int, i int, j int, value double") if fits else None
    for r in got.groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect() if fits else []:
        error = abs(r["value"] / fits[r["dim"]][0] - (r["i"] == r["j"]))
        off[r["dim"]] = max(off.get(r["dim"], 0.0), error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in _vectors(batch, "v"):
                n, _, left, _, varies, explained = fits[x.shape[1]]
                y, z = projected(x)
                t = _exact(y, (n * (_largest(y) + 1)) ** 2 * x.shape[1]) * n - np.array(left, dtype=object if n >= 1 << 62 else np.int64)
                deviation = [int(d) if d < 1 << 63 else None for d in (t * t).sum(axis=1)]
                k = len(varies)
                whitened = np.full((len(own), k), np.nan)
                whitened[:, varies] = z
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(np.repeat(own, k))), pa.array(np.tile(np.arange(1, k + 1), len(own)), pa.int32()),
                        pa.array(np.full(len(own) * k, n), pa.int64()), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(own)), k))),
                        pa.array(whitened.ravel(), pa.float64(), mask=np.tile(~varies, len(own))),
                        pa.array(np.tile(explained, len(own)), pa.float64(), from_pandas=True),
                        pa.array([off.get(x.shape[1])] * (len(own) * k), pa.float64()),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(
        run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    return out.withColumnRenamed("id", id_col)
