"""Operators on embeddings: brute force and odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, embedding_dedup, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def made(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], n) for i, v, n in rows], SCHEMA)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for _ in range(60):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 14))):
            rows.append((n, centre + rng.normal(size=16) * 0.28, int(rng.integers(0, 3)) if rng.random() < 0.9 else None))
            n += 1
    return rows + [(n + i, rows[3][1], rows[3][2]) for i in range(4)]  # exact copies


@pytest.fixture(scope="module")
def odd(spark):
    v = [1.0, 0.0, 0.0, 0.0]
    rows = [
        (1, None, 0), (2, [], 0), (3, [0, 0, 0, 0], 0), (4, [1, None, 0, 0], 0), (5, [float("nan"), 1, 0, 0], 0),
        (6, [float("inf"), 1, 0, 0], 0), (7, v, 0), (8, v, 0), (8, v, 0), (9, v, None), (None, v, 0), (10, [1.0, 0.0], 0), (20, [2.0, 0, 0, 0.1], 0),
    ]
    frame = made(spark, rows)
    for name in ("id", "v", "rep", "cell", "ok", "dim", "score", "rank"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.mark.parametrize("per_cell", [4096, 20])
def test_links_equal_brute_force(spark, clustered, monkeypatch, per_cell):
    """With one cell, and with many cells and blocks."""
    monkeypatch.setattr(embedding_dedup, "PER_CELL", per_cell)
    rows = clustered
    unit = np.array([np.float32(v) for _, v, _ in rows], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = [n for _, _, n in rows]
    hit = unit @ unit.T >= 0.93
    links = {i: [j for j in range(len(rows)) if j != i and hit[i, j] and label[i] is not None and label[i] == label[j]] for i in range(len(rows))}
    root = {}
    for i in links:
        if i not in root:
            todo, root[i] = [i], i
            while todo:
                for j in links[todo.pop()]:
                    if j not in root:
                        root[j] = i
                        todo.append(j)
    assert 50 < sum(map(len, links.values()))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(made(spark, rows)).collect()}
    assert got == {i: (len(links[i]), root[i], root[i] == i) for i in links}


def test_cells_lose_no_partner():
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(800, 8))
    unit[400:] = unit[:400] + rng.normal(size=(400, 8)) * 0.2
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    centres = embedding_dedup.spherical_kmeans(unit, 30)
    row, cell, home = embedding_dedup.cells_of(unit, centres, 0.93)
    at = {int(r): int(c) for r, c, h in zip(row, cell, home, strict=True) if h}
    inside = set(zip(row.tolist(), cell.tolist(), strict=True))
    near = np.argwhere(unit @ unit.T >= 0.93)
    assert len(near) > 1000 and all((int(i), at[int(j)]) in inside for i, j in near)
    assert len(row) < 30 * len(unit)


def test_near_duplicates_of_odd_rows(spark, odd):
    got = embedding_dedup.near_duplicates(odd).collect()
    by = {r["vec_id"]: r for r in got}
    assert len(got) == odd.count()
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in (1, 2, 3, 4, 5, 6, 9, 10))
    assert by[7]["n_links"] == 4 and by[20]["n_links"] == 4 and by[8]["component_id"] == 7 and by[None]["component_id"] == 7
    assert not by[None]["kept"] and embedding_dedup.near_duplicates(odd.limit(0)).count() == 0


def exact(rows, asks, k):
    out = {}
    for i, v in rows:
        if asks(i):
            scored = sorted(((-float(np.dot(v, w)), j) for j, w in rows if j != i))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


@pytest.mark.parametrize("stretch", [0.0, 1.0])
def test_search_recall(spark, stretch):
    """Vectors of one length, and of very different lengths."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(1500, 24))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * np.exp(stretch * rng.normal(size=(1500, 1)) * 0.3)
    rows = [(i, np.float64(np.float32(x))) for i, x in enumerate(v)]
    got = ann.nearest(made(spark, [(i, x, 0) for i, x in rows]), F.col("vec_id") % 20 == 0, k=20).collect()
    want = exact(rows, lambda i: i % 20 == 0, 20)
    found = 0
    for q, best in want.items():
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        for r in mine:
            assert abs(r["score"] - float(np.dot(rows[q][1], rows[r["vec_id"]][1]))) < 1e-12
        found += len({r["vec_id"] for r in mine} & {j for j, _ in best})
    assert found / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("lengths", ["one", "outliers", "spread"])
def test_recall_does_not_hang_on_lengths(spark, monkeypatch, lengths):
    """64 dimensions, tables for the bands of 500 rows or more; every query has its 20."""
    monkeypatch.setattr(ann, "EXACT", 500)
    rng = np.random.default_rng(11)
    v = rng.normal(size=(3000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if lengths == "outliers":
        v[7], v[8] = v[7] * 100, v[8] * 10
    if lengths == "spread":
        v *= np.exp(0.5 * rng.normal(size=(3000, 1)))
    rows = [(i, np.float64(np.float32(x))) for i, x in enumerate(v)]
    got = ann.nearest(made(spark, [(i, x, 0) for i, x in rows]), F.col("vec_id") % 20 == 0, k=20).collect()
    want = exact(rows, lambda i: i % 20 == 0, 20)
    mine = {q: {r["vec_id"] for r in got if r["query_id"] == q} for q in want}
    assert all(len(m) == 20 for m in mine.values())
    assert sum(len(mine[q] & {j for j, _ in best}) for q, best in want.items()) / (20 * len(want)) >= 0.9


def test_small_sets_and_short_queries_are_whole(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, np.float64(np.float32(x))) for i, x in enumerate(rng.normal(size=(21, 64)))]
    frame = made(spark, [(i, x, 0) for i, x in rows])
    for least in (4096, 1):  # compared at once, or after the tables gave too few
        monkeypatch.setattr(ann, "EXACT", least)
        got = ann.nearest(frame, F.col("vec_id") % 20 == 0, k=20).collect()
        assert {q: [j for j, _ in b] for q, b in exact(rows, lambda i: i % 20 == 0, 20).items()} == {
            q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20)
        }


def test_blocks_of_a_bucket_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    frame = made(spark, [(i, rng.normal(size=8), 0) for i in range(300)] + [(1000 + i, np.ones(8), 0) for i in range(200)])
    one = {tuple(r) for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, k=5).select("query_id", "rank", "vec_id").collect()}
    monkeypatch.setattr(ann, "BLOCK", 16)
    assert {tuple(r) for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, k=5).select("query_id", "rank", "vec_id").collect()} == one


def test_search_of_odd_rows(odd):
    got = ann.nearest(odd, F.col("vec_id") % 20 == 0, k=20).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(20, 7), (20, 8), (20, 9)]
    assert ann.nearest(odd.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_hadamard_is_orthogonal():
    h = ann.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def test_vectors_of_many_cells_are_assigned_in_bounded_memory():
    """Vectors without clusters are guests in nearly every cell: what is held at once grows neither with cells nor with vectors."""
    import tracemalloc

    rng = np.random.default_rng(4)
    unit, centres = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(n, 32)) for n in (5000, 2000)))
    few = [np.concatenate(c) for c in zip(*embedding_dedup.assigned(unit[:600], centres, 0.93), strict=True)]
    assert all((a == b).all() for a, b in zip(few, embedding_dedup.cells_of(unit[:600], centres, 0.93), strict=True))
    tracemalloc.start()
    rows = homes = 0
    for row, _, home in embedding_dedup.assigned(unit, centres, 0.93):
        assert len(row) <= embedding_dedup.SENT
        rows += len(row)
        homes += home.sum()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert homes == len(unit) and rows > 5 * len(unit) and peak < 100 << 20
    assert (vectors.stacked(vectors.blobs(unit).to_pylist()) == unit).all()
