"""FEAST whitening against numpy's own eigenvectors and plain integer sums."""

import math

import numpy as np
import pytest

from ledgerloom.llm import feast, whitening


def spectrum(kind: str, d: int) -> np.ndarray:
    rng = np.random.default_rng(d)
    if kind == "repeated":
        return np.repeat([4.0, 2.0, 1.0, 0.5], d // 4)
    if kind == "falling":
        return np.exp(-np.arange(d) / 6.0)
    if kind == "deficient":
        return np.r_[rng.random(d // 4) + 0.1, np.zeros(d - d // 4)]
    return rng.random(d) + 0.1


@pytest.mark.parametrize("kind", ["random", "repeated", "falling", "deficient"])
@pytest.mark.parametrize("d", [1, 2, 12, 64, 128])
def test_contours_find_the_whole_spectrum(kind, d):
    if kind in ("repeated", "deficient") and d < 4:
        return
    e = spectrum(kind, d)
    q, _ = np.linalg.qr(np.random.default_rng(d + 1).standard_normal((d, d)))
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    true = np.linalg.eigvalsh(a)
    for shift in (0.3, 0.77, 1.1):
        assert feast.above(a, shift) == (true > shift).sum()
    cut = feast.intervals(a, min(32, d))
    found = [feast.inside(a, *c) for c in cut]
    values = np.sort(np.concatenate([v for v, _ in found]))[::-1]
    assert len(values) >= min(32, d)
    assert np.allclose(values, true[::-1][: len(values)], atol=1e-13 * true.max())
    for v, x in found:
        assert np.abs(a @ x.T - x.T * v).max() < 1e-12 * true.max()


def by_hand(vectors):
    """Per usable row: deviation and the components of the covariance, from numpy's eigenvectors."""
    x = [[math.floor(64 * float(np.float64(c))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    y = np.array([[(n * a - b) / n for a, b in zip(row, s, strict=True)] for row in x])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    return n, deviation, y, v, e[::-1], u.T[::-1]


def test_whitening_of_a_table(spark):
    rng = np.random.default_rng(4)
    good = (rng.standard_normal((300, 40)) * np.linspace(0.2, 3, 40) + 5).astype(float)
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(good)]
    rows += [(900, None, "x"), (901, [1.0] * 39 + [None], "x"), (902, [float("nan")] * 40, "x"), (903, [math.inf] + [0.0] * 39, "x"), (904, [], "x")]
    rows += [(7, rows[7][1], "again"), (None, [0.0] * 40, "no id")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")
    got = whitening.whiten(table).collect()
    kept = [r for r in rows if r[1] and len(r[1]) == 40 and all(c is not None and math.isfinite(c) for c in r[1])]
    n, deviation, y, v, e, u = by_hand([r[1] for r in kept])
    assert len(got) == 32 * len(kept) == 32 * n
    by_row: dict = {}
    for r in got:
        by_row.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    for (vec_id, _, _), d, own in zip(kept, deviation, y, strict=True):
        for c, rs in by_row[vec_id].items():
            want = own @ u[c - 1] / math.sqrt(e[c - 1])
            for r in rs:
                assert r["n"] == n and r["deviation"] == d
                assert abs(abs(r["whitened"]) - abs(want)) < 1e-9
                assert abs(r["explained"] - e[c - 1] / np.trace(v)) < 1e-12
    assert {len(rs) for rs in by_row[7].values()} == {2}
    assert {r["identity_error"] for r in got if r["identity_error"] < 1e-9} == {got[0]["identity_error"]}


def test_far_means_lose_no_digits(spark):
    rng = np.random.default_rng(5)
    near = rng.integers(-40, 40, (200, 6)) / 64
    far = near + np.array([1e6, -3e9, 2.0**40, 0, 5e5, -(2.0**44)])
    names = "vec_id long, embedding array<double>"
    read = lambda a: {(r[0], r[1]): r for r in whitening.whiten(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(a)], names)).collect()}
    one, other = read(near), read(far)
    assert one.keys() == other.keys()
    for key, r in one.items():
        assert r["deviation"] == other[key]["deviation"] and abs(r["whitened"] - other[key]["whitened"]) < 1e-9


def test_whitening_without_variance(spark):
    names = "vec_id int, embedding array<float>, component string"
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, -2.0, 7.0], "c")], names)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one)] == [
        (c, 1, 0, None, None, None) for c in (1, 2, 3)
    ]
    flat = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0], "c"), (2, [0.0, 3.0], "c")], names)).collect()
    assert [(r["component"], r["whitened"] and abs(round(r["whitened"], 9))) for r in sorted(flat)] == [(1, 1.0), (2, None)] * 2
    assert {r["identity_error"] < 1e-12 for r in flat} == {True}
    assert whitening.whiten(spark.createDataFrame([], names)).collect() == []
    two = whitening.whiten(spark.createDataFrame([(1, [1.0], "c"), (2, [3.0], "c"), (3, [1.0, 2.0], "c")], names)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in two) == [(1, 1, 2), (2, 1, 2), (3, 1, 1), (3, 2, 1)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e308]), (2, [-1e308])], "vec_id int, embedding array<double>")).collect()
    assert sorted((r["deviation"], abs(round(r["whitened"], 9))) for r in huge if r["deviation"] is not None) in ([], [(0, 1.0)] * 2)


def test_lengths_beyond_the_bound_are_refused(spark):
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [0.0] * 4097)], "vec_id int, embedding array<double>"))
