"""Eigenpairs of a symmetric matrix by contour integration, interval by interval.

An interval's spectral projector is the contour integral of the resolvent around it. A
Gauss-Legendre rule turns it into a few complex shifted solves; applied to a block of
vectors and followed by Rayleigh-Ritz, a few rounds give all eigenpairs inside. How
many there are is known beforehand from the inertia of the matrix shifted to both ends,
so a missing pair is noticed. Intervals do not depend on each other.
"""

from __future__ import annotations

import numpy as np

NODES = 8
ROUNDS = 40
SMALL = 12  # eigenvalues of an interval that is not divided further


def negative_pivots(a: np.ndarray) -> int:
    """How many eigenvalues of symmetric ``a`` are negative: the inertia of its block LDL' factors
    with complete pivoting (blocks of one or two rows)."""
    a, count = np.array(a, dtype=np.float64), 0
    ratio = (1 + np.sqrt(17)) / 8
    while len(a):
        d = np.abs(np.diag(a))
        i = int(np.argmax(d))
        off = np.abs(np.tril(a, -1))
        r, c = divmod(int(np.argmax(off)), len(a))
        if d[i] == 0 and off[r, c] == 0:
            break
        if d[i] >= ratio * off[r, c]:
            keep = np.arange(len(a)) != i
            count += a[i, i] < 0
            column = a[keep, i]
            a = a[np.ix_(keep, keep)] - np.outer(column, column / a[i, i])
        else:
            keep = np.ones(len(a), dtype=bool)
            keep[[r, c]] = False
            block = a[np.ix_([r, c], [r, c])]
            count += 1  # such a block has a negative determinant
            columns = a[np.ix_(keep, [r, c])]
            a = a[np.ix_(keep, keep)] - columns @ np.linalg.solve(block, columns.T)
    return count


def above(a: np.ndarray, shift: float) -> int:
    return len(a) - negative_pivots(a - shift * np.eye(len(a)))


def intervals(a: np.ndarray, want: int) -> list[tuple[float, float, int]]:
    """(low, high, count) that hold at least the ``want`` largest eigenvalues of positive semidefinite ``a``.

    Ends are taken where the inertia does not change nearby. Eigenvalues that no such end
    parts (multiple ones) stay in one interval.
    """
    top = high = float(np.abs(a).sum(axis=1).max()) * 1.01
    todo, out, found = [(-0.01 * high, high, len(a), 0)], [], 0
    while todo and found < want:
        low, high, count, over = todo.pop()
        ends = []
        if count > SMALL:
            width = high - low
            for at in (0.5, 0.45, 0.55, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8, 0.1, 0.9):
                mid = low + at * width
                if width > 1e-9 * top and above(a, mid - 1e-4 * width) == above(a, mid + 1e-4 * width):
                    ends = [mid]
                    break
        if ends:
            upper = above(a, ends[0]) - over
            if count - upper:
                todo.append((low, ends[0], count - upper, over + upper))
            if upper:
                todo.append((ends[0], high, upper, over))
        else:
            out.append((low, high, int(count)))
            found += count
    return out


def inside(a: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in (low, high) and unit eigenvectors, one a row."""
    n = len(a)
    t, w = np.polynomial.legendre.leggauss(NODES)
    center, radius = (low + high) / 2, (high - low) / 2
    turns = np.exp(1j * np.pi * (1 + t) / 2)
    y = np.random.default_rng(seed).standard_normal((n, min(n, count + count // 2 + 4)))
    scale, best = np.abs(a).sum(axis=1).max(), np.inf
    for _ in range(ROUNDS):
        q = np.zeros_like(y)
        for turn, weight in zip(turns, w, strict=True):
            solved = np.linalg.solve((center + radius * turn) * np.eye(n) - a, y.astype(complex))
            q += weight / 2 * (radius * turn * solved).real
        u, s, _ = np.linalg.svd(q, full_matrices=False)
        u = u[:, s > 1e-13 * s[0]]
        values, small = np.linalg.eigh(u.T @ a @ u)
        x = u @ small
        own = (values > low) & (values < high)
        worst = np.abs(a @ x[:, own] - x[:, own] * values[own]).max(initial=0.0)
        if own.sum() == count and (worst <= 4e-16 * scale or worst >= best and best <= 1e-12 * scale):
            return values[own], x[:, own].T
        if own.sum() == count:
            best = min(best, worst)
        y = x
    if best > 1e-10 * scale:
        raise RuntimeError(f"{count} eigenvalues lie in ({low}, {high}), not all of them were found")
    return values[own], x[:, own].T
