"""Leading eigenvectors of a symmetric matrix that fits the driver: its side is the width of the vectors, never their number.

Householder reflections make the matrix tridiagonal, Sturm counts bisect the leading eigenvalues, inverse iteration finds
their vectors (those of close eigenvalues are made orthogonal to each other), and the reflections carry them back.
"""

from __future__ import annotations

import numpy as np

# Eigenvalues closer than this share of the matrix's size form a cluster.
CLOSE = 1e-3
ROUNDS = 6


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors): H = I - 2uu' for each reflector u, which acts on the last len(u) places."""
    a = np.array(matrix, float)
    n, reflectors = len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size and np.linalg.norm(x[1:]):
            x[0] += np.copysign(size, x[0])
            u = x / np.linalg.norm(x)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ u
            q = 2 * (p - (u @ p) * u)
            rest -= np.outer(u, q) + np.outer(q, u)
            column = a[k + 1 :, k]
            column -= 2 * (u @ column) * u
        else:
            u = np.zeros(n - k - 1)
        reflectors.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def carried_back(reflectors: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """The columns of `vectors`, in the coordinates of the matrix that the reflectors were made from."""
    out = vectors.copy()
    for u in reversed(reflectors):
        part = out[len(out) - len(u) :]
        part -= 2 * np.outer(u, u @ part)
    return out


def _size(diagonal: np.ndarray, off: np.ndarray) -> float:
    """A bound on the absolute value of all eigenvalues (Gershgorin)."""
    beside = np.zeros(len(diagonal))
    beside[:-1] += np.abs(off)
    beside[1:] += np.abs(off)
    return float((np.abs(diagonal) + beside).max(initial=0.0))


def counts_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are less than each number: the negative terms of the Sturm sequence."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    q = diagonal[0] - at
    found = (q < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off, strict=True):
        q = d - at - e * e / np.where(np.abs(q) < least, np.copysign(least, q), q)
        found += q < 0
    return found


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The `k` greatest eigenvalues, falling, each bisected until neighbouring doubles bound it."""
    n, size = len(diagonal), _size(diagonal, off)
    wanted = n - np.arange(1, k + 1)  # so many eigenvalues are less than, or as great as, each of these
    low, high = np.full(k, -size * 1.001 - 1e-300), np.full(k, size * 1.001 + 1e-300)
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high) | (high - low <= 1e-17 * size)).all():
            return middle
        above = counts_below(diagonal, off, middle) > wanted
        low, high = np.where(above, low, middle), np.where(above, middle, high)


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, tiny: float):
    """Solves (T - shift) x = b by elimination with row exchanges; a vanishing pivot counts as `tiny`."""
    n = len(diagonal)
    rows = np.zeros((n, 3))  # what is left of each row from its pivot on
    rows[:, 0] = diagonal - shift
    rows[:-1, 1] = off
    factors, swapped = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0), bool)
    for i in range(n - 1):
        below = np.array([off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < n else 0.0])
        if abs(below[0]) > abs(rows[i, 0]):
            swapped[i] = True
            rows[i], below = below, rows[i].copy()
        if abs(rows[i, 0]) < tiny:
            rows[i, 0] = tiny
        factors[i] = below[0] / rows[i, 0]
        rows[i + 1] = [below[1] - factors[i] * rows[i, 1], below[2] - factors[i] * rows[i, 2], 0.0]
    if abs(rows[-1, 0]) < tiny:
        rows[-1, 0] = tiny

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for i in range(n - 1):
            if swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factors[i] * x[i]
        for i in range(n - 1, -1, -1):
            x[i] -= rows[i, 1] * (x[i + 1] if i + 1 < n else 0.0) + rows[i, 2] * (x[i + 2] if i + 2 < n else 0.0)
            x[i] /= rows[i, 0]
        return x

    return solve


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as columns, for its falling `values`."""
    n, size = len(diagonal), _size(diagonal, off) or 1.0
    tiny = np.finfo(float).eps * size
    draw = np.random.default_rng(0)
    out = np.zeros((n, len(values)))
    first, last = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLOSE * size:
            first, last = k, np.inf
        # Equal eigenvalues are pushed apart by a rounding error each, so that no two systems are the same.
        last = min(value, last - 4 * tiny)
        solve = _solver(diagonal, off, last, tiny)
        x = draw.uniform(-1, 1, n)
        for _ in range(ROUNDS):
            x = solve(x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, first:k] @ (out[:, first:k].T @ x)
        out[:, k] = x / np.linalg.norm(x)
    return out


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the `k` greatest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    k = min(k, len(matrix))
    if not k:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, reflectors = tridiagonal(matrix)
    values = leading_values(diagonal, off, k)
    return values, carried_back(reflectors, vectors_of(diagonal, off, values))
