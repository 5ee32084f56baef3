"""Leading eigenvalues and eigenvectors of a symmetric matrix.

Householder reflections bring the matrix to tridiagonal form; Sturm counts, which tell how many
eigenvalues lie below a value, bisect the leading ones; inverse iteration finds the tridiagonal
matrix's eigenvectors, those of close eigenvalues kept orthogonal among themselves; the
reflections turn them back.
"""

from __future__ import annotations

import numpy as np

#: Eigenvalues closer than this part of the matrix norm are one cluster.
CLUSTER = 1e-3
_EPS = np.finfo(float).eps
_TINY = np.finfo(float).tiny


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal, and Householder vectors (row k reflects the entries behind k)."""
    a = matrix.copy()
    n = len(a)
    reflectors = np.zeros((max(0, n - 2), n))
    for k in range(n - 2):
        x = a[k + 1 :, k]
        largest = np.abs(x[1:]).max()
        if largest == 0:
            continue
        scale = max(largest, abs(x[0]))
        v = x / scale
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v /= np.sqrt(v @ v)
        reflectors[k, k + 1 :] = v
        rest = a[k + 1 :, k + 1 :]
        p = 2 * (rest @ v)
        w = p - (p @ v) * v
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
    return a.diagonal().copy(), a.diagonal(-1).copy(), reflectors


def counts_below(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each value: negative pivots of T - x."""
    square = np.concatenate([[0.0], off * off])
    floor = max(_TINY, _EPS * np.sqrt(square.max()) * _EPS)
    q, out = np.ones(len(values)), np.zeros(len(values), np.int64)
    for d, s in zip(diagonal, square, strict=True):
        q = d - values - s / q
        q = np.where(np.abs(q) < floor, -floor, q)
        out += q < 0
    return out


def largest_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, bisected together to the last bits."""
    n = len(diagonal)
    reach = np.concatenate([np.abs(off), [0.0]]) + np.concatenate([[0.0], np.abs(off)])
    norm = max(np.abs(diagonal).max() + reach.max(), _TINY)
    low = np.full(count, (diagonal - reach).min() - 2 * _EPS * norm * n)
    high = np.full(count, (diagonal + reach).max() + 2 * _EPS * norm * n)
    # The k-th largest has n - k eigenvalues below it.
    wanted = n - 1 - np.arange(count)
    for _ in range(120):
        middle = low + (high - low) / 2
        up = counts_below(diagonal, off, middle) <= wanted
        low, high = np.where(up, middle, low), np.where(up, high, middle)
        if np.all(high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high)) + _TINY):
            break
    return low + (high - low) / 2


class _Shifted:
    """T - x, eliminated with row exchanges, for solving with several right sides."""

    def __init__(self, diagonal: np.ndarray, off: np.ndarray, x: float, floor: float) -> None:
        n = len(diagonal)
        self.pivot, self.next, self.third = np.zeros(n), np.zeros(n), np.zeros(n)
        self.factor, self.swap = np.zeros(n), np.zeros(n, bool)
        p, u = diagonal[0] - x, off[0] if n > 1 else 0.0
        for i in range(n - 1):
            below, d, e = off[i], diagonal[i + 1] - x, off[i + 1] if i + 2 < n else 0.0
            if abs(below) > abs(p):
                self.swap[i] = True
                self.pivot[i], self.next[i], self.third[i] = below, d, e
                f = p / below
                p, u = u - f * d, -f * e
            else:
                p = p if abs(p) >= floor else floor
                self.pivot[i], self.next[i] = p, u
                f = below / p
                p, u = d - f * u, e
            self.factor[i] = f
        self.pivot[n - 1] = p if abs(p) >= floor else floor

    def solve(self, b: np.ndarray) -> np.ndarray:
        b, n = b.copy(), len(b)
        for i in range(n - 1):
            if self.swap[i]:
                b[i], b[i + 1] = b[i + 1], b[i]
            b[i + 1] -= self.factor[i] * b[i]
        for i in range(n - 1, -1, -1):
            if i + 1 < n:
                b[i] -= self.next[i] * b[i + 1]
            if i + 2 < n:
                b[i] -= self.third[i] * b[i + 2]
            b[i] /= self.pivot[i]
            if abs(b[i]) > 1e200:
                b /= abs(b[i])
        return b


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of the tridiagonal matrix for falling eigenvalues."""
    n = len(diagonal)
    norm = max(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0), _TINY)
    floor = _EPS * norm
    random = np.random.default_rng(12345)
    out = np.zeros((len(values), n))
    first, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        # Equal eigenvalues get shifts of their own.
        shift = min(value, shift - 2 * floor) if k > first else value
        solver = _Shifted(diagonal, off, shift, floor)
        v = random.uniform(-1, 1, n)
        for _ in range(5):
            v = solver.solve(v)
            v /= np.abs(v).max()
            for _ in range(2):
                v -= out[first:k].T @ (out[first:k] @ v)
            v /= np.sqrt(v @ v)
        out[k] = v
    return out


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors as rows.

    The entry of largest size in a vector is positive.
    """
    count = min(count, len(matrix))
    scale = np.abs(matrix).max(initial=0.0)
    if not count or scale == 0:
        return np.zeros(count), np.eye(len(matrix))[:count]
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = largest_values(diagonal, off, count)
    vectors = inverse_iteration(diagonal, off, values)
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        vectors -= 2 * np.outer(vectors @ v, v)
    vectors /= np.sqrt((vectors * vectors).sum(1))[:, None]
    peak = vectors[np.arange(count), np.abs(vectors).argmax(1)]
    return values * scale, vectors * np.sign(peak)[:, None]
