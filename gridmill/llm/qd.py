"""Singular values and right singular vectors of a small matrix by qd transforms.

Householder reflections make the matrix bidiagonal. Differential quotient-difference transforms with shifts
find the squares of its singular values, each with a small relative error. For each of them two
factorisations, one from the top and one from the bottom, meet at the row where they disagree least: the
twisted factorisation, whose null vector is the singular vector.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Neighbouring eigenvalues closer than this, relatively, are settled together.
CLUSTER = 1e-4


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and Q, where matrix = P B Q^T with orthogonal P and Q; the matrix is square."""
    a = np.array(matrix, float)
    n = len(a)
    q = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = v @ v
        return v, (2 / size if size > 0 else 0.0)

    for k in range(n):
        v, f = reflector(a[k:, k])
        a[k:, k:] -= f * np.outer(v, v @ a[k:, k:])
        if k + 1 < n:
            v, f = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= f * np.outer(a[k:, k + 1 :] @ v, v)
            q[:, k + 1 :] -= f * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd transform with a shift: the new q and e, and the differences d."""
    n = len(q)
    new_q, new_e, diff = [0.0] * n, [0.0] * (n - 1), [0.0] * n
    d = q[0] - shift
    for i in range(n - 1):
        diff[i] = d
        total = d + e[i]
        ratio = q[i + 1] / total if total else np.inf
        new_q[i], new_e[i] = total, e[i] * ratio
        d = d * ratio - shift
    diff[-1] = new_q[-1] = d
    return new_q, new_e, diff


def squared_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling.

    A zero-shift transform bounds the least of them from below by the inverse of the sum of inverse
    differences. A bolder shift just under the least difference is tried first and given up if a difference
    becomes negative.
    """
    top = max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0))
    if top == 0:
        return np.zeros(len(diagonal))
    # A zero on the diagonal becomes a number far below rounding, so that no transform divides by zero.
    q = (np.maximum(np.abs(diagonal) / top, 1e-60) ** 2).tolist()
    e = ((upper / top) ** 2).tolist()
    blocks, found = [(q, e, 0.0)], []
    while blocks:
        q, e, base = blocks.pop()
        done = False
        while len(q) > 1 and not done:
            for i in range(len(e) - 1, -1, -1):
                if e[i] <= (EPS * EPS) * max(base + q[i], base + q[i + 1]) or e[i] <= 1e-300:
                    blocks += [(q[: i + 1], e[:i], base), (q[i + 1 :], e[i + 1 :], base)]
                    done = True
                    break
            if done:
                break
            if q[0] < q[-1]:  # small ones belong at the end; the turned matrix has the same singular values
                q, e = q[::-1], e[::-1]
            plain_q, plain_e, d = qd_step(q, e, 0.0)
            least = min(d)
            safe = 1 / sum(1 / x for x in d) if least > 0 else 0.0
            for shift in (least - plain_e[-1], safe * (1 - 8 * EPS * len(q))):
                if shift > EPS * least:
                    new_q, new_e, d = qd_step(plain_q, plain_e, shift)
                    if min(d) >= 0:
                        q, e, base = new_q, new_e, base + shift
                        break
            else:
                q, e = plain_q, plain_e
        if not done:
            found.append(q[0] + base)
    return np.sort(np.array(found))[::-1] * top * top


def twisted_vector(q: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """The null vector of L diag(q) L^T - value, with ``low`` under the unit diagonal of L, and what it leaves over."""
    n = len(q)
    s, p = np.empty(n), np.empty(n)
    plus, minus = np.empty(n - 1), np.empty(n - 1)
    tiny = EPS * EPS * q.max()
    s[0] = -value
    for i in range(n - 1):
        d = s[i] + q[i] or tiny
        plus[i] = q[i] * low[i] / d
        s[i + 1] = plus[i] * low[i] * s[i] - value
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        d = q[i] * low[i] ** 2 + p[i + 1] or tiny
        ratio = q[i] / d
        minus[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    left_over = s + p + value
    r = int(np.argmin(np.abs(left_over)))
    z = np.zeros(n)
    z[r] = 1
    for i in range(r - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -minus[i] * z[i]
    size = z @ z
    return z / np.sqrt(size), left_over[r] / size


def right_vectors(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``most`` eigenvalues of matrix^T matrix, falling, and their unit vectors as columns.

    Values that are nothing but rounding are left out. Of a vector and its negative, the one whose largest
    entry is positive is taken.
    """
    n = matrix.shape[1]
    scale = np.abs(matrix).max(initial=0)
    if not n or scale == 0:
        return np.empty(0), np.empty((n, 0))
    diagonal, upper, q = bidiagonalise(matrix / scale)
    values = squared_values(diagonal, upper)
    values = values[: min(most, int((values > (n * EPS) ** 2 * values[0] * 16).sum()))]
    square = np.diag(diagonal**2)
    if n > 1:
        square[np.arange(1, n), np.arange(1, n)] += upper**2
        square[np.arange(n - 1), np.arange(1, n)] = square[np.arange(1, n), np.arange(n - 1)] = diagonal[:-1] * upper
    vectors = np.empty((n, len(values)))
    near_zero = np.maximum(np.abs(diagonal), 1e-60)
    pivot, low = near_zero**2, upper / np.where(diagonal < 0, -near_zero, near_zero)[:-1]
    # Where the upper diagonal vanishes, the matrix falls into blocks; each value belongs to one of them.
    cuts = np.flatnonzero(np.abs(upper) <= EPS * 1e-2 * (np.abs(diagonal[:-1]) + np.abs(diagonal[1:]))) + 1
    blocks = list(zip([0, *cuts], [*cuts, n]))
    for k, value in enumerate(values):
        best = None
        for lo, hi in blocks:
            z, rest = twisted_vector(pivot[lo:hi], low[lo : hi - 1], value)
            if hi - lo > 1:
                z, rest = twisted_vector(pivot[lo:hi], low[lo : hi - 1], value + rest)
            if best is None or abs(rest) < best[0]:
                best = abs(rest), lo, hi, z
        _, lo, hi, z = best
        vectors[:, k] = 0
        vectors[lo:hi, k] = z
    values, vectors = settle(square, values, vectors)
    vectors = q @ vectors
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    return values * scale**2, vectors


def settle(square: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of values that are nearly equal, made orthogonal: inverse iteration on their common space."""
    values = values.copy()
    lo = 0
    while lo < len(values):
        hi = lo + 1
        while hi < len(values) and values[hi - 1] - values[hi] <= CLUSTER * values[hi - 1]:
            hi += 1
        if hi - lo > 1:
            # Starts that are parallel get a fixed different direction each.
            z = vectors[:, lo:hi] + 1e-3 * np.random.default_rng(1).normal(size=(len(square), hi - lo))
            shifted = square - (values[lo:hi].mean() * (1 + 4 * EPS)) * np.eye(len(square))
            for _ in range(4):
                z = np.linalg.qr(z)[0]
                try:
                    z = np.linalg.solve(shifted, z)
                except np.linalg.LinAlgError:
                    z = np.linalg.solve(shifted + 1e-12 * values[lo] * np.eye(len(square)), z)
            z = np.linalg.qr(z)[0]
            inner, turn = np.linalg.eigh(z.T @ square @ z)
            values[lo:hi], vectors[:, lo:hi] = inner[::-1], (z @ turn)[:, ::-1]
        lo = hi
    return values, vectors
