"""Singular values and right singular vectors of a small square matrix by a bidiagonal qd solver.

Householder reflections bring R to upper bidiagonal form B; ``dqds`` (differential quotient-difference with shifts)
finds the singular values of B to high relative accuracy; a twisted factorisation of B'B - e I gives each right
singular vector of B, orthogonalised within clusters, and the right reflections carry it back.  The matrix has the
size of the embedding's dimension, never of its rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
CLUSTER = 1e-3                 # relative gap below which eigenvectors are orthogonalised against each other


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Householder v (unit) and alpha with (I - 2 v v') x = alpha e1."""
    norm = np.linalg.norm(x)
    if norm == 0:
        return np.zeros_like(x), 0.0
    alpha = -norm if x[0] >= 0 else norm
    v = x.copy()
    v[0] -= alpha
    return v / np.linalg.norm(v), alpha


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal a and superdiagonal b of B = U' R V, and the right reflectors (V is their product in order)."""
    m = r.astype(float).copy()
    d = len(m)
    right = []
    for i in range(d):
        v, _ = reflector(m[i:, i])
        m[i:, i:] -= 2 * np.outer(v, v @ m[i:, i:])
        if i < d - 2:
            w, _ = reflector(m[i, i + 1:])
            m[i:, i + 1:] -= 2 * np.outer(m[i:, i + 1:] @ w, w)
            right.append(w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def back(z: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """V z for the right reflectors of ``bidiagonalise``."""
    x = z.copy()
    for i in range(len(right) - 1, -1, -1):
        w = right[i]
        x[i + 1:] -= 2 * w * (w @ x[i + 1:])
    return x


def _dqd(q: list[float], e: list[float], s: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds transform with shift s: new q and e and the running d; None where a pivot turns negative."""
    n = len(q)
    nq, ne, ds = [0.0] * n, [0.0] * (n - 1), [0.0] * n
    d = q[0] - s
    for i in range(n - 1):
        if d < 0:
            return None
        ds[i] = d
        nq[i] = d + e[i]
        if nq[i] == 0.0:                       # zero pivot: nothing is carried on
            ne[i], d = 0.0, q[i + 1] - s
        else:
            t = q[i + 1] / nq[i]
            ne[i], d = e[i] * t, d * t - s
    if d < 0:
        return None
    nq[-1], ds[-1] = d, d
    return nq, ne, ds


def _dqds_block(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues of B'B of one unreduced block, by deflation from the end."""
    found, sigma = [], 0.0
    while q:
        if len(q) == 1:
            found.append(sigma + q[0])
            break
        if e[-1] <= EPS * EPS * (sigma + q[-1]) or e[-1] <= EPS * EPS * q[-2]:
            found.append(sigma + q[-1])
            q, e = q[:-1], e[:-1]
            continue
        cut = [i for i in range(len(e)) if e[i] <= EPS * EPS * (sigma + q[i + 1]) * 0.25]
        if cut:
            i = cut[-1]
            found += [sigma + x for x in _dqds_block(q[i + 1:], e[i + 1:])]
            q, e = q[:i + 1], e[:i]
            continue
        q, e, ds = _dqd(q, e, 0.0)             # always succeeds; 1/d sums to the trace of the inverse
        low = min(ds)
        if low <= 0.0:                         # a zero eigenvalue deflates after this transform
            if q[-1] == 0.0 and e[-1] == 0.0:
                found.append(sigma)
                q, e = q[:-1], e[:-1]
            continue
        safe = 1.0 / sum(1.0 / x for x in ds)
        for s in (low * (1 - 4 * EPS), 0.5 * (low + safe), safe * (1 - 8 * EPS)):
            if s < EPS * sigma * 1e-3 or sigma + s == sigma:
                break
            step = _dqd(q, e, s)
            if step is not None:
                q, e, sigma = step[0], step[1], sigma + s
                break
    return found


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the upper bidiagonal (a, b), falling."""
    scale = max(np.max(np.abs(a), initial=0.0), np.max(np.abs(b), initial=0.0))
    if scale == 0:
        return np.zeros(len(a))
    q, e = list((a / scale) ** 2), list((b / scale) ** 2)
    return np.sort(_dqds_block(q, e))[::-1] * scale * scale


def _twisted(t: np.ndarray, off: np.ndarray, lam: float, order: int) -> np.ndarray:
    """Vector of the tridiagonal (t, off) - lam I from its twisted factorisation at the ``order``-th least twist pivot."""
    n = len(t)
    tiny = EPS * EPS * (np.max(np.abs(t)) + np.max(np.abs(off), initial=0.0)) + np.finfo(float).tiny
    up, down = np.empty(n), np.empty(n)
    up[0] = t[0] - lam
    for i in range(1, n):
        p = up[i - 1] if abs(up[i - 1]) > tiny else tiny
        up[i] = t[i] - lam - off[i - 1] ** 2 / p
    down[-1] = t[-1] - lam
    for i in range(n - 2, -1, -1):
        p = down[i + 1] if abs(down[i + 1]) > tiny else tiny
        down[i] = t[i] - lam - off[i] ** 2 / p
    gamma = up + down - (t - lam)
    k = int(np.argsort(np.abs(gamma), kind="stable")[min(order, n - 1)])
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        p = up[i] if abs(up[i]) > tiny else tiny
        z[i] = -off[i] * z[i + 1] / p
    for i in range(k + 1, n):
        p = down[i] if abs(down[i]) > tiny else tiny
        z[i] = -off[i - 1] * z[i - 1] / p
    return z / np.linalg.norm(z)


def eigenvectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Columns: unit eigenvectors of B'B for its first ``values`` (falling), orthogonal also in clusters.

    Blocks that a negligible superdiagonal entry separates are solved on their own, each value in the block it
    belongs to (the block where its vector leaves the least residual).
    """
    n = len(a)
    t = a ** 2 + np.concatenate([[0.0], b ** 2])
    off = a[:-1] * b
    norm = max(np.max(np.abs(t)), np.finfo(float).tiny)
    ends = [0, *[i + 1 for i in range(n - 1) if abs(off[i]) <= EPS * EPS * norm], n]
    blocks = list(zip(ends[:-1], ends[1:], strict=True))
    out = np.zeros((n, len(values)))
    for j, lam in enumerate(values):
        near = [i for i in range(j) if abs(values[i] - lam) <= CLUSTER * lam + 16 * EPS * norm]
        best = None
        for lo, hi in blocks:
            for order in range(min(len(near) + 1, hi - lo)):
                z = np.zeros(n)
                z[lo:hi] = _twisted(t[lo:hi], off[lo:hi - 1], lam, order)
                for _ in range(2):
                    z -= out[:, near] @ (out[:, near].T @ z)
                size = np.linalg.norm(z)
                if size < 1e-6:
                    continue
                z /= size
                r = t * z - lam * z
                r[:-1] += off * z[1:]
                r[1:] += off * z[:-1]
                miss = np.linalg.norm(r)
                if best is None or miss < best[0]:
                    best = (miss, z)
        out[:, j] = best[1]
    return out


def solve(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of the square R (falling, all) and its first k right singular vectors (columns)."""
    a, b, right = bidiagonalise(r)
    values = dqds(a, b)
    z = eigenvectors(a, b, values[:k])
    return values, np.column_stack([back(z[:, j], right) for j in range(z.shape[1])]) if z.shape[1] else z
