"""Eigenvalues and vectors of a symmetric matrix: Householder reflections to three diagonals, then implicit QR steps."""

from __future__ import annotations

import math

import numpy as np

#: QR steps that one eigenvalue may take; two or three are usual.
MOST_STEPS = 60


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal d, the one beside it e, and q with q' a q tridiagonal."""
    a, n = np.array(a, float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if np.linalg.norm(v[1:]) <= 1e-300:
            continue
        v[0] += math.copysign(size, v[0])
        v /= np.linalg.norm(v)
        low = a[k + 1 :, k + 1 :]
        p = low @ v
        w = p - (v @ p) * v
        low -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _step(d: np.ndarray, e: np.ndarray, q: np.ndarray, low: int, high: int) -> None:
    """One implicit QR step with Wilkinson's shift on rows low..high; the rows of q are the vectors."""
    half = (d[high - 1] - d[high]) / 2
    beside = e[high - 1]
    shift = d[high] - beside * beside / (half + math.copysign(math.hypot(half, beside), half)) if beside else d[high]
    x, z = d[low] - shift, e[low]
    for k in range(low, high):
        r = math.hypot(x, z)
        c, s = (x / r, z / r) if r else (1.0, 0.0)
        if k > low:
            e[k - 1] = r
        a, b, m = d[k], d[k + 1], e[k]
        d[k] = c * c * a + 2 * c * s * m + s * s * b
        d[k + 1] = s * s * a - 2 * c * s * m + c * c * b
        e[k] = c * s * (b - a) + (c * c - s * s) * m
        if k < high - 1:
            x, z = e[k], s * e[k + 1]
            e[k + 1] = c * e[k + 1]
        one = c * q[k] + s * q[k + 1]
        q[k + 1] = c * q[k + 1] - s * q[k]
        q[k] = one


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and the unit eigenvectors as rows; each vector's entry of largest size is positive."""
    d, e, q = tridiagonal(a)
    q = np.ascontiguousarray(q.T)
    eps = np.finfo(float).eps
    high, steps = len(d) - 1, 0
    while high > 0:
        near = np.abs(e[:high]) <= eps * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))
        e[:high][near] = 0
        if e[high - 1] == 0:
            high, steps = high - 1, 0
            continue
        zeros = np.flatnonzero(e[:high] == 0)
        _step(d, e, q, int(zeros[-1]) + 1 if len(zeros) else 0, high)
        steps += 1
        if steps > MOST_STEPS:
            raise ArithmeticError("the QR iteration doesn't converge; does the matrix hold numbers that aren't finite?")
    order = np.argsort(-d, kind="stable")
    d, q = d[order], q[order]
    top = np.abs(q).argmax(axis=1)
    return d, q * np.where(q[np.arange(len(q)), top] < 0, -1.0, 1.0)[:, None]
