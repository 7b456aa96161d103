"""Penalised trend (I + lam*D'D) tau = y, solved block by block.

A change of one value moves the trend by an amount that decays with distance, at a rate set by
``lam``. With :func:`reach` rows on both sides of a block, the rows beyond weigh less than the
rounding of a double, so the block's own solution equals that of the whole series.

The factors depend on a block's length alone. Their triangular bands are cut into tiles, each with its inverse, so a solution is a
short chain of small matrix products, for all blocks of one length at once.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

TILE = 64


def reach(lam: float) -> int:
    return max(60, math.ceil(44.0 * math.sqrt(2.0) * max(lam, 1e-3) ** 0.25))


@lru_cache(maxsize=32)
def factors(n: int, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and the two bands of the LDL' factorisation of the five-diagonal matrix of n >= 3 rows."""
    main, one = np.full(n, 1 + 6 * lam), np.full(n - 1, -4 * lam)
    main[[0, -1]], one[[0, -1]] = 1 + lam, -2 * lam
    main[[1, -2]] = 1 + 5 * lam
    if n == 3:
        main[1] = 1 + 4 * lam
    d, e, f = [0.0] * n, [0.0] * n, [0.0] * n
    for i, m in enumerate(main.tolist()):
        d[i] = m - (e[i - 1] ** 2 * d[i - 1] if i else 0.0) - (f[i - 2] ** 2 * d[i - 2] if i > 1 else 0.0)
        if i < n - 1:
            e[i] = (float(one[i]) - (e[i - 1] * f[i - 1] * d[i - 1] if i else 0.0)) / d[i]
        if i < n - 2:
            f[i] = lam / d[i]
    return np.array(d), np.array(e), np.array(f)


@lru_cache(maxsize=32)
def _tiles(n: int, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverses of the lower triangle's diagonal tiles, and what the two rows before a tile send into it, padded to whole tiles."""
    _, e, f = factors(n, lam)
    size = -(-n // TILE) * TILE
    e, f = (np.concatenate([x, np.zeros(size - n)]) for x in (e, f))
    lower = np.tile(np.eye(TILE), (size // TILE, 1, 1))
    at = np.arange(size).reshape(-1, TILE)
    k = np.arange(TILE)
    lower[:, k[1:], k[:-1]] = e[at[:, :-1]]
    lower[:, k[2:], k[:-2]] = f[at[:, :-2]]
    carry = np.zeros((len(lower), 2, 2))  # rows of the tile x (two before, one before)
    starts = at[1:, 0]
    carry[1:, 0, 0], carry[1:, 0, 1], carry[1:, 1, 1] = f[starts - 2], e[starts - 1], f[starts - 1]
    inverse = np.linalg.inv(lower)
    return inverse, carry, np.ascontiguousarray(inverse.transpose(0, 2, 1))


def solve(y: np.ndarray, lam: float) -> np.ndarray:
    """Trends of one block, or of several of one length as columns."""
    n = len(y)
    if n < 3:
        return y.astype(float).copy()
    d, _, _ = factors(n, float(lam))
    inverse, carry, upper = _tiles(n, float(lam))
    z = np.zeros((len(inverse) * TILE, *y.shape[1:]))
    z[:n] = y
    z = z.reshape(len(inverse), TILE, -1)
    for k in range(len(z)):
        if k:
            z[k, :2] -= carry[k] @ z[k - 1, -2:]
        z[k] = inverse[k] @ z[k]
    z.reshape(len(inverse) * TILE, -1)[:n] /= d[:, None]
    for k in range(len(z) - 1, -1, -1):
        if k + 1 < len(z):
            z[k, -2:] -= carry[k + 1].T @ z[k + 1, :2]
        z[k] = upper[k] @ z[k]
    return z.reshape(len(inverse) * TILE, -1)[:n].reshape(y.shape)


def noise(cycle: np.ndarray, n: int) -> np.ndarray:
    """Sample deviation of the cycle over the rows around each, of a quarter of the series and ten at most; ends repeat the nearest."""
    window = min(10, n // 4)
    out = np.full(len(cycle), np.nan)
    if window < 2 or len(cycle) < window:
        return out
    own = np.lib.stride_tricks.sliding_window_view(cycle, window)
    first = window // 2
    out[first : first + len(own)] = own.std(axis=1, ddof=1)
    out[:first], out[first + len(own) :] = out[first], out[first + len(own) - 1]
    return out
