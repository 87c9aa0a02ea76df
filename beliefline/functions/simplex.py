"""Linear programs with bounds: maximise c x under A x = b, low <= x <= high, by the revised simplex method in numpy."""

from __future__ import annotations

import numpy as np

TOLERANCE = 1e-9


def _iterate(a: np.ndarray, b: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray, basis: list[int], at_high: np.ndarray, limit: int = 5000) -> np.ndarray:
    m, n = a.shape
    for _ in range(limit):
        inside = np.zeros(n, bool)
        inside[basis] = True
        x = np.where(at_high, high, low)
        x[inside] = 0
        inverse = np.linalg.inv(a[:, basis])
        x[basis] = inverse @ (b - a @ x)
        price = c - (c[basis] @ inverse) @ a
        enter = next((j for j in range(n) if not inside[j] and high[j] - low[j] > TOLERANCE and ((not at_high[j] and price[j] > TOLERANCE) or (at_high[j] and price[j] < -TOLERANCE))), None)  # Bland's rule
        if enter is None:
            return x
        sign = -1.0 if at_high[enter] else 1.0
        step = -sign * (inverse @ a[:, enter])
        best, leave, to_high = high[enter] - low[enter], None, False
        for i in range(m):
            j = basis[i]
            if step[i] < -TOLERANCE:
                t = (x[j] - low[j]) / -step[i]
            elif step[i] > TOLERANCE:
                t = (high[j] - x[j]) / step[i]
            else:
                continue
            t = max(t, 0.0)
            if t < best - 1e-12 or (t <= best + 1e-12 and leave is not None and j < basis[leave]):
                best, leave, to_high = t, i, step[i] > 0
        if leave is None:
            if not np.isfinite(best):
                raise ValueError("unbounded")
            at_high[enter] = not at_high[enter]
        else:
            at_high[basis[leave]] = to_high
            basis[leave] = enter
    raise RuntimeError("no end after many steps")


def maximise(c: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[float, np.ndarray] | None:
    """(optimum, x), or None if nothing is feasible. Two phases with an artificial variable a row."""
    m, n = a.shape
    at_high = ~np.isfinite(low) | ((np.abs(high) < np.abs(low)) & np.isfinite(high))
    start = np.where(at_high, high, low)
    rest = b - a @ start
    signs = np.where(rest >= 0, 1.0, -1.0)
    wide = np.hstack([a, np.diag(signs)])
    lo, hi = np.concatenate([low, np.zeros(m)]), np.concatenate([high, np.full(m, np.inf)])
    flags, basis = np.concatenate([at_high, np.zeros(m, bool)]), list(range(n, n + m))
    x = _iterate(wide, b, np.concatenate([np.zeros(n), -np.ones(m)]), lo, hi, basis, flags)
    if x[n:].sum() > 1e-7:
        return None
    hi[n:] = 0.0
    x = _iterate(wide, b, np.concatenate([c, np.zeros(m)]), lo, hi, basis, flags)
    return float(c @ x[:n]), x[:n]
