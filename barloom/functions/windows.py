"""Fixed windows over one symbol's sessions, in NumPy. A window with a gap (NaN), or not yet full, is unknown (NaN).

Every window is computed from its own values: running sums would be cheaper but carry rounding from session to session.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

NAN = float("nan")


def views(values: np.ndarray, n: int) -> np.ndarray:
    """All full windows of n values, a row each."""
    return np.lib.stride_tricks.sliding_window_view(values, n)


def lagged(values: np.ndarray, n: int = 1) -> np.ndarray:
    out = np.full(len(values), NAN)
    out[n:] = values[: max(0, len(values) - n)]
    return out


def rolled(values: np.ndarray, n: int, fn: Callable, ahead: int = 0) -> np.ndarray:
    """fn over each window of n values; ahead: sessions that the window ends before today."""
    out = np.full(len(values), NAN)
    if len(values) >= n + ahead:
        made = fn(views(values, n), axis=1)
        out[n - 1 + ahead :] = made[: len(made) - ahead]
    return out


def mean(values: np.ndarray, n: int) -> np.ndarray:
    return rolled(values, n, np.mean)


def deviation(values: np.ndarray, n: int) -> np.ndarray:
    """Sample standard deviation."""
    return rolled(values, n, lambda v, axis: np.std(v, axis=axis, ddof=1))


def highest(values: np.ndarray, n: int, ahead: int = 0) -> np.ndarray:
    return rolled(values, n, np.max, ahead)


def lowest(values: np.ndarray, n: int) -> np.ndarray:
    return rolled(values, n, np.min)


def since_highest(values: np.ndarray, n: int) -> np.ndarray:
    """Sessions since the highest value of the window, the latest of equals."""
    return rolled(values, n, lambda v, axis: np.argmax(v[:, ::-1], axis=axis).astype(float))


def highest_before(values: np.ndarray) -> np.ndarray:
    """The highest value of all sessions before today, whatever gaps there are."""
    return lagged(np.fmax.accumulate(values)) if len(values) else values


def over(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """num / den where den is positive, else NaN."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(den > 0, num / den, NAN)


def log_regression(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Slope a session and r2 of the least-squares line through the logarithms of n positive values; 0 and NaN if flat."""
    x = np.arange(n) - (n - 1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        y = np.log(np.where(values > 0, values, NAN))

        def slope_of(v, axis):
            return (v - v.mean(axis=axis, keepdims=True)) @ x / (x @ x)

        slope = rolled(y, n, slope_of)
        spread = rolled(y, n, lambda v, axis: ((v - v.mean(axis=axis, keepdims=True)) ** 2).sum(axis=axis))
        flat = highest(values, n) == lowest(values, n)
        r2 = np.where(flat | np.isnan(slope), NAN, np.clip(slope**2 * (x @ x) / spread, 0, 1))
    return np.where(flat & ~np.isnan(slope), 0.0, slope), r2


def known(*values: np.ndarray) -> np.ndarray:
    """Whether all are known."""
    return ~np.any(np.isnan(values), axis=0)


def tri(value: np.ndarray, *inputs: np.ndarray) -> np.ndarray:
    """A condition as true, false, or None while any of its inputs is unknown."""
    return np.where(known(*inputs), np.asarray(value).astype(object), None)
