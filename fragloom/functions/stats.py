"""Tail probabilities that Spark has no function for, as Arrow functions over whole batches on the rows that reach a test."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_SMALL = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 16)))))


def log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n! by Stirling's series, from a table below 16."""
    n = np.asarray(n, dtype=np.float64)
    x = np.maximum(n, 15.0) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return np.where(n < 16, _SMALL[np.clip(n, 0, 15).astype(np.int64)], series)


def _log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def _falling(i: np.ndarray, last: np.ndarray, step: int, ratio: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """1 + r + r r' + ...: terms from i to ``last`` in units of the first, where each is ``ratio`` times the one before, until they count no more."""
    total = np.where((last - i) * step >= 0, 1.0, 0.0)
    at = np.flatnonzero((last - i) * step > 0)
    i, term = i[at].copy(), np.ones(len(at))
    while len(at):
        term = term * ratio(i, at)
        i = i + step
        total[at] += term
        on = ((last[at] - i) * step > 0) & (term > total[at] * 1e-17)
        at, i, term = at[on], i[on], term[on]
    return total


def binomial_tails(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X > k) for X binomial; 0 where k >= n, 1 where k < 0, NaN where an argument is. Sums run away from the mean, where terms fall."""
    k, n, p = (np.asarray(x, dtype=np.float64) for x in (k, n, p))
    out = np.where(np.isnan(k) | np.isnan(n) | np.isnan(p), np.nan, np.where(k >= n, 0.0, np.where((k < 0) | (p >= 1), 1.0, 0.0)))
    inner = np.flatnonzero((k >= 0) & (k < n) & (p > 0) & (p < 1))
    k, n, p = k[inner], n[inner], p[inner]
    odds = p / (1 - p)
    log = lambda i: _log_choose(n, i) + i * np.log(p) + (n - i) * np.log1p(-p)
    above = k + 1 > n * p
    up = np.exp(log(k + 1)) * _falling(np.where(above, k + 1, n + 1), n, 1, lambda i, at: (n[at] - i) / (i + 1) * odds[at])
    down = np.exp(log(k)) * _falling(np.where(above, -1.0, k), np.zeros(len(k)), -1, lambda i, at: i / (n[at] - i + 1) / odds[at])
    out[inner] = np.clip(np.where(above, up, 1 - down), 0, 1)
    return out


def fisher_tails(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """One-sided (greater) exact tests of the tables [[a, b], [c, d]]; NaN where a number is missing or negative."""
    a, b, c, d = (np.asarray(x, dtype=np.float64) for x in (a, b, c, d))
    good = np.flatnonzero((a >= 0) & (b >= 0) & (c >= 0) & (d >= 0))
    out = np.full(len(a), np.nan)
    a, b, c, d = a[good], b[good], c[good], d[good]
    row, col, rest = a + b, a + c, d - a  # rest + i is the last cell where the first is i
    total = a + b + c + d
    log = lambda i: _log_choose(col, i) + _log_choose(total - col, row - i) - _log_choose(total, row)
    most, least = np.minimum(row, col), np.maximum(0, -rest)
    above = a * total > row * col
    up = np.exp(log(a)) * _falling(np.where(above, a, most + 1), most, 1, lambda i, at: (row[at] - i) * (col[at] - i) / ((i + 1) * (rest[at] + i + 1)))
    # what is below a, summed downwards from a - 1
    lower = ~above & (a > least)
    below = np.where(lower, a - 1, least)
    down = np.exp(log(below)) * _falling(np.where(lower, below, least - 1), least, -1, lambda i, at: i * (rest[at] + i) / ((row[at] - i + 1) * (col[at] - i + 1)))
    out[good] = np.clip(np.where(above, up, np.where(lower, 1 - down, 1.0)), 0, 1)
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    return float(binomial_tails(np.array([k]), np.array([n]), np.array([p]))[0])


def fisher_tail(a: int, b: int, c: int, d: int) -> float:
    return float(fisher_tails(*(np.array([x]) for x in (a, b, c, d)))[0])


def _column(s: pd.Series) -> np.ndarray:
    return s.to_numpy(dtype=np.float64, na_value=np.nan)


@F.pandas_udf(DoubleType())
def binom_sf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X > k); null where an argument is null."""
    out = pd.Series(binomial_tails(_column(k), _column(n), _column(p)))
    return out.astype(object).where(out.notna(), None)


@F.pandas_udf(DoubleType())
def fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """The one-sided exact test; null where an argument is null or negative."""
    out = pd.Series(fisher_tails(_column(a), _column(b), _column(c), _column(d)))
    return out.astype(object).where(out.notna(), None)
