"""How many containers of which mix of a few sizes: the cutting-stock programme of a bounded number of sizes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

GAP = 0.001  # how far above the least possible number of containers the programme may stop


def best_mix(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The mix of sizes within ``capacity`` that is worth most, each size any number of times.

    One size after the other is let in; a stretch of as many capacities as the size is long depends on the one before it, so each
    is taken at once.
    """
    value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int32)
    for k in np.flatnonzero(worth > 1e-12).tolist():
        s, v = int(sizes[k]), float(worth[k])
        for low in range(s, capacity + 1, s):
            own = slice(low, min(low + s, capacity + 1))
            gain = value[low - s : own.stop - s] + v
            better = gain > value[own] + 1e-12
            np.copyto(value[own], gain, where=better)
            pick[own][better] = k
    mix, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while pick[c] >= 0:
        mix[pick[c]] += 1
        c -= int(sizes[pick[c]])
    return float(value[capacity]), mix


def best_mixes(sizes: Sequence[int], counts: Sequence[int], capacity: int, gap: float = GAP) -> tuple[list[tuple[np.ndarray, int]], float]:
    """([(mix, containers)], gap): together at least ``counts`` places of every size, in few containers.

    Column generation on the linear programme: the basis always has as many mixes as sizes, the mix worth most at the
    basis's prices enters, and the one that runs out first leaves. At prices under which no mix is worth more than g, the
    least number of containers is the counts' worth divided by g; the programme stops when it is within ``gap`` of the
    greatest such bound, and gives how far it is. Counts are shifted by less than a millionth of one, each by another, so
    that no two mixes run out at once and every round gets nearer. The whole parts of the solution are kept and what they
    leave over is put together first fit, largest first, so it takes at most one container more for each size.
    """
    s, n = np.asarray(sizes, dtype=np.int64), np.asarray(counts, dtype=np.float64)
    shifted = n + np.arange(1, len(n) + 1) * (1e-7 / len(n))
    basis, bound = np.diag(capacity // s).astype(np.float64), 0.0
    while True:
        prices = np.linalg.solve(basis.T, np.ones(len(s)))
        x = np.maximum(np.linalg.solve(basis, shifted), 0)
        gain, mix = best_mix(s, prices, capacity)
        used = float(x.sum())
        bound = max(bound, float(np.maximum(prices, 0) @ n) / max(gain, 1.0))
        apart = used / bound - 1
        if gain <= 1 + 1e-7 or apart <= gap:
            break
        direction = np.linalg.solve(basis, mix.astype(np.float64))
        able = direction > 1e-9
        ratio = np.where(able, x / np.where(able, direction, 1), np.inf)
        basis[:, int(ratio.argmin())] = mix
    whole = np.floor(np.maximum(np.linalg.solve(basis, n), 0) + 1e-6).astype(np.int64)
    out = [(basis[:, k].astype(np.int64), int(w)) for k, w in enumerate(whole) if w]
    left = np.maximum(np.asarray(counts) - sum((m * w for m, w in out), np.zeros(len(s), dtype=np.int64)), 0)
    while left.any():
        mix, room = np.zeros(len(s), dtype=np.int64), capacity
        for k in np.argsort(-s):
            mix[k] = min(left[k], room // s[k])
            room -= mix[k] * s[k]
        times = int(min(left[k] // mix[k] for k in np.flatnonzero(mix)))
        out.append((mix, times))
        left -= mix * times
    return out, max(apart, 0.0)
