"""Numeric kernels on small arrays: what windows and expressions cannot say."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=4096)
def savgol_matrix(window: int, order: int) -> np.ndarray:
    """Row i holds the weights that give a least-squares polynomial's value at point i of a window."""
    x = np.arange(window) - (window - 1) / 2
    v = np.vander(x, order + 1, increasing=True)
    return v @ np.linalg.pinv(v)


def savgol(x: np.ndarray, window: int, order: int) -> np.ndarray:
    """Moving polynomial fit; the first and last half windows take the fit of the first and last full window."""
    c, h = savgol_matrix(window, order), window // 2
    middle = np.convolve(x, c[h][::-1], mode="valid")
    return np.concatenate([c[:h] @ x[:window], middle, c[h + 1 :] @ x[-window:]])


def half_even(x: float) -> int:
    return int(np.rint(x))


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Strict maxima inside the series; a flat top counts once, at its middle rounded down."""
    out, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < n and x[j + 1] == x[i]:
                j += 1
            if j + 1 < n and x[j + 1] < x[i]:
                out.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    return np.array(out, np.int64)


def apart(peaks: np.ndarray, heights: np.ndarray, distance: int) -> np.ndarray:
    """Peaks left when the tallest (the later of equals) removes all nearer than `distance`, and so on downwards."""
    keep = np.ones(len(peaks), bool)
    for i in np.lexsort((np.arange(len(peaks)), heights))[::-1]:
        if keep[i]:
            near = np.abs(peaks - peaks[i]) < distance
            near[i] = False
            keep &= ~near
    return peaks[keep]


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height over the higher of the two lowest points on the way to a strictly higher point or the end."""
    out = np.empty(len(peaks))
    for k, p in enumerate(peaks):
        left, right = np.flatnonzero(x[:p] > x[p]), np.flatnonzero(x[p + 1 :] > x[p])
        a = left[-1] + 1 if len(left) else 0
        b = p + 1 + right[0] if len(right) else len(x)
        out[k] = x[p] - max(x[a : p + 1].min(), x[p:b].min())
    return out


def find_peaks(x: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    peaks = local_maxima(x)
    peaks = apart(peaks, x[peaks], distance)
    return peaks[prominences(x, peaks) >= prominence]


def peakiness(x: np.ndarray, longer: bool = False) -> float:
    """Largest bend (absolute second difference) of a smoothed leg. longer: the wider window of falling legs."""
    n = len(x)
    window = 2 * half_even((n if longer else n - 3) / 8) + 3
    order = min(half_even(n / 3) - 2, 2)
    if n < window or order < 0 or order >= window:
        return float("nan")
    bend = np.abs(np.diff(savgol(x, window, order), 2))
    return float(bend.max()) if len(bend) else float("nan")


@lru_cache(maxsize=512)
def _bends(n: int, window: int, order: int) -> np.ndarray:
    """The matrix that takes a leg of n points to the second differences of its smoothed form."""
    return np.diff(savgol_all(np.eye(n), window, order), 2, axis=0)


def savgol_all(x: np.ndarray, window: int, order: int) -> np.ndarray:
    """savgol() of each column."""
    return np.stack([savgol(c, window, order) for c in x.T], axis=1)


def peakiness_all(legs: list, longer: bool = False, most: int = 600) -> np.ndarray:
    """peakiness() of many legs: those of one length, up to `most` points, in one matrix product."""
    out = np.full(len(legs), np.nan)
    by: dict[int, list[int]] = {}
    for i, x in enumerate(legs):
        if x is not None:
            by.setdefault(len(x), []).append(i)
    for n, at in by.items():
        window = 2 * half_even((n if longer else n - 3) / 8) + 3
        order = min(half_even(n / 3) - 2, 2)
        if n < max(window, 3) or order < 0 or order >= window:
            continue
        if n > most:
            out[at] = [peakiness(np.asarray(legs[i], float), longer) for i in at]
        else:
            out[at] = np.abs(np.array([legs[i] for i in at], float) @ _bends(n, window, order).T).max(axis=1)
    return out


def _smoother(m: int, longer: bool) -> tuple[int, int]:
    """Window and order for a leg of m points."""
    return 2 * half_even((m if longer else m - 3) / 8) + 3, min(half_even(m / 3) - 2, 2)


def prefix_bends(x: np.ndarray, longer: bool = False) -> np.ndarray:
    """peakiness() of the first m points of each row of x, in column m - 1, for all m at once.

    Prefixes of one window and order share their smoothed inner points, and their largest bend so far is a running
    maximum; each prefix adds only the fit of its last window. All rows are taken together.
    """
    n = x.shape[1]
    out = np.full(x.shape, np.nan)
    same: dict[tuple[int, int], list[int]] = {}
    for m in range(3, n + 1):
        window, order = _smoother(m, longer)
        if m >= window and 0 <= order < window:
            same.setdefault((window, order), []).append(m)
    for (window, order), sizes in same.items():
        c, h = savgol_matrix(window, order), window // 2
        top = sizes[-1]
        windows = np.lib.stride_tricks.sliding_window_view(x[:, :top], window, axis=1)  # (rows, top - window + 1, window)
        middle = windows @ c[h]
        inner = np.zeros(middle.shape)  # the largest bend at inner points up to and with each window's middle
        if middle.shape[1] > 2:
            inner[:, 1:-1] = np.abs(np.diff(middle, 2, axis=1))
        inner = np.maximum.accumulate(inner, axis=1)
        first = windows[:, 0]
        head = np.abs(first @ np.diff(c[: h + 1], 2, axis=0).T).max(axis=1, initial=0.0)
        turn = np.abs(first @ c[h - 1] - 2 * middle[:, 0] + middle[:, 1]) if middle.shape[1] > 1 else np.zeros(len(x))
        rest = np.diff(c[h:], 2, axis=0)
        for m in sizes:
            j = m - window
            if j == 0:
                out[:, m - 1] = np.abs(first @ np.diff(c, 2, axis=0).T).max(axis=1, initial=0.0)
                continue
            last = windows[:, j]
            tail = np.abs(last @ rest.T).max(axis=1, initial=0.0)
            join = np.abs(middle[:, j - 1] - 2 * middle[:, j] + last @ c[h + 1])
            out[:, m - 1] = np.maximum.reduce([head, turn, inner[:, j - 1], tail, join])
    return out


def leg_path(prices: list, volumes: list, least: int, longer: bool = False, cells: int = 1 << 20) -> list[np.ndarray]:
    """For each leg an array (6, durations): the bend of the volumes so far, their maximum, and the four quarter slopes of
    the prices so far, at the durations from `least` to the whole leg. Legs of like length are stacked and filled up.

    Quarters and slopes are those of the first `duration` steps of a leg; a price of 0 at its start gives no number.
    """
    size = np.array([len(p) for p in prices], np.int64)
    out: list[np.ndarray] = [np.zeros((6, 0))] * len(size)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > least]
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and size[order[high]] <= 1.5 * size[order[low]] + 8 and (high - low + 1) * size[order[high]] <= cells:
            high += 1
        legs = order[low:high]
        n = int(size[legs[-1]])
        p, v = np.zeros((len(legs), n)), np.zeros((len(legs), n))
        for k, i in enumerate(legs):
            p[k, : size[i]], v[k, : size[i]] = prices[i], volumes[i]
        d = np.arange(least, n)
        edge = np.stack([q * (d // 4) + np.minimum(q, d % 4) for q in range(5)])
        at = p[:, edge]  # (legs, 5, durations)
        with np.errstate(all="ignore"):
            slopes = 100 * np.diff(at, axis=1) / (p[:, :1, None] * (np.diff(edge, axis=0) * d)[None])
        bends, most = prefix_bends(v, longer)[:, least:], np.maximum.accumulate(v, axis=1)[:, least:]
        every = np.concatenate([bends[:, None], most[:, None], slopes], axis=1)
        for k, i in enumerate(legs):
            out[i] = every[k, :, : size[i] - least]
        low = high
    return out


def weighted_quantile(values: np.ndarray, weights: np.ndarray, q) -> np.ndarray:
    """Quantiles by midpoints of cumulated weight, over the last midpoint; negative weights count as 0. Plain ones where
    the last midpoint is 0."""
    order = np.argsort(values, kind="stable")
    weights = np.maximum(weights[order], 0)
    c = np.cumsum(weights) - weights / 2
    return np.interp(q, c / c[-1], values[order]) if c[-1] > 0 else np.quantile(values, q)


#: Widths of the scoring network's layers (fixed values).
LAYERS = (191, 128, 64, 32, 32, 1)
LEAK = 0.01


def forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    for i, (w, b) in enumerate(layers):
        x = x @ w.T + b
        if i < len(layers) - 1:
            x = np.where(x > 0, x, LEAK * x)
    return x[:, 0]


def gradients(x: np.ndarray, y: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sums over rows of the gradients of squared error."""
    inputs, sums = [x], []
    for i, (w, b) in enumerate(layers):
        z = inputs[-1] @ w.T + b
        sums.append(z)
        inputs.append(np.where(z > 0, z, LEAK * z) if i < len(layers) - 1 else z)
    delta = 2 * (sums[-1] - y[:, None])
    out = []
    for i in range(len(layers) - 1, -1, -1):
        out.append((delta.T @ inputs[i], delta.sum(axis=0)))
        if i:
            delta = (delta @ layers[i][0]) * np.where(sums[i - 1] > 0, 1.0, LEAK)
    return out[::-1]
