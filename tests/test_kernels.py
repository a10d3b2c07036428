"""Numeric kernels against plain versions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftmark.functions import kernels as k


def test_savgol_fits_polynomials_exactly():
    x = np.arange(40.0)
    for order in (1, 2, 3):
        y = 3 + sum((i + 1) * (x / 10) ** (i + 1) for i in range(order))
        assert np.allclose(k.savgol(y, 21, order), y)
    noisy = np.random.default_rng(0).standard_normal(30)
    out = k.savgol(noisy, 7, 2)
    for i in range(30):
        s = min(max(i - 3, 0), 23)
        c = np.polyfit(np.arange(7), noisy[s : s + 7], 2)
        assert np.isclose(out[i], np.polyval(c, i - s))
    assert len(k.savgol(np.arange(21.0), 21, 3)) == 21


def plain_peaks(x, distance, prominence):
    n, out = len(x), []
    for i in range(1, n - 1):
        j = i
        while j + 1 < n and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < n and x[j + 1] < x[i]:
            out.append((i + j) // 2)
    kept = []
    for p in sorted(out, key=lambda p: (x[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def high(p):
        left, i = x[p], p
        while i >= 0 and x[i] <= x[p]:
            left, i = min(left, x[i]), i - 1
        right, i = x[p], p
        while i < n and x[i] <= x[p]:
            right, i = min(right, x[i]), i + 1
        return x[p] - max(left, right)

    return sorted(p for p in kept if high(p) >= prominence)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=0, max_size=40), st.integers(1, 6), st.floats(0, 3))
def test_peaks_against_a_plain_version(x, distance, prominence):
    x = np.array(x, float)
    assert k.find_peaks(x, distance, prominence).tolist() == plain_peaks(x, distance, prominence)


def test_peak_edge_cases():
    assert k.find_peaks(np.array([1.0, 5, 5, 1]), 1, 0).tolist() == [1]
    assert k.find_peaks(np.array([1.0, 5, 5, 5, 1]), 1, 0).tolist() == [2]
    assert k.find_peaks(np.array([5.0, 1, 5]), 1, 0).tolist() == []
    assert k.find_peaks(np.ones(9), 5, 0).tolist() == []
    assert k.find_peaks(np.array([0.0, 3, 0, 3, 0]), 5, 0).tolist() == [3]


@pytest.mark.parametrize("n", [5, 6, 7, 8, 10, 11, 15, 23])
def test_peakiness_windows(n):
    x = np.random.default_rng(n).uniform(1, 2, n)
    window = 2 * int(np.rint((n - 3) / 8)) + 3
    order = min(int(np.rint(n / 3)) - 2, 2)
    want = np.abs(np.diff(k.savgol(x, window, order), 2)).max() if order >= 0 else np.nan
    assert np.isclose(k.peakiness(x), want, equal_nan=True)
    assert np.isclose(k.peakiness(5 * x), 5 * k.peakiness(x), equal_nan=True)


def test_weighted_quantiles():
    assert k.weighted_quantile(np.array([3.0]), np.array([2.0]), [0.1, 0.9]).tolist() == [3, 3]
    assert k.weighted_quantile(np.array([1.0, 2, 3]), np.zeros(3), [0.5]).tolist() == [2]
    got = k.weighted_quantile(np.array([10.0, 0, 20]), np.array([1.0, 1, 2]), 0.5)
    assert np.isclose(got, np.interp(0.5, np.array([0.5, 1.5, 3]) / 3, [0, 10, 20]))


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    layers = [(rng.standard_normal((4, 3)), rng.standard_normal(4)), (rng.standard_normal((1, 4)), rng.standard_normal(1))]
    x, y = rng.standard_normal((6, 3)), rng.standard_normal(6)
    got = k.gradients(x, y, layers)
    for i, (w, b) in enumerate(layers):
        for at in np.ndindex(w.shape):
            old, e = w[at], 1e-6
            w[at] = old + e
            up = ((k.forward(x, layers) - y) ** 2).sum()
            w[at] = old - e
            down = ((k.forward(x, layers) - y) ** 2).sum()
            w[at] = old
            assert np.isclose(got[i][0][at], (up - down) / (2 * e), rtol=1e-4, atol=1e-5)


def test_bends_by_length_are_those_of_each_leg():
    rng = np.random.default_rng(3)
    legs = [rng.standard_normal(n).cumsum() for n in (0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 11, 15, 23, 40, 41, 90, 700)] + [None]
    for longer in (False, True):
        got = k.peakiness_all(legs, longer)
        want = [np.nan if x is None else k.peakiness(x, longer) for x in legs]
        assert np.allclose(got, want, equal_nan=True)


def test_negative_weights_count_as_none():
    v, w = np.array([3.0, 1.0, 2.0]), np.array([1.0, -5.0, 1.0])
    assert np.allclose(k.weighted_quantile(v, w, [0.1, 0.5, 0.9]), k.weighted_quantile(v, np.maximum(w, 0), [0.1, 0.5, 0.9]))
    assert np.allclose(k.weighted_quantile(v, -np.abs(w), [0.5]), [2.0])


@pytest.mark.parametrize("longer", [False, True])
def test_bends_of_all_prefixes(longer):
    x = np.random.default_rng(8).uniform(0, 5, (5, 90))
    got = k.prefix_bends(x, longer)
    want = np.array([[k.peakiness(row[: m + 1], longer) for m in range(90)] for row in x])
    assert np.allclose(got, want, equal_nan=True)


def test_leg_paths_against_each_duration():
    rng = np.random.default_rng(9)
    sizes = [0, 3, 4, 5, 6, 7, 11, 12, 30, 31, 33, 120]
    legs = [(rng.uniform(1, 9, n), rng.uniform(0, 4, n)) for n in sizes]
    for cells in (1, 1 << 20):
        got = k.leg_path([p for p, _ in legs], [v for _, v in legs], 4, cells=cells)
        for (p, v), found in zip(legs, got):
            assert found.shape == (6, max(0, len(p) - 4))
            for d in range(4, len(p)):
                slopes = [q.mean() / d for q in np.array_split(np.diff(p[: d + 1]) / p[0] * 100, 4)]
                assert np.allclose(found[:, d - 4], [k.peakiness(v[: d + 1]), v[: d + 1].max(), *slopes], equal_nan=True)
