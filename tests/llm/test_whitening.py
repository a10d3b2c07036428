"""Whitening against numpy's own eigenvectors and exact sums."""

import numpy as np
import pytest

from driftmark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, component int, x string"


def symmetric(rng, n, values):
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize("n", [1, 2, 3, 5, 20, 64])
def test_components_against_numpy(n):
    rng = np.random.default_rng(n)
    cases = [rng.uniform(0, 10, n), 2.0 ** -np.arange(n), np.ones(n), np.zeros(n), np.append(np.full(n - 1, 3.0), 1e-9), np.linspace(1, 1 + 1e-12, n), 1e12 * rng.uniform(1, 2, n)]
    for values in cases:
        a = symmetric(rng, n, values)
        a = (a + a.T) / 2
        d, e, q = W.tridiagonal(a)
        t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
        size = max(np.abs(a).max(), 1e-300)
        assert np.abs(q @ t @ q.T - a).max() < 1e-13 * n * size and np.abs(q.T @ q - np.eye(n)).max() < 1e-13 * n
        got, u = W.leading_components(a, 4)
        k = min(4, n)
        assert np.abs(got - np.linalg.eigvalsh(a)[::-1][:k]).max() < 1e-13 * n * size
        assert np.abs(u.T @ u - np.eye(k)).max() < 1e-12
        assert np.abs(a @ u - u * got).max() < 1e-12 * n * size


def test_sturm_counts():
    d, e = np.array([2.0, 2.0, 2.0]), np.array([-1.0, -1.0])
    at = np.array([-1.0, 0.5857, 0.5859, 2.0001, 3.41, 3.42])
    assert W.sturm_counts(d, e, at).tolist() == [0, 0, 1, 2, 2, 3]


def plain(rows, scale=256):
    """{(id, component): values} and the components, by numpy."""
    keep = [(i, v) for i, v, *_ in rows if v and None not in v and np.isfinite(v).all()]
    x = np.array([[int(np.floor(np.float64(np.float32(c)) * scale)) for c in v] for _, v in keep])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = np.cov(fit.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    out = {}
    for (i, _), row in zip(keep, x):
        for c in range(4):
            out[i, c + 1] = (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)), (row - s / n) @ u[:, c] / np.sqrt(e[c]), e[c] / np.trace(v))
    return out


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(3)
    mixing = rng.standard_normal((12, 12))
    rows = [(i, (rng.standard_normal(12) @ mixing / 8).astype("float32").tolist(), 1, 1, "x") for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1], 1, 1, "x") for i in range(150)]  # copies do not weigh
    odd = [(1, None), (2, []), (3, [None] * 12), (4, [float("nan")] * 12), (5, [float("inf")] + [0.0] * 11), (6, [1.0, 2.0])]
    df = spark.createDataFrame(rows + [(5000 + i, v, None, None, None) for i, v in odd] + [(7000, [-0.0] * 12, 1, 1, "x")], SCHEMA).repartition(5)
    want = plain([*rows, (7000, [0.0] * 12)])
    got = W.whiten(df).collect()
    assert {(r["vec_id"], r["component"]) for r in got} == set(want) and len(got) == len(want)
    sign = {}
    for r in got:
        n, deviation, whitened, explained = want[r["vec_id"], r["component"]]
        sign.setdefault(r["component"], np.sign(r["whitened"] * whitened))
        assert r["n"] == n and r["deviation"] == deviation and abs(r["explained"] - explained) < 1e-12
        assert abs(r["whitened"] - sign[r["component"]] * whitened) < 1e-9 and r["identity_error"] < 1e-10


def test_awkward_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert W.whiten(make([])).count() == 0
    assert W.whiten(make([(1, None, 1, 1, "x"), (2, [], 1, 1, "x")])).collect() == []
    one = W.whiten(make([(None, [0.5, 0.25], 1, 1, "x"), (3, [0.5, 0.25], 1, 1, "x"), (3, [0.5, 0.25], 1, 1, "x")])).collect()
    assert len(one) == 6 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in one)
    line = W.whiten(make([(i, [i / 256, 2 * i / 256, 0.0], 1, 1, "x") for i in range(5)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line) and line[0]["identity_error"] < 1e-12
    # Numbers too large for a long are null, others exact.
    big = {(r["vec_id"], r["component"]): r for r in W.whiten(make([(1, [3e7], 1, 1, "x"), (2, [-3e7], 1, 1, "x"), (3, [0.0], 1, 1, "x")])).collect()}
    assert big[3, 1]["deviation"] == 0 and big[1, 1]["deviation"] is None and abs(big[1, 1]["whitened"] - big[2, 1]["whitened"]) > 1
