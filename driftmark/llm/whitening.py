"""Whitening of embeddings by their leading principal components.

Vectors become whole numbers (the floor of `scale` times each entry). The covariance is over the different vectors, so
that copies do not weigh: Spark counts and sums them, then adds up centred products, one matrix a batch. The matrix has
as many rows as a vector has entries, whatever the table; the driver brings it to tridiagonal form by Householder
reflections, finds the leading eigenvalues by bisection on Sturm counts and their vectors by inverse iteration, with
vectors of near values made orthogonal again. The projection is broadcast and applied to every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Scratch

EPS = float(np.finfo(float).eps)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) of a symmetric matrix with a = q t q', q orthogonal, by Householder reflections."""
    t, n = np.array(a, float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = t[k + 1 :, k]
        top = np.abs(x).max()
        if top == 0 or not np.abs(x[1:]).any():
            continue
        v = x / top
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v *= np.sqrt(2 / (v @ v))  # the reflection is 1 - v v'
        p = t[k + 1 :, k + 1 :] @ v
        w = p - v * (v @ p) / 2
        t[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        t[k + 1 :, k] -= v * (v @ t[k + 1 :, k])
        t[k, k + 1 :] = t[k + 1 :, k]
        q[:, k + 1 :] -= np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(t).copy(), np.diag(t, 1).copy(), q


def sturm_counts(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each number: the negative terms of its Sturm sequence."""
    least = np.finfo(float).tiny / EPS * max(1.0, float(np.abs(e).max(initial=0.0)) ** 2)
    term = d[0] - at
    count = (term < 0).astype(int)
    for i in range(1, len(d)):
        term = np.where(np.abs(term) < least, -least, term)
        term = d[i] - at - e[i - 1] * (e[i - 1] / term)
        count += term < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues, falling, each bisected until no number lies between its bounds."""
    n = len(d)
    radius = np.concatenate(([0.0], np.abs(e))) + np.concatenate((np.abs(e), [0.0]))
    low, high = np.full(k, (d - radius).min()), np.full(k, (d + radius).max())
    high += EPS * np.maximum(np.abs(low), np.abs(high)) + np.finfo(float).tiny
    wanted = n - np.arange(k)  # the eigenvalue has this many up to and with it
    while True:
        mid = low + (high - low) / 2
        if ((mid <= low) | (mid >= high)).all():
            return low + (high - low) / 2
        below = sturm_counts(d, e, mid) >= wanted
        low, high = np.where(below, low, mid), np.where(below, mid, high)


def _solve(d: np.ndarray, e: np.ndarray, value: float, b: np.ndarray, least: float) -> np.ndarray:
    """x with (t - value) x = b, by elimination with row exchanges; a pivot below `least` becomes that."""
    n = len(d)
    up, over, far, x = d - value, np.append(e, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        under, here, right = e[i], up[i + 1], over[i + 1]
        if abs(under) > abs(up[i]):
            f = up[i] / under
            up[i], here, old = under, over[i] - f * here, here
            over[i], far[i], right = old, right, -f * right
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
        else:
            up[i] = up[i] if abs(up[i]) >= least else least
            f = under / up[i]
            here -= f * over[i]
            x[i + 1] -= f * x[i]
        up[i + 1], over[i + 1] = here, right
    up[n - 1] = up[n - 1] if abs(up[n - 1]) >= least else least
    for i in range(n - 1, -1, -1):
        rest = x[i]
        if i + 1 < n:
            rest -= over[i] * x[i + 1]
        if i + 2 < n:
            rest -= far[i] * x[i + 2]
        x[i] = rest / up[i]
    return x


def inverse_iteration(d: np.ndarray, e: np.ndarray, values: np.ndarray, steps: int = 6) -> np.ndarray:
    """Unit eigenvectors in columns, for falling eigenvalues. Values nearer than a thousandth of the matrix's norm form a
    cluster, whose vectors are made orthogonal in every step; equal ones are asked for slightly apart."""
    norm = max(float((np.abs(d) + np.abs(np.append(e, 0.0)) + np.abs(np.append(0.0, e))).max()), np.finfo(float).tiny)
    rng = np.random.default_rng(5)
    out, asked, first = np.zeros((len(d), len(values))), np.array(values, float), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            first = j
        if j > first and asked[j] >= asked[j - 1] - 10 * EPS * norm:
            asked[j] = asked[j - 1] - 10 * EPS * norm
        x = rng.uniform(-1, 1, len(d))
        for _ in range(steps):
            x = _solve(d, e, asked[j], x / np.abs(x).max(), EPS * norm)
            near = out[:, first:j]
            for _ in range(2):
                x = x - near @ (near.T @ x)
            x /= np.abs(x).max()
            x /= np.sqrt(x @ x)
        out[:, j] = x
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) of a covariance, falling. The sign is that of the greatest entry."""
    k, top = min(k, len(v)), float(np.abs(v).max())
    if top == 0:
        return np.zeros(k), np.eye(len(v))[:, :k]
    d, e, q = tridiagonal(v / top)
    values = leading_values(d, e, k)
    u = q @ inverse_iteration(d, e, values)
    u /= np.sqrt((u * u).sum(axis=0))
    return values * top, u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(k)])


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _products(width: int, mean: np.ndarray, project: np.ndarray | None = None):
    """x vectors to the sums of products of their centred entries, or of their projections: (i, j, total) with i <= j,
    and the projections' own sums at j = -1."""
    size = width if project is None else project.shape[1]
    i, j = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            x = _matrix(batch.column(0), width, float) - mean
            x = x if project is None else x @ project
            total += x.T @ x
            sums += x.sum(axis=0)
        columns = [np.append(i, np.arange(size)), np.append(j, np.full(size, -1)), np.append(total[i, j], sums)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "total"])

    return run


def _second_moments(x: DataFrame, n: int, width: int, mean: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """The covariance of x vectors or of their projections, divisor n. One row an entry reaches the driver."""
    size = width if project is None else project.shape[1]
    rows = x.mapInArrow(_products(width, mean, project), "i long, j long, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).toPandas()
    out, sums = np.zeros((size, size)), np.zeros(size)
    pair = rows[rows["j"] >= 0]
    out[pair["i"], pair["j"]] = out[pair["j"], pair["i"]] = pair["total"]
    own = rows[rows["j"] < 0]
    sums[own["i"]] = own["total"]
    return out / n - np.outer(sums / n, sums / n)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """One row per usable row of vectors and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    x = floor(scale * entry); n, the entries' sums S, mean and covariance V are over the different x vectors. deviation:
    the sum of (n x - S)^2 over entries, exact (null where no long holds it). whitened: x - S/n on the unit eigenvector
    of the component, over the root of its eigenvalue e; explained: e over V's trace. identity_error: the largest
    absolute entry of whitened's covariance over the different vectors, measured by one more pass, minus the identity.

    Vectors that are null, empty or hold null or non-finite entries are dropped, and so are vectors of another length
    than most usable rows have (of equally frequent lengths the greatest counts). Components are at most as many as
    entries. Where an eigenvalue is 0 but for rounding (n = 1, too few different vectors, constant tables), whitened is
    null and the component is left out of identity_error, which is null if none is left; explained is null if the trace
    is 0. Null and repeated ids pass through, repeated rows repeat their result; other columns are not read; an empty
    table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    v = F.col(vector_col).cast("array<double>")
    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(_usable(F.col("v")))
    picked = picked.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = picked.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], schema)
    width = sizes[0]["width"]
    picked = picked.filter(F.size("x") == width)
    fit = scratch.save(picked.select("x").groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    entries = fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("total"), F.min("x").alias("low"), F.max("x").alias("high"))
    moments = entries.orderBy("i").collect()  # one row an entry of a vector
    n, sums = moments[0]["n"], [int(m["total"]) for m in moments]
    mean = np.array([s / n for s in sums])
    spread = [max(n * m["high"] - s, s - n * m["low"]) for m, s in zip(moments, sums)]
    plain = sum(x * x for x in spread) < 1 << 63 and max(n * max(abs(m["low"]), abs(m["high"])) for m in moments) < 1 << 63
    covariance = _second_moments(fit, n, width, mean)
    values, u = leading_components(covariance, components)
    trace = float(np.trace(covariance))
    k = len(values)
    good = values > width * EPS * max(trace, 0.0)
    project = u[:, good] / np.sqrt(values[good])
    error = None
    if good.any():
        error = float(np.abs(_second_moments(fit, n, width, mean, project) - np.eye(project.shape[1])).max())
    scratch.drop_all()
    explained = [float(e / trace) if trace > 0 else None for e in values]
    exact = np.array(sums, np.int64 if plain else object)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _matrix(batch.column(1), width, np.int64), batch.num_rows
            away = (x if plain else x.astype(object)) * n - exact
            deviation = (away * away).sum(axis=1)
            if not plain:
                deviation = [d if d < 1 << 63 else None for d in deviation.tolist()]
            whitened, known = np.zeros((m, k)), np.tile(good, m)
            whitened[:, good] = (x - mean) @ project
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, n), pa.int64()),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(whitened.ravel(), mask=~known),
                pa.array(explained * m, pa.float64()),
                pa.array([error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return picked.mapInArrow(rows, schema)
