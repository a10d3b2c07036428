"""Near-duplicate embeddings by lattice hashing.

Each table projects unit vectors to `blocks` random 8-dimensional views, scales them and decodes every view to its
nearest point of the E8 lattice; the points make the bucket. A vector is stored under its own cell and looks
also into neighbouring cells, those across the facets of its Voronoi cell that are nearest to it. Candidates are
verified by cosine in double precision.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Scratch, connected_components, hot_join
from driftmark.llm.hashing import U, mix


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled to be whole: the facets of its Voronoi cell."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-2, 2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            whole.append(v)
    half = [s for s in itertools.product((-1, 1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(whole + half)


FACETS = minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest whole points of even sum: round, and where the sum is odd turn the worst coordinate the other way."""
    out = np.rint(x)
    odd = np.flatnonzero(out.sum(axis=1) % 2)
    rest = x[odd] - out[odd]
    worst = np.abs(rest).argmax(axis=1)
    out[odd, worst] += np.where(rest[np.arange(len(odd)), worst] < 0, -1, 1)
    return out


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points, doubled to be whole: the better of the two cosets of D8."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return (np.where(nearer[:, None], a, b) * 2).astype(np.int64)


def _fold(points: np.ndarray) -> np.ndarray:
    key = np.zeros(points.shape[:-1], U)
    for i in range(points.shape[-1]):
        key = mix(key * U(0x9E3779B97F4A7C15) + points[..., i].astype(U))
    return key


def cells(x: np.ndarray, label: np.ndarray, tables: int, blocks: int, width: float, probes: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(own cell, neighbouring cells) of unit vectors: arrays (n, tables) and (n, tables * blocks * probes)."""
    rng = np.random.default_rng(seed)
    own, near = [], []
    for t in range(tables):
        keys, others = [], []
        for _ in range(blocks):
            view = np.linalg.qr(rng.standard_normal((x.shape[1], 8)))[0] if x.shape[1] >= 8 else rng.standard_normal((x.shape[1], 8))
            y = x @ view / width + rng.uniform(0, 1, 8)
            point = nearest_e8(y)
            toward = (2 * y - point) @ FACETS.T
            best = np.argpartition(-toward, probes, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), np.int64)
            keys.append(_fold(point))
            others.append(_fold(point[:, None, :] + FACETS[best]))
        salt = mix(label.astype(np.int64).astype(U) * U(0xD6E8FEB86659FD93) + U(t + 1))
        joined = lambda parts, salt=salt: mix(sum(mix(p + U(b + 1)) for b, p in enumerate(parts)) ^ salt)
        own.append(joined(keys))
        for b in range(blocks):
            for i in range(probes):
                near.append(joined([others[c][:, i] if c == b else keys[c] for c in range(blocks)]))
    return np.stack(own, 1), (np.stack(near, 1) if near else np.zeros((len(x), 0), U))


def _unit(rows: list) -> tuple[np.ndarray, list[int]]:
    """Unit vectors in double precision and the places they come from; unusable vectors are left out."""
    out, at = [], []
    for i, v in enumerate(rows):
        if v and None not in v:
            a = np.array(v, float)
            top = np.abs(a).max()
            if np.isfinite(top) and top > 0:
                a = a / top  # no overflow, no underflow
                out.append(a / np.sqrt((a * a).sum()))
                at.append(i)
    return out, at


def _hashed(tables: int, blocks: int, width: float, probes: int):
    names = ["id", "label", "c1", "c2", "unit", "own", "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = (c.to_pylist() for c in batch.columns)
            found, at = _unit(vectors)
            for size in {len(v) for v in found}:
                mine = [k for k, v in enumerate(found) if len(v) == size]
                x, place = np.stack([found[k] for k in mine]), [at[k] for k in mine]
                label = np.array([labels[i] for i in place], np.int64)
                own, near = cells(x, label, tables, blocks, width, probes)
                bits = np.where(x == 0, 0.0, x).view(U)  # -0.0 is 0.0
                c1 = _fold(bits) ^ mix(label.astype(U) + U(size))
                columns = [[ids[i] for i in place], label, c1.view(np.int64), mix(_fold(bits[:, ::-1]) + c1).view(np.int64)]
                arrays = [pa.array(c, pa.int64()) for c in columns]
                arrays += [pa.array([v.tobytes() for v in x], pa.binary())]
                arrays += [pa.array(list(k.view(np.int64)), pa.list_(pa.int64())) for k in (own, near)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _cosine(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ua, ub = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            hit = [len(a) == len(b) and float(np.frombuffer(a) @ np.frombuffer(b)) >= least for a, b in zip(ua, ub, strict=True)]
            hit = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=["a", "b"])

    return run


def lattice_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.93,
    tables: int = 12,
    blocks: int = 2,
    width: float = 0.24,
    probes: int = 3,
) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Two vectors of one label link when their cosine is at least `least`. Vectors of equal direction form one class
    before hashing and are counted, not paired. No bucket is capped. Vectors that are null, empty, zero or hold
    null or non-finite components, and rows with a null label or id, link with nothing; so do vectors of
    different lengths. Repeated rows are copies and link with each other. Rows that repeat an id with another vector
    share a component and the greatest of their numbers of links, and each of their vectors links with others. Other
    columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "lattice")
    picked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = picked.filter("id is not null and label is not null and v is not null")
    schema = "id long, label long, c1 long, c2 long, unit binary, own array<long>, near array<long>"
    hashed = scratch.save(rows.mapInArrow(_hashed(tables, blocks, width, probes), schema), "hashed")
    classes = scratch.save(hashed.groupBy("c1", "c2").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    # Different directions are numbered, since an id may have several.
    reps = hashed.join(classes, ["id", "c1", "c2"]).dropDuplicates(["id", "c1", "c2"])
    reps = scratch.save(reps.select(F.monotonically_increasing_id().alias("rep"), F.col("id").alias("least"), "c1", "c2", "copies", "unit", "own", "near"), "reps")
    members = hashed.select("id", "c1", "c2").join(reps.select("rep", "least", "copies", "c1", "c2"), ["c1", "c2"])
    members = scratch.save(members.select("id", "rep", "least", "copies"), "members")
    shared_ids = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").select("id", "a")
    by_id = members.select("id", "rep").join(shared_ids, "id").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct()

    stored = reps.select(F.col("rep").alias("a"), F.explode("own").alias("key"))
    asking = reps.select(F.col("rep").alias("b"), F.explode(F.concat("own", "near")).alias("key"))
    found = stored.join(asking, "key").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    unit = lambda x: reps.select(F.col("rep").alias(x), F.col("unit").alias(f"u{x}"))
    pairs = found.join(unit("a"), "a").join(unit("b"), "b").select("a", "b", "ua", "ub")
    links = scratch.save(pairs.mapInArrow(_cosine(least), "a long, b long"), "links")

    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(reps.select(F.col("rep").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    parts = connected_components(scratch, scratch.save(links.union(by_id), "all-links"))
    named = parts.join(reps.select(F.col("rep").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    named = hot_join(parts, named, "component", "node", parts, parts.count()).select(F.col("node").alias("rep"), "component_id")
    found = members.join(named, "rep", "left").join(degree.withColumnRenamed("a", "rep"), "rep", "left")
    found = found.groupBy("id").agg(
        F.max(F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.min(F.coalesce("component_id", "least")).alias("component_id")
    )
    out = picked.select("id").join(found, "id", "left")
    part = F.coalesce("component_id", "id")
    out = out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"),
        F.coalesce(F.col("id") == part, F.lit(True)).alias("kept"),
    )
    return scratch.last(out)
