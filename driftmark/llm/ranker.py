"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A document labelled 1 is preferred to one labelled 0. The model gives each document a worth w.x and the pair
(i, j) the probability sigmoid(w.(x_i - x_j)); w minimises the logistic loss over pairs of a bounded sample of
labelled rows. The threshold is the quantile of the sample's worths at the share of label 0, and the score maps
that threshold to 0.3.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.quality_rules import base_counts, statistics

#: The score at the threshold.
AT_THRESHOLD = 0.3
_DIGITS = b"0123456789"


def features(text: str | None) -> list[float]:
    """Statistics of a text alone; an empty text has those of its pseudo-counts."""
    counts = base_counts(text)
    n, _, _, dup, repeated, words = counts
    raw = (text or "").encode()
    digits = len(raw) - len(raw.translate(None, _DIGITS))
    lengths = [len(w) for w in words]
    mean = sum(lengths) / max(n, 1)
    spread = math.sqrt(sum((x - mean) ** 2 for x in lengths) / max(n, 1))
    stats = statistics(text, counts) or [math.log(5), 0.0, math.log(0.02), 1.0, math.log(0.15)]
    return [*stats, repeated / (n + 20), dup / (raw.count(b"\n") + 5), math.log((digits + 1) / (len(raw) + 200)), math.log(spread + 1)]


N_FEATURES = len(features(None))


def _expand(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standard scores, clipped, and their squares: a quality may lie in the middle of a statistic."""
    z = np.clip((x - centre) / scale, -8, 8)
    return np.hstack([z, z * z / 4])


@dataclass
class Ranker:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    width: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        worth = _expand(x, self.centre, self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip((worth - self.threshold) / self.width + math.log(AT_THRESHOLD / (1 - AT_THRESHOLD)), -40, 40)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """Bradley-Terry fit by Newton steps. With one class only, every score is the share of label 1."""
    centre, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        worth = 1.0 if len(good) else -1.0
        return Ranker(centre, scale, np.zeros(2 * x.shape[1]), -4 * worth, 1.0)
    low, centre, high = np.percentile(x, [25, 50, 75], axis=0)
    scale = np.maximum((high - low) / 1.349, 0.25 * x.std(axis=0) + 1e-3)
    wide = _expand(x, centre, scale)
    rng = np.random.default_rng(seed)
    each = max(1, pairs // max(len(good), len(bad)))
    i = rng.permutation(np.resize(good, each * max(len(good), len(bad))))
    j = rng.permutation(np.resize(bad, len(i)))
    d = wide[i] - wide[j]
    w = np.zeros(wide.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        gradient = d.T @ (p - 1) / len(d) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    worth = np.sort(wide @ w)
    cut = len(bad)
    threshold = (worth[cut - 1] + worth[cut]) / 2
    return Ranker(centre, scale, w, float(threshold), float(worth.std() / 4 + 1e-9))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 12_000, folds: int = 5) -> Ranker:
    """Fit on at most `max_labelled` labelled rows, those whose hashed id is smallest; rows whose crc32(id as
    text) is divisible by `folds` are never used. The bound makes the id list safe to broadcast and the sample
    safe on the driver. Null labels and ids are skipped; an id labelled twice counts once, by its larger label, and
    rows that repeat an id count once, by their smallest text."""
    ids = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    ids = ids.filter("y in (0, 1) and id is not null").filter(F.crc32(F.col("id").cast("string")) % folds != 0)
    ids = ids.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    rows = rows.select("y", "text").mapInArrow(_featured, "y int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), N_FEATURES)
    order = np.lexsort((*x.T, rows["y"].to_numpy())) if len(rows) else []
    return fit_pairs(x[order], rows["y"].to_numpy()[order])


def score(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (score of 0.3 or more).

    Null texts score as empty ones. A null id is never held out. Repeated rows repeat their result; other
    columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = picked.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= AT_THRESHOLD, 1).otherwise(0).alias("predicted"))
