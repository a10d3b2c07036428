"""Scoring and training feed-forward networks over tables of samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.functions.kernels import LAYERS, forward, gradients
from driftmark.sources.versioned import Versioned

Layers = list[tuple[np.ndarray, np.ndarray]]


def made_weights(spark: SparkSession, checkpoints: int, layers: tuple[int, ...] = LAYERS) -> DataFrame:
    """(checkpoint, layer, out_idx, w, bias) by a closed formula, for tests and demonstrations without trained weights."""
    out = None
    for layer, (n, m) in enumerate(zip(layers[:-1], layers[1:], strict=True)):
        one = spark.range(1, checkpoints + 1).select(F.col("id").cast("int").alias("checkpoint"), F.lit(layer).alias("layer"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("out_idx"))
        angle = lambda j: F.sin(F.col("checkpoint") * 0.37 + F.lit(layer) * 1.3 + F.col("out_idx") * 0.71 + j * 0.29)
        w = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: angle(j) / math.sqrt(n))
        one = one.select("checkpoint", "layer", "out_idx", w.alias("w"), (F.cos(F.col("out_idx") * 1.1) * 0.01).alias("bias"))
        out = one if out is None else out.union(one)
    return out


def collected(weights: DataFrame) -> dict[int, Layers]:
    """Weights to the driver: a few hundred rows a checkpoint, whatever the samples."""
    rows = weights.orderBy("checkpoint", "layer", "out_idx").collect()
    out: dict[int, dict[int, list]] = {}
    for r in rows:
        out.setdefault(r["checkpoint"], {}).setdefault(r["layer"], []).append((r["w"], r["bias"]))
    return {c: [(np.array([w for w, _ in x]), np.array([b for _, b in x])) for _, x in sorted(per.items())] for c, per in out.items()}


def score(samples: DataFrame, weights: DataFrame, keep: list[str], features: str = "features") -> DataFrame:
    """Every sample under every checkpoint, in long form: keep, checkpoint, prediction. One product a batch."""
    nets = samples.sparkSession.sparkContext.broadcast(collected(weights))
    chosen = samples.select(*keep, F.col(features).alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(len(keep)).to_pylist(), float)
            for c, layers in nets.value.items():
                if len(x):
                    cols = [*batch.columns[: len(keep)], pa.array(np.full(len(x), c, np.int32)), pa.array(forward(x, layers))]
                    yield pa.RecordBatch.from_arrays(cols, names=[*keep, "checkpoint", "prediction"])

    schema = T.StructType([*chosen.drop("_x").schema.fields, T.StructField("checkpoint", T.IntegerType()), T.StructField("prediction", T.DoubleType())])
    return chosen.mapInArrow(run, schema)


_SUMS = "net int, layer int, out_idx int, g array<double>, gb double, n long"


def network_sums(samples: DataFrame, nets: dict[int, Layers]) -> DataFrame:
    """(net, layer, out_idx, g, gb, n): sums over samples(features, target, part) for several networks in one pass, partial per
    task and then added up; rows are not shuffled. Rows of part 'train' give gradients; those of any other part give the
    network's squared error, as layer -1 with the sum in gb."""
    shared = samples.sparkSession.sparkContext.broadcast(nets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        n, error, m = 0, dict.fromkeys(shared.value, 0.0), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = np.array(batch.column(0).to_pylist(), float), np.array(batch.column(1).to_pylist(), float)
            t = np.array(batch.column(2).to_pylist()) == "train"
            n, m = n + int(t.sum()), m + int((~t).sum())
            for net, layers in shared.value.items():
                if t.any():
                    now = gradients(x[t], y[t], layers)
                    total[net] = now if net not in total else [(a + c, b + d) for (a, b), (c, d) in zip(total[net], now, strict=True)]
                if not t.all():
                    error[net] += float(((forward(x[~t], layers) - y[~t]) ** 2).sum())
        rows = [(net, k, i, w[i].tolist(), float(b[i]), n) for net, sums in total.items() for k, (w, b) in enumerate(sums) for i in range(len(b))]
        rows += [(net, -1, 0, [0.0], e, m) for net, e in error.items() if m]
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _SUMS.split(", ")])

    parts = samples.select("features", "target", "part").mapInArrow(run, _SUMS)
    key = ["net", "layer", "out_idx"]
    sums = parts.select(*key, F.posexplode("g").alias("i", "x"), "gb", "n").groupBy(*key, "i").agg(F.sum("x").alias("x"), F.sum("gb").alias("gb"), F.sum("n").alias("n"))
    rows = sums.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("x"), F.first("gb").alias("gb"), F.first("n").alias("n"))
    return rows.select(*key, F.col("x.x").alias("g"), "gb", "n")


def gradient_rows(samples: DataFrame, layers: Layers, features: str = "features", target: str = "target") -> DataFrame:
    """(layer, out_idx, g, gb, n): gradient sums of one network over all samples."""
    rows = samples.select(F.col(features).alias("features"), F.col(target).cast("double").alias("target"), F.lit("train").alias("part"))
    return network_sums(rows, {0: layers}).drop("net")


def clipped(rows: DataFrame, max_norm: float) -> DataFrame:
    """Mean gradients scaled down to a norm of at most max_norm."""
    mean = rows.select("layer", "out_idx", F.transform("g", lambda x: x / F.col("n")).alias("g"), (F.col("gb") / F.col("n")).alias("gb"))
    norm = mean.agg(F.sqrt(F.sum(F.aggregate("g", F.lit(0.0), lambda a, x: a + x * x) + F.col("gb") * F.col("gb"))).alias("norm"))
    factor = F.least(F.lit(1.0), max_norm / (F.col("norm") + 1e-12))
    both = mean.crossJoin(F.broadcast(norm))  # one row
    return both.select("layer", "out_idx", F.transform("g", lambda x: x * factor).alias("g"), (F.col("gb") * factor).alias("gb"), "norm")


CHECKPOINTS = "step int, layer int, out_idx int, w array<double>, bias double, holdout_error double"


def checkpoints(spark: SparkSession, path: str) -> Versioned:
    """The table of kept weights: a partition a step, complete or not there at all."""
    return Versioned(spark, path, "step", CHECKPOINTS)


def kept_layers(table: DataFrame, step: int) -> Layers:
    """Weights of one step to the driver: a few hundred rows."""
    rows = table.filter(F.col("step") == step).withColumn("checkpoint", F.lit(0))
    return collected(rows)[0]


def _layer_rows(spark: SparkSession, step: int, layers: Layers, error: float) -> DataFrame:
    rows = [(step, k, i, w[i].tolist(), float(b[i]), error) for k, (w, b) in enumerate(layers) for i in range(len(b))]
    return spark.createDataFrame(rows, CHECKPOINTS)


def train(batches: DataFrame, holdout: DataFrame, layers: Layers, steps: int, rate: float = 1e-4, max_norm: float = 1.0, every: int = 10, path: str | None = None) -> tuple[Layers, list[tuple[int, float]]]:
    """Gradient steps over batches(batch, features, target); every `every` steps the holdout's mean squared error.

    path: the place of checkpoints(); every `every` steps the weights are added there with their error, and a run that
    finds some goes on behind the last of them, as if it had never stopped. Only per-layer sums reach the driver.
    """
    spark = batches.sparkSession
    n = batches.agg(F.max("batch")).first()[0] + 1
    log: list[tuple[int, float]] = []
    table = checkpoints(spark, path) if path else None
    if table is not None and table.version():
        log = sorted((r["step"], r["holdout_error"]) for r in table.read().select("step", "holdout_error").distinct().collect())
        log = [x for x in log if x[0] <= steps]
        layers = kept_layers(table.read(), log[-1][0]) if log else layers
    for step in range(log[-1][0] if log else 0, steps):
        rows = clipped(gradient_rows(batches.filter(F.col("batch") == step % n), layers), max_norm).orderBy("layer", "out_idx").collect()
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r["layer"], []).append((r["g"], r["gb"]))
        layers = [(w - rate * np.array([g for g, _ in by[k]]), b - rate * np.array([gb for _, gb in by[k]])) for k, (w, b) in enumerate(layers)]
        if (step + 1) % every == 0 or step + 1 == steps:
            log.append((step + 1, holdout_error(holdout, layers)))
            if table is not None:
                table.update(_layer_rows(spark, step + 1, layers, log[-1][1]))
    return layers, log


def holdout_error(holdout: DataFrame, layers: Layers) -> float:
    net = holdout.sparkSession.sparkContext.broadcast(layers)

    @F.pandas_udf("double")
    def predicted(x: pd.Series) -> pd.Series:
        return pd.Series(forward(np.array(x.tolist(), float), net.value))

    e = predicted("features") - F.col("target")
    return holdout.agg(F.avg(e * e)).first()[0]


def rate_search(samples: DataFrame, layers: Layers, rates: list[float], steps: int = 20, max_norm: float = 1.0) -> list[tuple[float, float]]:
    """(rate, score) for each candidate: log of the later over the earlier median of the holdout's errors, per unit of rate.
    The most negative is best.

    samples(features, target, part: 'train' or 'holdout') may have any number of rows: one pass a step adds up the gradients
    of all candidates' networks and the errors of the step before. Sums of weights, not rows, reach the driver.
    """
    nets = {i: [(w.copy(), b.copy()) for w, b in layers] for i in range(len(rates))}
    errors: dict[int, list[float]] = {i: [] for i in nets}
    for step in range(steps + 1):
        found: dict[int, dict[int, dict[int, tuple]]] = {}
        for r in network_sums(samples, nets).collect():
            found.setdefault(r["net"], {}).setdefault(r["layer"], {})[r["out_idx"]] = (np.array(r["g"]), r["gb"], r["n"])
        for i, by in found.items():
            if step:
                _, e, m = by[-1][0]
                errors[i].append(e / m)
            means = [(np.array([by[k][o][0] / by[k][o][2] for o in sorted(by[k])]), np.array([by[k][o][1] / by[k][o][2] for o in sorted(by[k])])) for k in range(len(layers))]
            norm = math.sqrt(sum(float((g * g).sum() + (b * b).sum()) for g, b in means))
            f = min(1.0, max_norm / (norm + 1e-12))
            nets[i] = [(w - rates[i] * f * g, b - rates[i] * f * c) for (w, b), (g, c) in zip(nets[i], means, strict=True)]
    h = steps // 2
    return [(rates[i], math.log(np.median(e[h:]) / np.median(e[:h])) / rates[i]) for i, e in errors.items()]
