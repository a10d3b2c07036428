"""Local prediction intervals from the residuals of similar past cases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions.kernels import weighted_quantile
from driftmark.operators.clean import finite
from driftmark.operators.neighbours import nearest_cases
from driftmark.operators.stats import value_ranks

DESCRIPTORS = 12
QUANTILES = (0.1, 0.5, 0.9)


def _array_moments(x: Column) -> tuple[Column, Column]:
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    square = F.aggregate(F.transform(x, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v) / n
    return mean, F.sqrt(square)


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def descriptors(features: str = "features", point: str = "point") -> Column:
    """Twelve numbers of a sample and its prediction that neighbours are sought by."""
    f = lambda i: F.get(F.col(features), F.lit(i))
    length = lambda i: F.log1p(F.greatest(f(i), F.lit(0.0)))
    mean, deviation = _array_moments(F.slice(features, 18, 63))
    volume = [F.log1p(F.abs(f(i))) for i in (10, 11, 12, 13)]
    return F.array(length(14), f(0), f(9) / 100, length(15), length(16), deviation, mean, *volume, signed_log(F.col(point)))


#: Names of the classes of duration, beta and RSI, and their bounds (fixed values).
DURATIONS = ((7, "very_short_4_7"), (14, "short_8_14"), (28, "medium_15_28"), (None, "long_29_plus"))
BETAS = ("low_beta", "market_beta", "high_beta")
STRENGTHS = ("oversold", "neutral", "overbought")


def duration_class(d: Column) -> Column:
    (a, first), (b, second), (c, third), (_, last) = DURATIONS
    return F.when(d <= a, first).when(d <= b, second).when(d <= c, third).otherwise(last)


def beta_class(b: Column) -> Column:
    low, middle, high = BETAS
    return F.when(b < 0.75, low).when(b <= 1.25, middle).otherwise(high)


def rsi_class(r: Column) -> Column:
    low, middle, high = STRENGTHS
    return F.when(r < 30, low).when(r <= 70, middle).otherwise(high)


def calibration_set(old: DataFrame, new: DataFrame, new_weight: float = 2.0) -> DataFrame:
    """Cases of both sets with actual > 0 and finite numbers: residual, source weight, descriptor, group."""
    both = old.withColumn("weight", F.lit(1.0)).unionByName(new.withColumn("weight", F.lit(new_weight)))
    good = both.filter((F.col("actual") > 0) & finite(F.col("actual")) & finite(F.col("point")))
    duration = F.get("features", F.lit(14))
    out = good.withColumns({"residual": F.col("actual") - F.col("point"), "descriptor": descriptors(), "group": duration_class(duration), "duration": duration})
    return out.filter(F.forall("descriptor", finite))


def robust_scales(cases: DataFrame) -> DataFrame:
    """One row: medians and interquartile ranges (1 where 0) of every descriptor, exact.

    Values are ranked per descriptor by range partitions (stats.value_ranks), since an exact percentile without a key
    would hold all values in one task; a quantile lies between the two values about its rank.
    """
    long = cases.select(F.posexplode("descriptor").alias("i", "x"))
    n = long.groupBy("i").agg(F.count("*").alias("n"))
    upto = value_ranks(long, "x", "i").join(F.broadcast(n), "i")  # a row per descriptor
    at = {q: q * (F.col("n") - 1) for q in (0.25, 0.5, 0.75)}
    # A value stands at the ranks from `before` to `upto` - 1.
    on = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("upto")), F.col("x")))
    low, high = ({q: on(f(p)) for q, p in at.items()} for f in (F.floor, F.ceil))
    part = lambda q: F.first(at[q] - F.floor(at[q]))
    value = lambda q: low[q] + (high[q] - low[q]) * part(q)
    row = upto.groupBy("i").agg(value(0.5).alias("m"), (value(0.75) - value(0.25)).alias("s"))
    row = row.agg(F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s")))).alias("x"))
    return row.select(F.col("x.m").alias("medians"), F.col("x.s").alias("spreads"))


def scaled(cases: DataFrame, scales: DataFrame, clip: float = 8.0) -> DataFrame:
    both = cases.crossJoin(F.broadcast(scales))  # one row
    z = lambda t: F.least(F.greatest((t["x"] - t["m"]) / t["s"], F.lit(-clip)), F.lit(clip))
    zipped = F.arrays_zip(F.col("descriptor").alias("x"), F.col("medians").alias("m"), F.col("spreads").alias("s"))
    return both.withColumn("descriptor", F.transform(zipped, z)).drop("medians", "spreads")


_INTERVALS = "query long, q10 double, q50 double, q90 double, lower_coverage double, upper_coverage double, nearest double, neighbours int"


def intervals(found: DataFrame, queries: DataFrame, least: int = 14) -> DataFrame:
    """Per query: weighted residual quantiles, widened for short observations, the neighbours' coverage, nearest distance.

    queries(query, duration, point). A neighbour weighs its source weight over 0.25 + distance.
    """
    lists = found.groupBy("query").agg(F.collect_list(F.struct("distance", "residual", "weight")).alias("x"))  # k rows at most
    factor = F.when(F.col("duration") < least, F.sqrt(least / F.greatest("duration", F.lit(5.0)))).otherwise(1.0)
    rows = lists.join(queries.select("query", factor.alias("factor")), "query").select("query", "factor", "x.distance", "x.residual", "x.weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q, factor, d, r, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d, r = np.array(d), np.array(r)
                w = np.array(w) / (0.25 + d)
                low, mid, high = weighted_quantile(r, w, QUANTILES)
                low, high = mid + (low - mid) * factor, mid + (high - mid) * factor
                total = w.sum()
                out.append((q, low, mid, high, (w * (r >= low)).sum() / total, (w * (r <= high)).sum() / total, d.min(), len(d)))
            names = [x.split()[0] for x in _INTERVALS.split(", ")]
            kinds = [pa.int64(), *[pa.float64()] * 6, pa.int32()]
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    bands = rows.mapInArrow(run, _INTERVALS)
    point = F.col("point")
    return bands.join(queries.select("query", "point"), "query").withColumns({"lower": point + F.col("q10"), "expected": point + F.col("q50"), "upper": point + F.col("q90")})


def coverage_audit(old: DataFrame, new: DataFrame, k: int = 800) -> DataFrame:
    """Calibrate on old cases alone, bound every new case with actual > 0, report how many lie within."""
    cases = calibration_set(old, old.limit(0)).withColumn("case", F.col("id"))
    scales = robust_scales(cases)
    tests = scaled(calibration_set(new, new.limit(0)), scales).withColumn("query", F.col("id"))
    found = nearest_cases(tests, scaled(cases, scales), k)
    both = intervals(found, tests).join(tests.select("query", "actual"), "query")
    above, below = (F.col("actual") >= F.col("lower")), (F.col("actual") <= F.col("upper"))
    share = lambda c: F.avg(c.cast("double"))
    return both.agg(F.count("*").alias("test_samples"), share(above).alias("lower_coverage"), share(below).alias("upper_coverage"), share(above & below).alias("central_coverage"))
