"""Turning points of a price series and the moves between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.functions.kernels import find_peaks
from driftmark.operators.series import along

SPLITS = (42, 48)
#: Statuses of a present trough (fixed values).
CONFIRMED = "confirmed_trough"
PROVISIONAL = "provisional_recent_low"
NO_LOW = "no_recent_low_after_latest_peak"
LATE_LOW = "provisional_trough_has_fewer_than_five_observations"
SHORT_FALL = "provisional_fall_too_short"
TOO_FEW = "too_few_confirmed_extrema"
#: The status where only confirmed troughs count.
LAST_IS_PEAK = "latest_confirmed_extremum_is_peak"


def segmented(bars: DataFrame, parts: int) -> DataFrame:
    """part: the number of a bar's segment when a series of n bars is cut in `parts`, the first n % parts longer by one."""
    n = F.count("*").over(Window.partitionBy("ticker"))
    size, longer = F.floor(n / parts), n % parts
    head = longer * (size + 1)
    part = F.when(F.col("pos") < head, F.floor(F.try_divide("pos", size + 1))).otherwise(longer + F.floor(F.try_divide(F.col("pos") - head, size)))
    return bars.withColumn("part", part.cast("int"))


def _turns(sign: int, distance: int, share: float):
    @F.pandas_udf("array<int>")
    def find(pos: pd.Series, price: pd.Series) -> pd.Series:
        out = []
        for p, x in zip(pos, price, strict=True):
            x = np.asarray(x, float)
            out.append(np.asarray(p)[find_peaks(sign * x, distance, share * x.mean())].tolist())
        return pd.Series(out, dtype=object)

    return find


def segment_extrema(bars: DataFrame, splits: tuple[int, ...] = SPLITS, distance: int = 5, share: float = 0.05) -> DataFrame:
    """(ticker, split, part, pos, kind): peaks and troughs inside segments, at least `distance` apart and as prominent
    as `share` of the segment's mean. Each segment is one array of n / split points."""
    cut = None
    for s in splits:
        one = segmented(bars.select("ticker", "pos", "price"), s).withColumn("split", F.lit(s))
        cut = one if cut is None else cut.union(one)
    rows = cut.groupBy("ticker", "split", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "price"))).alias("x"))
    rows = rows.select("ticker", "split", "part", F.col("x.pos").alias("p"), F.col("x.price").alias("x"))
    both = [rows.select("ticker", "split", "part", F.explode(_turns(sign, distance, share)("p", "x")).alias("pos"), F.lit(kind).alias("kind")) for sign, kind in ((1, "peak"), (-1, "trough"))]
    return both[0].union(both[1])


def raw_extrema(found: DataFrame) -> DataFrame:
    """Distinct places over both segmentations; a place that any of them calls a trough is one."""
    return found.groupBy("ticker", "pos").agg(F.when(F.bool_or(F.col("kind") == "trough"), "trough").otherwise("peak").alias("kind"))


def spaced(extrema: DataFrame, after: int = 126, gap: int = 5) -> DataFrame:
    """Extrema later than bar `after`; of two that stand closer than `gap` the earlier goes, in one pass."""
    late = extrema.filter(F.col("pos") > after)
    following = F.lead("pos").over(along())
    return late.withColumn("_next", following).filter("_next is null or _next - pos >= " + str(gap)).drop("_next")


def neighbourhood_extrema(bars: DataFrame, reach: int = 5) -> DataFrame:
    """Bars strictly above or below all `reach` neighbours on both sides (fewer at the ends)."""
    w = along()
    before, behind = w.rowsBetween(-reach, -1), w.rowsBetween(1, reach)
    n = F.count("*").over(Window.partitionBy("ticker"))
    p = F.col("price")
    peak = (p > F.max("price").over(before)) & (p > F.max("price").over(behind))
    trough = (p < F.min("price").over(before)) & (p < F.min("price").over(behind))
    out = bars.select("ticker", "pos", F.when(peak, "peak").when(trough, "trough").alias("kind"), n.alias("n"))
    return out.filter("kind is not null and pos > 3 and pos < n - 3").drop("n")


def transitions(extrema: DataFrame, bars: DataFrame, start: int | None = None) -> DataFrame:
    """(ticker, k, before, this, next, gap, target): inner extrema with both neighbours; start: the first bar to take."""
    w = along()
    out = extrema.select("ticker", "kind", F.lag("pos").over(w).alias("before"), F.col("pos").alias("this"), F.lead("pos").over(w).alias("next"), (F.row_number().over(w) - 1).alias("k"))
    out = out.filter("before is not null and next is not null")
    if start is not None:
        out = out.filter(F.col("this") >= start)
    price = lambda at, name: bars.select("ticker", F.col("pos").alias(at), F.col("price").alias(name))
    out = out.join(price("this", "p0"), ["ticker", "this"]).join(price("next", "p1"), ["ticker", "next"])
    target = F.try_divide(100 * (F.col("p1") - F.col("p0")), F.col("p0"))
    return out.select("ticker", "k", "kind", "before", "this", "next", (F.col("next") - F.col("this")).alias("gap"), target.alias("target"))


def mean_spacing(bars: DataFrame, extrema: DataFrame, history: int | None = None) -> DataFrame:
    """Bars per raw extremum; history: count only bars and extrema before that position."""
    upto = (lambda df: df.filter(F.col("pos") < history)) if history else (lambda df: df)
    n = upto(bars).groupBy("ticker").agg(F.count("*").alias("n"))
    m = upto(extrema).groupBy("ticker").agg(F.count("*").alias("m"))
    return n.join(m, "ticker", "left").select("ticker", (F.col("n") / F.greatest(F.coalesce("m", F.lit(0)), F.lit(1))).alias("spacing"))


def active_trough(extrema: DataFrame, bars: DataFrame, least: int = 4, provisional: bool = True) -> DataFrame:
    """Per ticker (trough, before, status): the trough that the present move starts from, or why there is none.
    provisional: a low after the last peak may stand for a trough; else the last extremum must be one."""
    w = Window.partitionBy("ticker").orderBy(F.desc("pos"))
    last = extrema.select("ticker", "pos", "kind", F.lead("pos").over(w).alias("before"), F.row_number().over(w).alias("r")).filter("r = 1").drop("r")
    after = bars.select("ticker", F.col("pos").alias("at"), "price").join(last.withColumnRenamed("pos", "pos"), "ticker").filter("at > pos")
    low = after.groupBy("ticker").agg(F.count("*").alias("bars_after"), F.min_by("at", F.struct("price", "at")).alias("low"), F.max("at").alias("end"))
    found = last.join(low, "ticker", "left")
    behind, fall = F.col("end") - F.col("low"), F.col("low") - F.col("pos")
    status: Column = (
        F.when((F.col("kind") == "trough") & F.col("before").isNull(), TOO_FEW)
        .when(F.col("kind") == "trough", CONFIRMED)
        .when(F.lit(not provisional), LAST_IS_PEAK)
        .when(F.coalesce("bars_after", F.lit(0)) < least + 1, NO_LOW)
        .when(behind < least, LATE_LOW)
        .when(fall < least, SHORT_FALL)
        .otherwise(PROVISIONAL)
    )
    out = found.withColumn("status", status)
    peak = F.col("status") == PROVISIONAL
    sure = F.col("status") == CONFIRMED
    return out.select("ticker", F.when(sure, F.col("pos")).when(peak, F.col("low")).alias("trough"), F.when(sure, F.col("before")).when(peak, F.col("pos")).alias("before"), "status")
