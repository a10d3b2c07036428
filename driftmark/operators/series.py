"""Returns, down-sampling and smoothing: windows over (ticker, pos), one sort for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from driftmark.functions.kernels import savgol_matrix


def along(key: str = "ticker", order: str = "pos") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def change(col: str, w: WindowSpec) -> Column:
    """Percent change on the previous value."""
    before = F.lag(col).over(w)
    return F.try_divide(100 * (F.col(col) - before), before)


def rate(col: str, w: WindowSpec) -> Column:
    """Percent change with the present value as denominator."""
    return F.try_divide(100 * (F.col(col) - F.lag(col).over(w)), F.col(col))


def block_means(bars: DataFrame, width: int, *cols: str) -> DataFrame:
    """Means of whole blocks of `width` bars, numbered by j; an incomplete last block goes."""
    out = bars.groupBy("ticker", F.floor(F.col("pos") / width).alias("j")).agg(F.count("*").alias("c"), *(F.avg(c).alias(c) for c in cols))
    return out.filter(F.col("c") == width).drop("c")


def moving_average(col: str, width: int, w: WindowSpec) -> Column:
    """Mean of `width` rows up to this one; null before there are so many."""
    frame = w.rowsBetween(1 - width, 0)
    return F.when(F.count(col).over(frame) == width, F.avg(col).over(frame))


def smoothed(df: DataFrame, cols: list[str], window: int, order: int, key: str = "ticker", by: str = "pos", first: int = 0) -> DataFrame:
    """df with Savitzky-Golay smoothed columns in place; null in series shorter than the window or where a value is missing.

    Rows inside are a sum of neighbours times constants. Those within half a window of an end take the first or last
    full window, which is gathered once per series, with the weights of their place in it; all over one sort. by must
    count the rows of a series from `first`.
    """
    h, table = window // 2, savgol_matrix(window, order).tolist()
    w = Window.partitionBy(key).orderBy(by)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pos, n = F.col(by) - first, F.col("_n")
    rows = df.withColumn("_n", F.count("*").over(every))
    new = {}
    for c in cols:
        middle = F.lit(0.0)
        for k, weight in enumerate(table[h]):
            middle = middle + (F.lag(c, h - k) if k < h else F.lead(c, k - h)).over(w) * weight
        new[f"_mid_{c}"] = middle
        new[f"_head_{c}"] = F.collect_list(F.when(pos < window, F.col(c))).over(every)
        new[f"_tail_{c}"] = F.collect_list(F.when(pos >= n - window, F.col(c))).over(every)
    rows = rows.withColumns(new)
    weights = F.array(*(F.array(*map(F.lit, x)) for x in table))
    fit = lambda x, i: F.aggregate(F.zip_with(x, F.element_at(weights, (i + 1).cast("int")), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    full = lambda c: (n >= window) & (F.size(f"_head_{c}") == window) & (F.size(f"_tail_{c}") == window)
    value = lambda c: F.when(pos < h, fit(F.col(f"_head_{c}"), pos)).when(pos >= n - h, fit(F.col(f"_tail_{c}"), pos - n + window)).otherwise(F.col(f"_mid_{c}"))
    return rows.withColumns({c: F.when(full(c), value(c)) for c in cols}).drop("_n", *new)


def trailing_vectors(pairs: DataFrame, size: int = 63) -> DataFrame:
    """(ticker, j, returns, rates): the last `size` pair returns and volume rates up to pair j, where all exist."""
    frame = along(order="j").rowsBetween(1 - size, 0)
    out = pairs.select("ticker", "j", F.collect_list("ret").over(frame).alias("returns"), F.collect_list("vrate").over(frame).alias("rates"))
    return out.filter((F.size("returns") == size) & (F.size("rates") == size))


def smoothing(bars: DataFrame) -> DataFrame:
    """Prices and volumes as the trailing vectors take them."""
    return smoothed(bars, ["price", "volume"], 21, 3)


def pair_series(bars: DataFrame, smooth: bool = True, width: int = 2) -> DataFrame:
    """(ticker, j, price, volume, ret, vrate) of block means of the smoothed or plain series."""
    if smooth:
        bars = smoothing(bars.select("ticker", "pos", "price", "volume")).dropna()
    pairs = block_means(bars, width, "price", "volume")
    w = along(order="j")
    return pairs.withColumns({"ret": change("price", w), "vrate": change("volume", w)})
