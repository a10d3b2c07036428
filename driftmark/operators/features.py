"""The 191-value samples: what is known of a move at each bar after its turning point.

Everything that belongs to a bar (beta, RSI, mean volume, trailing vectors) is computed once per bar by windows and
joined to the samples by (ticker, position); the legs between extrema are arrays made once per move. Samples stay
narrow until the vector is put together last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.functions import kernels
from driftmark.operators.clean import finite
from driftmark.operators.extrema import TOO_FEW
from driftmark.operators.macro import month_index
from driftmark.operators.series import along

#: Places in the vector: 17 pattern values, 63 returns, 63 volume rates, 48 macro values.
WIDTH = 191
#: Reasons for which a ticker has no current row, beside the trough's statuses (fixed values).
SHORT_HISTORY = "less_than_three_years_history"
NEW_TROUGH = "trough_has_fewer_than_five_observations"
BROKEN_TROUGH = "current_price_has_broken_below_confirmed_trough"
NO_BENCHMARK = "benchmark_alignment_failed"
NO_RETURNS = "insufficient_smoothed_return_history"
NO_MACRO = "macro_window_unavailable"
NOT_FINITE = "nonfinite_feature"


def durations(moves: DataFrame, inclusive: bool = False, least: int = 4) -> DataFrame:
    """One row per bar of a move from `least` bars on; inclusive: also the bar that ends it, as in training panels."""
    last = F.col("gap") if inclusive else F.col("gap") - 1
    return moves.filter(last >= least).withColumn("duration", F.explode(F.sequence(F.lit(least), last))).withColumn("end", F.col("this") + F.col("duration"))


def sample_meta(moves: DataFrame, bars: DataFrame, inclusive: bool = False) -> DataFrame:
    """(ticker, extremum_date, end_date, next_date, duration, fall_duration, target) of every sample."""
    on = lambda at, name: bars.select("ticker", F.col("pos").alias(at), F.col("date").alias(name))
    dated = moves.join(on("this", "extremum_date"), ["ticker", "this"]).join(on("next", "next_date"), ["ticker", "next"])
    rows = durations(dated, inclusive).join(on("end", "end_date"), ["ticker", "end"])
    return rows.select("ticker", "extremum_date", "end_date", "next_date", "duration", (F.col("this") - F.col("before")).alias("fall_duration"), "target")


def beta(bars: DataFrame, length: int = 126) -> DataFrame:
    """(ticker, pos, beta) of price on bench over `length` bars; null before there are so many or where bench is flat."""
    w = along()
    simple = lambda c: F.try_divide(F.col(c) - F.lag(c).over(w), F.lag(c).over(w))
    r = bars.select("ticker", "pos", simple("price").alias("x"), simple("bench").alias("y"))
    return r.select("ticker", "pos", _beta(w, length))


def _beta(w: WindowSpec, length: int) -> Column:
    """Of returns x on y."""
    frame = w.rowsBetween(2 - length, 0)
    both = F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).over(frame) == length - 1
    value = F.try_divide(F.covar_samp("x", "y").over(frame), F.var_samp("y").over(frame))
    return F.when(both, value).alias("beta")


def rsi(bars: DataFrame, prices: int = 14) -> DataFrame:
    """(ticker, pos, rsi) from the deltas between `prices` bars; 100 where nothing was lost."""
    w = along()
    d = bars.select("ticker", "pos", (F.col("price") - F.lag("price").over(w)).alias("d"))
    return d.select("ticker", "pos", _rsi(w, prices))


def _rsi(w: WindowSpec, prices: int) -> Column:
    """Of price deltas d."""
    frame = w.rowsBetween(2 - prices, 0)
    gain, loss = F.sum(F.greatest("d", F.lit(0.0))).over(frame), F.sum(F.greatest(-F.col("d"), F.lit(0.0))).over(frame)
    value = F.when(loss == 0, 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(gain, loss)))
    return F.when(F.count("d").over(frame) == prices - 1, value).alias("rsi")


def mean_volume(bars: DataFrame, length: int = 126) -> DataFrame:
    return bars.select("ticker", "pos", _mean_volume(along(), length))


def _mean_volume(w: WindowSpec, length: int) -> Column:
    frame = w.rowsBetween(1 - length, 0)
    return F.when(F.count("volume").over(frame) == length, F.avg("volume").over(frame)).alias("mean_volume")


def day_features(bars: DataFrame, length: int = 126, prices: int = 14) -> DataFrame:
    """(ticker, pos, date, beta, rsi, mean_volume): all windows over one sort of the bars."""
    w = along()
    simple = lambda c: F.try_divide(F.col(c) - F.lag(c).over(w), F.lag(c).over(w))
    steps = bars.select("ticker", "pos", "date", "volume", simple("price").alias("x"), simple("bench").alias("y"), (F.col("price") - F.lag("price").over(w)).alias("d"))
    return steps.select("ticker", "pos", "date", _beta(w, length), _rsi(w, prices), _mean_volume(w, length))


def legs(bars: DataFrame, extrema: DataFrame) -> DataFrame:
    """(ticker, leg, prices, volumes): from each extremum to the next, both included; the last runs to the end."""
    w = along()
    flag = extrema.select("ticker", "pos", F.lit(1).alias("x"))
    marked = bars.select("ticker", "pos", "price", "volume").join(flag, ["ticker", "pos"], "left")
    numbered = marked.withColumn("leg", F.sum(F.coalesce("x", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).filter("leg >= 0")
    starts = numbered.filter("x = 1").select("ticker", (F.col("leg") - 1).alias("leg"), "pos", "price", "volume").filter("leg >= 0")
    points = numbered.select("ticker", "leg", "pos", "price", "volume").union(starts.select("ticker", "leg", "pos", "price", "volume"))
    rows = points.groupBy("ticker", "leg").agg(F.array_sort(F.collect_list(F.struct("pos", "price", "volume"))).alias("x"))
    return rows.select("ticker", "leg", F.col("x.price").alias("prices"), F.col("x.volume").alias("volumes"))


def quarter_slopes(prices: Column, steps: Column) -> list[Column]:
    """Mean change in each quarter of a leg of `steps` deltas, over its first price, in percent, per bar of the leg.
    The first steps % 4 quarters are longer by one. Differences telescope, so each needs two prices only."""
    size, longer = F.floor(steps / 4).cast("int"), (steps % 4).cast("int")
    edge = [F.lit(i) * size + F.least(F.lit(i), longer) for i in range(5)]
    at = lambda i: F.get(prices, i)
    first = at(F.lit(0))
    return [F.try_divide(100 * (at(edge[i + 1]) - at(edge[i])), first * (edge[i + 1] - edge[i]) * steps) for i in range(4)]


def _bend(longer: bool):
    @F.pandas_udf(T.DoubleType())  # a type object: names need a session
    def value(legs: pd.Series) -> pd.Series:
        return pd.Series(kernels.peakiness_all(legs.tolist(), longer), dtype="float64")

    return value


#: What a leg is at each of its durations, beside the duration itself.
PATH = ("rise_bend", "rise_max", "r0", "r1", "r2", "r3")


def paths(moves: DataFrame, prices: str, volumes: str, inclusive: bool = False, least: int = 4) -> DataFrame:
    """One row per move and duration from `least` to gap - 1 (inclusive: to gap): the move's columns but its arrays,
    duration, end and PATH, the bend and maximum of the volumes and the quarter slopes of the prices so far.

    moves holds `this` and the leg from it to the next extremum as arrays of gap + 1 values. All durations of a leg come out
    of one kernel, so that no row carries a piece of the leg.
    """
    keep = [f for f in moves.schema.fields if f.name not in (prices, volumes)]
    schema = T.StructType([*keep, T.StructField("duration", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in PATH)])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0) for x in batch.column(c)] for c in (prices, volumes)]
            found = kernels.leg_path(*lists, least)
            if not inclusive:
                found = [x[:, :-1] for x in found]
            count = np.array([x.shape[1] for x in found], np.int64)
            rows = batch.select(names).take(pa.array(np.repeat(np.arange(len(count)), count)))
            duration = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + least
            every = np.concatenate([np.zeros((len(PATH), 0)), *found], axis=1)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(duration.astype(np.int32)), *map(pa.array, every)], names=[*names, "duration", *PATH])

    return moves.mapInArrow(run, schema).withColumn("end", F.col("this") + F.col("duration"))


rise_peakiness = _bend(False)
fall_peakiness = _bend(True)


def samples(moves: DataFrame, bars: DataFrame, extrema: DataFrame, spacing: DataFrame, vectors: DataFrame, macro: DataFrame, base_year: int, inclusive: bool = False, later_fall: bool = False, rough: bool = False) -> DataFrame:
    """(ticker, dates, duration, features, target): complete, finite vectors only. later_fall: the narrower window
    for falling legs of the later version; the month that counts is the one before the extremum's, rough: before the
    last bar's."""
    day = day_features(bars)
    leg = legs(bars, extrema)
    fall = leg.select("ticker", (F.col("leg") + 1).alias("k"), F.col("prices").alias("fp"), F.col("volumes").alias("fv"))
    rise = leg.select("ticker", F.col("leg").alias("k"), F.col("prices").alias("rp"), F.col("volumes").alias("rv"))
    bend = (rise_peakiness if later_fall else fall_peakiness)("fv")
    per_move = moves.join(fall, ["ticker", "k"]).withColumns({"fall_bend": bend, "fall_max": F.array_max("fv"), "fall": F.col("this") - F.col("before")})
    per_move = per_move.withColumns({f"f{i}": c for i, c in enumerate(quarter_slopes(F.col("fp"), F.col("fall")))}).drop("fp", "fv")
    dates = bars.select("ticker", F.col("pos").alias("this"), F.col("date").alias("extremum_date"))
    ends = bars.select("ticker", F.col("pos").alias("next"), F.col("date").alias("next_date"))
    per_move = per_move.join(dates, ["ticker", "this"]).join(ends, ["ticker", "next"]).join(spacing, "ticker").join(rise, ["ticker", "k"])
    # Long gaps make many rows: moves are spread before their durations come out.
    rows = paths(per_move.repartition("ticker", "k"), "rp", "rv", inclusive)
    rows = rows.join(day.select("ticker", F.col("pos").alias("end"), F.col("date").alias("end_date"), "beta", "rsi", "mean_volume"), ["ticker", "end"])
    rows = rows.withColumn("j", F.floor(F.col("end") / 2) - 2).join(vectors, ["ticker", "j"])
    rows = rows.withColumn("idx", month_index(F.col("end_date" if rough else "extremum_date"), base_year) - 1).join(F.broadcast(macro), "idx")
    over = lambda c: F.try_divide(c, "mean_volume")
    pattern = [
        F.col("beta"), *(F.col(f"r{i}") for i in range(4)), *(F.col(f"f{i}") for i in range(4)), F.col("rsi"), over("fall_max"), over("fall_bend"),
        over("rise_bend"), over("rise_max"), F.col("duration").cast("double"), F.col("fall").cast("double"), F.col("spacing"),
    ]
    vector = F.concat(F.array(*pattern), "returns", "rates", "macro")
    out = rows.select("ticker", "extremum_date", "end_date", "next_date", "duration", vector.alias("features"), "target")
    return out.filter((F.size("features") == WIDTH) & F.forall("features", finite))


def current_rows(bars: DataFrame, extrema: DataFrame, trough: DataFrame, spacing: DataFrame, vectors: DataFrame, macro: DataFrame, base_year: int, least_bars: int = 756) -> DataFrame:
    """One row per ticker at its last bar: the vector, or the first reason for which there is none."""
    w = Window.partitionBy("ticker")
    last = bars.withColumns({"end": F.max("pos").over(w), "history": F.count("*").over(w)}).filter("pos = end").select("ticker", "end", "history", F.col("date").alias("data_date"), F.col("price").alias("current_price"))
    count = extrema.groupBy("ticker").agg(F.count("*").alias("extrema"))
    rows = last.join(count, "ticker", "left").join(trough, "ticker", "left").join(spacing, "ticker", "left")
    price = bars.select("ticker", F.col("pos").alias("trough"), F.col("price").alias("trough_price"), F.col("date").alias("trough_date"))
    rows = rows.join(price, ["ticker", "trough"], "left").withColumns({"duration": F.col("end") - F.col("trough"), "fall": F.col("trough") - F.col("before")})
    span = bars.select("ticker", "pos", "price", "volume").join(rows.select("ticker", "before", "trough"), "ticker").filter("pos >= before")
    x = F.struct("pos", "price", "volume")
    leg = span.groupBy("ticker").agg(F.array_sort(F.collect_list(F.when(F.col("pos") <= F.col("trough"), x))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("pos") >= F.col("trough"), x))).alias("b"))
    rows = rows.join(leg, "ticker", "left").withColumns({"fall_bend": rise_peakiness("a.volume"), "rise_bend": rise_peakiness("b.volume"), "fall_max": F.array_max("a.volume"), "rise_max": F.array_max("b.volume")})
    rows = rows.withColumns({f"f{i}": c for i, c in enumerate(quarter_slopes(F.col("a.price"), F.col("fall")))} | {f"r{i}": c for i, c in enumerate(quarter_slopes(F.col("b.price"), F.col("duration")))}).drop("a", "b")
    rows = rows.join(day_features(bars).select("ticker", F.col("pos").alias("end"), "beta", "rsi", "mean_volume"), ["ticker", "end"], "left")
    rows = rows.withColumn("j", F.floor(F.col("end") / 2) - 2).join(vectors, ["ticker", "j"], "left")
    rows = rows.withColumn("idx", month_index(F.col("trough_date"), base_year) - 1).join(F.broadcast(macro), "idx", "left")
    over = lambda c: F.try_divide(c, "mean_volume")
    pattern = [
        F.col("beta"), *(F.col(f"r{i}") for i in range(4)), *(F.col(f"f{i}") for i in range(4)), F.col("rsi"), over("fall_max"), over("fall_bend"),
        over("rise_bend"), over("rise_max"), F.col("duration").cast("double"), F.col("fall").cast("double"), F.col("spacing"),
    ]
    vector = F.concat(F.array(*pattern), "returns", "rates", "macro")
    reason = (
        F.when(F.col("history") < least_bars, SHORT_HISTORY)
        .when(F.coalesce("extrema", F.lit(0)) < 2, TOO_FEW)
        .when(F.col("trough").isNull(), F.coalesce("status", F.lit(TOO_FEW)))
        .when(F.col("duration") < 4, NEW_TROUGH)
        .when(F.col("current_price") < F.col("trough_price"), BROKEN_TROUGH)
        .when(F.col("beta").isNull(), NO_BENCHMARK)
        .when(F.col("returns").isNull(), NO_RETURNS)
        .when(F.col("macro").isNull(), NO_MACRO)
        .when(~F.coalesce((F.size(vector) == WIDTH) & F.forall(vector, finite), F.lit(False)), NOT_FINITE)
    )
    gain = F.try_divide(100 * (F.col("current_price") - F.col("trough_price")), F.col("trough_price"))
    return rows.select(
        "ticker", "data_date", "trough_date", F.col("status").alias("trough_status"), "duration", "beta", "rsi", "current_price", "trough_price",
        gain.alias("current_gain"), F.col("history").alias("history_days"), reason.alias("reason"), F.when(reason.isNull(), vector).alias("features"),
    )
