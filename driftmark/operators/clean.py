"""Cleaning and aligning daily bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def typical_price(bars: DataFrame) -> DataFrame:
    """price: mean of open, high, low and close; null where one is null."""
    return bars.withColumn("price", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)


def good_bars(bars: DataFrame) -> DataFrame:
    return bars.withColumn("date", F.to_date("date")).filter("price is not null and volume is not null and volume > 0")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def usable_tickers(bars: DataFrame) -> DataFrame:
    """Tickers all of whose prices and volumes are finite numbers."""
    ok = F.bool_and(finite(F.col("price")) & finite(F.col("volume")))
    return bars.groupBy("ticker").agg(ok.alias("ok")).filter("ok").select("ticker")


def numbered(bars: DataFrame) -> DataFrame:
    """pos counts a ticker's bars from 0 in the order of their dates."""
    return bars.withColumn("pos", F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1)


def missing_bars(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per ticker, the calendar's days without price or without volume. Days are counted, not paired with tickers."""
    on = bars.join(calendar.select("date").distinct(), "date", "left_semi")
    days = calendar.select("date").distinct().agg(F.count("*").alias("days"))
    have = on.groupBy("ticker").agg(F.count("price").alias("p"), F.count("volume").alias("v"))
    every = bars.select("ticker").distinct().join(have, "ticker", "left").crossJoin(F.broadcast(days))  # days is one row
    return every.select("ticker", (F.col("days") - F.coalesce("p", F.lit(0))).alias("missing_price"), (F.col("days") - F.coalesce("v", F.lit(0))).alias("missing_volume"))


def align_benchmark(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """bench: the benchmark's price on the same date; gaps take the ticker's previous matched date, then the next."""
    w = Window.partitionBy("ticker").orderBy("date")
    joined = bars.join(benchmark.select("date", F.col("price").alias("b")), "date", "left")
    back = F.last("b", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("b", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return joined.withColumn("bench", F.coalesce(back, ahead)).drop("b")


def append_bars(history: DataFrame, new: DataFrame) -> DataFrame:
    """History and later bars under one numbering; a date in both keeps the history's bar."""
    fresh = new.join(history.select("ticker", "date"), ["ticker", "date"], "left_anti")
    return numbered(history.unionByName(fresh))


def last_bars(numbered_bars: DataFrame) -> DataFrame:
    """(ticker, last_pos, last_date): all that appending needs to know of a history."""
    return numbered_bars.groupBy("ticker").agg(F.max("pos").alias("last_pos"), F.max("date").alias("last_date"))


def later_bars(heads: DataFrame, new: DataFrame) -> DataFrame:
    """The bars of new behind each ticker's last one, numbered on from it; tickers without a history start at 0. heads is
    last_bars of the history, which itself is not read. Bars up to the last date are the history's and left out."""
    fresh = new.join(heads, "ticker", "left").filter("last_date is null or date > last_date")
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    return fresh.withColumn("pos", F.coalesce("last_pos", F.lit(-1)) + rank).drop("last_pos", "last_date")


def moved_heads(heads: DataFrame, appended: DataFrame) -> DataFrame:
    """last_bars after later_bars were appended."""
    both = heads.unionByName(last_bars(appended))
    return both.groupBy("ticker").agg(F.max("last_pos").alias("last_pos"), F.max("last_date").alias("last_date"))


def short_histories(bars: DataFrame, length: int) -> DataFrame:
    return bars.groupBy("ticker").agg(F.count("*").alias("rows")).filter(F.col("rows") != length)


def freshness(bars: DataFrame, benchmark: DataFrame, least_rows: int = 756, most_lag: int | None = None) -> DataFrame:
    """Status of each ticker. most_lag None: the last date must be the benchmark's; else days it may lag."""
    latest = benchmark.agg(F.max("date").alias("latest"))
    per = bars.groupBy("ticker").agg(F.max("date").alias("last_date"), F.count("*").alias("rows")).crossJoin(F.broadcast(latest))
    lag = F.datediff("latest", "last_date")
    fresh = F.col("last_date") >= F.col("latest") if most_lag is None else lag <= most_lag
    status = F.when(F.col("rows") < least_rows, "insufficient history").when(~fresh, "stale").otherwise("eligible")
    return per.select("ticker", "rows", lag.alias("lag_days"), status.alias("status"))


def contract_violations(bars: DataFrame, benchmark: DataFrame, moments: DataFrame, macro: DataFrame, width: int) -> DataFrame:
    """(check, violations): the input contracts, each a count that should be 0."""
    checks = [
        ("benchmark covers calendar", bars.select("date").distinct().join(benchmark.select("date"), "date", "left_anti")),
        ("mean and deviation are finite, deviation above 0", moments.filter(~finite(F.col("mean")) | ~finite(F.col("std")) | (F.col("std") <= 0))),
        ("macro is finite", macro.filter(~finite(F.col("value")))),
    ]
    out = None
    for name, bad in checks:
        one = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.union(one)
    count = moments.agg(F.abs(F.count("*") - width).alias("violations")).select(F.lit("moments are complete").alias("check"), "violations")
    return out.union(count)
