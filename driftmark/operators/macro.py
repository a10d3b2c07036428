"""Monthly economic series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmark.operators.clean import finite
from driftmark.operators.series import rate, smoothed


def month_calendar(spark: SparkSession, first: str, last: str, months: int = 1) -> DataFrame:
    """(series' calendar) month and its index, a row each `months` months."""
    one = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}', interval {months} month)")).alias("month"))
    return one.withColumn("idx", month_index(F.col("month"), int(first[:4])))


def month_index(date: Column, base_year: int) -> Column:
    return (F.year(date) - base_year) * 12 + F.month(date) - 1


def _per_series() -> Window:
    return Window.partitionBy("series_id").orderBy("month")


def reindexed(series: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each series on every month of the calendar, gaps filled with the last value before; the calendar is a few
    hundred months, so pairing it with the series' names is bounded."""
    grid = series.select("series_id").distinct().crossJoin(F.broadcast(calendar.select("month")))
    joined = grid.join(series, ["series_id", "month"], "left")
    filled = F.last("value", True).over(_per_series().rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("series_id", "month", filled.alias("value"))


def yearly_change(series: DataFrame) -> DataFrame:
    """Percent change on twelve months before, by date and not by row, without filling."""
    old = series.select("series_id", F.add_months("month", 12).alias("month"), F.col("value").alias("old"))
    out = series.join(old, ["series_id", "month"], "left")
    return out.select("series_id", "month", F.try_divide(100 * (F.col("value") - F.col("old")), F.col("old")).alias("value"))


def extended(original: DataFrame, live: DataFrame, calendar: DataFrame, cut: int = 252) -> DataFrame:
    """The first `cut` months of the original, the live values after, then filled forward."""
    a = original.select("series_id", "month", F.col("value").alias("a"))
    b = live.select("series_id", "month", F.col("value").alias("b"))
    grid = original.select("series_id").distinct().crossJoin(F.broadcast(calendar.select("month", "idx")))
    both = grid.join(a, ["series_id", "month"], "left").join(b, ["series_id", "month"], "left")
    picked = both.withColumn("value", F.when(F.col("idx") < cut, F.col("a")).otherwise(F.col("b")))
    filled = F.last("value", True).over(_per_series().rowsBetween(Window.unboundedPreceding, 0))
    return picked.select("series_id", "month", filled.alias("value"))


def real_rate(inflation: DataFrame, interest: DataFrame) -> DataFrame:
    """(month, real, interest again): real rate = inflation - interest, and interest recovered from both."""
    both = inflation.select("month", F.col("value").alias("inflation")).join(interest.select("month", F.col("value").alias("interest")), "month")
    real = both.withColumn("real", F.col("inflation") - F.col("interest"))
    return real.select("month", "real", (F.col("inflation") - F.col("real")).alias("recovered"))


def updated(base: DataFrame, live: DataFrame) -> DataFrame:
    """Live values over the base's on the dates that the base has; other dates are not added."""
    new = live.select("series_id", "month", F.col("value").alias("new"))
    return base.join(new, ["series_id", "month"], "left").select("series_id", "month", F.coalesce("new", "value").alias("value"))


def rate_feature(series: DataFrame, first: float, repeat: int = 1, months: int | None = None, window: int = 15, order: int = 1) -> DataFrame:
    """(series_id, idx, value): current-denominator rates with a fixed first value, each repeated (quarters to months),
    cut to `months`, smoothed."""
    w = _per_series()
    rates = series.select("series_id", "month", F.coalesce(rate("value", w), F.lit(first)).alias("value"), (F.row_number().over(w) - 1).alias("q"))
    spread = rates.select("series_id", "value", F.explode(F.sequence(F.col("q") * repeat, F.col("q") * repeat + repeat - 1)).alias("idx"))
    if months is not None:
        spread = spread.filter(F.col("idx") < months)
    return smoothed(spread, ["value"], window, order, "series_id", "idx").select("series_id", "idx", "value")


def monthly_mean(daily: DataFrame, window: int = 15, order: int = 2) -> DataFrame:
    """(month, idx, value): calendar-month means of a daily index, smoothed."""
    means = daily.groupBy(F.to_date(F.trunc("date", "month")).alias("month")).agg(F.avg("price").alias("value"))
    means = means.select(F.lit("index").alias("series_id"), "month", "value").withColumn("idx", F.row_number().over(_per_series()) - 1)
    return smoothed(means, ["value"], window, order, "series_id", "idx").select("month", "idx", "value")


def assembled(series: DataFrame, calendar: DataFrame, names: list[str]) -> DataFrame:
    """(idx, values): one array per month with every named series; only complete, finite months."""
    rows = series.join(F.broadcast(calendar.select("month", "idx")), "month").filter(finite(F.col("value")))
    wide = rows.groupBy("idx").pivot("series_id", names).agg(F.first("value"))
    return wide.dropna().select("idx", F.array(*(F.col(f"`{n}`") for n in names)).alias("values"))


def macro_windows(months: DataFrame, length: int = 6) -> DataFrame:
    """(idx, macro): the values of `length` months up to idx, each followed by its index."""
    w = Window.orderBy("idx").rowsBetween(1 - length, 0)  # a few hundred months
    rows = months.select("idx", F.concat("values", F.array(F.col("idx").cast("double"))).alias("v"))
    out = rows.select("idx", F.collect_list("v").over(w).alias("v"), F.min("idx").over(w).alias("first"))
    return out.filter(F.col("first") == F.col("idx") - length + 1).select("idx", F.flatten("v").alias("macro"))


def month_starts(bars: DataFrame, base_year: int) -> DataFrame:
    """(idx, start, stop): the calendar months of a numbered trading calendar, by position; the last one has no stop."""
    m = bars.groupBy(month_index(F.col("date"), base_year).alias("idx")).agg(F.min("pos").alias("start"))
    return m.select("idx", "start", F.lead("start").over(Window.orderBy("idx")).alias("stop"))  # a row per month


def month_of_position(positions: DataFrame, starts: DataFrame, width: int = 16) -> DataFrame:
    """idx of the month that a position lies in; positions before the first month have none and go.

    Positions meet months by equality of coarse bins of `width` positions, each of which lists the few months that reach
    into it; the list has a few entries a month and is broadcast. Positions behind the last start are its month's.
    """
    last = starts.agg(F.max("start").alias("_last"))
    months = starts.crossJoin(last).withColumn("stop", F.coalesce("stop", F.col("start") + 1))  # one row
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))
    listed = F.broadcast(months.select("idx", "start", "stop", F.col("_last"), F.explode(bins).alias("_bin")))
    at = positions.crossJoin(F.broadcast(last.withColumnRenamed("_last", "_end"))).withColumn("_at", F.least("pos", "_end"))
    joined = at.withColumn("_bin", F.floor(F.col("_at") / width)).join(listed, "_bin")
    return joined.filter("_at >= start and _at < stop").select(*positions.columns, "idx")


def start_of_month(months: DataFrame, starts: DataFrame) -> DataFrame:
    """start: the first position of the month in column idx; null for months without trading days."""
    return months.join(F.broadcast(starts.select("idx", "start")), "idx", "left").select(*months.columns, "start")
