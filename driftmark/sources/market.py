"""Market tables: readers, writers, and the tables that stand for a market in the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.sources.shared import saved

BAR_SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, kind: str = "parquet") -> DataFrame:
    """Daily bars between start (included) and end (excluded); both reach the scan as filters."""
    bars = spark.read.format(kind).schema(BAR_SCHEMA).load(path)
    return between(bars, start, end)


#: Fields of a wide download, in the order of BAR_SCHEMA's numbers.
FIELDS = ("open", "high", "low", "close", "volume")


def long_bars(wide: DataFrame, separator: str = "|") -> DataFrame:
    """Daily bars of a wide table: date, and one column a field and ticker, named like `open|AAA`, in any order.

    Each row becomes one row a ticker by an array of structs, without a shuffle; days on which a ticker has no value at
    all are left out. A ticker that lacks a field, or a column of another shape, is an error that names it.
    """
    found: dict[str, dict[str, str]] = {}
    for c in wide.columns:
        if c == "date":
            continue
        field, _, ticker = c.partition(separator)
        if field.lower() not in FIELDS or not ticker:
            raise ValueError(f"column {c} is not a field and a ticker")
        found.setdefault(ticker, {})[field.lower()] = c
    lacking = sorted(f"{t}: {f}" for t, have in found.items() for f in FIELDS if f not in have)
    if lacking or "date" not in wide.columns:
        raise ValueError(f"missing columns: {', '.join(lacking or ['date'])}")
    value = lambda c: F.col("`" + c.replace("`", "``") + "`").cast("double")
    each = [F.struct(F.lit(t).alias("ticker"), *(value(have[f]).alias(f) for f in FIELDS)) for t, have in sorted(found.items())]
    rows = wide.select(F.to_date("date").alias("date"), F.explode(F.array(*each)).alias("x")).select("x.ticker", "date", *(f"x.{f}" for f in FIELDS))
    return rows.filter(F.coalesce(*FIELDS).isNotNull())


def wide_bars(bars: DataFrame, tickers: list[str], separator: str = "|") -> DataFrame:
    """The inverse of long_bars, for the named tickers."""
    firsts = [F.first(f, True).alias(f) for f in FIELDS]
    wide = bars.groupBy("date").pivot("ticker", tickers).agg(*firsts)
    return wide.select("date", *(F.col(f"`{t}_{f}`").alias(f"{f}{separator}{t}") for f in FIELDS for t in tickers))


def between(bars: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        bars = bars.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        bars = bars.filter(F.col("date") < F.lit(end).cast("date"))
    return bars


def numeric_series(rows: DataFrame, value_col: str = "value") -> DataFrame:
    """Values as numbers; what is no number goes."""
    return rows.withColumn(value_col, F.col(value_col).try_cast("double")).dropna(subset=[value_col])


SERIES_SCHEMA = "series_id string, observation_date date, value string"
LISTED_SCHEMA = "symbol string, security string, sector string, sub_industry string"


def read_checked(spark: SparkSession, path: str, schema: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of CSV files with a fixed schema. A line with too few or too many fields, or one that does not
    fit its type, goes to quarantine(line) as it stands. Both are written, so that the files are read once and what was
    set aside stays the same."""
    lines = spark.read.schema(f"{schema}, _line string").csv(path, header=header, mode="PERMISSIVE", columnNameOfCorruptRecord="_line", enforceSchema=True)
    read = saved(lines, "checked")
    return read.filter("_line is null").drop("_line"), read.filter("_line is not null").select(F.col("_line").alias("line"))


def read_series(spark: SparkSession, path: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Observations with numeric values, dates as months, and the quarantine."""
    rows, bad = read_checked(spark, path, SERIES_SCHEMA, header)
    return numeric_series(rows).withColumnRenamed("observation_date", "month"), bad


def read_constituents(spark: SparkSession, path: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    rows, bad = read_checked(spark, path, LISTED_SCHEMA, header)
    return constituents(rows), bad


def write_summary(summary: DataFrame, path: str) -> None:
    """The one row of run_summary as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def constituents(rows: DataFrame) -> DataFrame:
    """The list's five columns, with the symbol in the form the bar tables use."""
    return rows.select(F.translate("symbol", ".", "-").alias("market_symbol"), "symbol", "security", "sector", "sub_industry")


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def run_summary(samples: DataFrame, bars: DataFrame) -> DataFrame:
    """One row: dates and rows of the bars, number of samples and tickers, range of targets."""
    a = bars.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("bar_rows"))
    b = samples.agg(F.count("*").alias("samples"), F.countDistinct("ticker").alias("tickers"), F.min("target").alias("target_min"), F.max("target").alias("target_max"))
    return a.crossJoin(b)  # one row each


# --- the driver's tables as a market ---


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ohlc(lines: DataFrame, *keys: str) -> DataFrame:
    """Bars of a day from trades, in the order of their full key, since (orderkey, linenumber) repeats."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    price = F.col("l_extendedprice")
    return lines.groupBy(*keys, F.to_date("l_shipdate").alias("date")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum("l_quantity").alias("volume"),
    )


def _keyed_lines(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """Trades with their ticker, the nation of the supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("ticker"))
    return lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"], how).join(nations, F.col("s_nationkey") == F.col("n_nationkey"), how)


def nation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uneven bars: one ticker for each suppliers' nation."""
    return _ohlc(_keyed_lines(spark, sf_dir), "ticker")


def trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, first, last, high, low, volume): a day's trades of each ticker, in a form that merges further; first
    and last are (order, price). Trades without a ticker count for the whole market alone."""
    price = F.col("l_extendedprice")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price.alias("price"))
    return _keyed_lines(spark, sf_dir, "left").groupBy("ticker", F.to_date("l_shipdate").alias("date")).agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.max(price).alias("high"), F.min(price).alias("low"), F.sum("l_quantity").alias("volume")
    )


def day_totals(days: DataFrame) -> DataFrame:
    """trading_days of all tickers together."""
    return days.groupBy("date").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))


def day_bars(days: DataFrame) -> DataFrame:
    keys = [c for c in ("ticker", "date") if c in days.columns]
    return days.select(*keys, F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "volume")


def flag_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return _ohlc(lines.withColumn("ticker", F.concat("l_returnflag", "l_linestatus")), "ticker")


def benchmark_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ohlc(table(spark, sf_dir, "lineitem"))


def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, month, value): monthly mean order value by priority."""
    orders = table(spark, sf_dir, "orders")
    month = F.to_date(F.trunc("o_orderdate", "month")).alias("month")
    return orders.groupBy(F.col("o_orderpriority").alias("series_id"), month).agg((F.sum("o_totalprice") / F.count("*")).alias("value"))


def listed_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension in the shape of a constituent list."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.concat_ws(".", "n_name", F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_name").alias("security"),
        F.col("r_name").alias("sector"), F.col("n_name").alias("sub_industry"),
    )
