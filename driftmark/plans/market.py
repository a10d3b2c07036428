"""Registered market queries and their SQL twins.

Each function is one operator or workload over the driver's tables, found by queries(); SQL holds the same result in
DuckDB's dialect where SQL can say it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmark.functions.kernels import LAYERS, savgol_matrix
from driftmark.operators import calibrate, clean, extrema, features, macro, model, rank, series, stats
from driftmark.sources import market as src
from driftmark.sources.shared import bucketed, saved, shared_path
from driftmark.sources.versioned import Versioned
from driftmark.streaming import ticks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
HISTORY = "1998-01-01"
BASE_YEAR = 1995
QUARTERS = tuple(f"{y}-{d}" for y in (1999, 2000, 2001) for d in ("03-31", "06-30", "09-30", "12-31"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# --- tables that several queries start from ---

_OHLC = """CAST(l_shipdate AS DATE) AS date,
 first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open,
 max(l_extendedprice) AS high, min(l_extendedprice) AS low,
 last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close, sum(l_quantity) AS volume"""
BARS = f"""b0 AS (SELECT n_name AS ticker, {_OHLC} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
 GROUP BY n_name, CAST(l_shipdate AS DATE)),
bars AS (SELECT *, (open + high + low + close) / 4 AS price, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos FROM b0)"""
BENCH = f"""bn AS (SELECT {_OHLC} FROM lineitem GROUP BY CAST(l_shipdate AS DATE)), bench AS (SELECT date, (open + high + low + close) / 4 AS price FROM bn)"""
ALIGNED = f"""{BARS}, {BENCH}, aligned AS (SELECT bars.*, bench.price AS bench FROM bars LEFT JOIN bench USING (date))"""
TURNS = f"""{BARS}, e0 AS (SELECT ticker, pos, price, count(*) OVER (PARTITION BY ticker) AS n,
 max(price) OVER a AS ma, min(price) OVER a AS ia, max(price) OVER b AS mb, min(price) OVER b AS ib FROM bars
 WINDOW a AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
turns AS (SELECT ticker, pos, CASE WHEN price > ma AND price > mb THEN 'peak' ELSE 'trough' END AS kind FROM e0
 WHERE ((price > ma AND price > mb) OR (price < ia AND price < ib)) AND pos > 3 AND pos < n - 3)"""
SPACED = f"""{TURNS}, spaced AS (SELECT ticker, pos, kind FROM (SELECT *, lead(pos) OVER (PARTITION BY ticker ORDER BY pos) AS nx FROM turns WHERE pos > 126)
 WHERE nx IS NULL OR nx - pos >= 5)"""
MOVES = f"""{SPACED}, m0 AS (SELECT ticker, kind, lag(pos) OVER w AS before, pos AS this, lead(pos) OVER w AS next, row_number() OVER w - 1 AS k FROM spaced
 WINDOW w AS (PARTITION BY ticker ORDER BY pos)),
moves AS (SELECT m.ticker, k, kind, before, this, next, next - this AS gap, 100 * (q.price - p.price) / p.price AS target FROM m0 m
 JOIN bars p ON p.ticker = m.ticker AND p.pos = this JOIN bars q ON q.ticker = m.ticker AND q.pos = next WHERE before IS NOT NULL AND next IS NOT NULL)"""
MONTHLY = """monthly AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) / count(*) AS value FROM orders
 GROUP BY o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE))"""
SCORED = """scored AS (SELECT l_returnflag AS dataset, CAST(l_linenumber % 3 AS INT) AS checkpoint, l_orderkey AS "group", l_extendedprice / 1000 - 40 AS actual,
 floor(l_extendedprice / 1500) - 20 + floor(l_quantity / 10) AS prediction FROM lineitem)"""


def bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.numbered(clean.typical_price(src.nation_bars(spark, sf_dir)))


def benchmark_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.typical_price(src.benchmark_bars(spark, sf_dir))


def bars_and_benchmark(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """bars_of and benchmark_of from one scan of the trades: a day's trades of all tickers are those of each together."""
    days = saved(src.trading_days(spark, sf_dir), "days")
    return clean.numbered(clean.typical_price(src.day_bars(days.filter("ticker is not null")))), clean.typical_price(src.day_bars(src.day_totals(days)))


def aligned_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.align_benchmark(*bars_and_benchmark(spark, sf_dir))


def written_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars_of written once, for plans that use it in several places; windows by ticker need no exchange."""
    return bucketed(bars_of(spark, sf_dir), "bars", "ticker", "pos")


def turns_of(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    return extrema.neighbourhood_extrema(bars_of(spark, sf_dir) if bars is None else bars)


def plain_moves(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    bars = written_bars(spark, sf_dir) if bars is None else bars
    return extrema.transitions(extrema.spaced(turns_of(spark, sf_dir, bars)), bars)


def scored_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return src.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("dataset"), (F.col("l_linenumber") % 3).alias("checkpoint"), F.col("l_orderkey").alias("group"),
        (price / 1000 - 40).alias("actual"), (F.floor(price / 1500) - 20 + F.floor(F.col("l_quantity") / 10)).cast("double").alias("prediction"),
    )


def calendar_of(spark: SparkSession) -> DataFrame:
    return macro.month_calendar(spark, "1995-01-01", "2001-12-01")


# --- sources, sinks, cleaning ---


@query(f"WITH {BARS} SELECT ticker, count(*) AS bars, min(date) AS first_date, max(date) AS last_date FROM bars WHERE date >= DATE '1996-01-01' AND date < DATE '1998-01-01' GROUP BY ticker")
def s1_bars_between(spark, sf_dir):
    path = shared_path(spark, "bars")
    src.nation_bars(spark, sf_dir).write.parquet(path)
    return src.read_bars(spark, path, "1996-01-01", "1998-01-01").groupBy("ticker").agg(F.count("*").alias("bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(f"WITH {BARS} SELECT ticker, date, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume FROM bars")
def s1_wide_download(spark, sf_dir):
    """Bars spread over one column a field and ticker, written, and made long again."""
    tickers = [x["n_name"] for x in src.table(spark, sf_dir, "nation").select("n_name").collect()]  # a column each
    path = shared_path(spark, "wide")
    src.wide_bars(src.nation_bars(spark, sf_dir), sorted(tickers)).write.parquet(path)
    return src.long_bars(spark.read.parquet(path)).select("ticker", "date", *(r(c, 4).alias(c) for c in ("open", "high", "low", "close")), "volume")


@query(f"WITH {BARS} SELECT ticker, pos, round(100 * (price - lag(price) OVER w) / lag(price) OVER w, 6) AS change FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY pos)")
def s1_bars_by_ticker(spark, sf_dir):
    """Changes over the table of bars that is stored by ticker."""
    return written_bars(spark, sf_dir).select("ticker", "pos", r(series.change("price", series.along())).alias("change"))


@query(f"WITH {MONTHLY} SELECT series_id, count(*) AS n, round(sum(value), 4) AS total FROM monthly WHERE month(month) <> 7 GROUP BY series_id")
def s2_numeric_series(spark, sf_dir):
    m = src.monthly_series(spark, sf_dir)
    text = m.withColumn("value", F.when(F.month("month") == 7, ".").otherwise(F.col("value").cast("string")))
    return src.numeric_series(text).groupBy("series_id").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


def _series_files(spark: SparkSession, sf_dir: str) -> str:
    """CSV files of the monthly series: a line a value, some without a number, some with a broken date or a field too many."""
    m = src.monthly_series(spark, sf_dir).withColumn("m", F.month("month"))
    value = F.when(F.col("m") == 7, ".").otherwise(F.col("value").cast("string"))
    date = F.when(F.col("m") == 3, "1995-02-31").otherwise(F.col("month").cast("string"))
    line = F.concat_ws(",", "series_id", date, value, F.when((F.col("m") == 11) & F.col("series_id").startswith("5"), "x"))
    path = shared_path(spark, "series")
    m.select(line).write.text(path)
    return path


_BROKEN = "month(month) = 3 OR (month(month) = 11 AND series_id LIKE '5%')"


@query(f"WITH {MONTHLY} SELECT series_id, month, round(value, 4) AS value FROM monthly WHERE NOT ({_BROKEN}) AND month(month) <> 7")
def s2_series_from_files(spark, sf_dir):
    return src.read_series(spark, _series_files(spark, sf_dir), header=False)[0].withColumn("value", r("value", 4))


@query(f"WITH {MONTHLY} SELECT series_id, count(*) AS lines FROM monthly WHERE {_BROKEN} GROUP BY series_id")
def s3_quarantined_lines(spark, sf_dir):
    bad = src.read_series(spark, _series_files(spark, sf_dir), header=False)[1]
    return bad.groupBy(F.substring_index("line", ",", 1).alias("series_id")).agg(F.count("*").alias("lines"))


@query(f"WITH {MONTHLY} SELECT series_id, month, round(value, 4) AS value FROM monthly")
def s3_base_series(spark, sf_dir):
    return src.monthly_series(spark, sf_dir).select("series_id", "month", r("value", 4).alias("value"))


@query("SELECT replace(n_name || '.' || s_suppkey, '.', '-') AS market_symbol, n_name || '.' || s_suppkey AS symbol, s_name AS security, r_name AS sector, n_name AS sub_industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def s4_constituents(spark, sf_dir):
    return src.constituents(src.listed_suppliers(spark, sf_dir))


@query("SELECT replace(n_name || '.' || s_suppkey, '.', '-') AS market_symbol, n_name || '.' || s_suppkey AS symbol, s_name AS security, r_name AS sector, n_name AS sub_industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def s4_constituents_from_file(spark, sf_dir):
    path = shared_path(spark, "listed")
    src.listed_suppliers(spark, sf_dir).write.csv(path, header=True)
    return src.read_constituents(spark, path)[0]


@query(f"WITH {BARS} SELECT ticker, count(*) AS n, sum(volume) AS volume FROM bars GROUP BY ticker")
def s5_partitioned_write(spark, sf_dir):
    path = shared_path(spark, "panel")
    src.write_partitioned(src.nation_bars(spark, sf_dir).repartition("ticker"), path, "ticker")
    return spark.read.parquet(path).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query(f"WITH {BARS} SELECT ticker, count(*) AS n, round(sum(CASE WHEN ticker < 'J' THEN 2 * volume ELSE volume END), 4) AS volume FROM bars GROUP BY ticker")
def s5_replaced_tickers(spark, sf_dir):
    """A table of versions: written whole, then changed for some tickers only."""
    bars = saved(src.nation_bars(spark, sf_dir), "bars")
    table = Versioned(spark, shared_path(spark, "versions"), "ticker", bars.schema)
    table.replace(bars)
    table.update(bars.filter("ticker < 'J'").withColumn("volume", F.col("volume") * 2))
    return table.read().groupBy("ticker").agg(F.count("*").alias("n"), r(F.sum("volume"), 4).alias("volume"))


@query(f"WITH {MOVES} SELECT (SELECT min(date) FROM bars) AS first_date, (SELECT max(date) FROM bars) AS last_date, (SELECT count(*) FROM bars) AS bar_rows, count(*) AS samples, count(DISTINCT ticker) AS tickers, round(min(target), 6) AS target_min, round(max(target), 6) AS target_max FROM moves")
def s6_run_summary(spark, sf_dir):
    bars = written_bars(spark, sf_dir)
    out = src.run_summary(plain_moves(spark, sf_dir, bars), bars)
    path = shared_path(spark, "summary")
    src.write_summary(out, path)
    return spark.read.schema(out.schema).json(path).withColumns({c: r(c) for c in ("target_min", "target_max")})


@query(f"WITH {BARS} SELECT ticker, date, round(price, 6) AS price FROM bars")
def c1_typical_price(spark, sf_dir):
    return clean.typical_price(src.nation_bars(spark, sf_dir)).select("ticker", "date", r("price").alias("price"))


@query(f"WITH {BARS} SELECT ticker, count(*) AS n, sum(volume) AS volume FROM bars WHERE volume > 0 AND day(date) <> 13 AND day(date) <> 14 GROUP BY ticker")
def c2_good_bars(spark, sf_dir):
    b = bars_of(spark, sf_dir)
    b = b.withColumns({"price": F.when(F.dayofmonth("date") != 13, F.col("price")), "volume": F.when(F.dayofmonth("date") != 14, F.col("volume")).otherwise(0.0)})
    return clean.good_bars(b).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query(f"WITH {BARS} SELECT ticker FROM bars GROUP BY ticker HAVING bool_and(price < 104900)")
def c3_usable_tickers(spark, sf_dir):
    b = bars_of(spark, sf_dir).withColumn("price", F.when(F.col("price") < 104900, F.col("price")).otherwise(float("nan")))
    return clean.usable_tickers(b)


@query(f"WITH {BARS}, {BENCH} SELECT t.ticker, (SELECT count(*) FROM bench) - count(b.price) AS missing_price, (SELECT count(*) FROM bench) - count(b.volume) AS missing_volume FROM (SELECT DISTINCT ticker FROM bars) t LEFT JOIN bars b ON b.ticker = t.ticker GROUP BY t.ticker")
def c4_missing_bars(spark, sf_dir):
    return clean.missing_bars(bars_of(spark, sf_dir), benchmark_of(spark, sf_dir))


@query(
    f"""WITH {BARS}, {BENCH}, j AS (SELECT bars.ticker, bars.date, b.price AS b FROM bars LEFT JOIN (SELECT * FROM bench WHERE day(date) > 9) b USING (date))
SELECT ticker, date, round(coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(b IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bench FROM j"""
)
def c5_align_benchmark(spark, sf_dir):
    bars, benchmark = bars_and_benchmark(spark, sf_dir)
    return clean.align_benchmark(bars, benchmark.filter(F.dayofmonth("date") > 9)).select("ticker", "date", r("bench").alias("bench"))


@query(f"WITH {BARS} SELECT ticker, date, pos FROM bars")
def c6_append_bars(spark, sf_dir):
    b = src.nation_bars(spark, sf_dir)
    return clean.append_bars(src.between(b, None, HISTORY), src.between(b, "1997-06-01", None)).select("ticker", "date", "pos")


@query(f"WITH {BARS} SELECT ticker, date, pos FROM bars")
def c6_later_bars(spark, sf_dir):
    """New bars numbered on from the stored heads in two steps; what is stored keeps its numbers."""
    b = saved(src.nation_bars(spark, sf_dir), "bars")
    store = saved(clean.numbered(src.between(b, None, "1996-01-01")), "numbered")
    heads = saved(clean.last_bars(store), "heads")
    for start, end in (("1995-06-01", HISTORY), ("1997-06-01", None)):
        fresh = saved(clean.later_bars(heads, src.between(b, start, end)), "later")
        store, heads = store.unionByName(fresh), saved(clean.moved_heads(heads, fresh), "heads")
    return store.select("ticker", "date", "pos")


@query(f"WITH {BARS} SELECT ticker, count(*) AS rows FROM bars GROUP BY ticker HAVING count(*) <> 2000")
def c6_short_histories(spark, sf_dir):
    return clean.short_histories(bars_of(spark, sf_dir), 2000)


_FRESH = f"""WITH {BARS}, {BENCH}, p AS (SELECT ticker, max(date) AS d, count(*) AS rows, date_diff('day', max(date), (SELECT max(date) FROM bench)) AS lag_days FROM bars GROUP BY ticker)
SELECT ticker, rows, lag_days, CASE WHEN rows < 756 THEN 'insufficient history' WHEN lag_days > %d THEN 'stale' ELSE 'eligible' END AS status FROM p"""


@query(_FRESH % 0)
def c7_freshness_strict(spark, sf_dir):
    return clean.freshness(bars_of(spark, sf_dir), benchmark_of(spark, sf_dir))


@query(_FRESH % 7)
def c7_freshness_lenient(spark, sf_dir):
    return clean.freshness(bars_of(spark, sf_dir), benchmark_of(spark, sf_dir), most_lag=7)


@query(
    f"""WITH {BARS}, {BENCH}, {MONTHLY}, x AS (SELECT unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT i, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS std FROM x GROUP BY i)
SELECT 'benchmark covers calendar' AS "check", count(DISTINCT date) AS violations FROM bars WHERE date NOT IN (SELECT date FROM bench WHERE day(date) > 9)
UNION ALL SELECT 'mean and deviation are finite, deviation above 0', count(*) FROM m WHERE NOT isfinite(mean) OR NOT isfinite(std) OR std <= 0
UNION ALL SELECT 'macro is finite', count(*) FROM monthly WHERE month(month) = 7 UNION ALL SELECT 'moments are complete', abs(count(*) - 191) FROM m"""
)
def c8_contract_violations(spark, sf_dir):
    gaps = benchmark_of(spark, sf_dir).filter(F.dayofmonth("date") > 9)
    monthly = src.monthly_series(spark, sf_dir).withColumn("value", F.when(F.month("month") != 7, F.col("value")).otherwise(float("nan")))
    moments = stats.mean_std(stats.partial_moments(vectors_of(spark, sf_dir)))
    return clean.contract_violations(bars_of(spark, sf_dir), gaps, moments, monthly, 191)


# --- returns, smoothing ---


@query(f"WITH {BARS} SELECT ticker, pos, round(100 * (price - lag(price) OVER w) / lag(price) OVER w, 6) AS change FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY pos)")
def r1_change(spark, sf_dir):
    return bars_of(spark, sf_dir).select("ticker", "pos", r(series.change("price", series.along())).alias("change"))


@query(f"WITH {BARS} SELECT ticker, pos, round(100 * (price - lag(price) OVER w) / price, 6) AS rate FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY pos)")
def r2_rate(spark, sf_dir):
    return bars_of(spark, sf_dir).select("ticker", "pos", r(series.rate("price", series.along())).alias("rate"))


@query(f"WITH {BARS} SELECT ticker, pos // 2 AS j, round(avg(price), 6) AS price, round(avg(volume), 6) AS volume FROM bars GROUP BY ticker, pos // 2 HAVING count(*) = 2")
def r3_pair_means(spark, sf_dir):
    return series.block_means(bars_of(spark, sf_dir), 2, "price", "volume").select("ticker", "j", r("price").alias("price"), r("volume").alias("volume"))


def _savgol_sql(window: int, order: int, col: str, source: str, key: str, by: str) -> str:
    w = window - 1
    table = "[" + ", ".join("[" + ", ".join(map(repr, row)) + "]" for row in savgol_matrix(window, order).tolist()) + "]"
    return f"""SELECT {key}, {by}, list_inner_product(near[s - greatest({by} - {w}, 0) + 1 : s - greatest({by} - {w}, 0) + {window}], {table}[{by} - s + 1]) AS v FROM
 (SELECT *, least(greatest({by} - {window // 2}, 0), n - {window}) AS s FROM (SELECT {key}, {by}, count(*) OVER (PARTITION BY {key}) AS n,
 list(CAST({col} AS DOUBLE)) OVER (PARTITION BY {key} ORDER BY {by} ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING) AS near FROM {source}) WHERE n >= {window})"""


@query(f"WITH {BARS}, v AS ({_savgol_sql(21, 3, 'price', 'bars', 'ticker', 'pos')}) SELECT ticker, pos, round(v, 4) AS smooth FROM v")
def r4_savgol(spark, sf_dir):
    return series.smoothed(bars_of(spark, sf_dir), ["price"], 21, 3).select("ticker", "pos", r("price", 4).alias("smooth")).dropna()


@query(f"WITH {BARS} SELECT ticker, pos, round(avg(price) OVER w, 6) AS mean FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 10")
def r5_moving_average(spark, sf_dir):
    return bars_of(spark, sf_dir).select("ticker", "pos", r(series.moving_average("price", 10, series.along())).alias("mean")).dropna()


@query(
    f"""WITH {BARS}, p AS (SELECT ticker, pos // 2 AS j, avg(price) AS price, avg(volume) AS volume FROM bars GROUP BY ticker, pos // 2 HAVING count(*) = 2),
c AS (SELECT ticker, j, 100 * (price - lag(price) OVER w) / lag(price) OVER w AS ret, 100 * (volume - lag(volume) OVER w) / lag(volume) OVER w AS vr FROM p WINDOW w AS (PARTITION BY ticker ORDER BY j))
SELECT ticker, j, round(sum(ret) OVER f, 5) AS sum_returns, round(sum(vr) OVER f, 5) AS sum_rates FROM c WINDOW f AS (PARTITION BY ticker ORDER BY j ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) QUALIFY count(ret) OVER f = 63"""
)
def r6_trailing_vectors(spark, sf_dir):
    v = series.trailing_vectors(series.pair_series(bars_of(spark, sf_dir), smooth=False))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return v.select("ticker", "j", r(total("returns"), 5).alias("sum_returns"), r(total("rates"), 5).alias("sum_rates"))


# --- extrema ---


@query(
    f"""WITH {BARS}, n AS (SELECT ticker, pos, count(*) OVER (PARTITION BY ticker) AS n FROM bars)
SELECT ticker, pos, CASE WHEN pos < (n % 42) * (n // 42 + 1) THEN pos // (n // 42 + 1) ELSE n % 42 + (pos - (n % 42) * (n // 42 + 1)) // (n // 42) END AS part FROM n"""
)
def e1_segments(spark, sf_dir):
    return extrema.segmented(bars_of(spark, sf_dir), 42).select("ticker", "pos", "part")


_SEGMENTS = f"""WITH {BARS}, n AS (SELECT ticker, pos, price, count(*) OVER (PARTITION BY ticker) AS n FROM bars),
c AS (SELECT *, CASE WHEN pos < (n % split) * (n // split + 1) THEN pos // (n // split + 1) ELSE n % split + (pos - (n % split) * (n // split + 1)) // (n // split) END AS part
 FROM n CROSS JOIN (SELECT unnest([42, 48]) AS split)),
g AS (SELECT ticker, split, part, sign, list(pos ORDER BY pos) AS p, list(sign * price ORDER BY pos) AS x, 0.05 * avg(price) AS least, count(*) AS n FROM c CROSS JOIN (SELECT unnest([1, -1]) AS sign) GROUP BY ALL),
rises AS (SELECT *, list_transform(list_filter(range(2, n), lambda i: x[i - 1] < x[i]), lambda i: {{'i': i, 'j': i + coalesce(list_position(list_transform(x[i + 1 :], lambda v: v <> x[i]), true), n - i + 1)}}) AS r FROM g),
tops AS (SELECT *, list_transform(list_filter(r, lambda s: s.j <= n AND x[s.j] < x[s.i]), lambda s: (s.i + s.j - 1) // 2) AS t FROM rises),
ranked AS (SELECT *, list_transform(list_sort(list_transform(t, lambda i: {{'h': -x[i], 'q': -i}})), lambda s: [-s.q]) AS o FROM tops WHERE len(t) > 0),
apart AS (SELECT *, list_reduce(o, lambda a, b: CASE WHEN list_bool_or(list_transform(a, lambda y: abs(y - b[1]) < 5)) THEN a ELSE list_concat(a, b) END) AS k FROM ranked),
sides AS (SELECT *, unnest(k) AS q FROM apart),
ends AS (SELECT *, coalesce(list_max(list_filter(range(1, q), lambda i: x[i] > x[q])), 0) AS a, coalesce(list_min(list_filter(range(q + 1, n + 1), lambda i: x[i] > x[q])), n + 1) AS b FROM sides),
segment_turns AS (SELECT ticker, split, part, CAST(p[q] AS INT) AS pos, CASE WHEN sign > 0 THEN 'peak' ELSE 'trough' END AS kind FROM ends WHERE x[q] - greatest(list_min(x[a + 1 : q]), list_min(x[q : b - 1])) >= least),
raw AS (SELECT ticker, pos, CASE WHEN bool_or(kind = 'trough') THEN 'trough' ELSE 'peak' END AS kind FROM segment_turns GROUP BY ticker, pos),
labelled AS (SELECT ticker, pos, kind FROM (SELECT *, lead(pos) OVER (PARTITION BY ticker ORDER BY pos) AS nx FROM raw WHERE pos > 126) WHERE nx IS NULL OR nx - pos >= 5)"""


@query(f"{_SEGMENTS} SELECT * FROM segment_turns")
def e2_segment_extrema(spark, sf_dir):
    return extrema.segment_extrema(bars_of(spark, sf_dir))


@query(f"{_SEGMENTS} SELECT * FROM raw")
def e3_raw_extrema(spark, sf_dir):
    return extrema.raw_extrema(extrema.segment_extrema(bars_of(spark, sf_dir)))


@query(f"WITH {SPACED} SELECT ticker, pos, kind FROM spaced")
def e4_spaced(spark, sf_dir):
    return extrema.spaced(turns_of(spark, sf_dir)).select("ticker", "pos", "kind")


@query(f"{_SEGMENTS} SELECT * FROM labelled")
def e5_labelled(spark, sf_dir):
    return extrema.spaced(extrema.raw_extrema(extrema.segment_extrema(bars_of(spark, sf_dir))))


@query(f"WITH {TURNS} SELECT ticker, pos, kind FROM turns")
def e6_neighbourhood(spark, sf_dir):
    return turns_of(spark, sf_dir)


@query(f"WITH {MOVES} SELECT ticker, k, kind, before, this, next, gap, round(target, 6) AS target FROM moves")
def e7_transitions(spark, sf_dir):
    return plain_moves(spark, sf_dir).withColumn("target", r("target"))


@query(f"WITH {TURNS} SELECT b.ticker, round(b.n / greatest(coalesce(m, 0), 1), 6) AS spacing FROM (SELECT ticker, count(*) AS n FROM bars GROUP BY ticker) b LEFT JOIN (SELECT ticker, count(*) AS m FROM turns GROUP BY ticker) t USING (ticker)")
def e8_spacing(spark, sf_dir):
    bars = written_bars(spark, sf_dir)
    return extrema.mean_spacing(bars, turns_of(spark, sf_dir, bars)).withColumn("spacing", r("spacing"))


@query(
    f"""WITH {SPACED}, l AS (SELECT ticker, pos, kind, lag(pos) OVER (PARTITION BY ticker ORDER BY pos) AS before FROM spaced
 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pos DESC) = 1),
a AS (SELECT l.ticker, count(*) AS after, arg_min(b.pos, (b.price, b.pos)) AS low, max(b.pos) AS fin FROM l JOIN bars b ON b.ticker = l.ticker AND b.pos > l.pos GROUP BY l.ticker),
s AS (SELECT l.*, a.low, CASE WHEN kind = 'trough' AND before IS NULL THEN 'too_few_confirmed_extrema' WHEN kind = 'trough' THEN 'confirmed_trough' WHEN coalesce(after, 0) < 5 THEN 'no_recent_low_after_latest_peak'
 WHEN fin - low < 4 THEN 'provisional_trough_has_fewer_than_five_observations' WHEN low - pos < 4 THEN 'provisional_fall_too_short' ELSE 'provisional_recent_low' END AS status FROM l LEFT JOIN a USING (ticker))
SELECT ticker, CASE status WHEN 'confirmed_trough' THEN pos WHEN 'provisional_recent_low' THEN low END AS trough,
 CASE status WHEN 'confirmed_trough' THEN before WHEN 'provisional_recent_low' THEN pos END AS before, status FROM s"""
)
def e9_active_trough(spark, sf_dir):
    bars = written_bars(spark, sf_dir)
    return extrema.active_trough(extrema.spaced(turns_of(spark, sf_dir, bars)), bars)


@query(
    f"""WITH {SPACED}, l AS (SELECT ticker, pos, kind, lag(pos) OVER (PARTITION BY ticker ORDER BY pos) AS before FROM spaced QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pos DESC) = 1)
SELECT ticker, CASE WHEN kind = 'trough' AND before IS NOT NULL THEN pos END AS trough, CASE WHEN kind = 'trough' THEN before END AS before,
 CASE WHEN kind <> 'trough' THEN 'latest_confirmed_extremum_is_peak' WHEN before IS NULL THEN 'too_few_confirmed_extrema' ELSE 'confirmed_trough' END AS status FROM l"""
)
def e9_confirmed_trough(spark, sf_dir):
    """The older rule: the last extremum must be a trough."""
    bars = written_bars(spark, sf_dir)
    return extrema.active_trough(extrema.spaced(turns_of(spark, sf_dir, bars)), bars, provisional=False)


@query(
    f"""{_SEGMENTS}, m0 AS (SELECT ticker, kind, lag(pos) OVER w AS before, pos AS this, lead(pos) OVER w AS next, row_number() OVER w - 1 AS k FROM labelled WINDOW w AS (PARTITION BY ticker ORDER BY pos))
SELECT m.ticker, k, kind, before, this, next, next - this AS gap, round(100 * (q.price - p.price) / p.price, 6) AS target FROM m0 m
 JOIN bars p ON p.ticker = m.ticker AND p.pos = this JOIN bars q ON q.ticker = m.ticker AND q.pos = next WHERE before IS NOT NULL AND next IS NOT NULL"""
)
def e7_labelled_transitions(spark, sf_dir):
    """Moves between the extrema that the jobs use: both segmentations, labelled and spaced."""
    bars = written_bars(spark, sf_dir)
    raw = extrema.raw_extrema(extrema.segment_extrema(bars))
    return extrema.transitions(extrema.spaced(raw), bars).withColumn("target", r("target"))


# --- features ---


@query(f"WITH {MOVES} SELECT ticker, this, unnest(range(4, gap)) AS duration FROM moves")
def f1_durations(spark, sf_dir):
    return features.durations(plain_moves(spark, sf_dir)).select("ticker", "this", "duration")


@query(f"WITH {MOVES} SELECT ticker, this, unnest(range(4, gap + 1)) AS duration FROM moves")
def f1_durations_inclusive(spark, sf_dir):
    return features.durations(plain_moves(spark, sf_dir), inclusive=True).select("ticker", "this", "duration")


@query(
    f"""WITH {ALIGNED}, rr AS (SELECT ticker, pos, price / lag(price) OVER w - 1 AS x, bench / lag(bench) OVER w - 1 AS y FROM aligned WINDOW w AS (PARTITION BY ticker ORDER BY pos))
SELECT ticker, pos, round(covar_samp(x, y) OVER f / var_samp(y) OVER f, 5) AS beta FROM rr WINDOW f AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 124 PRECEDING AND CURRENT ROW) QUALIFY count(x) OVER f = 125"""
)
def f2_beta(spark, sf_dir):
    return features.beta(aligned_bars(spark, sf_dir)).select("ticker", "pos", r("beta", 5).alias("beta")).dropna()


@query(
    f"""WITH {BARS}, d AS (SELECT ticker, pos, price - lag(price) OVER (PARTITION BY ticker ORDER BY pos) AS d FROM bars),
g AS (SELECT ticker, pos, sum(greatest(d, 0)) OVER f AS gain, sum(greatest(-d, 0)) OVER f AS loss, count(d) OVER f AS n FROM d WINDOW f AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW))
SELECT ticker, pos, round(CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END, 5) AS rsi FROM g WHERE n = 13"""
)
def f3_rsi(spark, sf_dir):
    return features.rsi(bars_of(spark, sf_dir)).select("ticker", "pos", r("rsi", 5).alias("rsi")).dropna()


def _quarters(start: str, steps: str) -> str:
    edge = lambda i: f"({start} + {i} * ({steps} // 4) + least({i}, {steps} % 4))"
    price = lambda at: f"(SELECT price FROM bars b WHERE b.ticker = x.ticker AND b.pos = {at})"
    one = lambda i: f"round(100 * ({price(edge(i + 1))} - {price(edge(i))}) / ({price(start)} * ({edge(i + 1)} - {edge(i)}) * {steps}), 8) AS q{i}"
    return ", ".join(map(one, range(4)))


@query(f"WITH {MOVES}, x AS (SELECT ticker, this, before, this - before AS fall FROM moves) SELECT ticker, this, {_quarters('before', 'fall')} FROM x")
def f4_fall_quarters(spark, sf_dir):
    bars = written_bars(spark, sf_dir)
    leg = features.legs(bars, extrema.spaced(turns_of(spark, sf_dir, bars))).select("ticker", (F.col("leg") + 1).alias("k"), "prices")
    rows = plain_moves(spark, sf_dir, bars).join(leg, ["ticker", "k"])
    slopes = features.quarter_slopes(F.col("prices"), F.col("this") - F.col("before"))
    return rows.select("ticker", "this", *(r(c, 8).alias(f"q{i}") for i, c in enumerate(slopes)))


@query(f"WITH {MOVES}, x AS (SELECT ticker, this, unnest(range(4, gap)) AS duration FROM moves) SELECT ticker, this, duration, {_quarters('this', 'duration')} FROM x")
def f4_rise_quarters(spark, sf_dir):
    bars = written_bars(spark, sf_dir)
    leg = features.legs(bars, extrema.spaced(turns_of(spark, sf_dir, bars))).select("ticker", F.col("leg").alias("k"), "prices", "volumes")
    rows = features.paths(plain_moves(spark, sf_dir, bars).join(leg, ["ticker", "k"]), "prices", "volumes")
    return rows.select("ticker", "this", "duration", *(r(f"r{i}", 8).alias(f"q{i}") for i in range(4)))


@query(f"WITH {MOVES} SELECT m.ticker, this, max(volume) FILTER (pos <= this) AS fall_max, max(volume) FILTER (pos >= this) AS rise_max FROM moves m JOIN bars b ON b.ticker = m.ticker AND pos BETWEEN before AND next GROUP BY ALL")
def f5_leg_maxima(spark, sf_dir):
    bars = written_bars(spark, sf_dir)
    leg = features.legs(bars, extrema.spaced(turns_of(spark, sf_dir, bars)))
    side = lambda shift, name: leg.select("ticker", (F.col("leg") + shift).alias("k"), F.array_max("volumes").alias(name))
    return plain_moves(spark, sf_dir, bars).join(side(1, "fall_max"), ["ticker", "k"]).join(side(0, "rise_max"), ["ticker", "k"]).select("ticker", "this", "fall_max", "rise_max")


@query(
    f"""WITH {MOVES}, x AS (SELECT *, unnest(range(4, gap)) AS duration FROM moves) SELECT x.ticker, a.date AS extremum_date, b.date AS end_date, c.date AS next_date, duration, this - before AS fall_duration, round(target, 6) AS target
FROM x JOIN bars a ON a.ticker = x.ticker AND a.pos = this JOIN bars b ON b.ticker = x.ticker AND b.pos = this + duration JOIN bars c ON c.ticker = x.ticker AND c.pos = next"""
)
def f9_sample_meta(spark, sf_dir):
    bars = written_bars(spark, sf_dir)
    return features.sample_meta(plain_moves(spark, sf_dir, bars), bars).withColumn("target", r("target"))


@query(f"WITH {BARS} SELECT ticker, pos, round(avg(volume) OVER f, 6) AS mean_volume FROM bars WINDOW f AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER f = 126")
def f5_mean_volume(spark, sf_dir):
    return features.mean_volume(bars_of(spark, sf_dir)).select("ticker", "pos", r("mean_volume").alias("mean_volume")).dropna()


def _swing(spark: SparkSession, sf_dir: str, days: tuple[str, ...] = ()):
    """Bars, raw and filtered extrema, moves and the benchmark: what samples are made of, cut from the lineage once. days: every
    ticker as it stood on each of them, as a ticker of its own."""
    plain, benchmark = bars_and_benchmark(spark, sf_dir)
    bars = clean.align_benchmark(plain, benchmark)
    if days:
        bars = bars.withColumn("day", F.explode(F.array(*map(F.lit, days)))).filter("date <= cast(day AS date)")
        bars = bars.withColumn("ticker", F.concat_ws("@", "ticker", "day")).drop("day")
    bars = bucketed(bars, "bars", "ticker", "pos")
    raw = saved(extrema.raw_extrema(extrema.segment_extrema(bars)), "extrema")
    kept = extrema.spaced(raw)
    moves = extrema.transitions(kept, bars)
    return bars, raw, kept, moves, benchmark


def _macro_windows(spark: SparkSession, sf_dir: str, benchmark: DataFrame) -> DataFrame:
    cal = calendar_of(spark)
    m = macro.reindexed(src.monthly_series(spark, sf_dir), cal)
    vix = macro.monthly_mean(benchmark).select(F.lit("index").alias("series_id"), "month", "value")
    rates = macro.rate_feature(m, 0.455).join(cal.select("idx", "month"), "idx").select(F.concat("series_id", F.lit(" rate")).alias("series_id"), "month", "value")
    yearly = macro.yearly_change(m.filter("series_id like '1%'")).select(F.lit("yearly").alias("series_id"), "month", "value")
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED rate", "5-LOW rate", "index", "yearly"]
    return saved(macro.macro_windows(macro.assembled(m.unionByName(rates).unionByName(vix).unionByName(yearly), cal, names)), "macro")


def sample_table(spark: SparkSession, sf_dir: str, inclusive: bool = False, rough: bool = False) -> DataFrame:
    bars, raw, kept, moves, benchmark = _swing(spark, sf_dir)
    vectors = saved(series.trailing_vectors(series.pair_series(bars, smooth=not rough)), "vectors")
    return features.samples(moves, bars, kept, extrema.mean_spacing(bars, raw), vectors, _macro_windows(spark, sf_dir, benchmark), BASE_YEAR, inclusive, rough=rough)


def _bend_sql(of: str, legs: str = "leg") -> str:
    """The largest second difference of each leg v of n values in legs(ticker, leg, v, n), smoothed by a polynomial of
    window w and order o: sums of orthogonal polynomials about each window's middle."""
    fit = """list_transform(range(n), lambda i: list_avg(y[i + 1]) + CASE WHEN o > 0 THEN t[i + 1] * list_inner_product(y[i + 1], u) / list_inner_product(u, u) ELSE 0 END
 + CASE WHEN o > 1 THEN (t[i + 1] * t[i + 1] - list_avg(uu)) * list_inner_product(y[i + 1], list_transform(uu, lambda z: z - list_avg(uu))) / list_sum(list_transform(uu, lambda z: (z - list_avg(uu)) ** 2)) ELSE 0 END)"""
    return f"""(SELECT ticker, leg, CASE WHEN n < w OR o < 0 OR o >= w OR n < 3 THEN NULL ELSE list_max(list_transform(range(2, n), lambda i: abs(s[i - 1] - 2 * s[i] + s[i + 1]))) END AS bend FROM
 (SELECT *, CASE WHEN n >= w AND o >= 0 THEN {fit} END AS s FROM (SELECT *, list_transform(range(n), lambda i: v[least(greatest(i - h, 0), n - w) + 1 : least(greatest(i - h, 0), n - w) + w]) AS y,
 list_transform(range(n), lambda i: CAST(i - least(greatest(i - h, 0), n - w) - h AS DOUBLE)) AS t, list_transform(range(w), lambda i: CAST(i - h AS DOUBLE)) AS u, list_transform(range(w), lambda i: CAST((i - h) ** 2 AS DOUBLE)) AS uu FROM
 (SELECT *, CAST(2 * round_even(({of}) / 8, 0) + 3 AS BIGINT) AS w, CAST(round_even(({of}) / 8, 0) + 1 AS BIGINT) AS h, CAST(least(round_even(n / 3, 0) - 2, 2) AS BIGINT) AS o FROM {legs}))))"""


@query(
    f"""WITH {SPACED}, l0 AS (SELECT ticker, pos, row_number() OVER (PARTITION BY ticker ORDER BY pos) - 1 AS leg, coalesce(lead(pos) OVER (PARTITION BY ticker ORDER BY pos), 1000000) AS nx FROM spaced),
leg AS (SELECT b.ticker, leg, list(CAST(volume AS DOUBLE) ORDER BY b.pos) AS v, count(*) AS n FROM l0 JOIN bars b ON b.ticker = l0.ticker AND b.pos BETWEEN l0.pos AND nx GROUP BY ALL)
SELECT ticker, leg, round(r.bend, 4) AS rise, round(f.bend, 4) AS fall FROM {_bend_sql('n - 3')} r JOIN {_bend_sql('n')} f USING (ticker, leg)"""
)
def f6_peakiness(spark, sf_dir):
    bars = written_bars(spark, sf_dir)
    leg = features.legs(bars, extrema.spaced(turns_of(spark, sf_dir, bars)))
    return leg.select("ticker", "leg", r(features.rise_peakiness("volumes"), 4).alias("rise"), r(features.fall_peakiness("volumes"), 4).alias("fall"))


@query()
def f8_rough_samples(spark, sf_dir):
    """Samples of unsmoothed pairs, with the macro window of the month of the sample's last bar."""
    s = sample_table(spark, sf_dir, rough=True)
    return s.select("ticker", "extremum_date", "end_date", r("target").alias("target"), r(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 1).alias("sum"))


@query()
def f8_samples(spark, sf_dir):
    s = sample_table(spark, sf_dir)
    return s.select("ticker", "extremum_date", "end_date", "next_date", "duration", r("target").alias("target"), r(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 1).alias("sum"))


@query()
def f10_current_rows(spark, sf_dir):
    digits = {"beta": 5, "rsi": 5, "current_price": 6, "trough_price": 6, "current_gain": 6}
    return current_of(spark, sf_dir).drop("features").withColumns({c: r(c, n) for c, n in digits.items()})


def current_of(spark: SparkSession, sf_dir: str, days: tuple[str, ...] = ()) -> DataFrame:
    bars, raw, kept, _, benchmark = _swing(spark, sf_dir, days)
    vectors = saved(series.trailing_vectors(series.pair_series(bars)), "vectors")
    # The price tables outlast the monthly ones: the newest macro window stands for later months.
    m = _macro_windows(spark, sf_dir, benchmark)
    newest = m.agg(F.max_by("macro", "idx").alias("macro"), F.max("idx").alias("last"))
    later = spark.range(0, 120).select(F.col("id").cast("int").alias("idx")).crossJoin(F.broadcast(newest)).filter("idx > last").select("idx", "macro")
    return features.current_rows(bars, kept, extrema.active_trough(kept, bars), extrema.mean_spacing(bars, raw), vectors, m.union(later), BASE_YEAR, 400)


@query()
def f11_training_panel(spark, sf_dir):
    key = F.concat_ws("-", F.date_format("extremum_date", "yyyyMM"), F.date_format("extremum_date", "dd"), F.col("duration").cast("string"))
    panel = sample_table(spark, sf_dir, inclusive=True).withColumn("sample_key", key)
    panel_table = Versioned(spark, shared_path(spark, "training"), "ticker", panel.schema)
    panel_table.replace(panel, most=100_000)
    return panel_table.read().groupBy("ticker").agg(F.count("*").alias("samples"), F.countDistinct("sample_key").alias("keys"), r(F.avg("target")).alias("mean_target"))


# --- macro ---

_CAL = "cal AS (SELECT CAST(unnest(range(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-02', INTERVAL 1 MONTH)) AS DATE) AS month), idx AS (SELECT month, (year(month) - 1995) * 12 + month(month) - 1 AS idx FROM cal)"


@query(f"WITH {MONTHLY} SELECT a.series_id, a.month, round(100 * (a.value - b.value) / b.value, 6) AS value FROM monthly a LEFT JOIN monthly b ON a.series_id = b.series_id AND a.month = b.month + INTERVAL 12 MONTH")
def m1_yearly_change(spark, sf_dir):
    return macro.yearly_change(src.monthly_series(spark, sf_dir)).withColumn("value", r("value"))


@query(
    f"""WITH {MONTHLY}, {_CAL}, g AS (SELECT s.series_id, idx.month, idx.idx, m.value FROM (SELECT DISTINCT series_id FROM monthly) s CROSS JOIN idx LEFT JOIN monthly m ON m.series_id = s.series_id AND m.month = idx.month)
SELECT series_id, month, round(last_value(CASE WHEN idx < 60 THEN value ELSE value * 2 END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS value FROM g"""
)
def m2_extended(spark, sf_dir):
    m = src.monthly_series(spark, sf_dir)
    return macro.extended(m, m.withColumn("value", F.col("value") * 2), calendar_of(spark), 60).withColumn("value", r("value", 4))


@query(f"WITH {MONTHLY} SELECT a.month, round(a.value - b.value, 4) AS real, round(b.value, 4) AS recovered FROM monthly a JOIN monthly b ON a.month = b.month AND a.series_id = '1-URGENT' AND b.series_id = '2-HIGH'")
def m3_real_rate(spark, sf_dir):
    m = src.monthly_series(spark, sf_dir)
    return macro.real_rate(m.filter("series_id = '1-URGENT'"), m.filter("series_id = '2-HIGH'")).select("month", r("real", 4).alias("real"), r("recovered", 4).alias("recovered"))


@query(f"WITH {MONTHLY} SELECT series_id, month, round(CASE WHEN month(month) % 2 = 0 THEN value * 3 ELSE value END, 4) AS value FROM monthly WHERE year(month) < 2000")
def m4_updated(spark, sf_dir):
    m = src.monthly_series(spark, sf_dir)
    return macro.updated(m.filter(F.year("month") < 2000), m.filter(F.month("month") % 2 == 0).withColumn("value", F.col("value") * 3)).withColumn("value", r("value", 4))


@query(
    f"""WITH {MONTHLY}, {_CAL}, g AS (SELECT s.series_id, cal.month, m.value FROM (SELECT DISTINCT series_id FROM monthly) s CROSS JOIN cal LEFT JOIN (SELECT * FROM monthly WHERE month(month) % 3 = 1) m ON m.series_id = s.series_id AND m.month = cal.month)
SELECT series_id, month, round(last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS value FROM g"""
)
def m5_reindexed(spark, sf_dir):
    quarters = src.monthly_series(spark, sf_dir).filter(F.month("month") % 3 == 1)
    return macro.reindexed(quarters, calendar_of(spark)).withColumn("value", r("value", 4))


@query(
    f"""WITH {MONTHLY}, q AS (SELECT series_id, row_number() OVER w - 1 AS q, coalesce(100 * (value - lag(value) OVER w) / value, 0.455) AS value FROM monthly WHERE month(month) % 3 = 1 WINDOW w AS (PARTITION BY series_id ORDER BY month)),
s AS (SELECT series_id, q * 3 + i AS idx, value FROM q CROSS JOIN (SELECT unnest([0, 1, 2]) AS i) WHERE q * 3 + i < 70), v AS ({_savgol_sql(15, 1, 'value', 's', 'series_id', 'idx')}) SELECT series_id, idx, round(v, 5) AS value FROM v"""
)
def m6_rate_feature(spark, sf_dir):
    quarters = src.monthly_series(spark, sf_dir).filter(F.month("month") % 3 == 1)
    return macro.rate_feature(quarters, 0.455, 3, 70).withColumn("value", r("value", 5)).dropna()


@query(
    f"""WITH {BENCH}, m AS (SELECT 'i' AS k, CAST(date_trunc('month', date) AS DATE) AS month, avg(price) AS value FROM bench GROUP BY 2), n AS (SELECT *, row_number() OVER (ORDER BY month) - 1 AS idx FROM m),
v AS ({_savgol_sql(15, 2, 'value', 'n', 'k', 'idx')}) SELECT n.month, n.idx, round(v.v, 4) AS value FROM v JOIN n USING (idx)"""
)
def m7_monthly_mean(spark, sf_dir):
    return macro.monthly_mean(benchmark_of(spark, sf_dir)).withColumn("value", r("value", 4)).dropna()


@query(
    f"""WITH {MONTHLY}, {_CAL}, w AS (SELECT idx, max(CASE WHEN series_id = '1-URGENT' THEN value END) AS a, max(CASE WHEN series_id = '2-HIGH' THEN value END) AS b FROM monthly JOIN idx USING (month) GROUP BY idx HAVING a IS NOT NULL AND b IS NOT NULL)
SELECT idx, round(sum(a + b + idx) OVER f, 2) AS total FROM w WINDOW f AS (ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) QUALIFY min(idx) OVER f = idx - 5"""
)
def m9_macro_windows(spark, sf_dir):
    months = macro.assembled(src.monthly_series(spark, sf_dir), calendar_of(spark), ["1-URGENT", "2-HIGH"])
    return macro.macro_windows(months).select("idx", r(F.aggregate("macro", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query(f"WITH {MOVES} SELECT m.ticker, this, (year(date) - 1995) * 12 + month(date) - 2 AS idx FROM moves m JOIN bars b ON b.ticker = m.ticker AND b.pos = this")
def m10_month_key(spark, sf_dir):
    bars = written_bars(spark, sf_dir)
    dates = bars.select("ticker", F.col("pos").alias("this"), "date")
    return plain_moves(spark, sf_dir, bars).join(dates, ["ticker", "this"]).select("ticker", "this", (macro.month_index(F.col("date"), BASE_YEAR) - 1).alias("idx"))


@query(
    f"""WITH {BENCH}, c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM bench), {BARS}, st AS (SELECT (year(date) - 1995) * 12 + month(date) - 1 AS idx, min(pos) AS start FROM c GROUP BY 1)
SELECT ticker, pos, (SELECT max(idx) FROM st WHERE start <= bars.pos) AS idx FROM bars"""
)
def m11_month_of_position(spark, sf_dir):
    calendar = clean.numbered(benchmark_of(spark, sf_dir).select(F.lit("calendar").alias("ticker"), "date"))
    return macro.month_of_position(bars_of(spark, sf_dir).select("ticker", "pos"), macro.month_starts(calendar, BASE_YEAR))


@query(
    f"""WITH {BENCH}, {_CAL}, c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM bench), st AS (SELECT (year(date) - 1995) * 12 + month(date) - 1 AS idx, min(pos) AS start FROM c GROUP BY 1)
SELECT idx.month, idx.idx, st.start FROM idx LEFT JOIN st USING (idx)"""
)
def m11_start_of_month(spark, sf_dir):
    calendar = clean.numbered(benchmark_of(spark, sf_dir).select(F.lit("calendar").alias("ticker"), "date"))
    return macro.start_of_month(calendar_of(spark), macro.month_starts(calendar, BASE_YEAR))


def _slopes_sql(prices: str, steps: str) -> str:
    """A leg's four quarter slopes, as a list."""
    edge = lambda i: f"(({i}) * ({steps} // 4) + least({i}, {steps} % 4))"
    one = f"100 * ({prices}[{edge('i + 1')} + 1] - {prices}[{edge('i')} + 1]) / ({prices}[1] * ({edge('i + 1')} - {edge('i')}) * {steps})"
    return f"list_transform(range(4), lambda i: {one})"


# The samples' 191 values, as their sum: what belongs to a bar, the legs, the trailing vectors and the macro windows.
_SAMPLES = f"""{_SEGMENTS}, {BENCH}, {MONTHLY}, {_CAL},
m0 AS (SELECT ticker, kind, lag(pos) OVER w AS before, pos AS this, lead(pos) OVER w AS next, row_number() OVER w - 1 AS k FROM labelled WINDOW w AS (PARTITION BY ticker ORDER BY pos)),
mv AS (SELECT m.*, next - this AS gap, 100 * (q.price - p.price) / p.price AS target, p.date AS extremum_date, q.date AS next_date FROM m0 m
 JOIN bars p ON p.ticker = m.ticker AND p.pos = this JOIN bars q ON q.ticker = m.ticker AND q.pos = next WHERE before IS NOT NULL AND next IS NOT NULL),
st AS (SELECT b.ticker, b.pos, b.date, b.volume, b.price / lag(b.price) OVER w - 1 AS x, bench.price / lag(bench.price) OVER w - 1 AS y, b.price - lag(b.price) OVER w AS d
 FROM bars b JOIN bench USING (date) WINDOW w AS (PARTITION BY b.ticker ORDER BY b.pos)),
d0 AS (SELECT ticker, pos, date, CASE WHEN count(x) OVER f1 = 125 THEN covar_samp(x, y) OVER f1 / var_samp(y) OVER f1 END AS beta, count(d) OVER f2 AS nd, sum(greatest(d, 0)) OVER f2 AS gain,
 sum(greatest(-d, 0)) OVER f2 AS loss, CASE WHEN count(volume) OVER f3 = 126 THEN avg(volume) OVER f3 END AS mean_volume FROM st WINDOW f1 AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 124 PRECEDING AND CURRENT ROW),
 f2 AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), f3 AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)),
days AS (SELECT ticker, pos, date, beta, mean_volume, CASE WHEN nd = 13 THEN CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END END AS rsi FROM d0),
sp AS ({_savgol_sql(21, 3, 'price', 'bars', 'ticker', 'pos')}), sv AS ({_savgol_sql(21, 3, 'volume', 'bars', 'ticker', 'pos')}),
pr AS (SELECT ticker, pos // 2 AS j, avg(sp.v) AS price, avg(sv.v) AS volume FROM sp JOIN sv USING (ticker, pos) GROUP BY ALL HAVING count(*) = 2),
ch AS (SELECT ticker, j, 100 * (price - lag(price) OVER w) / lag(price) OVER w AS ret, 100 * (volume - lag(volume) OVER w) / lag(volume) OVER w AS vr FROM pr WINDOW w AS (PARTITION BY ticker ORDER BY j)),
vec AS (SELECT ticker, j, list(ret) OVER f AS rets, list(vr) OVER f AS vrs, sum(ret) OVER f + sum(vr) OVER f AS total FROM ch WINDOW f AS (PARTITION BY ticker ORDER BY j ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) QUALIFY count(ret) OVER f = 63 AND count(vr) OVER f = 63),
base AS (SELECT s.series_id, idx.month, idx.idx, last_value(m.value IGNORE NULLS) OVER (PARTITION BY s.series_id ORDER BY idx.month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
 FROM (SELECT DISTINCT series_id FROM monthly) s CROSS JOIN idx LEFT JOIN monthly m ON m.series_id = s.series_id AND m.month = idx.month),
rt AS (SELECT series_id, row_number() OVER w - 1 AS idx, coalesce(100 * (value - lag(value) OVER w) / value, 0.455) AS value FROM base WINDOW w AS (PARTITION BY series_id ORDER BY month)),
rv AS ({_savgol_sql(15, 1, 'value', 'rt', 'series_id', 'idx')}),
bm AS (SELECT 'i' AS k, CAST(date_trunc('month', date) AS DATE) AS month, avg(price) AS value FROM bench GROUP BY 2), bi AS (SELECT *, row_number() OVER (ORDER BY month) - 1 AS q FROM bm),
bv AS ({_savgol_sql(15, 2, 'value', 'bi', 'k', 'q')}),
wide AS (SELECT idx.idx, [a.value, b.value, c.value, r4.v, r5.v, bv.v, 100 * (a.value - y.value) / y.value, idx.idx] AS vals, a.value + b.value + c.value + r4.v + r5.v + bv.v + 100 * (a.value - y.value) / y.value + idx.idx AS total FROM idx
 JOIN base a ON a.month = idx.month AND a.series_id = '1-URGENT' JOIN base b ON b.month = idx.month AND b.series_id = '2-HIGH' JOIN base c ON c.month = idx.month AND c.series_id = '3-MEDIUM'
 JOIN rv r4 ON r4.idx = idx.idx AND r4.series_id = '4-NOT SPECIFIED' JOIN rv r5 ON r5.idx = idx.idx AND r5.series_id = '5-LOW' JOIN bi ON bi.month = idx.month JOIN bv ON bv.q = bi.q
 JOIN base y ON y.series_id = '1-URGENT' AND idx.month = y.month + INTERVAL 12 MONTH),
win AS (SELECT idx, flatten(list(vals) OVER f) AS macro, sum(total) OVER f AS total FROM wide WINDOW f AS (ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) QUALIFY min(idx) OVER f = idx - 5),
fl AS (SELECT m.ticker, k AS leg, list(CAST(volume AS DOUBLE) ORDER BY pos) AS v, list(price ORDER BY pos) AS p, count(*) AS n FROM mv m JOIN bars b ON b.ticker = m.ticker AND pos BETWEEN before AND this GROUP BY ALL),
rl AS (SELECT m.ticker, k AS leg, list(CAST(volume AS DOUBLE) ORDER BY pos) AS v, list(price ORDER BY pos) AS p FROM mv m JOIN bars b ON b.ticker = m.ticker AND pos BETWEEN this AND next GROUP BY ALL),
sm AS (SELECT mv.*, unnest(range(4, gap + @more)) AS duration, this - before AS fall FROM mv),
rleg AS (SELECT sm.ticker, k * 100000 + duration AS leg, v[1 : duration + 1] AS v, duration + 1 AS n FROM sm JOIN rl ON rl.ticker = sm.ticker AND rl.leg = k),
sample AS (SELECT s.ticker, extremum_date, e.date AS end_date, next_date, duration, target, beta + rsi + (list_max(fl.v) + fb.bend + rb.bend + list_max(rl.v[1 : duration + 1])) / mean_volume + duration + fall
 + (SELECT count(*) FROM bars b WHERE b.ticker = s.ticker) / greatest((SELECT count(*) FROM raw WHERE raw.ticker = s.ticker), 1) + list_sum({_slopes_sql('fl.p', 'fall')}) + list_sum({_slopes_sql('rl.p', 'duration')}) + vec.total + win.total AS total,
 list_concat([beta], {_slopes_sql('rl.p', 'duration')}, {_slopes_sql('fl.p', 'fall')}, [rsi, list_max(fl.v) / mean_volume, fb.bend / mean_volume, rb.bend / mean_volume, list_max(rl.v[1 : duration + 1]) / mean_volume, duration, fall,
 (SELECT count(*) FROM bars b WHERE b.ticker = s.ticker) / greatest((SELECT count(*) FROM raw WHERE raw.ticker = s.ticker), 1)], vec.rets, vec.vrs, win.macro) AS features
 FROM sm s JOIN days e ON e.ticker = s.ticker AND e.pos = this + duration JOIN fl ON fl.ticker = s.ticker AND fl.leg = k JOIN {_bend_sql('n', 'fl')} fb ON fb.ticker = s.ticker AND fb.leg = k
 JOIN rl ON rl.ticker = s.ticker AND rl.leg = k JOIN {_bend_sql('n - 3', 'rleg')} rb ON rb.ticker = s.ticker AND rb.leg = k * 100000 + duration
 JOIN vec ON vec.ticker = s.ticker AND vec.j = (this + duration) // 2 - 2 JOIN win ON win.idx = (year(@keyed) - {BASE_YEAR}) * 12 + month(@keyed) - 2)""".replace("@keyed", "extremum_date")
_PAIRS = "avg(sp.v) AS price, avg(sv.v) AS volume FROM sp JOIN sv USING (ticker, pos)"
_SQL["f8_rough_samples"] = (
    _SAMPLES.replace("@more", "0").replace(_PAIRS, "avg(price) AS price, avg(volume) AS volume FROM bars").replace("(year(extremum_date)", "(year(e.date)").replace("month(extremum_date) - 2", "month(e.date) - 2")
    + " SELECT ticker, extremum_date, end_date, round(target, 6) AS target, round(total, 1) AS sum FROM sample WHERE total IS NOT NULL"
)


_W = "list_transform(range({n}), lambda j: sin(c * 0.37 + {layer} * 1.3 + o * 0.71 + j * 0.29) / sqrt({n}))"


def _network_sql(samples: str, checkpoints: int, widths: tuple[int, ...]) -> str:
    """Common tables net0, net1, ... of samples(key, features) under made_weights: net<last>(key, c, x), x[1] the prediction."""
    out = [f"net0 AS (SELECT key, CAST(c AS INT) AS c, features AS x FROM {samples} CROSS JOIN (SELECT unnest(range(1, {checkpoints + 1})) AS c))"]
    for layer, (n, m) in enumerate(zip(widths, widths[1:])):
        z = "z" if layer == len(widths) - 2 else "CASE WHEN z > 0 THEN z ELSE 0.01 * z END"
        out.append(f"w{layer} AS MATERIALIZED (SELECT c, o, {_W.format(n=n, layer=layer)} AS w, cos(o * 1.1) * 0.01 AS b FROM (SELECT unnest(range(1, {checkpoints + 1})) AS c) CROSS JOIN (SELECT unnest(range({m})) AS o))")
        out.append(f"net{layer + 1} AS MATERIALIZED (SELECT key, c, list({z} ORDER BY o) AS x FROM (SELECT key, h.c, o, list_inner_product(x, w) + b AS z FROM net{layer} h JOIN w{layer} w ON w.c = h.c) GROUP BY key, c)")
    return ", ".join(out)


_SQL["f8_samples"] = _SAMPLES.replace("@more", "0") + " SELECT ticker, extremum_date, end_date, next_date, duration, round(target, 6) AS target, round(total, 1) AS sum FROM sample WHERE total IS NOT NULL"
_SQL["f10_current_rows"] = (
    _SAMPLES.replace("@more", "0")
    + f""", l AS (SELECT ticker, pos, kind, lag(pos) OVER (PARTITION BY ticker ORDER BY pos) AS before, count(*) OVER (PARTITION BY ticker) AS extrema FROM labelled QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pos DESC) = 1),
a AS (SELECT l.ticker, count(*) AS after, arg_min(b.pos, (b.price, b.pos)) AS low, max(b.pos) AS fin FROM l JOIN bars b ON b.ticker = l.ticker AND b.pos > l.pos GROUP BY l.ticker),
u AS (SELECT l.*, low, CASE WHEN kind = 'trough' AND before IS NULL THEN 'too_few_confirmed_extrema' WHEN kind = 'trough' THEN 'confirmed_trough' WHEN coalesce(after, 0) < 5 THEN 'no_recent_low_after_latest_peak'
 WHEN fin - low < 4 THEN 'provisional_trough_has_fewer_than_five_observations' WHEN low - pos < 4 THEN 'provisional_fall_too_short' ELSE 'provisional_recent_low' END AS status FROM l LEFT JOIN a USING (ticker)),
act AS (SELECT ticker, extrema, status, CASE status WHEN 'confirmed_trough' THEN pos WHEN 'provisional_recent_low' THEN low END AS trough FROM u),
newest AS (SELECT ticker, max(pos) AS fin, count(*) AS history, arg_max(date, pos) AS data_date, arg_max(price, pos) AS current_price FROM bars GROUP BY ticker),
now AS (SELECT n.*, status, coalesce(extrema, 0) AS extrema, trough, fin - trough AS duration, p.date AS trough_date, p.price AS trough_price, beta, rsi, vec.total AS past, (year(p.date) - {BASE_YEAR}) * 12 + month(p.date) - 2 AS mi
 FROM newest n LEFT JOIN act USING (ticker) LEFT JOIN bars p ON p.ticker = n.ticker AND p.pos = trough LEFT JOIN days d ON d.ticker = n.ticker AND d.pos = fin LEFT JOIN vec ON vec.ticker = n.ticker AND vec.j = fin // 2 - 2)
SELECT ticker, data_date, trough_date, status AS trough_status, duration, round(beta, 5) AS beta, round(rsi, 5) AS rsi, round(current_price, 6) AS current_price, round(trough_price, 6) AS trough_price,
 round(100 * (current_price - trough_price) / trough_price, 6) AS current_gain, history AS history_days, CASE WHEN history < 400 THEN 'less_than_three_years_history' WHEN extrema < 2 THEN 'too_few_confirmed_extrema'
 WHEN trough IS NULL THEN status WHEN duration < 4 THEN 'trough_has_fewer_than_five_observations' WHEN current_price < trough_price THEN 'current_price_has_broken_below_confirmed_trough' WHEN beta IS NULL THEN 'benchmark_alignment_failed'
 WHEN past IS NULL THEN 'insufficient_smoothed_return_history' WHEN mi NOT IN (SELECT idx FROM win) AND NOT mi BETWEEN (SELECT max(idx) + 1 FROM win) AND 119 THEN 'macro_window_unavailable' END AS reason FROM now"""
)
_SQL["f11_training_panel"] = (
    _SAMPLES.replace("@more", "1") + " SELECT ticker, count(*) AS samples, count(DISTINCT strftime(extremum_date, '%Y%m-%d') || '-' || duration) AS keys, round(avg(target), 6) AS mean_target FROM sample WHERE total IS NOT NULL GROUP BY ticker"
)


# --- normalisation, sampling ---

_X = "x AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))


@query(f"WITH {_X} SELECT CAST(i AS INT) AS i, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END, 6) AS std FROM x GROUP BY i")
def n1_moments(spark, sf_dir):
    one = stats.partial_moments(vectors_of(spark, sf_dir))
    return stats.mean_std(one).select("i", r("mean").alias("mean"), r("std").alias("std"))


@query(_SQL["n1_moments"])
def n2_merged_moments(spark, sf_dir):
    parts = stats.partial_moments(vectors_of(spark, sf_dir), "features", "label")
    return stats.mean_std(stats.merged_moments(parts)).select("i", r("mean").alias("mean"), r("std").alias("std"))


@query(_SQL["n1_moments"])
def n2_recorded_moments(spark, sf_dir):
    """Batches come one by one, the first one wrong and then again: the kept moments are those of all rows."""
    v = saved(vectors_of(spark, sf_dir), "vectors")
    path = shared_path(spark, "moments")
    batch = F.pmod("vec_id", F.lit(3))
    stats.record_moments(spark, path, "0", v.filter(batch > 0))
    for k in (1, 0, 2):
        stats.record_moments(spark, path, str(k), v.filter(batch == k))
    return stats.mean_std(stats.recorded_moments(spark, path)).select("i", r("mean").alias("mean"), r("std").alias("std"))


@query(f"WITH {_X}, m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY i) SELECT vec_id, round(sum((x - m) / s), 5) AS z, round(sum(x), 5) AS back FROM x JOIN m USING (i) GROUP BY vec_id")
def n3_standardised(spark, sf_dir):
    v = vectors_of(spark, sf_dir)
    arrays = stats.as_arrays(stats.mean_std(stats.partial_moments(v)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    z = stats.standardised(v, arrays).withColumn("z", r(total("features"), 5))
    return stats.restored(z, arrays).select("vec_id", "z", r(total("features"), 5).alias("back"))


def _drawn(below: str, *on: str) -> str:
    return f"(('0x' || substr(md5({" || '|' || ".join(on)}), 1, 12))::BIGINT % ({below}))"


@query(f"SELECT draw, vec_id FROM (SELECT range AS draw, {_drawn('(SELECT count(*) FROM embeddings)', 'range', '1')} AS row_id FROM range(1000)) JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_id FROM embeddings) USING (row_id)")
def p1_uniform_sample(spark, sf_dir):
    panel = stats.ranked_rows(vectors_of(spark, sf_dir).select("vec_id"), F.col("vec_id").asc_nulls_last())
    return stats.uniform_sample(panel, 1000, 1).select("draw", "vec_id")


@query(
    f"""WITH {MOVES}, g AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY this) - 1 AS m FROM moves WHERE gap >= 4), t AS (SELECT ticker, count(*) AS moves, row_number() OVER (ORDER BY ticker) - 1 AS t FROM g GROUP BY ticker),
d AS (SELECT range AS draw, {_drawn('(SELECT count(*) FROM t)', 'range', '1')} AS t FROM range(1000)), p AS (SELECT draw, ticker, {_drawn('moves', 'draw', '2')} AS m FROM d JOIN t USING (t))
SELECT draw, ticker, this, 4 + {_drawn('gap - 3', 'draw', '3')} AS duration FROM p JOIN g USING (ticker, m)"""
)
def p2_hierarchical_sample(spark, sf_dir):
    return stats.hierarchical_sample(plain_moves(spark, sf_dir), 1000, 1)


@query("SELECT vec_id, (row_number() OVER (ORDER BY ('0x' || substr(md5(vec_id || '|1'), 1, 12))::BIGINT, vec_id) - 1) // 100 AS batch FROM embeddings")
def p3_shuffled_batches(spark, sf_dir):
    return stats.shuffled_batches(vectors_of(spark, sf_dir).select("vec_id"), 100, 1, "vec_id")


# --- scoring, training ---

_NET = (64, 8, 1)


@query(
    f"""WITH h AS (SELECT vec_id, c, list(CASE WHEN z > 0 THEN z ELSE 0.01 * z END ORDER BY o) AS h FROM (SELECT vec_id, c, o, list_inner_product(embedding::DOUBLE[], {_W.format(n=64, layer=0)}) + cos(o * 1.1) * 0.01 AS z
 FROM embeddings CROSS JOIN (SELECT unnest([1, 2, 3]) AS c) CROSS JOIN (SELECT unnest(range(8)) AS o)) GROUP BY vec_id, c)
SELECT vec_id, CAST(c AS INT) AS checkpoint, round(list_inner_product(h, {_W.format(n=8, layer=1)}) + 0.01, 5) AS prediction FROM (SELECT *, 0 AS o FROM h)"""
)
def t2_scores(spark, sf_dir):
    return model.score(vectors_of(spark, sf_dir), model.made_weights(spark, 3, _NET), ["vec_id"]).withColumn("prediction", r("prediction", 5))


@query(
    f"""{_SAMPLES.replace("@more", "0")}, keyed AS MATERIALIZED (SELECT *, row_number() OVER () AS key FROM sample WHERE total IS NOT NULL), {_network_sql("keyed", 1, LAYERS)}
SELECT ticker, extremum_date, duration, round(target, 6) AS target, c AS checkpoint, round(x[1], 1) AS prediction FROM net{len(LAYERS) - 1} JOIN keyed USING (key)"""
)
def t1_wide_scores(spark, sf_dir):
    """Raw samples: predictions of tens of thousands, given to one digit."""
    out = model.score(sample_table(spark, sf_dir), model.made_weights(spark, 1), ["ticker", "extremum_date", "duration", "target"])
    return out.withColumns({"prediction": r("prediction", 1), "target": r("target")})


def _trainable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors_of(spark, sf_dir).select("vec_id", "features", F.get("features", F.lit(0)).alias("target"))


@query(
    f"""WITH h AS (SELECT vec_id, o, embedding::DOUBLE[] AS x, list_inner_product(embedding::DOUBLE[], {_W.format(n=64, layer=0)}) + cos(o * 1.1) * 0.01 AS z FROM embeddings CROSS JOIN (SELECT unnest(range(8)) AS o) CROSS JOIN (SELECT 1 AS c)),
a AS (SELECT *, CASE WHEN z > 0 THEN z ELSE 0.01 * z END AS a, CASE WHEN z > 0 THEN 1.0 ELSE 0.01 END AS d, sin(0.37 + 1.3 + o * 0.29) / sqrt(8) AS v FROM h),
p AS (SELECT vec_id, 2 * (sum(a * v) + 0.01 - any_value(x[1])) AS delta FROM a GROUP BY vec_id),
g AS (SELECT 0 AS layer, o AS out_idx, j, avg(delta * v * d * x[j + 1]) AS g FROM a JOIN p USING (vec_id) CROSS JOIN (SELECT unnest(range(64)) AS j) GROUP BY ALL UNION ALL SELECT 1, 0, o, avg(delta * a) FROM a JOIN p USING (vec_id) GROUP BY o),
b AS (SELECT 0 AS layer, o AS out_idx, avg(delta * v * d) AS gb FROM a JOIN p USING (vec_id) GROUP BY o UNION ALL SELECT 1, 0, avg(delta) FROM p),
n AS (SELECT sqrt((SELECT sum(g * g) FROM g) + (SELECT sum(gb * gb) FROM b)) AS norm), f AS (SELECT norm, least(1, 1 / (norm + 1e-12)) AS f FROM n)
SELECT CAST(layer AS INT) AS layer, CAST(out_idx AS INT) AS out_idx, round(any_value(s) * any_value(f), 6) AS sum, round(any_value(gb) * any_value(f), 6) AS gb, round(any_value(norm), 6) AS norm
FROM (SELECT layer, out_idx, sum(g) AS s FROM g GROUP BY ALL) JOIN b USING (layer, out_idx) CROSS JOIN f GROUP BY layer, out_idx"""
)
def t3_gradient(spark, sf_dir):
    net = model.collected(model.made_weights(spark, 1, _NET))[1]
    rows = model.clipped(model.gradient_rows(_trainable(spark, sf_dir), net), 1.0)
    return rows.select("layer", "out_idx", r(F.aggregate("g", F.lit(0.0), lambda a, x: a + x)).alias("sum"), r("gb").alias("gb"), r("norm").alias("norm"))


def standard_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training panel, standardised by moments merged over its tickers; a hashed fifth of its moves is held out."""
    panel = saved(sample_table(spark, sf_dir, inclusive=True), "panel")
    arrays = stats.as_arrays(stats.mean_std(stats.merged_moments(stats.partial_moments(panel, "features", "ticker"))))
    held = stats.draw(F.lit(5), "ticker", "extremum_date", 3) == 0
    return saved(stats.standardised(panel, arrays).withColumn("part", F.when(held, "holdout").otherwise("train")), "standard")


def _batched(rows: DataFrame, n: int) -> DataFrame:
    return rows.filter("part = 'train'").withColumn("batch", stats.draw(F.lit(n), "ticker", "extremum_date", "duration", 4))


@query()
def t4_training(spark, sf_dir):
    """An epoch over the panel in eight hashed batches, stopped after four steps and gone on with from the kept weights."""
    rows = standard_panel(spark, sf_dir)
    net = model.collected(model.made_weights(spark, 1))[1]
    path = shared_path(spark, "weights")
    for steps in (4, 8):
        model.train(_batched(rows, 8), rows.filter("part = 'holdout'"), net, steps, rate=0.01, every=2, path=path)
    kept = model.checkpoints(spark, path).read()
    total = F.sum(F.aggregate("w", F.lit(0.0), lambda a, x: a + x) + F.col("bias"))
    return kept.groupBy("step").agg(F.count("*").alias("rows"), r(total, 4).alias("sum"), r(F.max("holdout_error"), 4).alias("holdout_mse"))


@query()
def t5_rate_search(spark, sf_dir):
    """Learning rates tried on all rows, a pass a step; a hashed quarter is held out."""
    rows = _trainable(spark, sf_dir).select("features", "target", F.when(stats.draw(F.lit(4), "vec_id", 6) == 0, "holdout").otherwise("train").alias("part"))
    net = model.collected(model.made_weights(spark, 1, _NET))[1]
    found = model.rate_search(saved(rows, "search"), net, [1e-4, 1e-3, 1e-2])
    return spark.createDataFrame([(x, round(y, 4)) for x, y in found], "rate double, score double")


@query()
def w3_training(spark, sf_dir):
    """Panel, moments, search for a rate, training with kept weights; then every kept network on the moves held out."""
    rows = standard_panel(spark, sf_dir)
    net = model.collected(model.made_weights(spark, 1))[1]
    rate, _ = min(model.rate_search(rows.select("features", "target", "part"), net, [1e-3, 1e-2], steps=4), key=lambda x: x[1])
    path = shared_path(spark, "weights")
    held = rows.filter("part = 'holdout'")
    model.train(_batched(rows, 4), held, net, steps=4, rate=rate, every=2, path=path)
    weights = model.checkpoints(spark, path).read().withColumnRenamed("step", "checkpoint")
    group = F.concat_ws("|", "ticker", "extremum_date", "next_date").alias("group")
    scored = model.score(held.select(group, "features", F.col("target").alias("actual")), weights, ["group", "actual"])
    out = stats.metrics(saved(scored, "scored"), "checkpoint")
    return out.select("checkpoint", "samples", "transitions", r("direction", 4).alias("direction"), r("rmse", 3).alias("rmse"), r("mae", 3).alias("mae"))


# --- evaluation ---

_SAME = "CASE WHEN sign(actual) = sign(prediction) THEN 1.0 ELSE 0.0 END"
_UP, _DOWN = "avg(CAST(prediction > 0 AS INT)) FILTER (actual > 0)", "avg(CAST(prediction <= 0 AS INT)) FILTER (actual <= 0)"
_RANKED = f"""{SCORED}, ranked AS (SELECT *, rank() OVER (PARTITION BY dataset, checkpoint ORDER BY actual) + (count(*) OVER (PARTITION BY dataset, checkpoint, actual) - 1) / 2.0 AS ra,
 rank() OVER (PARTITION BY dataset, checkpoint ORDER BY prediction) + (count(*) OVER (PARTITION BY dataset, checkpoint, prediction) - 1) / 2.0 AS rb FROM scored)"""
_METRICS = f"""SELECT dataset, checkpoint, count(*) AS samples, count(DISTINCT "group") AS transitions, round(avg(CASE WHEN actual > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_target_rate,
 round(avg(CASE WHEN prediction > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_prediction_rate, round(corr(actual, prediction), 6) AS pearson, round(avg({_SAME}), 6) AS direction,
 round({_UP}, 6) AS positive_recall, round({_DOWN}, 6) AS negative_recall, round(({_UP} + {_DOWN}) / 2, 6) AS balanced_direction, round(avg((prediction - actual) ** 2), 5) AS mse, round(sqrt(avg((prediction - actual) ** 2)), 5) AS rmse,
 round(avg(abs(prediction - actual)), 5) AS mae, round(stddev_pop(actual), 5) AS baseline_rmse, round(1 - sum((prediction - actual) ** 2) / (var_pop(actual) * count(*)), 5) AS r_squared,
 round(avg(actual), 5) AS actual_mean, round(avg(prediction), 5) AS prediction_mean, round(corr(ra, rb), 6) AS spearman FROM ranked GROUP BY dataset, checkpoint"""
_SIX = ("positive_target_rate", "positive_prediction_rate", "pearson", "direction", "positive_recall", "negative_recall", "balanced_direction", "spearman")
_FIVE = ("mse", "rmse", "mae", "baseline_rmse", "r_squared", "actual_mean", "prediction_mean")


@query(f"WITH {_RANKED} {_METRICS}")
def v1_metrics(spark, sf_dir):
    out = stats.metrics(scored_of(spark, sf_dir), "dataset", "checkpoint")
    return out.withColumns({c: r(c) for c in _SIX} | {c: r(c, 5) for c in _FIVE})


@query(f"WITH {_RANKED} SELECT dataset, round(corr(actual, prediction), 6) AS pearson FROM scored GROUP BY dataset")
def v3_pearson(spark, sf_dir):
    return scored_of(spark, sf_dir).groupBy("dataset").agg(r(stats.correlation("actual", "prediction")).alias("pearson"))


@query(f"WITH {_RANKED} SELECT dataset, checkpoint, round(corr(ra, rb), 6) AS spearman FROM ranked GROUP BY dataset, checkpoint")
def v4_spearman(spark, sf_dir):
    return stats.spearman(scored_of(spark, sf_dir), "dataset", "checkpoint").withColumn("spearman", r("spearman"))


@query(
    f"""WITH {SCORED}, w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY dataset, checkpoint, "group") AS w FROM scored), m AS (SELECT dataset, checkpoint, sum(w * (prediction - actual) ** 2) / sum(w) AS mse,
 sum(w * abs(prediction - actual)) / sum(w) AS mae, sum(w * {_SAME}) / sum(w) AS dir, sum(w * actual * actual) / sum(w) - (sum(w * actual) / sum(w)) ** 2 AS sst FROM w GROUP BY dataset, checkpoint)
SELECT dataset, checkpoint, round(sqrt(mse), 5) AS weighted_rmse, round(mae, 5) AS weighted_mae, round(dir, 6) AS weighted_direction, round(1 - mse / sst, 5) AS weighted_r_squared FROM m"""
)
def v5_weighted_metrics(spark, sf_dir):
    out = stats.weighted_metrics(scored_of(spark, sf_dir), "dataset", "checkpoint")
    return out.withColumns({c: r(c, 5) for c in ("weighted_rmse", "weighted_mae", "weighted_r_squared")} | {"weighted_direction": r("weighted_direction")})


@query(
    f"""WITH {_RANKED}, t AS ({_METRICS}) SELECT dataset, 'rmse' AS metric, arg_min(checkpoint, (rmse, checkpoint)) AS checkpoint FROM t GROUP BY dataset
UNION ALL SELECT dataset, 'pearson', arg_min(checkpoint, (-pearson, checkpoint)) FROM t GROUP BY dataset UNION ALL SELECT dataset, 'spearman', arg_min(checkpoint, (-spearman, checkpoint)) FROM t GROUP BY dataset"""
)
def v6_best_checkpoints(spark, sf_dir):
    return stats.best_checkpoints(v1_metrics(spark, sf_dir), ["rmse"], ["pearson", "spearman"])


# --- calibration ---


@query(
    "SELECT CASE WHEN l_quantity <= 7 THEN 'very_short_4_7' WHEN l_quantity <= 14 THEN 'short_8_14' WHEN l_quantity <= 28 THEN 'medium_15_28' ELSE 'long_29_plus' END AS duration_class, CASE WHEN l_quantity / 25 < 0.75 THEN 'low_beta' WHEN l_quantity / 25 <= 1.25 THEN 'market_beta' ELSE 'high_beta' END AS beta_class,"
    " CASE WHEN l_quantity * 2 < 30 THEN 'oversold' WHEN l_quantity * 2 <= 70 THEN 'neutral' ELSE 'overbought' END AS rsi_class, count(*) AS n FROM lineitem GROUP BY 1, 2, 3"
)
def k4_classes(spark, sf_dir):
    q = F.col("l_quantity")
    keys = [calibrate.duration_class(q).alias("duration_class"), calibrate.beta_class(q / 25).alias("beta_class"), calibrate.rsi_class(q * 2).alias("rsi_class")]
    return src.table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.count("*").alias("n"))


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors laid out as samples (twice, by 30) with a point and a result."""
    f = F.transform(F.concat("features", "features"), lambda x: x * 30)
    v = vectors_of(spark, sf_dir).select("vec_id", "label", f.alias("features"))
    return v.withColumns({"point": F.get("features", F.lit(1)) / 3, "actual": F.get("features", F.lit(2)) / 3})


_F = "f AS (SELECT vec_id, label, list_transform(list_concat(embedding, embedding)::DOUBLE[], lambda x: x * 30) AS f FROM embeddings)"
_SLOG = "sign({0}) * ln(1 + abs({0}))"
_D12 = [
    "ln(1 + greatest(f[15], 0))", "f[1]", "f[10] / 100", "ln(1 + greatest(f[16], 0))", "ln(1 + greatest(f[17], 0))", "list_stddev_pop(f[18:80])", "list_avg(f[18:80])",
    *(f"ln(1 + abs(f[{i}]))" for i in (11, 12, 13, 14)), _SLOG.format("(f[2] / 3)"),
]


@query(f"WITH {_F} SELECT vec_id, {', '.join(f'round({d}, 5) AS d{i}' for i, d in enumerate(_D12))} FROM f")
def k1_descriptors(spark, sf_dir):
    d = _described(spark, sf_dir).withColumn("d", calibrate.descriptors())
    return d.select("vec_id", *(r(F.get("d", F.lit(i)), 5).alias(f"d{i}") for i in range(calibrate.DESCRIPTORS)))


@query(
    f"""WITH {_F}, b AS (SELECT CASE WHEN label < 3 THEN 1.0 ELSE 2.0 END AS weight, f[3] / 3 AS actual, f[2] / 3 AS point, f[15] AS d FROM f WHERE label IS NOT NULL)
SELECT CASE WHEN d <= 7 THEN 'very_short_4_7' WHEN d <= 14 THEN 'short_8_14' WHEN d <= 28 THEN 'medium_15_28' ELSE 'long_29_plus' END AS "group", count(*) AS cases, CAST(sum(weight) AS DOUBLE) AS weight, round(avg(actual - point), 5) AS residual FROM b WHERE actual > 0 GROUP BY 1"""
)
def k2_calibration_set(spark, sf_dir):
    both = _described(spark, sf_dir)
    cases = calibrate.calibration_set(both.filter("label < 3"), both.filter("label >= 3"))
    return cases.groupBy("group").agg(F.count("*").alias("cases"), F.sum("weight").alias("weight"), r(F.avg("residual"), 5).alias("residual"))


@query(
    f"""WITH {_F}, d AS (SELECT vec_id, unnest(range(12)) AS i, unnest([{', '.join(_D12)}]) AS x FROM f), q AS (SELECT i, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS b FROM d GROUP BY i)
SELECT vec_id, round(sum(i * least(greatest((x - m) / CASE WHEN b > a THEN b - a ELSE 1 END, -8), 8)), 4) AS z FROM d JOIN q USING (i) GROUP BY vec_id"""
)
def k3_scaled(spark, sf_dir):
    d = _described(spark, sf_dir).select("vec_id", calibrate.descriptors().alias("descriptor"))
    z = calibrate.scaled(d, calibrate.robust_scales(d))
    return z.select("vec_id", r(F.aggregate(F.transform("descriptor", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x), 4).alias("z"))


def _cases_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors_of(spark, sf_dir).filter("label is not null")
    residual = F.get("features", F.lit(0)) * 10
    return v.select(F.col("vec_id").alias("case"), F.col("label").cast("string").alias("group"), F.col("features").alias("descriptor"), residual.alias("residual"), F.lit(1.0).alias("weight"))


def _queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return _cases_of(spark, sf_dir).filter(F.col("case") % 50 == 0).select(F.col("case").alias("query"), "group", "descriptor", F.lit(6.0).alias("duration"), F.lit(0.0).alias("point"))


_NEAR = """n0 AS (SELECT q.vec_id AS query, c.vec_id AS "case", list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS d, CAST(c.embedding[1] AS DOUBLE) * 10 AS res FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 50 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, "case") AS rn FROM n0 QUALIFY rn <= 20)"""


@query(f"""WITH {_NEAR} SELECT query, "case", round(d, 5) AS distance FROM near""")
def k5_nearest(spark, sf_dir):
    found = calibrate.nearest_cases(_queries_of(spark, sf_dir), _cases_of(spark, sf_dir), 20)
    return found.select("query", "case", r("distance", 5).alias("distance"))


@query(
    """WITH n0 AS (SELECT q.l_orderkey * 8 + q.l_linenumber AS query, c.l_orderkey * 8 + c.l_linenumber AS "case", sqrt((q.l_quantity - c.l_quantity) ** 2 + (q.l_discount - c.l_discount) ** 2 * 10000 + (q.l_extendedprice - c.l_extendedprice) ** 2 / 1000000) AS d
 FROM x q JOIN x c ON q.l_returnflag = c.l_returnflag WHERE (q.l_orderkey * 8 + q.l_linenumber) % 997 = 0)
SELECT query, "case", round(d, 5) AS distance FROM n0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, "case") <= 20""".replace(
        "WITH ", "WITH x AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount, min(l_extendedprice) AS l_extendedprice, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL), "
    )
)
def k5_nearest_lines(spark, sf_dir):
    """Groups of many cases, found over pivots: for every 997th line of an order, the lines most like it."""
    table = src.table(spark, sf_dir, "lineitem")
    # Flags by their places in order: the least text of a group would have all lines sorted, the least number has not.
    flags = saved(stats.ranked_rows(table.select("l_returnflag").filter("l_returnflag is not null").distinct(), "l_returnflag"), "flags")
    lines = table.join(flags, "l_returnflag", "left").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_quantity", "l_discount", "l_extendedprice", "row_id")))
    near = F.array(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_extendedprice") / 1000)
    cases = lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("case"), F.col("row_id").alias("group"), near.alias("descriptor"), F.lit(0.0).alias("residual"), F.lit(1.0).alias("weight"))
    cases = saved(cases, "lines")
    asked = cases.filter(F.col("case") % 997 == 0).select(F.col("case").alias("query"), "group", "descriptor")
    return calibrate.nearest_cases(asked, cases, 20).select("query", "case", r("distance", 5).alias("distance"))


def _quantile_sql(q: float) -> str:
    return f"""max(CASE WHEN {q} <= p AND lp IS NULL THEN res WHEN {q} > p AND np IS NULL THEN res WHEN p <= {q} AND {q} < np THEN res + ({q} - p) / (np - p) * (nres - res) END)"""


@query(
    f"""WITH {_NEAR}, w AS (SELECT query, d, res, 1 / (0.25 + d) AS w, "case" FROM near), c AS (SELECT *, sum(w) OVER o - w / 2 AS c FROM w WINDOW o AS (PARTITION BY query ORDER BY res, d, "case" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, c / max(c) OVER (PARTITION BY query) AS p FROM c), l AS (SELECT *, lag(p) OVER o AS lp, lead(p) OVER o AS np, lead(res) OVER o AS nres FROM p WINDOW o AS (PARTITION BY query ORDER BY p)),
q AS (SELECT query, {_quantile_sql(0.1)} AS a, {_quantile_sql(0.5)} AS b, {_quantile_sql(0.9)} AS c, min(d) AS nearest FROM l GROUP BY query),
f AS (SELECT query, b + (a - b) * sqrt(14 / 6.0) AS lower, b AS expected, b + (c - b) * sqrt(14 / 6.0) AS upper, nearest FROM q)
SELECT f.query, round(lower, 4) AS lower, round(expected, 4) AS expected, round(upper, 4) AS upper, round(nearest, 4) AS nearest, round(sum(w) FILTER (res >= lower) / sum(w), 5) AS lower_coverage, round(sum(w) FILTER (res <= upper) / sum(w), 5) AS upper_coverage
FROM f JOIN w USING (query) GROUP BY ALL"""
)
def k6_intervals(spark, sf_dir):
    q = _queries_of(spark, sf_dir)
    out = calibrate.intervals(calibrate.nearest_cases(q, _cases_of(spark, sf_dir), 20), q)
    return out.select("query", *(r(c, 4).alias(c) for c in ("lower", "expected", "upper", "nearest")), *(r(c, 5).alias(c) for c in ("lower_coverage", "upper_coverage")))


def predicted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a prediction, an id, and the side of the history boundary they fall on."""
    s = saved(sample_table(spark, sf_dir), "samples")
    arrays = stats.as_arrays(stats.mean_std(stats.partial_moments(s)))
    weights = model.made_weights(spark, 1)
    keep = ["ticker", "extremum_date", "duration", "target"]
    z = model.score(stats.standardised(s, arrays), weights, keep).withColumnRenamed("prediction", "point").drop("checkpoint", "target")
    key = F.xxhash64("ticker", "extremum_date", "duration")
    out = s.join(z, ["ticker", "extremum_date", "duration"]).select(key.alias("id"), "ticker", "extremum_date", "features", F.col("target").alias("actual"), (F.col("point") * 10 + 10).alias("point"))
    return saved(out, "predicted")


@query()
def k9_coverage_audit(spark, sf_dir):
    s = predicted_samples(spark, sf_dir)
    return calibrate.coverage_audit(s.filter(F.col("extremum_date") < HISTORY), s.filter(F.col("extremum_date") >= HISTORY))


# --- ranking ---

_CAND = f"""{BARS}, c0 AS (SELECT ticker, count(*) AS history, arg_max(price, date) AS current_price, min(price) AS trough_price, avg(price) AS ap FROM bars GROUP BY ticker),
c1 AS (SELECT *, 100 * (current_price - trough_price) / trough_price AS gain, ap / 1000 - 20 AS lo, ap / 800 AS ex, ap / 700 - 10 AS hi, history % 7 AS dist FROM c0),
c2 AS (SELECT *, greatest(lo, gain) AS lower, greatest(ex, gain) AS expected FROM c1), c3 AS (SELECT *, greatest(hi, expected) AS upper FROM c2),
c4 AS (SELECT *, 100 * (trough_price * (1 + lower / 100) / current_price - 1) AS lr, 100 * (trough_price * (1 + expected / 100) / current_price - 1) AS er, 100 * (trough_price * (1 + upper / 100) / current_price - 1) AS ur FROM c3),
c5 AS (SELECT *, history % 2 = 0 AS trained, 1.0 / (1 + greatest(dist, 0)) * least(history / 2520, 1.0) * CASE WHEN history % 2 = 0 THEN 1.0 ELSE 0.85 END * CASE WHEN history % 3 = 0 THEN 1.0 ELSE 0.78 END AS sure FROM c4),
cand AS (SELECT *, lr + 0.35 * er - 0.18 * greatest(ur - lr, 0) + 4 * sure AS score, CASE WHEN history < 1260 OR dist > 4 THEN 'low' WHEN NOT trained OR dist > 2.5 THEN 'medium' ELSE 'high' END AS reliability FROM c5)"""


def candidates_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_of(spark, sf_dir)
    c = b.groupBy("ticker").agg(F.count("*").alias("history"), F.max_by("price", "date").alias("current_price"), F.min("price").alias("trough_price"), F.avg("price").alias("ap"))
    gain = 100 * (F.col("current_price") - F.col("trough_price")) / F.col("trough_price")
    c = c.withColumns({"current_gain": gain, "lower": F.col("ap") / 1000 - 20, "expected": F.col("ap") / 800, "upper": F.col("ap") / 700 - 10, "dist": F.col("history") % 7, "trained": F.col("history") % 2 == 0})
    c = rank.path_constrained(c)
    sure = rank.confidence(F.col("history"), F.col("dist"), F.col("trained"), F.col("history") % 3 == 0)
    c = c.withColumns({"sure": sure, "reliability": rank.reliability(F.col("history"), F.col("dist"), F.col("trained"))})
    return c.withColumn("rank_score", rank.rank_score(F.col("lower_remaining"), F.col("expected_remaining"), F.col("width"), F.col("sure")))


@query(f"WITH {_CAND} SELECT ticker, round(lower, 5) AS lower, round(expected, 5) AS expected, round(upper, 5) AS upper, round(lr, 5) AS lower_remaining, round(ur - lr, 5) AS width, reliability, round(sure, 6) AS sure, round(score, 5) AS rank_score FROM cand")
def q1_candidates(spark, sf_dir):
    c = candidates_of(spark, sf_dir)
    return c.select("ticker", *(r(x, 5).alias(x) for x in ("lower", "expected", "upper", "lower_remaining", "width", "rank_score")), "reliability", r("sure").alias("sure"))


@query(f"WITH {_CAND}, l AS (SELECT n_name || '.' || s_suppkey AS symbol, n_name, s_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 2 = 0) SELECT c.ticker, l.s_name AS company, l.r_name AS sector, c.history > 1000 AS trained FROM cand c JOIN l ON l.n_name = c.ticker")
def q5_enriched(spark, sf_dir):
    listed = src.listed_suppliers(spark, sf_dir).filter("cast(split_part(symbol, '.', -1) as int) % 2 = 0").select(F.col("sub_industry").alias("market_symbol"), "security", "sector")
    c = candidates_of(spark, sf_dir).drop("trained")
    return rank.enriched(c, listed, c.filter("history > 1000")).select("ticker", "company", "sector", "trained")


@query(f"WITH {_CAND} SELECT ticker, row_number() OVER (ORDER BY score DESC, lr DESC, er DESC, ticker) AS rank FROM cand")
def q6_ranked(spark, sf_dir):
    return rank.ranked(candidates_of(spark, sf_dir)).select("ticker", "rank")


@query(f"WITH {_CAND} SELECT ticker, round(lr, 5) AS lower_remaining FROM cand ORDER BY lr DESC, er DESC, ticker LIMIT 10")
def q6_top(spark, sf_dir):
    return rank.top(candidates_of(spark, sf_dir), 10, "bounds").select("ticker", r("lower_remaining", 5).alias("lower_remaining"))


@query(
    f"""WITH {BARS}, h AS (SELECT ticker, count(*) AS n FROM bars GROUP BY ticker), x AS (SELECT n_name AS ticker, CASE WHEN h.n IS NULL THEN 'missing_cache' WHEN h.n < 1500 THEN 'less_than_three_years_history' END AS reason FROM nation LEFT JOIN h ON n_name = h.ticker)
SELECT reason, count(*) AS n, string_agg(ticker, ', ' ORDER BY ticker) AS tickers, CASE reason WHEN 'missing_cache' THEN 'Market Data is lacking' ELSE 'Historical Data is lacking' END AS message FROM x WHERE reason IS NOT NULL GROUP BY reason"""
)
def q7_exclusions(spark, sf_dir):
    universe = src.table(spark, sf_dir, "nation").select(F.col("n_name").alias("ticker"))
    h = bars_of(spark, sf_dir).groupBy("ticker").agg(F.count("*").alias("n"))
    return rank.exclusion_report(rank.exclusions(universe, h.select("ticker", F.when(F.col("n") < 1500, features.SHORT_HISTORY).alias("reason"))))


@query()
def w2_ranking(spark, sf_dir):
    """Current rows as of each quarter's end, scored, bounded by their nearest past cases, ranked over all quarters."""
    past = predicted_samples(spark, sf_dir)
    now = saved(current_of(spark, sf_dir, QUARTERS).filter("reason is null"), "current")
    arrays = stats.as_arrays(stats.mean_std(stats.partial_moments(past)))
    point = model.score(stats.standardised(now, arrays), model.made_weights(spark, 1), ["ticker"]).select("ticker", (F.col("prediction") * 10 + 10).alias("point"))
    now = now.join(point, "ticker").withColumn("query", F.xxhash64("ticker"))
    old = past.select("id", "features", "actual", "point")
    cases = saved(calibrate.calibration_set(old, old.limit(0)).withColumn("case", F.col("id")), "cases")
    scales = calibrate.robust_scales(cases)
    asked = now.withColumns({"descriptor": calibrate.descriptors(), "group": calibrate.duration_class(F.col("duration"))})
    asked = calibrate.scaled(asked, scales)
    bands = calibrate.intervals(calibrate.nearest_cases(asked, calibrate.scaled(cases, scales)), asked.withColumn("duration", F.col("duration").cast("double"))).drop("point")
    rows = rank.path_constrained(now.join(bands, "query").withColumn("trained", F.lit(True)))
    sure = rank.confidence(F.col("history_days"), F.col("nearest"), F.col("trained"), F.col("trough_status") == "confirmed_trough")
    rows = rows.withColumns({"sure": sure, "reliability": rank.reliability(F.col("history_days"), F.col("nearest"), F.col("trained"))})
    rows = rows.withColumn("rank_score", rank.rank_score(F.col("lower_remaining"), F.col("expected_remaining"), F.col("width"), F.col("sure")))
    return rank.ranked(rows).select("rank", "ticker", "trough_status", "duration", r("lower", 4).alias("lower"), r("expected", 4).alias("expected"), r("upper", 4).alias("upper"), "reliability", r("rank_score", 4).alias("rank_score"))


@query(
    f"""{_SAMPLES.replace("@more", "0")}, keyed0 AS MATERIALIZED (SELECT *, row_number() OVER () AS key FROM sample WHERE total IS NOT NULL),
ft AS MATERIALIZED (SELECT key, unnest(range({LAYERS[0]})) AS i, unnest(features) AS v FROM keyed0), fm AS (SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS s FROM ft GROUP BY i),
zs AS MATERIALIZED (SELECT key, list((v - m) / s ORDER BY i) AS features FROM ft JOIN fm USING (i) GROUP BY key), {_network_sql("zs", 7, LAYERS)},
scored AS MATERIALIZED (SELECT CASE WHEN extremum_date < DATE '{HISTORY}' THEN 'original' ELSE 'holdout' END AS dataset, c AS checkpoint, concat_ws('|', ticker, extremum_date, next_date) AS "group", target AS actual, x[1] AS prediction
 FROM net{len(LAYERS) - 1} JOIN keyed0 USING (key)), {_RANKED.removeprefix(SCORED + ", ").replace("ranked", "placed")}, basic AS ({_METRICS.replace("FROM ranked", "FROM placed")}),
w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY dataset, checkpoint, "group") AS w FROM scored), wm AS (SELECT dataset, checkpoint, round(sqrt(sum(w * (prediction - actual) ** 2) / sum(w)), 4) AS weighted_rmse,
 round(sum(w * {_SAME}) / sum(w), 4) AS weighted_direction FROM w GROUP BY dataset, checkpoint)
SELECT dataset, checkpoint, samples, transitions, {", ".join(f"round({c}, 4) AS {c}" for c in ("pearson", "spearman", "direction"))}, {", ".join(f"round({c}, 3) AS {c}" for c in ("rmse", "mae", "r_squared"))}, weighted_rmse, weighted_direction FROM basic JOIN wm USING (dataset, checkpoint)"""
)
def w1_checkpoints(spark, sf_dir):
    """Holdout samples under seven checkpoints, all metrics, by dataset."""
    s = saved(sample_table(spark, sf_dir), "samples").withColumn("dataset", F.when(F.col("extremum_date") < HISTORY, "original").otherwise("holdout"))
    arrays = stats.as_arrays(stats.mean_std(stats.partial_moments(s)))
    z = stats.standardised(s.withColumn("group", F.concat_ws("|", "ticker", "extremum_date", "next_date")), arrays)
    scored = model.score(z, model.made_weights(spark, 7), ["dataset", "group", "target"]).withColumnRenamed("target", "actual")
    scored = saved(scored, "scored")
    out = stats.metrics(scored, "dataset", "checkpoint").join(stats.weighted_metrics(scored, "dataset", "checkpoint"), ["dataset", "checkpoint"])
    return out.select("dataset", "checkpoint", "samples", "transitions", *(r(r(c), 4).alias(c) for c in ("pearson", "spearman", "direction")), *(r(r(c, 5), 3).alias(c) for c in ("rmse", "mae", "r_squared")), *(r(c, 4).alias(c) for c in ("weighted_rmse", "weighted_direction")))


# --- streaming ---

_TICKS = """t AS (SELECT event_type AS key, CAST(ts AS DATE) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS ticks FROM events GROUP BY event_type, CAST(ts AS DATE))"""


@query(f"WITH {_TICKS} SELECT key, date, open, high, low, close, ticks, round((open + high + low + close) / 4, 6) AS price FROM t WHERE date < (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) FROM events)")
def st1_daily_bars(spark, sf_dir):
    """A stream over the events table; a day closes when the watermark, one day behind, passes its end."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir, "events"))
    path = shared_path(spark, "stream")
    q = ticks.keep_bars(stream, path + "/bars", path + "/state", key="event_type", tie="event_id")
    q.awaitTermination()
    return spark.read.parquet(path + "/bars").select("key", "date", "open", "high", "low", "close", "ticks", r("price").alias("price"))


_OPEN = _TICKS.replace("count(*) AS ticks", "count(*) AS ticks, sum(value) AS volume")


@query(
    f"WITH {_OPEN} SELECT key, date, open, high, low, close, ticks, round(volume, 4) AS volume, round((open + high + low + close) / 4, 6) AS price,"
    " date + INTERVAL 1 DAY > (SELECT max(ts) - INTERVAL 1 DAY FROM events) AS provisional FROM t"
)
def st1_open_days(spark, sf_dir):
    """The stream in three pieces, stopped and started again between them: bars of days still open are there, and change."""
    events = src.table(spark, sf_dir, "events")
    path = shared_path(spark, "open-days")
    edges = events.agg(F.percentile_approx("ts", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("x")).first()["x"]
    piece = F.when(F.col("ts") <= edges[0], 0).when(F.col("ts") <= edges[1], 1).otherwise(2)
    for k in range(3):
        events.filter(piece == k).write.mode("append").parquet(path + "/ticks")
        stream = spark.readStream.schema(events.schema).parquet(path + "/ticks")
        ticks.keep_open_bars(stream, path + "/bars", path + "/state", key="event_type", tie="event_id").awaitTermination()
    out = ticks.present_bars(spark, path + "/bars")
    return out.select("key", "date", "open", "high", "low", "close", "ticks", r("volume", 4).alias("volume"), r("price").alias("price"), "provisional")


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder that a file stream can watch: the table written once more."""
    path = shared_path(spark, name)
    spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(path)
    return path
