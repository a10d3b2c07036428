"""Ranking current candidates, and reporting those left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.operators.stats import ranked_rows


def path_constrained(rows: DataFrame) -> DataFrame:
    """Bounds no lower than the gain so far, upper no lower than expected; prices and what is left of the way."""
    out = rows.withColumn("lower", F.greatest("lower", "current_gain")).withColumn("expected", F.greatest("expected", "current_gain"))
    out = out.withColumn("upper", F.greatest("upper", "expected"))
    for name in ("lower", "expected", "upper"):
        out = out.withColumn(f"{name}_price", F.col("trough_price") * (1 + F.col(name) / 100))
        out = out.withColumn(f"{name}_remaining", 100 * (F.try_divide(f"{name}_price", "current_price") - 1))
    return out.withColumn("width", F.col("upper_remaining") - F.col("lower_remaining"))


def reliability(history: Column, distance: Column, trained: Column) -> Column:
    return F.when((history < 1260) | (distance > 4), "low").when(~trained | (distance > 2.5), "medium").otherwise("high")


def confidence(history: Column, distance: Column, trained: Column, confirmed: Column) -> Column:
    near = 1 / (1 + F.greatest(distance, F.lit(0.0)))
    return near * F.least(history / 2520, F.lit(1.0)) * F.when(trained, 1.0).otherwise(0.85) * F.when(confirmed, 1.0).otherwise(0.78)


def rank_score(lower: Column, expected: Column, width: Column, sure: Column) -> Column:
    return lower + 0.35 * expected - 0.18 * F.greatest(width, F.lit(0.0)) + 4 * sure


def enriched(rows: DataFrame, listed: DataFrame, trained: DataFrame) -> DataFrame:
    """Company and sector by symbol, and whether the ticker was in training. Both lists are broadcast by their size only."""
    flag = trained.select("ticker", F.lit(True).alias("_t")).distinct()
    info = listed.select(F.col("market_symbol").alias("ticker"), F.col("security").alias("company"), "sector")
    out = rows.join(info, "ticker").join(flag, "ticker", "left")
    return out.withColumn("trained", F.coalesce("_t", F.lit(False))).drop("_t")


#: Sort columns, all descending, of the present and the older rankings.
ORDERS = {"score": ("rank_score", "lower_remaining", "expected_remaining"), "bounds": ("lower_remaining", "expected_remaining")}


def ranked(rows: DataFrame, order: str = "score") -> DataFrame:
    """rank 1 ... n, equal rows by ticker, without gathering the rows in one task."""
    keys = {f"_{i}": -F.col(c) for i, c in enumerate(ORDERS[order])}
    return ranked_rows(rows.withColumns(keys), *keys, "ticker").withColumn("rank", F.col("row_id") + 1).drop("row_id", *keys)


def top(rows: DataFrame, n: int = 25, order: str = "score") -> DataFrame:
    return rows.orderBy(*(F.desc(c) for c in ORDERS[order]), "ticker").limit(n)


#: The reason of tickers without bars, and what users are told (fixed values).
NO_BARS = "missing_cache"
MESSAGES = {
    "download_failed": "Market Data is lacking",
    "missing_cache": "Market Data is lacking",
    "less_than_three_years_history": "Historical Data is lacking",
    "macro_window_unavailable": "Macro Data is lacking",
    "benchmark_alignment_failed": "Benchmark Data is lacking",
    "insufficient_smoothed_return_history": "Return History Data is lacking",
    "nonfinite_feature": "Usable Feature Data is lacking",
    "no_recent_low_after_latest_peak": "Recent trough setup is lacking",
    "provisional_trough_has_fewer_than_five_observations": "Recent trough setup is too new",
    "provisional_fall_too_short": "Recent trough setup is too shallow in time",
}


def exclusions(universe: DataFrame, candidates: DataFrame) -> DataFrame:
    """(ticker, reason) of every ticker of the universe without a candidate row of its own."""
    why = candidates.filter("reason is not null").select("ticker", "reason")
    absent = universe.join(candidates, "ticker", "left_anti").select("ticker", F.lit(NO_BARS).alias("reason"))
    return why.union(absent)


def exclusion_report(excluded: DataFrame) -> DataFrame:
    """Per reason: number and names, in order, and the message for users, where the reason has one."""
    lists = excluded.groupBy("reason").agg(F.count("*").alias("n"), F.concat_ws(", ", F.array_sort(F.collect_list("ticker"))).alias("tickers"))
    said = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))
    return lists.withColumn("message", F.try_element_at(said, "reason"))
