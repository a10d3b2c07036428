"""Market operators: SQL twins over the driver's tables, and awkward bars."""

import math
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.functions import kernels
from driftmark.operators import clean, extrema, features, macro, model, series, stats
from driftmark.plans import market

SF = "/root/testdata/sf0.001"
SQL = market.oracle_sql()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, sql, name):
    got = market.queries()[name](spark, SF)
    cols = sorted(got.columns)
    mine = sorted((tuple(map(plain, r)) for r in got.select(*cols).collect()), key=str)
    want = sql.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({SQL[name]})").fetchall()
    assert mine == sorted((tuple(map(plain, r)) for r in want), key=str)


def walk(n, seed=0):
    return (100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.03, n)))).tolist()


def bars(spark, prices, ticker="A", volume=None):
    volume = volume or [10.0 + i % 7 for i in range(len(prices))]
    rows = [(ticker, i, float(p), float(v)) for i, (p, v) in enumerate(zip(prices, volume))]
    df = spark.createDataFrame(rows, "ticker string, pos int, price double, volume double")
    return df.selectExpr("*", "date_add(date'1995-01-02', pos) AS date", "price * 0.5 + pos AS bench")


def test_smoothing_is_the_kernel(spark):
    p = walk(60)
    got = [r["v"] for r in series.smoothed(bars(spark, p), ["price"], 21, 3).select("pos", F.col("price").alias("v")).orderBy("pos").collect()]
    assert np.allclose(got, kernels.savgol(np.array(p), 21, 3))
    short = series.smoothed(bars(spark, p[:20]), ["price"], 21, 3).select(F.col("price").alias("v")).collect()
    assert all(r["v"] is None for r in short)


def test_segment_extrema_do_not_depend_on_partitions(spark):
    p = walk(1000)
    want = set()
    for split in extrema.SPLITS:
        for part in np.array_split(np.arange(1000), split):
            x = np.array(p)[part]
            for sign, kind in ((1, "peak"), (-1, "trough")):
                want |= {(int(part[i]), kind) for i in kernels.find_peaks(sign * x, 5, 0.05 * x.mean())}
    for n in (1, 7):
        got = extrema.segment_extrema(bars(spark, p).repartition(n)).collect()
        assert {(r["pos"], r["kind"]) for r in got} == want


def test_spacing_drops_the_earlier(spark):
    rows = [("A", i, "peak") for i in (126, 127, 130, 133, 140)]
    got = extrema.spaced(spark.createDataFrame(rows, "ticker string, pos int, kind string")).collect()
    assert sorted(r["pos"] for r in got) == [133, 140]


@pytest.mark.parametrize("tail,status", [([9, 8, 7, 6], extrema.NO_LOW), ([9, 8, 7, 8, 6, 7, 8], extrema.LATE_LOW), ([9, 3, 4, 5, 6, 7, 8, 9], extrema.SHORT_FALL), ([9, 8, 7, 6, 5, 6, 7, 8, 9], "provisional_recent_low")])
def test_active_trough(spark, tail, status):
    b = bars(spark, [5.0] * 3 + [10.0] + tail)
    e = spark.createDataFrame([("A", 1, "trough"), ("A", 3, "peak")], "ticker string, pos int, kind string")
    assert extrema.active_trough(e, b).first()["status"] == status


def test_quarter_slopes_telescope(spark):
    p = walk(30, 3)
    for steps in (4, 5, 6, 7, 10, 23):
        d = np.diff(p[: steps + 1]) / p[0] * 100
        want = [q.mean() / steps for q in np.array_split(d, 4)]
        row = spark.createDataFrame([(p, steps)], "p array<double>, n int")
        got = row.select(*features.quarter_slopes(row["p"], row["n"])).first()
        assert np.allclose(list(got), want)


def test_rsi_and_beta_at_the_edges(spark):
    b = bars(spark, [float(i + 1) for i in range(140)])
    r = {x["pos"]: x["rsi"] for x in features.rsi(b).collect()}
    assert r[12] is None and r[13] == 100.0
    flat = b.selectExpr("ticker", "pos", "price", "1.0D AS bench")
    assert all(x["beta"] is None for x in features.beta(flat).collect())


def test_bad_bars_and_gaps(spark):
    rows = [("A", "2000-01-03", 1.0, 5.0), ("A", "2000-01-04", None, 5.0), ("A", "2000-01-05", 2.0, 0.0), ("B", "2000-01-03", float("nan"), 1.0), ("C", "2000-01-06", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, date string, price double, volume double").selectExpr("ticker", "to_date(date) AS date", "price", "volume")
    assert clean.good_bars(df).count() == 3
    assert [r["ticker"] for r in clean.usable_tickers(df).collect()] == ["C"]
    bench = spark.createDataFrame([("2000-01-04", 7.0)], "date string, price double").selectExpr("to_date(date) AS date", "price")
    got = {(r["ticker"], str(r["date"])): r["bench"] for r in clean.align_benchmark(df, bench).collect()}
    assert got[("A", "2000-01-03")] == got[("A", "2000-01-05")] == 7.0 and got[("C", "2000-01-06")] is None
    empty = df.limit(0)
    assert clean.numbered(empty).count() == clean.usable_tickers(empty).count() == 0


def test_contract_violations(spark):
    b = bars(spark, walk(5))
    moments = spark.createDataFrame([(0, 1.0, 1.0), (1, float("nan"), 1.0), (2, 0.0, 0.0)], "i int, mean double, std double")
    m = spark.createDataFrame([(1.0,), (None,)], "value double")
    got = {r["check"]: r["violations"] for r in clean.contract_violations(b, b.filter("pos > 1"), moments, m, 191).collect()}
    assert got == {"benchmark covers calendar": 2, "mean and deviation are finite, deviation above 0": 2, "macro is finite": 1, "moments are complete": 188}


def test_merged_moments_equal_whole(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 3)) * [1, 5, 0] + [1e3, 0, 4]
    df = spark.createDataFrame([(int(i % 7), r.tolist()) for i, r in enumerate(x)], "b int, features array<double>")
    got = stats.mean_std(stats.merged_moments(stats.partial_moments(df, "features", "b"))).orderBy("i").collect()
    assert np.allclose([r["mean"] for r in got], x.mean(axis=0)) and np.allclose([r["std"] for r in got], [x[:, 0].std(), x[:, 1].std(), 1])


def test_metrics_with_ties_and_constants(spark):
    rows = [("a", "g1", 1.0, 2.0), ("a", "g1", 1.0, 2.0), ("a", "g2", 3.0, 1.0), ("b", "g1", 2.0, 1.0), ("b", "g2", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "dataset string, group string, actual double, prediction double")
    got = {r["dataset"]: r for r in stats.metrics(df, "dataset").collect()}
    assert got["a"]["negative_recall"] is None and got["a"]["balanced_direction"] == 1.0 and np.isclose(got["a"]["spearman"], -1)
    assert got["b"]["pearson"] is None and got["b"]["r_squared"] is None and got["b"]["spearman"] is None


def test_metrics_by_group_shuffle_keys_alone_and_keep_null_ones(spark, sql):
    """Rows of each group carry no sums through a shuffle, ranks are not joined to actual values, and null keys, nulls and
    ties are ranked as SQL ranks them."""
    rng = np.random.default_rng(9)
    rows = [((None, "a", "b")[i % 3], i % 2, int(rng.integers(0, 40)), float(rng.integers(0, 60)), float(rng.integers(-9, 9))) for i in range(900)]
    rows += [("b", 0, 1, None, 3.0), ("b", 0, 2, 4.0, None), ("b", 0, 2, None, None)]
    df = spark.createDataFrame(rows, "dataset string, checkpoint int, group int, actual double, prediction double").repartition(5)
    out = stats.metrics(df, "dataset", "checkpoint")
    plan = out._jdf.queryExecution().executedPlan().toString()
    aggregates = re.findall(r"HashAggregate\(keys=\[([^\]]*)\], functions=\[([^\]]*)\]", plan)
    assert any("group#" in k for k, _ in aggregates) and not any("group#" in k and f for k, f in aggregates)
    ranked = market._RANKED.split(", ranked AS ")[1]
    data = ", ".join(str(tuple("NULL" if x is None else x for x in r)).replace("'NULL'", "NULL") for r in rows)
    want = sql.sql(f"""WITH scored(dataset, checkpoint, "group", actual, prediction) AS (VALUES {data}), ranked AS {ranked}
        SELECT dataset, checkpoint, count(DISTINCT "group"), round(corr(ra, rb), 9) FROM ranked GROUP BY dataset, checkpoint""").fetchall()
    got = [(r["dataset"], r["checkpoint"], r["transitions"], round(r["spearman"], 9)) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 6


def test_recalls_tell_above_zero_from_not_above_zero(spark):
    """A prediction of 0 for a fall, or of a fall for 0, is no rise and so a hit."""
    pairs = [(-1.0, 0.0), (0.0, -1.0), (0.0, 0.0), (-2.0, 3.0), (1.0, 0.0), (2.0, 4.0)]
    df = spark.createDataFrame([("a", "g", a, p) for a, p in pairs], "dataset string, group string, actual double, prediction double")
    got = stats.metrics(df, "dataset").first()
    assert got["negative_recall"] == 0.75 and got["positive_recall"] == 0.5 and got["balanced_direction"] == 0.625
    assert np.isclose(got["direction"], 2 / 6)


def test_last_extremum_must_be_a_trough_in_the_older_version(spark):
    b = bars(spark, walk(60))
    turns = spark.createDataFrame([("A", 20, "trough"), ("A", 40, "peak")], "ticker string, pos int, kind string")
    assert extrema.active_trough(turns, b, provisional=False).first()["status"] == extrema.LAST_IS_PEAK
    assert extrema.active_trough(turns.limit(1).union(turns.filter("false")), b, provisional=False).first()["status"] == "too_few_confirmed_extrema"


def test_samples_are_draws_of_the_panel(spark):
    moves = spark.createDataFrame([("A", 10, 9), ("A", 30, 4), ("B", 5, 20), ("B", 40, 3)], "ticker string, this int, gap int")
    got = stats.hierarchical_sample(moves, 500, 1).collect()
    assert len(got) == 500 and {(r["ticker"], r["this"]) for r in got} == {("A", 10), ("A", 30), ("B", 5)}
    assert {r["duration"] for r in got if r["this"] == 30} == {4} and {r["duration"] for r in got if r["this"] == 10} == set(range(4, 10))
    panel = stats.ranked_rows(moves, "ticker", "this")
    assert sorted(r["row_id"] for r in panel.collect()) == [0, 1, 2, 3]
    sizes = stats.shuffled_batches(spark.range(1003), 100, 1, "id").groupBy("batch").count().collect()
    assert sorted(r["count"] for r in sizes) == [3] + [100] * 10


def test_month_windows_need_every_month(spark):
    months = spark.createDataFrame([(i, [float(i)]) for i in (0, 1, 2, 3, 4, 5, 6, 8, 9)], "idx int, values array<double>")
    got = {r["idx"]: r["macro"] for r in macro.macro_windows(months).collect()}
    assert set(got) == {5, 6} and got[5] == [x for i in range(6) for x in (float(i), float(i))]


def trainable(spark, n=120):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((n, 5))
    y = np.where(x[:, 0] > 0, 2 * x[:, 0], -x[:, 1]) + 0.1 * rng.standard_normal(n)
    rows = [(i, i % 3, v.tolist(), float(t), "holdout" if i % 4 == 0 else "train") for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, batch int, features array<double>, target double, part string").repartition(3), x, y


def net(spark):
    return model.collected(model.made_weights(spark, 1, (5, 4, 1)))[1]


def test_training_goes_on_from_kept_weights(spark, tmp_path):
    df, _, _ = trainable(spark)
    held = df.filter("part = 'holdout'")
    whole, log = model.train(df, held, net(spark), 7, rate=0.05, every=2)
    path = f"file://{tmp_path}/weights"
    model.train(df, held, net(spark), 4, rate=0.05, every=2, path=path)
    parts, again = model.train(df, held, net(spark), 7, rate=0.05, every=2, path=path)
    assert [s for s, _ in again] == [s for s, _ in log] == [2, 4, 6, 7] and np.allclose([e for _, e in again], [e for _, e in log])
    assert all(np.allclose(a, c) and np.allclose(b, d) for (a, b), (c, d) in zip(whole, parts))
    table = model.checkpoints(spark, path)
    assert table.read().groupBy("step").count().collect() and {r["count"] for r in table.read().groupBy("step").count().collect()} == {5}
    version = table.version()
    model.train(df, held, net(spark), 7, rate=0.05, every=2, path=path)
    assert table.version() == version  # nothing is left to do


def test_rate_search_against_plain_steps(spark):
    df, x, y = trainable(spark)
    t = np.arange(len(y)) % 4 > 0
    want = []
    for rate in (1e-3, 1e-2):
        layers, errors = net(spark), []
        for _ in range(6):
            g = [(a / t.sum(), b / t.sum()) for a, b in kernels.gradients(x[t], y[t], layers)]
            f = min(1.0, 1 / (math.sqrt(sum((a * a).sum() + (b * b).sum() for a, b in g)) + 1e-12))
            layers = [(w - rate * f * a, b - rate * f * c) for (w, b), (a, c) in zip(layers, g)]
            errors.append(((kernels.forward(x[~t], layers) - y[~t]) ** 2).mean())
        want.append((rate, math.log(np.median(errors[3:]) / np.median(errors[:3])) / rate))
    assert np.allclose(model.rate_search(df, net(spark), [1e-3, 1e-2], steps=6), want)


def test_stored_rows_and_uniform_draws(spark):
    panel = stats.stored_rows(spark.range(0, 97, 1, 7).selectExpr("id AS x"))
    assert sorted(r["row_id"] for r in panel.collect()) == list(range(97))
    draws = stats.uniform_sample(panel, 9700, 2).groupBy("x").count().collect()
    counts = np.array([r["count"] for r in draws] + [0] * (97 - len(draws)))
    assert counts.sum() == 9700 and ((counts - 100) ** 2 / 100).sum() < 97 + 4 * math.sqrt(2 * 97)  # chi-square, four deviations
    same = lambda: sorted(map(tuple, stats.uniform_sample(panel, 50, 3).collect()))
    assert same() == same()


def test_uniform_sample_of_a_table_out_of_order(spark, tmp_path):
    """Files of unequal size, none in the order of the ids, a repeated id and one that is null: rows are those of SQL."""
    at = tmp_path / "embeddings.parquet"
    ids = np.random.default_rng(8).permutation(300).tolist()
    for part in (ids[:20] + [None], ids[20:220] + [7], ids[220:]):
        rows = [(i, [0.5], 1) for i in part]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.mode("append").parquet(str(at))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{at}/*.parquet'")
    got = market.p1_uniform_sample(spark, str(tmp_path)).select("draw", "vec_id").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(f"select draw, vec_id from ({SQL['p1_uniform_sample']})").fetchall())


def test_recorded_moments_replace_a_batch(spark, tmp_path):
    x = np.random.default_rng(7).standard_normal((60, 2)) * [1, 9] + [5, 0]
    df = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(x)], "b int, features array<double>")
    path = f"file://{tmp_path}/moments"
    stats.record_moments(spark, path, "a", df.limit(3))
    for name, b in (("a", 0), ("b", 1), ("c", 2), ("b", 1)):
        stats.record_moments(spark, path, name, df.filter(f"b = {b}"))
    got = stats.mean_std(stats.recorded_moments(spark, path)).orderBy("i").collect()
    assert np.allclose([(r["mean"], r["std"]) for r in got], np.stack([x.mean(axis=0), x.std(axis=0)], 1))
