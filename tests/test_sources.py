"""Readers and layouts of market tables."""

import pytest
from pyspark.sql import functions as F

from driftmark.operators import clean, macro, series
from driftmark.sources import market as src
from driftmark.sources.shared import bucketed, shared_root

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_stored_by_ticker_need_no_exchange(spark):
    bars = spark.range(200).selectExpr("concat('t', id % 5) AS ticker", "cast(id / 5 AS int) AS pos", "id * 1.5D AS price")
    stored = bucketed(bars, "bars", "ticker", "pos")
    w = series.along()
    moved = stored.select("ticker", "pos", series.change("price", w).alias("c"), F.avg("price").over(w.rowsBetween(-3, 0)).alias("m"))
    assert "Exchange" not in plan(moved) and "Exchange" in plan(bars.select("ticker", series.change("price", w)))
    assert "Exchange" not in plan(stored.groupBy("ticker").count())
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, bars.collect()))


def test_wide_and_long_bars(spark):
    rows = [("2024-01-02", 1.0, None, 2.0, None, 0.5, None, 1.5, None, 10.0, None), ("2024-01-03", None, 3.0, None, 4.0, None, 2.0, None, 3.5, None, None)]
    names = [f"{f}|{t}" for f in ("Open", "high", "low", "close", "volume") for t in ("A.B", "C`D")]
    wide = spark.createDataFrame(rows, "date string, " + ", ".join("`" + n.replace("`", "``") + "` double" for n in names))
    got = sorted((r["ticker"], str(r["date"]), r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in src.long_bars(wide).collect())
    assert got == [("A.B", "2024-01-02", 1.0, 2.0, 0.5, 1.5, 10.0), ("C`D", "2024-01-03", 3.0, 4.0, 2.0, 3.5, None)]
    with pytest.raises(ValueError, match="A.B: volume"):
        src.long_bars(wide.drop("volume|A.B"))
    with pytest.raises(ValueError, match="note"):
        src.long_bars(wide.withColumn("note", F.lit(1.0)))
    assert src.long_bars(wide.limit(0)).count() == 0


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_root(spark) == folder

    class Other:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_root(Other)
    Other.sparkContext.master = "local[4]"
    assert shared_root(Other).startswith("file:///") and shared_root(Other) == shared_root(Other)


def test_checked_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,date,value\nx,2024-01-01,1.5\nx,2024-02-30,2\ny,2024-01-01\nz,2024-01-01,3,4\nw,2024-03-01,.\n,,\n")
    rows, bad = src.read_series(spark, str(tmp_path / "a.csv"))
    assert [(r["series_id"], str(r["month"]), r["value"]) for r in rows.collect()] == [("x", "2024-01-01", 1.5)]
    assert sorted(r["line"] for r in bad.collect()) == ["x,2024-02-30,2", "y,2024-01-01", "z,2024-01-01,3,4"]
    (tmp_path / "b.csv").write_text("id,date,value\n")
    assert [x.count() for x in src.read_series(spark, str(tmp_path / "b.csv"))] == [0, 0]


def test_later_bars_do_not_read_the_history(spark, tmp_path):
    made = lambda first, n, t="A": spark.range(first, first + n).selectExpr(f"'{t}' AS ticker", "date_add(date'2020-01-01', cast(id AS int)) AS date", "id * 1.0D AS price")
    names = {}
    for name, df in {"history": clean.numbered(made(0, 10).union(made(3, 4, "B"))), "new": made(8, 6).union(made(0, 3, "C"))}.items():
        df.write.parquet(str(tmp_path / name))
        names[name] = spark.read.parquet(str(tmp_path / name))
    clean.last_bars(names["history"]).write.parquet(str(tmp_path / "heads"))
    heads = spark.read.parquet(str(tmp_path / "heads"))
    later = clean.later_bars(heads, names["new"])
    assert f"{tmp_path}/history" not in plan(later) and f"{tmp_path}/new" in plan(later)
    got = sorted((r["ticker"], r["pos"], r["price"]) for r in later.collect())
    assert got == [("A", 10 + i, 10.0 + i) for i in range(4)] + [("C", i, float(i)) for i in range(3)]
    assert sorted((r["ticker"], r["last_pos"]) for r in clean.moved_heads(heads, later).collect()) == [("A", 13), ("B", 3), ("C", 2)]


def test_months_are_found_by_equality(spark):
    starts = spark.createDataFrame([(3, 5, 9), (4, 9, 70), (6, 70, None)], "idx int, start int, stop int")
    pos = spark.createDataFrame([(p,) for p in (0, 4, 5, 8, 9, 40, 69, 70, 5000)], "pos int")
    found = macro.month_of_position(pos, starts)
    assert "NestedLoopJoin" not in plan(found.filter("pos >= 0").select("idx")).replace("BroadcastNestedLoopJoin BuildRight, Cross", "")
    assert sorted((r["pos"], r["idx"]) for r in found.collect()) == [(5, 3), (8, 3), (9, 4), (40, 4), (69, 4), (70, 6), (5000, 6)]
    months = spark.createDataFrame([(3,), (5,), (6,)], "idx int")
    assert sorted((r["idx"], r["start"]) for r in macro.start_of_month(months, starts).collect()) == [(3, 5), (5, None), (6, 70)]
