"""Versioned tables, and the bars of open days that are kept in one."""

import tempfile

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from driftmark.sources.versioned import Versioned
from driftmark.streaming import ticks

SCHEMA = "ticker string, pos int, price double"


def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def rows(spark, n, shift=0.0, names=("A B", "C", "Ü/1")):
    made = spark.range(n).select(F.explode(F.array(*map(F.lit, names))).alias("ticker"), F.col("id").cast("int").alias("pos"))
    return made.withColumns({"price": F.col("pos") * 0.5 + shift, "extra": F.lit(1)})


def content(df):
    return sorted(map(tuple, df.collect()))


def files(table):
    return {f for v in [table.version()] for f in (r["f"] for r in table.read(v).select(F.input_file_name().alias("f")).distinct().collect())}


def test_partitions_replaced_and_kept(spark):
    t = Versioned(spark, folder(), "ticker", SCHEMA)
    assert t.version() == 0 and t.read().count() == 0 and t.notes() == {}
    t.replace(rows(spark, 50), {"x": 1}, most=20)
    assert content(t.read()) == content(rows(spark, 50).select("ticker", "pos", "price"))
    first = files(t)
    sizes = t.read().groupBy(F.input_file_name()).count().collect()
    assert len(first) >= 9 and all(r["count"] <= 20 for r in sizes)
    t.update(rows(spark, 30, 7.0, ("C", "new")), {"x": 2})
    want = content(rows(spark, 50, names=("A B", "Ü/1")).union(rows(spark, 30, 7.0, ("C", "new"))).select("ticker", "pos", "price"))
    assert content(t.read()) == want and t.notes() == {"x": 2}
    same = lambda names: {f for f in names if "ticker=C" not in f and "ticker=new" not in f}
    assert same(files(t)) == same(first)
    assert content(t.read(1)) == content(rows(spark, 50).select("ticker", "pos", "price"))
    assert {r["ticker"] for r in t.read(values=["C"]).collect()} == {"C"}


def test_a_failed_write_changes_nothing(spark):
    t = Versioned(spark, folder(), "ticker", SCHEMA)
    t.replace(rows(spark, 10))
    before = content(t.read())
    bad = rows(spark, 10, 1.0).withColumn("price", F.when(F.col("pos") == 7, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("price")))
    with pytest.raises(Exception, match="lost"):
        t.update(bad)
    assert t.version() == 1 and content(t.read()) == before
    # Of two writers that start from one version, the later one fails.
    with pytest.raises(Py4JJavaError):
        t._commit({}, {}, 0)
    t.update(rows(spark, 5, names=("C",)))
    t.update(rows(spark, 6, names=("C",)))
    t.vacuum(keep=1)
    assert t.version() == 3 and t.read().filter("ticker = 'C'").count() == 6 and t.read().count() == 26
    left = spark.read.text(f"{t.path}/versions").count()
    assert left == 1


TICKS = "key string, ts timestamp, value double, n int"


def test_batches_that_come_again_change_nothing(spark):
    t = ticks.open_days(spark, folder())
    made = lambda data: ticks.daily_bars(spark.createDataFrame(data, "key string, ts string, value double, n int").withColumn("ts", F.to_timestamp("ts")), tie="n")
    assert ticks.upsert_bars(t, made([("a", "2024-01-01 10:00:00", 3.0, 1), ("a", "2024-01-02 09:00:00", 5.0, 1), ("b", "2024-01-01 10:00:00", 1.0, 1)]), 0)
    again = made([("a", "2024-01-02 09:00:00", 5.0, 1), ("a", "2024-01-02 11:00:00", 4.0, 2)])
    assert ticks.upsert_bars(t, again, 1) and not ticks.upsert_bars(t, again, 1) and t.version() == 2
    got = {(r["key"], str(r["date"])): r for r in ticks.present_bars(spark, t.path).collect()}
    assert len(got) == 3 and got["a", "2024-01-02"]["ticks"] == 2 and got["a", "2024-01-02"]["close"] == 4.0
    assert got["a", "2024-01-02"]["provisional"] and got["a", "2024-01-01"]["provisional"]
    assert ticks.upsert_bars(t, made([("b", "2024-01-04 00:00:00", 1.0, 1)]), 2)
    got = {(r["key"], str(r["date"])): r["provisional"] for r in ticks.present_bars(spark, t.path).collect()}
    assert not got["a", "2024-01-02"] and not got["b", "2024-01-01"] and got["b", "2024-01-04"]
