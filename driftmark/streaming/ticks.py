"""Daily bars kept up from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftmark.sources.versioned import Versioned

OPEN_DAYS = "key string, open double, high double, low double, close double, volume double, ticks long, price double, last_tick timestamp, date string"


def daily_bars(ticks: DataFrame, key: str = "key", ts: str = "ts", value: str = "value", lateness: str = "1 day", tie: str | None = None) -> DataFrame:
    """One bar per key and day. The present day is updated until the watermark closes it; later ticks are dropped.
    tie: a column that orders ticks of one instant. Works on streams and on batches."""
    order = F.struct(ts, *([tie] if tie else []))
    timed = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    bars = timed.groupBy(F.window(ts, "1 day").alias("day"), F.col(key)).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"),
        F.count("*").alias("ticks"), F.sum(value).alias("volume"), F.max(ts).alias("last_tick"),
    )
    price = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    return bars.select(F.col(key).alias("key"), F.to_date("day.start").alias("date"), "open", "high", "low", "close", "volume", "ticks", price.alias("price"), "last_tick")


def keep_bars(ticks: DataFrame, path: str, checkpoint: str, mode: str = "append", **names: str) -> StreamingQuery:
    """Write closed days (append) as Parquet; each bar is written once."""
    bars = daily_bars(ticks, **names).drop("last_tick")
    return bars.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_days(spark: SparkSession, path: str) -> Versioned:
    """The table that keep_open_bars writes: bars by day, a partition a day."""
    return Versioned(spark, path, "date", OPEN_DAYS)


def upsert_bars(table: Versioned, changed: DataFrame, batch: int) -> bool:
    """Put a batch's changed bars in place of those of the same key and day, as one version that notes the batch's number.
    A batch that comes again, after a restart between its version and the stream's own log, changes nothing; False then.
    Only the days that the batch has bars of are read and written."""
    before = table.notes()
    if before and batch <= before["batch"]:
        return False
    new = changed.withColumn("date", F.date_format("date", "yyyy-MM-dd")).select(*table.schema.names)
    days = [r["date"] for r in new.select("date").distinct().collect()]  # the days that one batch touches
    latest = new.agg(F.date_format(F.max("last_tick"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t")).first()["t"]
    latest = max(filter(None, (latest, before.get("latest"))), default=None)
    kept = table.read(values=days).join(new.select("key", "date"), ["key", "date"], "left_anti").select(*table.schema.names)
    table.update(kept.union(new), {"batch": batch, "latest": latest})
    return True


def keep_open_bars(ticks: DataFrame, path: str, checkpoint: str, **names: str) -> StreamingQuery:
    """Keep all bars, those of days still open included, in the table open_days(path): each batch updates its own."""
    table = open_days(ticks.sparkSession, path)

    def put(changed: DataFrame, batch: int) -> None:
        rows = changed.persist()
        try:
            upsert_bars(table, rows, batch)
        finally:
            rows.unpersist()

    return daily_bars(ticks, **names).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def present_bars(spark: SparkSession, path: str, lateness: str = "1 day") -> DataFrame:
    """The newest bars; provisional: the day can still change, since its end lies behind the newest tick less `lateness`."""
    table = open_days(spark, path)
    latest = F.lit(table.notes().get("latest")).cast("timestamp")
    ends = F.to_timestamp("date") + F.expr("interval 1 day")
    return table.read().withColumn("provisional", ends > latest - F.expr(f"interval {lateness}")).withColumn("date", F.to_date("date")).drop("last_tick")
