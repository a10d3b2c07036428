"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.sources.shared import shared_path


class Scratch:
    """Parquet tables of one operator run in the shared folder.

    A saved table cuts the lineage: its reader needs neither the shuffle files nor the executors that
    made it. ``drop`` removes a table that nothing reads any more; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = shared_path(spark, label)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        self._delete(*map(self.path, names))

    def drop_all(self) -> None:
        self._delete(self.root)

    def last(self, df: DataFrame, name: str = "result") -> DataFrame:
        """df saved, all other tables of the run dropped: for results that are small beside what they were made from."""
        saved = self.save(df, name)
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        conf = self.spark._jsc.hadoopConfiguration()
        self._delete(*(str(x.getPath()) for x in root.getFileSystem(conf).listStatus(root) if x.getPath().getName() != name))
        return saved

    def _delete(self, *paths: str) -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        for path in paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Narrow rows that one task may join on one key.
HOT = 100_000


def hot_join(left: DataFrame, right: DataFrame, key: str, by: str, counted: DataFrame, rows: int, least: int = 10_000, ways: int = 64) -> DataFrame:
    """left joined with right, which has one row a key. Keys of `least` rows or more of left are dealt over `ways` copies
    of their right row by a hash of left's column `by`, so that no key is joined in one task. counted: a written table of
    `rows` rows with left's keys, to tell them by; there are at most 500,000 such keys, which are broadcast."""
    if rows < least:
        return left.join(right, key)
    least = max(least, rows // 500_000)
    hot = F.broadcast(counted.groupBy(key).agg(F.count("*").alias("_c")).filter(F.col("_c") >= least).select(key, F.lit(True).alias("_hot")))
    way = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(ways))).otherwise(0).cast("int").alias("_way")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(hot, key, "left").select(*left.columns, way)
    b = right.join(hot, key, "left").select(*right.columns, F.explode(copies).alias("_way"))
    return a.join(b, [key, "_way"]).drop("_way")


def connected_components(scratch: Scratch, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the ends of links(a, b): component is the smallest id that can be reached.

    Every round lowers each node's label to the smallest among its neighbours, then takes the label
    of that label (pointer jumping), so that long chains close in about log(length) rounds. Each round
    is two joins and a map-side combined minimum, written to the shared folder; only the number of
    changed labels reaches the driver. Nodes with many neighbours and labels of many nodes are joined by copies.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    both = scratch.save(both, "cc-links")
    labels = scratch.save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")), "cc-0")
    n_links, n_nodes = both.count(), labels.count()
    before = None
    for i in range(1, max_rounds + 1):
        near = hot_join(both, labels.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v", "u", both, n_links, HOT)
        near = near.groupBy("u").agg(F.min("cv").alias("m"))
        low = labels.join(near, "u").select("u", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        # Every label is a node and so has a label itself.
        up = labels.select(F.col("u").alias("c"), F.col("c").alias("top"))
        now = hot_join(low, up, "c", "u", labels, n_nodes, HOT).select("u", "was", F.least("c", "top").alias("c"))
        saved = scratch.save(now, f"cc-{i}")
        if before is not None:
            scratch.drop(before)
        before, labels = f"cc-{i}", saved.select("u", "c")
        if saved.filter("c <> was").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))
