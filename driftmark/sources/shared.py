"""Tables written to the cluster's shared folder, to cut a lineage or to fix what a plan computes once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a session on one machine gets a folder of its own; a
    cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _LOCAL[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in a folder of its own in the shared one, deleted when the driver ends: lazy results may read it until then."""
    folder = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)  # marks only what is there
    return f"{folder}/table"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written once, for plans that read it several times."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, *order: str) -> DataFrame:
    """df written as a table of as many buckets by key as shuffles have partitions, sorted by key and order: windows and
    groupings by key then read it without an exchange, and with that many tasks however few bytes it has."""
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    write = df.repartition(n, key).write.bucketBy(n, key).sortBy(key, *order)
    write.format("parquet").option("path", shared_path(spark, name)).saveAsTable(table)
    return spark.table(table)
