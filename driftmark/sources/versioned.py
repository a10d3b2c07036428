"""Tables that are replaced as a whole or by partitions, and never seen half written.

Files of one write lie in a folder of their own. A version is a small list of partition folders, and becomes the
table's newest one when its list is moved into place; until then, and if the write fails, readers see the version
before. A write that replaces some partitions keeps the files of all others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Versioned:
    """path/data/written=<write>/<key>=<value>/: files; path/versions/<number>: which folders make up that version.

    Versions hold one entry a partition, which pass the driver; rows don't.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | T.StructType):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.tag = "written"
        while self.tag in self.schema.names:
            self.tag += "_"
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _names(self, folder: str) -> list[str]:
        at = self.jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(self.conf)
        return [str(x.getPath().getName()) for x in fs.listStatus(at)] if fs.exists(at) else []

    def version(self) -> int:
        """The newest number; 0: none yet."""
        return max((int(n) for n in self._names(f"{self.path}/versions") if n.isdigit()), default=0)

    def _listed(self, version: int) -> dict:
        if not version:
            return {"folders": {}, "notes": {}}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version:08d}", wholetext=True).first()[0])

    def notes(self) -> dict:
        """What the writer of the newest version noted."""
        return self._listed(self.version())["notes"]

    def read(self, version: int | None = None, values: list[str] | None = None) -> DataFrame:
        """The table, or its partitions of the given values (as the folders' names have them); extra columns never show."""
        folders = self._listed(self.version() if version is None else version)["folders"]
        paths = [f"{self.path}/data/{self.tag}={w}/{name}" for name, w in sorted(folders.items()) if values is None or name in {f"{self.key}={v}" for v in values}]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*paths).select(*self.schema.names)

    def _write(self, df: DataFrame, most: int) -> dict[str, str]:
        """Rows are dealt by key; adaptive execution joins small keys in one task and splits a large one over several."""
        write = uuid.uuid4().hex
        target = f"{self.path}/data/{self.tag}={write}"
        df.select(*self.schema.names).hint("rebalance", self.key).write.option("maxRecordsPerFile", most).partitionBy(self.key).parquet(target)
        return {n: write for n in self._names(target) if n.startswith(f"{self.key}=")}

    def _commit(self, folders: dict[str, str], notes: dict, base: int) -> int:
        """Move the list into place. Fails if another writer has made the same version."""
        path = self.jvm.org.apache.hadoop.fs.Path
        made = path(f"{self.path}/lists/{uuid.uuid4().hex}")
        out = made.getFileSystem(self.conf).create(made, False)
        out.write(json.dumps({"folders": folders, "notes": notes}).encode())
        out.close()
        to = path(f"{self.path}/versions/{base + 1:08d}")
        to.getFileSystem(self.conf).mkdirs(to.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.conf)
        context.rename(made, to, self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        return base + 1

    def replace(self, df: DataFrame, notes: dict | None = None, most: int = 1_000_000) -> int:
        """A new version of df's rows alone; its number."""
        base = self.version()
        return self._commit(self._write(df, most), notes or {}, base)

    def update(self, df: DataFrame, notes: dict | None = None, most: int = 1_000_000) -> int:
        """A new version in which the partitions that df has rows of are df's; all others keep their files."""
        base = self.version()
        return self._commit(self._listed(base)["folders"] | self._write(df, most), notes or {}, base)

    def vacuum(self, keep: int = 2) -> None:
        """Drop the versions before the newest `keep`, and all files that no version left needs."""
        newest = self.version()
        path = self.jvm.org.apache.hadoop.fs.Path
        old = [int(n) for n in self._names(f"{self.path}/versions") if n.isdigit() and int(n) <= newest - keep]
        needed = {(w, n) for v in range(max(1, newest - keep + 1), newest + 1) for n, w in self._listed(v)["folders"].items()}
        gone = [f"versions/{v:08d}" for v in old]
        for write in self._names(f"{self.path}/data"):
            names = [n for n in self._names(f"{self.path}/data/{write}") if n.startswith(f"{self.key}=")]
            gone += [f"data/{write}/{n}" for n in names if (write.removeprefix(f"{self.tag}="), n) not in needed]
        for name in gone:
            at = path(f"{self.path}/{name}")
            at.getFileSystem(self.conf).delete(at, True)
