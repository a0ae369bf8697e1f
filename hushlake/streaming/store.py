"""A keyed store of sealed mappings on plain files: batches are written once by number, the last version of an id counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import opened, sealed

ROW = "id string, cipher string, at timestamp, version long"


class KeyedStore:
    """Below root: log/batch=N, the rows that batch N changed, and base/upto=N, all rows as of batch N.

    A batch that comes again after a failure overwrites its own folder, so an id has one row of it however often it
    runs. A row without a cipher deletes its id. compact() writes a new base beside the old one and only then drops what
    it holds; readers take the newest base that was finished, and the batches behind it.
    """

    def __init__(self, spark: SparkSession, root: str, key: Column):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self, kind: str, prefix: str) -> list[int]:
        """Numbers of the finished folders of a kind; there are as many as batches since the last compaction."""
        fs, p = self._fs(f"{self.root}/{kind}")
        if not fs.exists(p):
            return []
        found = [s.getPath() for s in fs.listStatus(p)]
        done = [x for x in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return sorted(int(x.getName().removeprefix(prefix)) for x in done if x.getName().startswith(prefix))

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Rows (id, mapping, at) of a batch, for foreachBatch: of an id the latest row stays; a null mapping deletes."""
        if number <= max(self._numbers("base", "upto="), default=-1):
            return  # a base holds it already
        last = batch.filter("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("mapping", "at"), F.struct("at", F.to_json("mapping"))).alias("r"))
        rows = last.select("id", F.when(F.col("r.mapping").isNotNull(), sealed(F.col("r.mapping"), self.key)).alias("cipher"), F.col("r.at").alias("at"), F.lit(number).cast("long").alias("version"))
        rows.write.mode("overwrite").parquet(f"{self.root}/log/batch={number}")

    def rows(self, upto: int | None = None) -> DataFrame:
        """(id, cipher, at, version) of all ids that aren't deleted, as of a batch or the last."""
        bases = [n for n in self._numbers("base", "upto=") if upto is None or n <= upto]
        logs = [n for n in self._numbers("log", "batch=") if n > max(bases, default=-1) and (upto is None or n <= upto)]
        paths = [f"{self.root}/base/upto={n}" for n in bases[-1:]] + [f"{self.root}/log/batch={n}" for n in logs]
        if not paths:
            return self.spark.createDataFrame([], ROW)
        every = self.spark.read.schema(ROW).parquet(*paths)
        last = every.groupBy("id").agg(F.max_by(F.struct("cipher", "at", "version"), "version").alias("r"))
        return last.select("id", "r.*").filter("cipher IS NOT NULL")

    def mappings(self) -> DataFrame:
        """(id, mapping, readable): the mapping is null, and not readable, under another key than it was sealed with."""
        m = opened(F.col("cipher"), self.key)
        return self.rows().select("id", m.alias("mapping"), m.isNotNull().alias("readable"))

    def compact(self) -> int | None:
        """Fold all finished batches into a base; its number, or None if there is nothing new."""
        logs, bases = self._numbers("log", "batch="), self._numbers("base", "upto=")
        if not logs or logs[-1] <= max(bases, default=-1):
            return None
        self.rows(logs[-1]).write.mode("overwrite").parquet(f"{self.root}/base/upto={logs[-1]}")
        for path in [f"log/batch={n}" for n in logs] + [f"base/upto={n}" for n in bases]:
            fs, p = self._fs(f"{self.root}/{path}")
            fs.delete(p, True)
        return logs[-1]
