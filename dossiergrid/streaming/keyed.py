"""Keyed state of ingestion: which stored upload holds a key.

The table is laid out by buckets of the keys' hash, and a batch reads the folders of its own
buckets only, by their paths: neither listing nor scan grows with the other buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("kind", "value")


@dataclass(frozen=True)
class KeyTable:
    """(id, kind, value) of accepted uploads at ``path``, a folder per bucket and batch."""

    spark: SparkSession
    path: str
    buckets: int = 1024

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEYS), F.lit(self.buckets)).cast("int")

    def _folders(self, below: str = "") -> list[str]:
        """Names of the folders below a folder of the table; none where it isn't there yet."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def _exists(self, bucket: int) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self, buckets: list[int]) -> DataFrame | None:
        """The rows of some buckets, with ``bucket`` and ``batch``; None where there are none."""
        there = [b for b in buckets if self._exists(b)]
        if not there:
            return None
        return self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/bucket={b}" for b in there])

    def matching(self, keys: DataFrame, but_batch: int) -> DataFrame | None:
        """(id, kind, value) of stored uploads that share a key with ``keys``, without those of one batch.

        At most ``buckets`` numbers reach the driver.
        """
        touched = [r["bucket"] for r in keys.select(self._bucket().alias("bucket")).distinct().collect()]
        stored = self.read(touched)
        if stored is None:
            return None
        return stored.where(F.col("batch") != but_batch).join(keys.select(*KEYS).distinct(), list(KEYS), "left_semi").select("id", *KEYS)

    def put(self, keys: DataFrame, batch: int) -> None:
        """Add the keys of a batch; the same batch again replaces them. No other file is touched."""
        rows = keys.select("id", *KEYS, self._bucket().alias("bucket"), F.lit(batch).alias("batch"))
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.path)

    def compact(self, most: int = 16) -> int:
        """Merge buckets that hold more than ``most`` batches; returns how many were merged.

        The merged rows get a batch number below zero, which no batch has; the latest batch stays apart, as it may run again. The
        merged folder is written first and the old ones go afterwards, so a loss in between leaves rows twice, which changes no answer.
        """
        merged = 0
        for name in self._folders():
            batches = sorted(int(b.removeprefix("batch=")) for b in self._folders(name))
            if len(batches) <= most:
                continue
            older, number = batches[:-1], int(name.removeprefix("bucket="))
            rows = self.read([number]).where(F.col("batch").isin(older)).select("id", *KEYS).distinct()
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={min(0, batches[0]) - 1}")
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            fs = path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for b in older:
                fs.delete(path(f"{self.path}/{name}/batch={b}"), True)
            merged += 1
        return merged
