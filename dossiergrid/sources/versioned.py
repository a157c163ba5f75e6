"""Tables whose rows change in place, as versions in buckets.

A change adds a version to the buckets of its keys and touches no other file; of a key the latest
value of every column counts. A deletion is a version too. Buckets with many versions are
merged on their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the layout; a table must not have them.
LAYOUT = ("bucket", "version", "gone", "whole")


@dataclass(frozen=True)
class VersionedTable:
    """Rows with a unique ``key`` at ``path``. ``schema`` has the columns, the key among them."""

    spark: SparkSession
    path: str
    key: str
    schema: T.StructType
    buckets: int = 256

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 256) -> VersionedTable:
        """A new table with ``rows`` as its first version. Rows with a null key can't be changed and are refused."""
        if clash := set(LAYOUT) & set(rows.columns):
            raise ValueError(f"columns of the layout: {sorted(clash)}")
        out = cls(rows.sparkSession, path, key, rows.schema, buckets)
        out._write(rows.select("*", F.lit(False).alias("gone"), F.lit(True).alias("whole")))
        return out

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, path: str, name: str) -> list[int]:
        p, fs = self._fs(path)
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(f.removeprefix(f"{name}=")) for f in found if f.startswith(f"{name}="))

    def versions(self, bucket: int) -> list[int]:
        return self._numbers(f"{self.path}/bucket={bucket}", "version")

    def _next(self) -> int:
        """One more than the latest version; it is written beside the rows, so that no bucket is listed for it."""
        return max(self._numbers(f"{self.path}/_versions", "v"), default=0) + 1

    def _write(self, rows: DataFrame) -> int:
        version = self._next()
        kept = rows.where(F.col(self.key).isNotNull()).withColumn("bucket", self._bucket()).withColumn("version", F.lit(version))
        # One file a bucket; a version that was begun and not marked is replaced.
        kept.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(self.path)
        p, fs = self._fs(f"{self.path}/_versions/v={version}")
        fs.mkdirs(p)
        return version

    def upsert(self, changes: DataFrame) -> int:
        """Change the columns that aren't null in ``changes`` and add new keys; returns the version. Columns may be missing; keys are unique."""
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in changes.columns]
        return self._write(changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema if f.name in changes.columns], *empty, F.lit(False).alias("gone"), F.lit(False).alias("whole")))

    def delete(self, keys: DataFrame) -> int:
        """Delete the rows of ``keys`` (its first column); returns the version. A key that isn't there changes nothing."""
        rows = keys.select(F.col(keys.columns[0]).cast(self.schema[self.key].dataType).alias(self.key)).distinct()
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name != self.key]
        return self._write(rows.select("*", *empty, F.lit(True).alias("gone"), F.lit(True).alias("whole")))

    def _merged(self, stored: DataFrame) -> DataFrame:
        """The latest state of every key, with ``gone``. A deletion, like a whole row, hides all earlier values, null ones too."""
        cols = [f.name for f in self.schema if f.name != self.key]
        counts = lambda c: F.when(F.col(c).isNotNull() | F.col("whole"), F.col("version"))
        latest = [F.max_by(F.struct(F.col(c)), counts(c))[c].alias(c) for c in cols]
        return stored.groupBy(self.key).agg(*latest, F.max_by("gone", "version").alias("gone"))

    def _stored(self, *folders: str) -> DataFrame:
        layout = T.StructType([*self.schema.fields, T.StructField("gone", T.BooleanType()), T.StructField("whole", T.BooleanType()), T.StructField("bucket", T.IntegerType()), T.StructField("version", T.IntegerType())])
        return self.spark.read.schema(layout).option("basePath", self.path).parquet(*(folders or [self.path]))

    def read(self) -> DataFrame:
        """All rows as they are now."""
        return self._merged(self._stored()).where("not gone").select(*self.schema.names)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (its first column), from their buckets only; at most ``buckets`` numbers reach the driver."""
        wanted = keys.select(F.col(keys.columns[0]).cast(self.schema[self.key].dataType).alias(self.key)).distinct()
        touched = {r["b"] for r in wanted.select(self._bucket().alias("b")).distinct().collect()}
        folders = [f"{self.path}/bucket={b}" for b in sorted(touched & set(self._numbers(self.path, "bucket")))]
        if not folders:
            return self.read().where("false")
        return self._merged(self._stored(*folders).join(wanted, self.key, "left_semi")).where("not gone").select(*self.schema.names)

    def compact(self, most: int = 8) -> list[int]:
        """Merge every bucket of more than ``most`` versions into one, and return those buckets.

        The merged version is written first and the older ones go afterwards; a loss in between changes no answer, as the
        merged rows hide the older ones, and deleted keys stay deleted.
        """
        full = [b for b in self._numbers(self.path, "bucket") if len(self.versions(b)) > most]
        if full:
            older = {b: self.versions(b) for b in full}
            merged = self._merged(self._stored(*[f"{self.path}/bucket={b}" for b in full])).withColumn("whole", F.lit(True))
            self._write(merged.select(*self.schema.names, "gone", "whole"))
            for b, numbers in older.items():
                for v in numbers:
                    p, fs = self._fs(f"{self.path}/bucket={b}/version={v}")
                    fs.delete(p, True)
        return full


def delete_cascading(tables: dict[str, VersionedTable], root: str, ids: DataFrame, children_of: dict[str, list[tuple[str, str]]]) -> dict[str, int]:
    """Delete the rows ``ids`` of ``root`` and all that refer to them, as versions; returns the version per changed table.

    ``children_of`` maps a table to (child table, foreign key) pairs; a child's own children go with it.
    """
    done, queue = {}, [(root, ids.select(F.col(ids.columns[0]).alias("gone_id")).distinct())]
    while queue:
        name, gone = queue.pop(0)
        for child, foreign in children_of.get(name, []):
            table = tables[child]
            lost = table.read().join(gone, F.col(foreign) == F.col("gone_id"), "left_semi").select(F.col(table.key).alias("gone_id"))
            queue.append((child, lost))
        done[name] = tables[name].delete(gone)
    return done
