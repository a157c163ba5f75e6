"""Working tables in the folder that the driver and all executors share.

``spark.checkpoint.dir`` names that folder. It is read from the session and set
here only where it is unset, as in tests. Writing a table there cuts lineage and
survives the loss of executors, which local checkpoints do not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (one machine, as in tests).
LOCAL_FALLBACK = "/tmp/checkpoints"

_written: dict[int, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(LOCAL_FALLBACK)
        named = LOCAL_FALLBACK
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/dossiergrid/{name}-{uuid.uuid4().hex}"
    _written.setdefault(id(spark.sparkContext), []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete all working tables this driver has written; returns their number.

    Call it when no DataFrame built on them is needed any more.
    """
    paths = _written.pop(id(spark.sparkContext), [])
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where it is read in fewer parts than there are cores; else as it is.

    For costly work on each row of an input that is one small file: a large input has more parts
    than cores and isn't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
