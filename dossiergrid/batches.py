"""The size of the batches that pass between the JVM and Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of whole texts in one Arrow batch: a few megabytes for usual documents.
ROWS = 1024


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ROWS, if it is higher.

    Results are read lazily, so the setting stays; a batch of whole texts at
    Spark's default of 10,000 rows would take a large part of a small executor.
    """
    if not 0 < int(spark.conf.get(KEY)) <= ROWS:
        spark.conf.set(KEY, str(ROWS))
