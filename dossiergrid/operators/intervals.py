"""Lengths of unions of month intervals, for tables of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def months_by_key(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, months): months that at least one interval of the key covers; touching intervals join.

    Each interval counts at least a month; reversed ones and those over 600 months are left
    out. Equal intervals are folded before the window, so a key's sort holds distinct ones only.
    """
    valid = spans.where((F.col(end) >= F.col(start)) & (F.col(end) - F.col(start) <= 600))
    rows = valid.groupBy(key, F.col(start).alias("s")).agg(F.max(end).alias("e")).withColumn("e", F.greatest(F.col("e"), F.col("s") + 1))
    before = Window.partitionBy(key).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("upto", F.max("e").over(before))
    own = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce("upto", "s")))
    return rows.groupBy(key).agg(F.sum(own).alias("months"))
