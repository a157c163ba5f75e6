"""Extraction quality against known answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precision_recall(rows: DataFrame, predicted: Column, actual: Column, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of two flags, by group; a ratio without cases is 0."""
    counts = rows.groupBy(*by).agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn")
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *by, "tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def set_counts(found: Column, expected: Column) -> Column:
    """``struct<tp,fp,fn>`` of two lists, compared without case and repeats."""
    low = lambda c: F.array_distinct(F.transform(c, lambda x: F.lower(F.trim(x))))
    a, b = low(found), low(expected)
    return F.struct(F.size(F.array_intersect(a, b)).alias("tp"), F.size(F.array_except(a, b)).alias("fp"), F.size(F.array_except(b, a)).alias("fn"))
