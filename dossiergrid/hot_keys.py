"""Joins when one key may have a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows and this part of all rows on, so there are at most ``1 / SHARE`` hot keys.
LEAST, SHARE = 1_000, 1e-5


def join_split(rows: DataFrame, table: DataFrame, keys: list[str], total: int, least: int | None = None) -> DataFrame:
    """``rows`` inner joined with ``table``: a row per ``keys``, with ``n``, the number of its rows among the ``total`` ones.

    The rows of hot keys stay where they are and meet those keys by a broadcast, which
    ``SHARE`` bounds whatever the data are; the others are shuffled by key. ``n`` is left out.
    ``least`` may be higher where a row costs little.
    """
    least = LEAST if least is None else least
    if total <= least:  # then no key can be hot
        return rows.join(table.drop("n"), keys)
    hot = F.col("n") > max(least, int(total * SHARE))
    few = F.broadcast(table.where(hot).drop("n"))
    met = rows.join(few, keys)
    return met.unionByName(rows.join(few.select(*keys), keys, "left_anti").join(table.where(~hot).drop("n"), keys))


def join_dealt(rows: DataFrame, table: DataFrame, keys: list[str], by: Column, total: int, piece: int = 20_000) -> DataFrame:
    """``rows`` inner joined with ``table``, in which a key may have several rows too.

    A hot key's ``rows`` are dealt by ``by`` to as many pieces as their counted number needs, and its rows of the
    ``table`` go to each of them. Only the numbers of pieces are broadcast, for at most ``1 / SHARE`` keys.
    """
    if total <= piece:
        return rows.join(table, keys)
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(piece, int(total * SHARE)))
    pieces = F.broadcast(counted.select(*keys, F.ceil(F.col("__n") / piece).cast("int").alias("__k")))
    dealt = rows.withColumn("__by", F.xxhash64(by)).join(pieces, keys, "left").withColumn("__p", F.coalesce(F.pmod("__by", F.col("__k")), F.lit(0)).cast("int"))
    every = table.join(pieces, keys, "left").withColumn("__p", F.explode(F.sequence(F.lit(0), F.coalesce("__k", F.lit(1)) - 1)))
    return dealt.drop("__k", "__by").join(every.drop("__k"), [*keys, "__p"]).drop("__p")
