"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossiergrid.hot_keys import join_split
from dossiergrid.scratch import materialize

#: Links of a node that are no matter in one task.
LEAST_HUB = 100_000


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` from links ``a``, ``b``: the root is the least node of the component.

    Every step connects each node's neighbours to the least of them, which keeps the
    components and halves the paths; the links end as stars. Nodes without a link to
    another node have no row. Each round is written to the shared folder. The links of a hub
    are not shuffled to one task.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before, total = None, 2 * edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_split(both.where("v > u"), least, ["u"], total, LEAST_HUB).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Every link now points to a smaller node.
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = join_split(large, small, ["u"], total, LEAST_HUB).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(joined.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
