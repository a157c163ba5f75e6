"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, an external sort places
equals next to each other, and a window over the sorted runs compares
neighbours in full. The range key is bounded (the text's first characters and a
64-bit hash), so the sample that Spark brings to the driver for the splitters
stays small however long the texts are; equality is always decided by the whole
normalised text.

A text held by very many rows would end in one range. The hashes held by more
than a quarter of an average partition are counted first (there are fewer than
four times the number of partitions of them, so broadcasting them is bounded);
their rows get a piece number in the range key, by the place where they are read (identifiers
may be null or repeat), and one leader of each piece is joined by a second full comparison.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossiergrid.llm.expressions import ascii_lower
from dossiergrid.scratch import materialize, shuffle_partitions

#: Characters of the text in the range key.
PREFIX_CHARS = 32
#: Hashes of fewer rows than this are never split.
LEAST_HOT_ROWS = 64


def _hot_pieces(keyed: DataFrame, parts: int) -> list[dict]:
    """Hashes with over a quarter of an average partition's rows, and the pieces to split each into.

    At most ``4 * parts`` rows reach the driver: no more hashes can be so frequent.
    """
    counted = keyed.groupBy("__h").agg(F.count(F.lit(1)).alias("n"))
    top = counted.orderBy(F.desc("n"), "__h").limit(4 * parts + 1)
    all_rows = keyed.select(F.count(F.lit(1))).first()[0]
    least = max(LEAST_HOT_ROWS, all_rows / (4 * parts))
    return [{"h": r["__h"], "k": int(r["n"] // least) + 1} for r in top.collect() if r["n"] > least]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", carry: tuple[str, ...] = ()) -> DataFrame:
    """Group rows whose texts are identical after lower-casing A-Z, and keep one of each group.

    ``keep`` says which identifier stays: ``"min"`` or ``"max"``. Returns one row
    per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, and
    the columns to ``carry`` along.

    Null texts count as empty and are equal to empty ones. A null identifier loses
    to any other; a group of null identifiers has a null ``keep_id`` and keeps one
    row. Repeated rows are members of their group like any other, and exactly one
    row of a group is kept. Other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    text = F.coalesce(docs[text_col], F.lit(""))
    low = F.lower(text)
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        text.alias("__text"),
        F.substring(low, 1, PREFIX_CHARS).alias("__p"),
        F.xxhash64(low).alias("__h"),
        *[docs[c].alias(f"__carry_{c}") for c in carry],
    )
    along = [f"__carry_{c}" for c in carry]
    carried = [F.col(f"__carry_{c}").alias(c) for c in carry]
    hot = _hot_pieces(rows.select("__h"), parts)
    if hot:
        small = _inline(spark, hot, "array<struct<h:bigint,k:int>>").select(F.col("h").alias("__h"), F.col("k").alias("__k"))
        rows = rows.join(F.broadcast(small), "__h", "left").withColumn(
            "__s", F.when(F.col("__k").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__k")).cast("int")).otherwise(-1)
        )
    # A constant piece number would keep the window below from using the range partitioning.
    key = ["__p", "__h", "__s"] if hot else ["__p", "__h"]
    dealt = rows.select("doc_id", "__text", *key, *along).repartitionByRange(*key)
    normal = dealt.withColumn("__text", ascii_lower(F.col("__text")))
    # The range partitioning satisfies this window's clustering: no further shuffle.
    run = Window.partitionBy(*key, "__text")
    first = F.col("doc_id").asc_nulls_last() if keep == "min" else F.col("doc_id").desc_nulls_last()
    best = F.min if keep == "min" else F.max
    runs = normal.select(
        "doc_id",
        *key[1:],
        best("doc_id").over(run).alias("keep_id"),
        F.count(F.lit(1)).over(run).alias("group_size"),
        (F.row_number().over(run.orderBy(first)) == 1).alias("__lead"),
        F.sha2(F.col("__text").cast("binary"), 256).alias("text_sha256"),
        "__text",
        *along,
    )
    if not hot:
        return runs.select("doc_id", "keep_id", "group_size", F.col("__lead").alias("kept"), "text_sha256", *carried)
    slim = materialize(
        runs.withColumn("__text", F.when((F.col("__s") >= 0) & F.col("__lead"), F.col("__text"))), "exact-dedup-runs"
    )
    pieces = slim.where((F.col("__s") >= 0) & F.col("__lead"))
    whole = (
        pieces.groupBy("__text")
        .agg(
            best("keep_id").alias("__keep"),
            F.sum("group_size").alias("__size"),
            F.collect_list(F.struct("__h", "__s", "text_sha256", F.col("keep_id").alias("__best"))).alias("__pieces"),
        )
        # Several pieces may hold the identifier that stays; the first of them keeps its row.
        .withColumn("__lead_s", F.array_min(F.transform(F.filter("__pieces", lambda p: p["__best"].eqNullSafe(F.col("__keep"))), lambda p: p["__s"])))
        .select("__keep", "__size", "__lead_s", F.inline("__pieces"))
        .drop("__best")
    )
    return slim.join(F.broadcast(whole), ["__h", "__s", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("__size").isNull(), F.col("keep_id")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__size", "group_size").alias("group_size"),
        (F.col("__lead") & (F.col("__size").isNull() | (F.col("__s") == F.col("__lead_s")))).alias("kept"),
        "text_sha256",
        *carried,
    )


def _inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small local table made without Python on the executors."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, keep="max")


OP8_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
