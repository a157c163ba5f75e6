"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of equal token counts. Slot ``i`` lies at the
fractional part of ``(i + 1/2)`` times the golden ratio's inverse; the cumulative
targets of the sources cut the unit interval, and the source whose piece holds
the point owns the slot. Slots are ranked within their source, every source's
documents are laid end to end in a seeded shuffle, and the slot of rank ``r``
takes the ``r``-th block of that stream. A stream starts again at its end, at
most ``max_epochs`` times. A source that whole slots would leave more than
``TOLERANCE`` off its target takes exactly its target: its last slots are cut, or
slots are added to it at the end of the sequence.

Ranks and stream offsets are prefix sums in two levels (chunks, then rows within
a chunk), so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossiergrid.scratch import materialize

GOLDEN = 0.6180339887498949
#: Slots aimed at, and the most tokens of a block: the number of slots grows beyond it.
SLOTS = 65536
MAX_BLOCK = 4096
#: Slots of one chunk of the ranking, and cells of the unit interval for the range join.
CHUNK = 16384
CELLS = 1024
#: The most that a source may be off its target by whole slots, as a part of the target.
TOLERANCE = 0.01

WORDS = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """``documents``: a row per document; ``sources``; ``schedule``: the pieces of each slot."""

    documents: DataFrame
    sources: DataFrame
    schedule: DataFrame


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``lo``, ``hi`` from one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn. The total
    is shared by weight; a target above ``max_epochs`` sizes stops there, and the
    excess is shared by weight again, which ends at the water level at which
    ``min(max_epochs * size, level * weight)`` adds up to the total. The window has
    one row per source, not per document.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(x) for x in weights])
    ranked = sizes.withColumn("w", F.element_at(w, (F.pmod(F.row_number().over(order) - 1, len(weights)) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs).withColumn("total", F.sum("source_size").over(everything))
    # Sources reach their cap in the order of cap / weight; those before a source are full when it is.
    by_level = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("rest_w"))
    )
    # The level is the first whose source is not full at it.
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level"))))
    with_level = filled.withColumn("water", level.over(everything)["level"])
    target = F.when(F.col("cap") <= F.col("water") * F.col("w"), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("w"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        with_level.withColumn("target", F.coalesce(target, F.lit(0.0)))
        .withColumn("hi", F.sum("target").over(upto))
        .withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
        .withColumn("top", F.max("hi").over(everything))
        .select("source", "source_size", "target", F.try_divide("lo", "top").alias("lo"), F.try_divide("hi", "top").alias("hi"))
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: str = "mix",
) -> Mix:
    """Schedule a mix of all documents as long as the documents together.

    A null text has no words and is never taken. A null source is a source of its
    own, last in order. Repeated rows are separate documents; null identifiers are
    shuffled like any other. Other columns are ignored. Without rows, or without any
    word, nothing is taken. Reruns give the same mix: the shuffle hashes the seed
    and the identifier.
    """
    spark = docs.sparkSession
    ident = docs[id_col].cast("string")
    slim = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            docs[id_col].alias("doc_id"),
            docs[source_col].alias("source"),
            word_count(docs[text_col]).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident, F.lit("")))).alias("key"),
        ),
        "mix-sizes",
    )
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialize(source_targets(sizes, weights, max_epochs), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    block = min(MAX_BLOCK, max(1, total // SLOTS))
    n_slots = -(-total // block)

    # Offsets of the documents in their source's stream.
    place = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "row_id")
    bucketed = slim.where("size > 0").withColumn("bucket", F.substring("key", 1, 3))
    base = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(base), F.lit(0))).drop("n")
    local = bucketed.withColumn("end", F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    same = [local["source"].eqNullSafe(bases["source"]), local["bucket"] == bases["bucket"]]
    placed = local.join(bases, same).select(
        local["row_id"], local["source"], local["doc_id"], local["size"], (F.col("base") + F.col("end") - F.col("size")).alias("start")
    )

    # Slots and their ranks.
    cells = sources.where("hi > lo").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS)))
    )
    x = (F.col("slot") + F.lit(0.5)) * F.lit(GOLDEN)
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("x", x - F.floor(x)).withColumn("cell", F.floor(F.col("x") * CELLS))
    owned = slots.join(cells, (slots["cell"] == cells["cell"]) & (slots["x"] >= cells["lo"]) & (slots["x"] < cells["hi"])).select(
        "slot", "source", F.floor(F.col("slot") / CHUNK).alias("chunk")
    )
    chunks = owned.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunk_base = chunks.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    in_chunk = owned.withColumn("r", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    ranked = in_chunk.join(
        chunk_base, in_chunk["source"].eqNullSafe(chunk_base["source"]) & (in_chunk["chunk"] == chunk_base["chunk"])
    ).select(in_chunk["source"], in_chunk["slot"], (F.col("r") + F.col("base")).alias("rank"))

    # The words that a source takes, and the slots that it needs beyond its own; one row per source.
    owns = chunks.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("n"))
    quota = sources.join(owns, sources["source"].eqNullSafe(F.col("s")), "left").drop("s").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = F.least(F.col("n") * block, F.col("source_size") * max_epochs)
    off = F.abs(whole - F.col("target")) > F.col("target") * TOLERANCE
    quota = quota.withColumn("words", F.when(off, F.round("target").cast("long")).otherwise(whole))
    quota = quota.withColumn("extra", F.greatest(F.lit(0), F.ceil(F.col("words") / block) - F.col("n")))
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    quota = quota.withColumn("next", n_slots + F.coalesce(F.sum("extra").over(before), F.lit(0)))
    quota = materialize(quota.select("source", "source_size", "n", "words", "extra", "next"), "mix-quota")
    added = quota.where("extra > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("extra") - 1)))
    ranked = ranked.union(added.select("source", (F.col("next") + F.col("k")).alias("slot"), (F.col("n") + F.col("k")).alias("rank")))

    # The block of a rank is a span of the source's stream, which is repeated.
    spans = placed.join(quota.where("words > 0").select(F.col("source").alias("s"), "source_size", "words"), placed["source"].eqNullSafe(F.col("s")))
    passes = F.ceil(F.col("words") / F.col("source_size"))
    spans = spans.withColumn("epoch", F.explode(F.sequence(F.lit(0), passes.cast("int") - 1))).withColumn(
        "from", F.col("start") + F.col("epoch") * F.col("source_size")
    )
    spans = spans.where(F.col("from") < F.col("words")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words")))
    spans = spans.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    schedule = spans.join(ranked, spans["source"].eqNullSafe(ranked["source"]) & (spans["rank"] == ranked["rank"])).select(
        "slot",
        spans["source"],
        spans["rank"],
        "row_id",
        "doc_id",
        "epoch",
        F.greatest(F.lit(0), F.col("from") * -1 + spans["rank"] * block).alias("first_word"),
        (F.least(F.col("to"), (spans["rank"] + 1) * block) - F.greatest(F.col("from"), spans["rank"] * block)).alias("n_words"),
    )
    taken = schedule.groupBy("row_id").agg(F.sum("n_words").alias("taken"))
    documents = (
        slim.join(taken, "row_id", "left")
        .join(sources.select(F.col("source").alias("s"), "source_size", "target"), slim["source"].eqNullSafe(F.col("s")))
        .select("row_id", "doc_id", slim["source"], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
    return Mix(documents, sources, schedule)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).documents.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || doc_id) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source
), fill AS (
  SELECT 0 AS round, source, source_size, w, false AS capped, (SELECT sum(source_size) FROM s)::DOUBLE AS rest, NULL::DOUBLE AS target FROM s
  UNION ALL
  SELECT * FROM (
    SELECT round + 1 AS round, source, source_size, w, capped OR 3 * source_size <= level * w, rest, least(3 * source_size, level * w)
    FROM (
      SELECT *, (rest - coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0))
                / nullif(sum(CASE WHEN NOT capped THEN w END) OVER (), 0) AS level
      FROM fill
    )
  ) z WHERE z.round <= (SELECT count(*) FROM s)
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN 3.0::DOUBLE * source_size ELSE target END AS target
  FROM fill WHERE round = (SELECT max(round) FROM fill)
), b AS (
  SELECT *, sum(target) OVER (ORDER BY source ASC NULLS LAST) AS hi FROM t
), c AS (
  SELECT *, coalesce(lag(hi) OVER (ORDER BY source ASC NULLS LAST), 0.0) / max(hi) OVER () AS lo01, hi / max(hi) OVER () AS hi01 FROM b
), k AS (
  SELECT sum(size)::BIGINT AS total, least(4096, greatest(1, sum(size)::BIGINT // 65536)) AS block FROM d
), x AS (
  SELECT (i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE - floor((i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) AS x
  FROM (SELECT unnest(range((SELECT (total + block - 1) // block FROM k))) AS i)
), n AS (
  SELECT c.source, count(x.x) AS slots FROM c LEFT JOIN x ON x.x >= c.lo01 AND x.x < c.hi01 GROUP BY c.source
), p AS (
  SELECT d.doc_id, d.source, d.size, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d
)
SELECT p.doc_id, p.size, t.source_size, t.target,
       (((m.words // greatest(t.source_size, 1)) * p.size)
        + greatest(0, least(p.size, m.words % greatest(t.source_size, 1) - p.start)))::BIGINT AS taken
FROM p
JOIN t ON t.source IS NOT DISTINCT FROM p.source
JOIN (SELECT source, CASE WHEN abs(whole - target) > target * 0.01::DOUBLE THEN round(target)::BIGINT ELSE whole END AS words
      FROM (SELECT n.source, t.target, least(n.slots * k.block, 3 * t.source_size)::BIGINT AS whole
            FROM n JOIN t ON t.source IS NOT DISTINCT FROM n.source, k)) m ON m.source IS NOT DISTINCT FROM p.source
"""
