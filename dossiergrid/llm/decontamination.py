"""Benchmark decontamination over a distributed positional inverted index.

Test items are cut into windows of consecutive words. The index stores a posting
(row, position, term) of the training text for every term that a window holds;
other terms can't take part in a match. The postings are written once to the
shared folder, so the corpus is tokenised once. A window is looked up from its
rarest terms: the list of the rarest is shifted by its offset and intersected
with the shifted list of the next, and what is left must be in the lists of all
the others. DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossiergrid.llm.expressions import ascii_lower
from dossiergrid.scratch import materialize

#: ASCII letters, digits, and every character beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: No word: marks the end of a text, at the position that is its number of words.
END = " "
#: A side is broadcast when it is known to have at most so many rows of a few dozen bytes.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Words in their order, not yet lower-cased; a null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if it has few rows; else leave the join to Spark's shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass
class PhraseIndex:
    """``postings`` (row_id, pos, term_id), ``rows`` (row_id, doc_id, n_words) of the corpus;
    ``windows`` (window_id, n, terms), ``window_items`` (window_id, item_id), ``terms`` of the tests."""

    postings: DataFrame
    rows: DataFrame
    windows: DataFrame
    window_items: DataFrame
    terms: DataFrame


def build_index(docs: DataFrame, items: DataFrame, width: int = 10, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> PhraseIndex:
    """Index ``docs`` for the windows of ``items``.

    An item of fewer words than ``width``, but not none, is one window. Null texts
    have no words. Each row of ``docs`` is a document of its own even where
    identifiers repeat or are null.
    """
    said = items.select(items[item_col].alias("item_id"), F.transform(words(items[item_text_col]), ascii_lower).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))
    cut = said.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("w")).distinct()
    cut = materialize(cut, "decontamination-windows")
    windows = materialize(cut.select("w").distinct().withColumn("window_id", F.monotonically_increasing_id()), "decontamination-window-ids")
    window_items = cut.join(windows, "w").select("window_id", "item_id")
    vocabulary = windows.select(F.explode("w").alias("term")).distinct().union(docs.sparkSession.range(1).select(F.lit(END)))
    terms = materialize(vocabulary.withColumn("term_id", F.monotonically_increasing_id()), "decontamination-terms")
    n_terms = terms.count()

    # Documents come with an end mark, which gives every row its length.
    text = docs.select(
        F.monotonically_increasing_id().alias("row_id"), docs[id_col].alias("doc_id"), F.concat(words(docs[text_col]), F.array(F.lit(END))).alias("w")
    )
    tokens = text.select("row_id", "doc_id", F.posexplode("w").alias("pos", "raw"))
    tokens = tokens.select("row_id", "doc_id", "pos", ascii_lower(F.col("raw")).alias("term"))
    end_id = terms.where(F.col("term") == END).first()["term_id"]
    found = tokens.join(small(terms, n_terms), "term").select(
        "row_id", F.when(F.col("term_id") == end_id, F.col("doc_id")).alias("doc_id"), "pos", "term_id"
    )
    stored = materialize(found, "decontamination-postings")
    rows = stored.where(F.col("term_id") == end_id).select("row_id", "doc_id", F.col("pos").cast("long").alias("n_words"))
    postings = stored.where(F.col("term_id") != end_id).select("row_id", "pos", "term_id")
    return PhraseIndex(postings, rows, windows, window_items, terms)


def _window_terms(index: PhraseIndex) -> DataFrame:
    """(window_id, n, off, term_id, rank) of the windows all of whose terms have postings; rank 1 is the rarest term."""
    spread = index.windows.select("window_id", F.size("w").alias("n"), F.posexplode("w").alias("off", "term"))
    lists = index.postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("postings"))
    n_terms = index.terms.count()
    known = spread.join(small(index.terms, n_terms), "term").join(small(lists, n_terms), "term_id")
    whole = Window.partitionBy("window_id")
    known = known.withColumn("known", F.count(F.lit(1)).over(whole)).where("known = n")
    return known.withColumn("rank", F.row_number().over(whole.orderBy("postings", "off"))).select("window_id", "n", "off", "term_id", "rank")


def exact_matches(index: PhraseIndex) -> DataFrame:
    """(row_id, window_id, start, n): every occurrence of every window."""
    terms = materialize(_window_terms(index), "decontamination-window-terms")
    n_terms = terms.count()
    first = terms.where("rank = 1").select("window_id", "n", F.col("off").alias("off1"), "term_id")
    second = terms.where("rank = 2").select("window_id", F.col("off").alias("off2"), F.col("term_id").alias("term2"))
    anchors = first.join(second, "window_id", "left")
    shifted = index.postings.join(small(anchors, n_terms), "term_id").select(
        "row_id", "window_id", "n", (F.col("pos") - F.col("off1")).alias("start"), "off2", "term2"
    )
    shifted = shifted.where("start >= 0")
    seconds = second.select(F.col("term2").alias("term_id")).distinct()
    with_second = index.postings.join(small(seconds, n_terms), "term_id", "left_semi")
    both = shifted.where("term2 is not null").withColumn("pos", F.col("start") + F.col("off2"))
    both = both.join(with_second.withColumnRenamed("term_id", "term2"), ["row_id", "pos", "term2"], "left_semi")
    left = both.select("row_id", "window_id", "n", "start").unionByName(shifted.where("n = 1").select("row_id", "window_id", "n", "start"))
    left = materialize(left, "decontamination-candidates")
    # The lists of all other terms, in the rows that still have a candidate.
    candidates = left.select("row_id").distinct()
    n_rows = candidates.count()
    near = index.postings.join(small(candidates, n_rows), "row_id", "left_semi")
    others = terms.where("rank > 2").select("window_id", "off", "term_id")
    wanted = left.where("n > 2").join(small(others, n_terms), "window_id").select(
        "row_id", "window_id", "n", "start", (F.col("start") + F.col("off")).alias("pos"), "term_id"
    )
    met = wanted.join(near, ["row_id", "pos", "term_id"], "left_semi")
    met = met.groupBy("row_id", "window_id", "start", "n").agg(F.count(F.lit(1)).alias("met")).where("met = n - 2")
    return met.select("row_id", "window_id", "start", "n").unionByName(left.where("n <= 2").select("row_id", "window_id", "start", "n"))


def _near(wanted: DataFrame, postings: DataFrame, lengths: list[int], slop: int) -> DataFrame:
    """The rows of ``wanted`` (row_id, window_id, n, need, at, term_id) with a posting of the term at most n + slop words away.

    Positions are cut into cells as wide as the reach, so that the range join is an equality on neighbouring cells.
    """
    reach = F.col("n") + slop
    own = F.floor(F.col("at") / reach)
    wanted = wanted.withColumn("cell", F.explode(F.sequence(own - 1, own + 1)))
    sizes = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    cells = postings.select(F.col("row_id").alias("row2"), F.col("term_id").alias("term2"), "pos", F.explode(sizes).alias("n2"))
    cells = cells.withColumn("cell2", F.floor(F.col("pos") / (F.col("n2") + slop)))
    close = (F.col("row_id") == F.col("row2")) & (F.col("term_id") == F.col("term2")) & (F.col("cell") == F.col("cell2")) & (F.col("n") == F.col("n2"))
    met = wanted.join(cells, close & (F.abs(F.col("pos") - F.col("at")) <= reach))
    return met.select("row_id", "window_id", "n", "need", "at", "term_id").distinct()


def proximity_matches(index: PhraseIndex, slop: int = 5) -> DataFrame:
    """(row_id, window_id, pos): places of a window's rarest term with all its other distinct terms
    at most ``n + slop`` words away, in any order. From the rarest on: the second rarest term
    must be near before any other is looked for."""
    terms = materialize(_window_terms(index), "decontamination-proximity-terms")
    n_terms = terms.count()
    own = terms.groupBy("window_id", "n", "term_id").agg(F.min("rank").alias("rank"))
    window = Window.partitionBy("window_id")
    own = own.withColumn("need", F.count(F.lit(1)).over(window)).withColumn("rank", F.row_number().over(window.orderBy("rank")))
    own = materialize(own, "decontamination-proximity-order")
    lengths = [r["n"] for r in own.select("n").distinct().collect()]  # at most the width of a window
    anchors = index.postings.join(small(own.where("rank = 1"), n_terms), "term_id")
    anchors = anchors.select("row_id", "window_id", "n", "need", F.col("pos").alias("at"))
    second = own.where("rank = 2").select("window_id", "term_id")
    few = index.postings.join(small(second.select("term_id").distinct(), n_terms), "term_id", "left_semi")
    two = _near(anchors.where("need > 1").join(small(second, n_terms), "window_id"), few, lengths, slop).drop("term_id")
    two = materialize(two, "decontamination-proximity-pairs")
    rows = two.select("row_id").distinct()
    here = index.postings.join(small(rows, rows.count()), "row_id", "left_semi")
    others = own.where("rank > 2").select("window_id", "term_id")
    all_met = _near(two.where("need > 2").join(small(others, n_terms), "window_id"), here, lengths, slop)
    all_met = all_met.groupBy("row_id", "window_id", "at", "need").agg(F.count(F.lit(1)).alias("met")).where("met = need - 2")
    done = [anchors.where("need = 1"), two.where("need = 2"), all_met]
    return reduce(DataFrame.unionByName, [d.select("row_id", "window_id", F.col("at").alias("pos")) for d in done])


def near_items(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 5, **cols: str) -> DataFrame:
    """(doc_id, item_id, n_places) of every document row and item with a window whose terms all stand near each other
    in some order; ``n_places`` counts the places of the windows' rarest terms. Null texts have no words."""
    index = build_index(docs, items, width, **cols)
    met = proximity_matches(index, slop).join(index.window_items, "window_id").select("row_id", "item_id", "pos").distinct()
    met = met.groupBy("row_id", "item_id").agg(F.count(F.lit(1)).alias("n_places"))
    return met.join(index.rows, "row_id").select("doc_id", "item_id", "n_places")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, **cols: str) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    ``n_hit`` counts the words inside any occurrence of a window; ``items_sha256``
    hashes the identifiers of the items with occurring windows, sorted as strings
    and joined by commas (null identifiers are left out of it and counted as one
    item). Without items, or without words, nothing is hit.
    """
    index = build_index(docs, items, width, **cols)
    matches = materialize(exact_matches(index), "decontamination-matches")
    # Spans of one document by start: each adds what lies beyond the furthest end before it.
    spans = matches.groupBy("row_id", "start").agg((F.col("start") + F.max("n")).alias("end"))
    earlier = Window.partitionBy("row_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("done", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    hit = spans.groupBy("row_id").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "done"))).alias("n_hit"))
    pairs = matches.select("row_id", "window_id").distinct().join(index.window_items, "window_id").select("row_id", "item_id").distinct()
    said = pairs.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("items")
    )
    out = index.rows.join(hit, "row_id", "left").join(said, "row_id", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontamination_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches of all documents with all items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), v AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM i WHERE len(w) > 0)
), z AS (SELECT DISTINCT n FROM v), p AS (
  SELECT doc_id, z.n, unnest(range(1, len(w) - z.n + 2)) AS s, w FROM d, z WHERE len(w) >= z.n
), m AS (
  SELECT p.doc_id, p.s, p.n, v.item_id FROM p JOIN v ON v.n = p.n AND v.win = array_to_string(p.w[p.s:p.s + p.n - 1], ' ')
), h AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT doc_id, s, n FROM m)) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
