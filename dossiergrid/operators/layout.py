"""Pages as tables of positioned words: column gutters, columns and lines.

A gutter is found by a sweep: every word adds one where it begins and takes one off where it
ends, and the running sum tells how many words lie across each two-point step. Runs of steps that at most
one word crosses are the islands of that sum. All windows hold the words of one page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossiergrid.functions.text import let

# The part of a page's width that may hold a gutter, its steps and least width in points, and the words beside it.
LEFT, RIGHT, STEP, LEAST_WIDTH = 0.22, 0.68, 2, 16
LEAST_WORDS, LEAST_LEFT, LEAST_RIGHT, LEAST_SHARE = 35, 12, 20, 0.12
# How far tops of one line may lie apart, and the gap that becomes two spaces.
TOLERANCE, WIDE_GAP = 3, 12


def gutters(words: DataFrame, pages: DataFrame, key: str = "page") -> DataFrame:
    """(key, left, right): the widest gutter of every page that has words enough on both sides, the first among equally wide ones.

    ``words``: key, x0, x1, top, text; ``pages``: key, width (one row a page). Pages of few words, without a positive width or without a gutter
    have no row.
    """
    sized = words.select(key, "x0", "x1").join(pages.where("width > 0").select(key, "width"), key)
    many = sized.groupBy(key).agg(F.count(F.lit(1)).alias("words"), F.first("width").alias("width")).where(F.col("words") >= LEAST_WORDS)
    begin, steps = F.col("width") * LEFT, F.ceil(F.col("width") * (RIGHT - LEFT) / STEP)
    first = F.floor((F.col("x0") - begin - STEP) / STEP) + 1
    last = F.ceil((F.col("x1") - begin) / STEP) - 1
    across = sized.select(key, F.greatest(first, F.lit(0)).alias("a"), F.least(last, steps - 1).alias("b")).where("a <= b")
    ends = across.select(key, F.inline(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("at"), F.lit(-1).alias("d")))))
    borders = many.select(key, F.inline(F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("d")), F.struct(steps.alias("at"), F.lit(0).alias("d")))))
    changes = ends.unionByName(borders).groupBy(key, "at").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(key).orderBy("at")
    swept = changes.withColumns({"over": F.sum("d").over(order), "next": F.lead("at").over(order)}).where("next is not null")
    crossed = F.col("over") > 1
    islands = swept.withColumn("crossed", crossed).withColumn("island", F.sum(F.col("crossed").cast("int")).over(order)).where("not crossed")
    bands = islands.groupBy(key, "island").agg(F.min("at").alias("from"), F.max("next").alias("to")).join(many, key)
    bands = bands.select(key, "words", "island", (begin + F.col("from") * STEP).alias("left"), F.least(begin + F.col("to") * STEP, F.col("width") * RIGHT).alias("right"))
    bands = bands.where(F.col("right") - F.col("left") >= LEAST_WIDTH)
    beside = words.select(key, "x0", "x1").join(bands, key).groupBy(key, "island", "left", "right", "words").agg(
        F.count_if(F.col("x1") <= F.col("left")).alias("n"), F.count_if(F.col("x0") >= F.col("right")).alias("m")
    )
    fits = (F.col("n") >= LEAST_LEFT) & (F.col("m") >= LEAST_RIGHT) & (F.least("n", "m") / F.col("words") >= LEAST_SHARE)
    best = F.min_by(F.struct("left", "right"), F.struct((F.col("left") - F.col("right")).alias("narrow"), "left"))
    return beside.where(fits).groupBy(key).agg(best.alias("g")).select(key, "g.left", "g.right")


def page_lines(words: DataFrame, pages: DataFrame, key: str = "page", tolerance: float = TOLERANCE) -> DataFrame:
    """(key, line_no, line): the lines of every page, column by column where it has a gutter; the column that begins higher comes first.

    A line takes the words whose tops lie at most ``tolerance`` below its first one's; words are ordered by x0 (then top and
    text), a wide gap becomes two spaces, and lines of blanks are left out. Words with a null position or text are left out.
    """
    placed = words.select(key, "text", "x0", "x1", "top").where("text is not null and x0 is not null and x1 is not null and top is not null")
    middle = (F.col("left") + F.col("right")) / 2
    rows = placed.join(gutters(placed, pages, key), key, "left").withColumn("side", F.coalesce(((F.col("x0") + F.col("x1")) / 2 >= middle).cast("int"), F.lit(0)))
    # A line's anchor is its first top, so the tops are walked through in order; there are as many as a column has lines, about.
    tops = rows.groupBy(key, "side").agg(F.array_sort(F.collect_set("top")).alias("tops"))
    none = F.array().cast("array<double>")
    walked = F.aggregate("tops", none, lambda found, t: F.when((F.size(found) == 0) | (t - F.try_element_at(found, F.lit(-1)) > tolerance), F.concat(found, F.array(t.cast("double")))).otherwise(found))
    anchored = tops.select(key, "side", walked.alias("anchors"), F.element_at("tops", 1).alias("begins"))
    # The anchor of a top is the last one that isn't below it.
    spans = anchored.select(key, "side", "begins", F.posexplode("anchors").alias("nth", "anchor"))
    spans = spans.withColumn("until", F.lead("anchor").over(Window.partitionBy(key, "side").orderBy("nth")))
    a, b = rows.alias("a"), spans.alias("b")
    same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.side") == F.col("b.side"))
    met = a.join(b, same & (F.col("a.top") >= F.col("b.anchor")) & (F.col("b.until").isNull() | (F.col("a.top") < F.col("b.until"))))
    met = met.select(F.col(f"a.{key}").alias(key), "a.side", "begins", "nth", "x0", "top", "text", "x1")
    line = met.groupBy(key, "side", "begins", "nth").agg(F.array_sort(F.collect_list(F.struct("x0", "top", "text", "x1"))).alias("w"))
    gap = lambda w, i: F.when(w["x0"] - F.try_element_at(F.col("w"), i)["x1"] >= WIDE_GAP, "  ").otherwise(" ")
    joined = F.array_join(F.transform("w", lambda w, i: F.concat(F.when(i == 0, F.lit("")).otherwise(gap(w, i)), w["text"])), "")
    line = line.select(key, "side", "begins", "nth", let(joined, lambda t: F.trim(t)).alias("line")).where("line <> ''")
    order = Window.partitionBy(key).orderBy("begins", "side", "nth")
    return line.select(key, (F.row_number().over(order) - 1).alias("line_no"), "line")
