"""Lines that word a skill nearly as it is written, for a table of any number of skills.

A run of as many words as the skill has, or one or two more, names the skill if ``token_set_ratio`` reaches a
threshold. Which runs can is told by two joins, never by trying a skill against a line it has nothing to do with:

* By words. If shared words alone make the ratio, they hold a stated part of the letters of the skill or of the run, so
  the rarest words that hold the rest and a letter more have a shared word among them (a prefix of the word set).
* By pairs of letters. Else the distinct words of both, with a blank around each, share a number of letter pairs that follows
  from their lengths: an insertion or deletion spoils at most two of a side's pairs and the order of words spoils none. Two sets
  that share t of their pairs hold two shared ones among their rarest (size - t + 2), so sets meet by two pairs at once.

Equal lines are cut into runs once, and equal runs are compared once, by their distinct words. What meets is counted before its ratio is taken. Skills and runs are
joined by Spark, hot keys dealt; only the ratio of the pairs that are left is Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossiergrid.functions.similarity import token_set_ratio
from dossiergrid.functions.text import text_or_empty
from dossiergrid.hot_keys import join_dealt, join_split
from dossiergrid.scratch import materialize

THRESHOLD = 85.0
#: Words that a run may have more than the skill.
MORE = 2


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text_or_empty(text)), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def skill_table(skills: DataFrame, skill: str = "skill") -> DataFrame:
    """(skill, n, words): distinct skills, trimmed and lower-cased, with their number of words and the distinct ones, sorted.

    Null and blank skills, and single words of less than four characters, are left out.
    """
    name = F.array_join(_words(F.col(skill)), " ")
    rows = skills.select(name.alias("skill")).distinct().withColumn("w", _words(F.col("skill")))
    rows = rows.where((F.size("w") >= 2) | (F.length("skill") >= 4))
    return rows.select("skill", F.size("w").alias("n"), F.array_sort(F.array_distinct("w")).alias("words"))


def _letters(words: Column) -> Column:
    return F.length(F.array_join(words, " "))


def _pairs(words: Column) -> Column:
    """The letter pairs of words with a blank on either side, each with which of its kind it is."""
    of = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(2)))))
    return F.transform(of, lambda x, i: F.concat(x, F.size(F.filter(F.slice(of, F.lit(1), i), lambda y: y == x)).cast("string")))


def _kept(a: Column, b: Column, threshold: float) -> Column:
    """Letters of two texts of these lengths that their longest common subsequence must keep."""
    return F.ceil((a + b) * threshold / 200 - 1e-9)


def _shared_pairs(a: Column, b: Column, threshold: float) -> Column:
    """Letter pairs that two word sets of these lengths share at least, where the ratio is that of the whole texts."""
    # Of the first's a + 1 pairs, each letter left out spoils two, and each letter put in one.
    return 1 - a - b + 3 * _kept(a, b, threshold)


def _least_shared(a: Column, threshold: float) -> Column:
    """``_shared_pairs`` with whatever length the other side has."""
    low, high = threshold / (200 - threshold), (200 - threshold) / threshold
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(a * low - 1e-9).cast("int")), F.floor(a * high + 1e-9).cast("int"))
    return F.array_min(F.transform(lengths, lambda b: _shared_pairs(a, b, threshold)))


def _runs(lines: DataFrame, lengths: list[int], line: str) -> DataFrame:
    """Every run of one of the ``lengths`` (in words) of every line, by its distinct words, sorted."""
    w = F.col("w")
    none = F.array().cast("array<struct<size:int,words:array<string>>>")

    def of(k: int) -> Column:
        run = lambda i: F.struct(F.lit(k).alias("size"), F.array_sort(F.array_distinct(F.slice(w, i, k))).alias("words"))
        return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), run)).otherwise(none)

    all_runs = F.concat(*[of(k) for k in lengths])
    rows = lines.withColumn("w", _words(F.col(line)))
    return rows.select(*[c for c in lines.columns if c != line], F.explode(F.array_distinct(all_runs)).alias("run")).select("*", "run.size", "run.words").drop("run")


def _ranked(rows: DataFrame, item: str, weight: Column, total: Column, name: str) -> DataFrame:
    """``rows`` (id, side, letters, ``item``) of items that some skill has, with ``df`` and ``before``: the ``weight`` of what is rarer in the set.

    What no skill has can't be shared: it is left out and counts as the rarest. ``total`` is the weight of a whole set.
    """
    wanted = rows.where("side = 1").select(item).distinct()
    counts = rows.groupBy(item).agg(F.count(F.lit(1)).alias("df")).join(wanted, item, "left_semi")
    counts = materialize(counts.withColumn("n", F.col("df")), f"{name}-counts")
    known = join_split(rows, counts, [item], rows.count())
    order, own = Window.partitionBy("id", "side").orderBy("df", item), Window.partitionBy("id", "side")
    rarer = F.coalesce(F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return known.withColumn("before", total - F.sum(weight).over(own) + rarer)


def _by_words(sets: DataFrame, threshold: float) -> DataFrame:
    """(run, skill_id) of sets whose shared words may make the ratio alone."""
    rows = materialize(sets.select("id", "side", "letters", F.explode("words").alias("word")), "skill-words")
    known = _ranked(rows, "word", F.length("word") + 1, F.col("letters") + 1, "skill-words")
    # Shared words hold at least ``least`` of the letters (with a blank after each word); all rarer ones may be missing.
    least = F.ceil(F.col("letters") * (threshold / (200 - threshold)) - 1e-9) + 1
    known = known.withColumn("first", F.col("before") <= F.col("letters") + 1 - least)
    known = materialize(known.select("id", "side", "word", "first"), "skill-word-prefixes")
    runs, skills = known.where("side = 0").select(F.col("id").alias("run"), "word", "first"), known.where("side = 1").select(F.col("id").alias("skill_id"), "word", "first")
    total = runs.count()
    met = join_dealt(runs.where("first").drop("first"), skills.drop("first"), ["word"], F.col("run"), total)
    met = met.unionByName(join_dealt(runs.drop("first"), skills.where("first").drop("first"), ["word"], F.col("run"), total))
    return met.select("run", "skill_id").distinct()


def _by_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(run, skill_id) of sets whose whole texts may have the ratio, by two letter pairs that are rare for both."""
    rows = sets.select("id", "side", "letters", F.explode(_pairs(F.col("words"))).alias("pair"))
    known = _ranked(materialize(rows, "skill-pairs"), "pair", F.lit(1), F.col("letters") + 1, "skill-pairs")
    prefix = known.where(F.col("before") < F.col("letters") + 3 - _least_shared(F.col("letters"), threshold))
    lists = prefix.groupBy("id", "side", "letters").agg(F.array_sort(F.collect_list(F.struct("df", "pair"))).alias("p"))
    two = F.flatten(F.transform(F.col("p.pair"), lambda x, i: F.transform(F.slice(F.col("p.pair"), i + 2, F.size("p")), lambda y: F.xxhash64(x, y))))
    keys = materialize(lists.where(F.size("p") > 1).select("id", "side", "letters", F.explode(two).alias("key")), "skill-pair-keys")
    skills = keys.where("side = 1").select(F.col("id").alias("skill_id"), F.col("letters").alias("b"), "key")
    runs = keys.where("side = 0").select(F.col("id").alias("run"), F.col("letters").alias("a"), "key")
    met = join_dealt(runs, skills, ["key"], F.col("run"), keys.count())
    a, b = F.col("a"), F.col("b")
    return met.where(_kept(a, b, threshold) <= F.least(a, b)).select("run", "skill_id").distinct()


def candidates(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(run, skill_id) of all ``sets`` (id, side, words, letters; side 1 are skills) that can have the ratio, and few others."""
    met = materialize(_by_words(sets, threshold).union(_by_pairs(sets, threshold)).distinct(), "skill-candidates")
    # Of these, only pairs that share enough letter pairs (or the letters that shared words need) are compared.
    of = lambda side, name: sets.where(f"side = {side}").select(F.col("id").alias(name), F.struct("words", "letters").alias(f"{name}_set"))
    pairs = met.join(of(0, "run"), "run").join(of(1, "skill_id"), "skill_id")
    a, b = F.col("run_set.letters"), F.col("skill_id_set.letters")
    shared = F.size(F.array_intersect(_pairs(F.col("run_set.words")), _pairs(F.col("skill_id_set.words"))))
    words = _letters(F.array_intersect(F.col("run_set.words"), F.col("skill_id_set.words")))
    whole = (_kept(a, b, threshold) <= F.least(a, b)) & (shared >= _shared_pairs(a, b, threshold))
    alone = words >= F.ceil(F.least(a, b) * (threshold / (200 - threshold)) - 1e-9)
    text = lambda name: F.array_join(f"{name}_set.words", " ").alias(f"{name}_text")
    return pairs.where(whole | alone).select("run", "skill_id", text("run"), text("skill_id"))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similar_skills(lines: DataFrame, skills: DataFrame, line: str = "line", skill: str = "skill", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``lines`` (without ``line``) with each ``skill`` that a run of their words is like, and the best ``ratio``.

    A row and a skill come once. Rows of ``lines`` are told apart by their other columns, so these should be a key. Null
    and empty lines hold nothing; skills are trimmed and lower-cased, and those too short to compare (``skill_table``) are
    left out. ``threshold`` is above 80, below which two shared letter pairs aren't certain.
    """
    if threshold <= 80:
        raise ValueError("threshold must be above 80")
    keys = [c for c in lines.columns if c != line]
    clash = {"size", "words", "run", "skill", "ratio", "w", "id", "n", "like"} & set(keys)
    if clash:
        raise ValueError(f"columns of lines that clash with the result's or working ones: {sorted(clash)}")
    own = materialize(skill_table(skills, skill), "skills")
    # Lengths of skills, in words: a handful.
    lengths = sorted({r["n"] + k for r in own.select("n").distinct().collect() for k in range(MORE + 1)})
    if not lengths:
        return lines.select(*keys).where("false").select(*keys, F.lit("").alias("skill"), F.lit(0.0).alias("ratio"))
    identifier = lambda c: F.xxhash64(F.array_join(c, " "))
    # Lines that many rows hold are cut into runs once; the rows themselves meet only what their line is like.
    rows = materialize(lines.where(F.col(line).isNotNull()), "skill-rows")
    texts = materialize(rows.groupBy(line).agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()), "skill-lines")
    runs = materialize(_runs(texts.select("id", line), lengths, line).withColumn("run", identifier(F.col("words"))), "skill-runs")
    # A set that several runs, or skills, have is compared once.
    sets = runs.groupBy("run").agg(F.first("words").alias("words")).select(F.col("run").alias("id"), F.lit(0).alias("side"), "words")
    named = own.withColumn("skill_id", identifier(F.col("words")))
    sets = sets.unionByName(named.groupBy("skill_id").agg(F.first("words").alias("words")).select(F.col("skill_id").alias("id"), F.lit(1).alias("side"), "words"))
    sets = materialize(sets.withColumn("letters", _letters(F.col("words"))), "skill-sets")
    like = candidates(sets, threshold).select("run", "skill_id", _ratio("run_text", "skill_id_text").alias("ratio")).where(F.col("ratio") >= threshold)
    like = materialize(like, "skill-ratios")
    # A skill counts for runs of its own length and up to MORE words more.
    wanted = like.join(named.select("skill_id", "skill", "n"), "skill_id").select("run", "skill", "n", "ratio")
    found = join_dealt(runs.select("id", "size", "run"), wanted, ["run"], F.col("id"), runs.count()).where(F.col("size").between(F.col("n"), F.col("n") + MORE))
    best = found.groupBy("id", "skill").agg(F.max("ratio").alias("ratio"))
    like = materialize(best.groupBy("id").agg(F.collect_list(F.struct("skill", "ratio")).alias("like")).join(texts, "id").drop("id"), "skill-likes")
    met = join_split(rows, like, [line], rows.count()).select(*keys, F.explode("like").alias("like"))
    return met.groupBy(*keys, F.col("like.skill").alias("skill")).agg(F.max("like.ratio").alias("ratio"))
