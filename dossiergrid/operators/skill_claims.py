"""Which wanted skills a resume names, on the line table: by name or alias, and by what entails them.

Every line meets the names that its own resume is asked for as one list, so that no pair of line and name becomes a row
unless the line names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossiergrid.functions import lexicon as lx
from dossiergrid.functions.text import text_or_empty
from dossiergrid.operators.history import claimed_lines

#: What disclaims a mention behind it. Spaces are single where it is looked for, so that it is of bounded length.
_CUE = f"(?:{lx.NEGATION}|{lx.ASPIRATION})".replace(r"\s+", " ")
_GUARD = _CUE + "[^.;:]{0,60}"


def _flat(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text_or_empty(value)), r"(?U)\s+", " "))


def _lookup(table: dict[str, list[str]], skill: Column) -> Column:
    pairs = [x for name, others in table.items() for x in (F.lit(name), F.array(*[F.lit(o) for o in others]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _flat(skill)), F.array().cast("array<string>"))


def names_of(skill: Column) -> Column:
    """A skill and its aliases, in small letters with single spaces."""
    return F.array_union(F.array(_flat(skill)), F.transform(_lookup(lx.SKILL_ALIASES, skill), _flat))


def entailing(skill: Column) -> Column:
    """The skills that entail a skill, in the order in which they are tried."""
    return _lookup(lx.SKILL_IMPLICATIONS, skill)


def names(flat: Column, name: Column) -> Column:
    """Whether a line (in small letters, with single spaces) has a mention of a name of ``names_of`` that nothing before it disclaims.

    Names with signs match anywhere, others as whole words.
    """
    body = F.when(name.rlike("[^a-z0-9 ]"), F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))).otherwise(F.concat(F.lit(r"\b"), name, F.lit(r"\b")))
    # Small letters hold no end of a quotation. The long pattern is made only for lines that disclaim something.
    plain = F.regexp_like(flat, F.concat(F.lit("(?U)"), body))
    guarded = F.regexp_like(flat, F.concat(F.lit("(?U)(?="), body, F.lit(f")(?<!{_GUARD})")))
    return (name != "") & F.contains(flat, name) & F.when(flat.rlike(f"(?U){_CUE}"), guarded).otherwise(plain)


def _asked(skill: Column) -> Column:
    """``array<struct<skill,rank,by,name>>``: all names that show a skill; rank 0 are its own, the others those of what entails it."""
    own = F.transform(names_of(skill), lambda n: F.struct(skill.alias("skill"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("by"), n.alias("name")))
    others = F.flatten(F.transform(entailing(skill), lambda e, i: F.transform(names_of(e), lambda n: F.struct(skill.alias("skill"), (i + 1).alias("rank"), e.alias("by"), n.alias("name")))))
    return F.concat(own, others)


def skill_claims(lines: DataFrame, wanted: DataFrame, key: str = "resume_id", line: str = "line", implied: bool = True) -> DataFrame:
    """(key, skill, named, implied_by) of every distinct skill in ``wanted`` (key, skills array).

    ``named`` is true where a line outside sections of what is being learnt names the skill or an alias with no disclaimer before
    the mention; else ``implied_by`` is the first skill that entails it and is named so (null with ``implied`` off). Blank and null skills are left out; a resume
    without lines names nothing; rows of ``wanted`` with one key count together. Skills that are only worded alike are for ``skill_join``.
    """
    trimmed = F.filter(F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda s: F.trim(text_or_empty(s))), lambda s: s != "")
    asked = wanted.select(F.col(key).alias("__key"), F.explode(trimmed).alias("skill")).distinct()
    shown = _asked(F.col("skill"))
    lists = asked.withColumn("a", shown if implied else F.filter(shown, lambda a: a["rank"] == 0)).groupBy("__key").agg(F.flatten(F.collect_list("a")).alias("asked"))
    rows = claimed_lines(lines.select(F.col(key).alias("__key"), "line_no", F.col(line).alias("line")), "__key")
    met = rows.select("__key", _flat(F.col("line")).alias("flat")).join(lists, "__key")
    hits = met.select("__key", F.explode(F.filter("asked", lambda a: names(F.col("flat"), a["name"]))).alias("hit"))
    # Both sides are few rows a resume; hits of a skill are folded before they are moved.
    best = hits.groupBy("__key", F.col("hit.skill").alias("skill")).agg(F.min(F.struct("hit.rank", "hit.by")).alias("best"))
    out = asked.join(best, ["__key", "skill"], "left")
    return out.select(F.col("__key").alias(key), "skill", F.coalesce(F.col("best.rank") == 0, F.lit(False)).alias("named"), F.col("best.by").alias("implied_by"))


def skill_sides(claims: DataFrame, wanted: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, matched, missing, implied) of every row of ``wanted`` (key, skills array): its skills in its own order, and a map of those that are only entailed."""
    pairs = claims.groupBy(F.col(key).alias("__key")).agg(
        F.collect_set(F.when(F.col("named") | F.col("implied_by").isNotNull(), F.col("skill"))).alias("have"),
        F.map_from_entries(F.collect_list(F.when(F.col("implied_by").isNotNull(), F.struct("skill", "implied_by")))).alias("implied"),
    )
    none = F.array().cast("array<string>")
    skills = F.filter(F.transform(F.coalesce("skills", none), lambda s: F.trim(text_or_empty(s))), lambda s: s != "")
    rows = wanted.select(F.col(key).alias("__key"), skills.alias("skills")).join(pairs, "__key", "left").withColumn("have", F.coalesce("have", none))
    side = lambda inside: F.filter("skills", lambda s: F.array_contains(F.col("have"), s) == inside)
    implied = F.coalesce("implied", F.create_map().cast("map<string,string>"))
    return rows.select(F.col("__key").alias(key), side(True).alias("matched"), side(False).alias("missing"), implied.alias("implied"))
