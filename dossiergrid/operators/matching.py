"""Which of its own job's skills a resume claims.

A job's skills go to its resumes with the job; one scalar Arrow function per resume then
tests them, so no text is copied per skill, no pair of resume and foreign skill is made and
nothing but the jobs' rows is moved. Null lists and texts count as empty, blank skills are
left out, a skill that is listed twice is reported twice.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossiergrid.batches import bound_batches
from dossiergrid.functions import claims
from dossiergrid.functions.text import text_or_empty

SIDES = ("required", "critical", "preferred")
#: Jobs are sent to every executor up to this many rows and bytes of text; beyond it they are joined by salted key.
MOST_JOBS, MOST_BYTES, SALT = 200_000, 64 << 20, 16

_FOUND = T.StructType().add("claimed", T.ArrayType(T.StringType())).add("inferred", T.MapType(T.StringType(), T.StringType()))


def with_jobs(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """``rows`` with the columns of their ``jobs`` by ``job_id`` (one row a job); rows without a job are left out.

    Few jobs are broadcast behind a count of their size. Else the rows of a job, however
    many, are dealt to ``SALT`` keys, and every job is there under each of them.
    """
    seen = jobs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct(*jobs.columns)))).alias("bytes")).first()
    if seen["n"] <= MOST_JOBS and (seen["bytes"] or 0) <= MOST_BYTES:
        return rows.join(F.broadcast(jobs), "job_id")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith("map")]), F.lit(SALT)).cast("int"))
    every = jobs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(every, ["job_id", "salt"]).drop("salt")


def _lists(column: pd.Series) -> list[list[str]]:
    return [[] if x is None else [s.strip() for s in x if s is not None and s.strip()] for x in column]


def _lines(column: pd.Series) -> list[list[str]]:
    return [claims.claimed_lines(x or "") for x in column]


@F.pandas_udf(_FOUND)
def _claims(text: pd.Series, skills: pd.Series) -> pd.DataFrame:
    have = claims.claimed(_lines(text), _lists(skills))
    return pd.DataFrame({"claimed": [sorted(x) for x in have], "inferred": [{} for _ in have]})


@F.pandas_udf(_FOUND)
def _claims_and_implied(text: pd.Series, skills: pd.Series) -> pd.DataFrame:
    have, by = claims.with_implied(_lines(text), _lists(skills))
    return pd.DataFrame({"claimed": [sorted(x) for x in have], "inferred": by})


@F.pandas_udf(T.BooleanType())
def _related_work(text: pd.Series, skills: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series(claims.related_work([x or "" for x in text], _lists(skills), [x or "" for x in title]))


_SCREENED = T.StructType().add("found", _FOUND).add("preferred", T.ArrayType(T.StringType())).add("related", T.BooleanType())


@F.pandas_udf(_SCREENED)
def _screened(text: pd.Series, needed: pd.Series, preferred: pd.Series, title: pd.Series) -> pd.DataFrame:
    have, by, liked, related = claims.screened([x or "" for x in text], _lists(needed), _lists(preferred), [x or "" for x in title])
    found = [{"claimed": sorted(x), "inferred": i} for x, i in zip(have, by, strict=True)]
    return pd.DataFrame({"found": found, "preferred": [sorted(x) for x in liked], "related": related})


def screened(text: Column, needed: Column, preferred: Column, title: Column) -> Column:
    """``struct<found,preferred,related>``: ``found_skills`` of the needed skills with implied ones, the preferred skills claimed, and ``related_work`` of all."""
    return _screened.asNondeterministic()(text, needed, preferred, title)


def found_skills(text: Column, skills: Column, implied: bool) -> Column:
    """``struct<claimed,inferred>``: the skills that a text claims, and a map of entailed ones to what entails them.

    ``text`` and ``skills`` must be columns of the input, not lambdas over them, which Spark does not hand to Python.
    """
    return (_claims_and_implied if implied else _claims).asNondeterministic()(text, skills)  # made once, where it stands


def related_work(text: Column, skills: Column, title: Column) -> Column:
    """Whether the work section (the whole text where there is none) claims a skill or holds a word of the title."""
    return _related_work.asNondeterministic()(text, skills, title)


def trimmed(skills: Column) -> Column:
    """Skills without blanks around them, and without blank ones; null as none."""
    some = F.coalesce(skills, F.array().cast("array<string>"))
    return F.filter(F.transform(some, lambda s: F.regexp_replace(text_or_empty(s), r"^\s+|\s+$", "")), lambda s: s != "")


def matched_in(skills: Column, found: Column, implied: bool = True) -> dict[str, Column]:
    """Columns matched, missing (in the order of ``skills``, already trimmed) and implied, from ``found_skills``."""
    names = F.map_keys(found["inferred"])
    have = F.concat(found["claimed"], names) if implied else found["claimed"]
    return {
        "matched": F.filter(skills, lambda s: F.array_contains(have, s)),
        "missing": F.filter(skills, lambda s: ~F.array_contains(have, s)),
        "implied": F.map_filter(found["inferred"], lambda s, _: F.array_contains(skills, s)) if implied else F.create_map().cast("map<string,string>"),
    }


def claimed_skills(resumes: DataFrame, skills: list[str], key: str = "resume_id", text: str = "text") -> DataFrame:
    """(key, skill, claimed) for every resume and every one of the (few, given) distinct ``skills``."""
    bound_batches(resumes.sparkSession)
    wanted = list(dict.fromkeys(s.strip() for s in skills if s.strip()))
    every = F.array(*[F.lit(s) for s in wanted]).cast("array<string>")
    rows = resumes.select(F.col(key).alias("key"), found_skills(F.col(text), every, False).alias("found"))
    return rows.select("key", F.explode(every).alias("skill"), "found").select("key", "skill", F.array_contains("found.claimed", F.col("skill")).alias("claimed"))


def analyze_skills(resumes: DataFrame, jobs: DataFrame, key: str = "resume_id", text: str = "text", implied: bool = True) -> DataFrame:
    """Matched and missing skills of every resume for its job.

    ``resumes`` has ``job_id``; ``jobs`` has (job_id, skills array), one row a job. Returns (key, job_id,
    matched, missing, implied): lists in the job's order, and a map from a skill that is
    only entailed to the one that entails it (the first of its list that is claimed).
    """
    bound_batches(resumes.sparkSession)
    own = jobs.select("job_id", trimmed(F.col("skills")).alias("skills"))
    rows = with_jobs(resumes.select(F.col(key), "job_id", F.col(text).alias("text")), own)
    rows = rows.withColumn("found", found_skills(F.col("text"), F.col("skills"), implied))
    return rows.select(key, "job_id", *[c.alias(n) for n, c in matched_in(F.col("skills"), F.col("found"), implied).items()])


def preferred_bonus(matched: Column, total: Column) -> Column:
    """Up to ten points by the share of preferred skills that is matched."""
    return F.when(total > 0, F.bround(F.size(matched) / total * 10, 2)).otherwise(F.lit(0.0))


def skills_percentage(have: Column, required: Column) -> Column:
    """The percentage of required skills in a list, whatever their case; 100 without requirements."""
    low = F.transform(have, F.lower)
    hit = F.size(F.filter(required, lambda s: F.array_contains(low, F.lower(s))))
    return F.when(F.size(required) == 0, F.lit(100.0)).otherwise(F.bround(hit / F.size(required) * 100, 2))


def predefined_skills(text: Column, skills: Column) -> Column:
    """The skills of a list that a text names as whole words, whatever their case, in the list's order; null as none."""
    low = F.lower(text_or_empty(text))
    quoted = lambda s: F.concat(F.lit(r"\b\Q"), F.regexp_replace(F.lower(F.trim(s)), r"\\E", ""), F.lit(r"\E\b"))
    return F.transform(F.filter(trimmed(skills), lambda s: F.contains(low, F.lower(s)) & F.regexp_like(low, quoted(s))), lambda s: F.trim(s))
