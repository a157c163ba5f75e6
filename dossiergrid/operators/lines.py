"""Resumes as tables of lines: sections, blocks, entities, record checks and quoted evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossiergrid.functions import lexicon as lx
from dossiergrid.functions.text import any_of, clip_excerpt, section_of_heading, split_lines, term_found, text_or_empty

# What the domain recogniser looks for, its kind, and the sections that make it sure.
_ENTITIES = [
    (
        "education_role",
        r"teacher|instructor|professor|lecturer|educator|tutor|faculty|guidance counselor|school administrator|teaching assistant|practice teacher"
        r"|student teacher|teacher aide|dean|principal",
        ["experience"],
    ),
    (
        "grade_level",
        r"kindergarten|pre[- ]?k|elementary|primary|secondary|senior high|junior high|grade(?:s)?\s*(?:[1-9]|1[0-2])(?:\s*(?:-|to)\s*(?:[1-9]|1[0-2]))?",
        ["experience", "education"],
    ),
    (
        "subject",
        r"english|filipino|mathematics|math|science|biology|chemistry|physics|social studies|history|music|physical education|tle"
        r"|araling panlipunan|edukasyon sa pagpapakatao|computer science",
        [],
    ),
    ("license", r"licensed professional teacher|let passer|lpt|teaching license|professional teaching certificate", None),
]
# How a line of duties begins.
_DUTY = (
    r"(?i)^(?:responsible|managed|developed|created|implemented|prepared|provided|assisted|collaborated|communicated|conducted|facilitated"
    r"|maintained|organized|coordinated|handled|taught|designed|supported|encourag(?:e|ed|ing)|ensur(?:e|ed|ing)|observ(?:e|ed|ing)"
    r"|supervis(?:e|ed|ing)|participat(?:e|ed|ing)|promot(?:e|ed|ing))\b"
)
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE = rf"(?i)\b(?:{_MONTH}[\s,./-]+)?(?:19|20)?\d{{2}}\s*(?:-|–|—|to)\s*(?:present|current|(?:{_MONTH}[\s,./-]+)?(?:19|20)?\d{{2}}\b)|\b(?:19|20)\d{{2}}\b"
_NOISE = (
    r"(?i)^(?:responsibilities|duties|environment|technologies|tools|skills?|project\s+description|references?)\s*:"
    r"|^(?:responsible\s+for|developed|managed|created|implemented|assisted|handled|prepared|collaborated|worked|provided|performed|designed|led)\b"
)


def line_table(resumes: DataFrame, key: str = "resume_id", text: str = "text") -> DataFrame:
    """(key, line_no, line): every line of every resume, from 0."""
    return resumes.select(F.col(key), F.posexplode(split_lines(F.col(text))).alias("line_no", "line"))


def sectioned(lines: DataFrame, key: str = "resume_id") -> DataFrame:
    """Lines with ``section`` (of the last heading line at or before them, "header" before any) and ``is_heading``."""
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("__s", F.try_element_at(section_of_heading(F.col("line")), F.lit(1)))
    return named.select(
        "*", F.coalesce(F.last("__s", ignorenulls=True).over(order), F.lit("header")).alias("section"), F.col("__s").isNotNull().alias("is_heading")
    ).drop("__s")


def segments(lines: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, segment, section, heading, line_no, lines): the blocks between headings, in order; empty first blocks are left out."""
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = sectioned(lines, key).withColumn("segment", F.sum(F.col("is_heading").cast("int")).over(order))
    out = rows.groupBy(key, "segment", "section").agg(
        F.max(F.when(F.col("is_heading"), F.trim("line"))).alias("heading"),
        F.min("line_no").alias("line_no"),
        F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("line_no", "line")))).alias("l"),
    )
    return out.select(key, "segment", "section", "heading", "line_no", F.col("l.line").alias("lines"))


def _branches(words: set[str]) -> str:
    """A pattern of the beginnings that ``words`` share, which a text leaves at its first other letter."""
    if "" in words:
        return ""
    heads = {w[0]: {v[1:] for v in words if v[0] == w[0]} for w in words}
    return "(?:" + "|".join(re.escape(c) + _branches(rest) for c, rest in sorted(heads.items())) + ")"


def _beginnings(pattern: str) -> set[str]:
    """The plain letters that each of the alternatives of a pattern begins with."""
    depth, parts = 0, [""]
    for c in pattern:
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return {re.match("[a-z ]+", part)[0] for part in parts}


_SKILL_WORDS = [v.lower() for name, variants in lx.EDUCATION_SKILLS.items() for v in (name, *variants)]
#: What every line with an entity, or in lower case with a skill, matches: the beginning of one at the start of a word.
_LIKE_ENTITY = rf"(?i)\b{_branches(set().union(*(_beginnings(pattern) for _, pattern, _ in _ENTITIES)))}"
_LIKE_SKILL = rf"\b{_branches(set(_SKILL_WORDS))}"


def entities(lines: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, type, name, evidence, section, line_no, confidence): terms of the teaching domain; each text of a line once.

    Lines are moved, and compared with the terms, only if one match finds how a term begins, or if they are headings.
    """
    like = F.col("line").rlike(_LIKE_ENTITY) | F.lower("line").rlike(_LIKE_SKILL) | (F.size(section_of_heading(F.col("line"))) > 0)
    rows = sectioned(lines.where(like), key).where("not is_heading").withColumn("evidence", F.trim("line")).where("evidence <> ''")
    found = []
    for kind, pattern, sure in _ENTITIES:
        grade = F.lit("high") if sure is None else F.when(F.col("section").isin(*sure), "high").otherwise("medium") if sure else F.lit("medium")
        names = F.regexp_extract_all("evidence", F.lit(rf"(?i)\b(?:{pattern})\b"), F.lit(0))
        found.append(F.transform(names, _entity(kind, grade)))
    low = F.lower("evidence")
    skills = F.array(
        *[
            F.struct(F.lit(name).alias("name"), any_of(*[low.rlike(r"\b" + v.lower().replace("-", r"\-") + r"\b") for v in (name, *variants)]).alias("hit"))
            for name, variants in lx.EDUCATION_SKILLS.items()
        ]
    )
    grade = F.when(F.col("section") == "skills", "high").otherwise("medium")
    found.append(F.transform(F.filter(skills, lambda s: s["hit"]), lambda s: F.struct(F.lit("education_skill").alias("type"), s["name"].alias("name"), grade.alias("confidence"))))
    flat = rows.select(key, "evidence", "section", "line_no", F.inline(F.concat(*found)))
    first = Window.partitionBy(key, "type", F.lower("name"), F.lower("evidence")).orderBy("line_no")
    return flat.withColumn("r", F.row_number().over(first)).where("r = 1").select(key, "type", "name", "evidence", "section", "line_no", "confidence")


def _entity(kind: str, grade: Column):
    return lambda name: F.struct(F.lit(kind).alias("type"), name.alias("name"), grade.alias("confidence"))


def _checked(*cases: tuple[Column, str]) -> Column:
    """``struct<valid,reason>`` by the first case that holds."""
    reason = F.lit(None).cast("string")
    for test, text in reversed(cases):
        reason = F.when(test, F.lit(text)).otherwise(reason)
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"))


# The reasons of both checks are fixed values.
def check_experience(title: Column, company: Column, years: Column, duration_unknown: Column) -> Column:
    """``struct<valid,reason>`` of a work record."""
    title, company = (F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " ")) for c in (title, company))
    years, unknown = F.coalesce(years, F.lit(0.0)), F.coalesce(duration_unknown, F.lit(False))
    return _checked(
        (title == "", "missing role"),
        ((F.length(title) > 100) | (F.size(section_of_heading(title)) > 0), "role resembles a heading"),
        (title.rlike(_DUTY) & (F.size(F.split(title, " ")) > 4), "role resembles a responsibility"),
        (company == "", "missing employer"),
        ((company != "Not Identified") & (company.rlike(r"(?U)^[\W_]") | F.contains(company, F.lit("@"))), "malformed employer"),
        ((years < 0) | (years > 50) | ((years == 0) & ~unknown), "invalid duration"),
    )


def check_education(degree: Column, institution: Column) -> Column:
    """``struct<valid,reason>`` of an education record."""
    degree, school = (F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " ")) for c in (degree, institution))
    date = school.rlike(r"(?i)^(?:(?:19|20)\d{2}|present|current|till date|to date)$")
    return _checked(
        ((degree == "") | (F.length(degree) > 255), "missing or oversized credential"),
        ((F.size(section_of_heading(degree)) > 0) | degree.rlike(_DUTY), "credential resembles non-education content"),
        (degree.rlike(r"(?i)\b(?:awards?|honors?|responsibilities|duties|skills?)\b"), "credential contains unrelated content"),
        (school == "", "missing institution value"),
        ((school != "Unknown Institution") & (F.contains(school, F.lit("@")) | date), "invalid institution"),
    )


def evidence_lines(lines: DataFrame, key: str = "resume_id") -> DataFrame:
    """Non-empty lines with the ``section`` evidence is quoted from, and their ``block`` between empty lines."""
    name = F.lit(None).cast("string")
    flat = F.trim(F.regexp_replace("line", r"(?U)\s+", " "))
    for section, pattern in reversed(lx.EVIDENCE_SECTIONS):
        name = F.when(F.col("text").rlike(rf"(?i)^\s*{pattern}"), F.lit(section)).otherwise(name)
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("text", flat).withColumn("__s", name)
    rows = rows.withColumn("block", F.sum((F.col("text") == "").cast("int")).over(order))
    rows = rows.withColumn("section", F.coalesce(F.last("__s", ignorenulls=True).over(order), F.lit("Resume")))
    heading = F.col("__s").isNotNull() & F.col("text").rlike("^[A-Za-z &/]+:?$")
    return rows.where("text <> ''").select(key, "line_no", "text", "section", "block", heading.alias("is_heading"))


def skill_evidence(lines: DataFrame, skills: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, skill, section, excerpt): the line that shows a skill, by order of sections, then the shortest, then the first.

    ``skills`` has (key, skill). Skills that no line shows are quoted from "Resume" without a line.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in lx.EVIDENCE_ORDER]), F.col("section"))
    known = [(k, a) for k, aliases in lx.SKILL_ALIASES.items() for a in aliases]
    table = F.create_map(*[x for k in lx.SKILL_ALIASES for x in (F.lit(k), F.array(*[F.lit(a) for s, a in known if s == k]))])
    low = F.lower(F.trim("skill"))
    names = F.array_union(F.array(low), F.coalesce(F.try_element_at(table, low), F.array().cast("array<string>")))
    wanted = skills.select(key, "skill", F.explode(names).alias("name"))
    hits = wanted.join(evidence_lines(lines, key), key).where(term_found(F.col("text"), F.col("name")))
    best = hits.groupBy(key, "skill").agg(F.min_by(F.struct("section", "text"), F.struct(rank.alias("r"), F.length("text").alias("n"), "line_no")).alias("b"))
    return skills.select(key, "skill").distinct().join(best, [key, "skill"], "left").select(
        key,
        "skill",
        F.coalesce("b.section", F.lit("Resume")).alias("section"),
        F.when(F.col("b").isNotNull(), clip_excerpt(F.col("b.text"))).otherwise(F.lit("Matched in the extracted resume text.")).alias("excerpt"),
    )


def record_evidence(lines: DataFrame, records: DataFrame, kind: str, key: str = "resume_id") -> DataFrame:
    """(key, record_no, section, excerpt) of ``records`` (key, record_no, primary, secondary).

    The anchor is the line with the primary text (else the secondary), preferring the
    record's own section and short lines. The secondary text and the nearest date of the
    same block, at most two lines away, are quoted with it; employment dates are looked
    for behind the record first, education dates before it. Without an anchor there is no row.
    """
    section = "Work Experience" if kind == "work" else "Education"
    named = lambda c: F.when(~F.coalesce(F.col(c), F.lit("")).isin("", "Not Identified", "Unknown Institution"), F.col(c))
    rows = records.select(key, "record_no", named("primary").alias("primary"), named("secondary").alias("secondary"))
    table = evidence_lines(lines, key)
    pairs = rows.join(table, key)
    hit = pairs.withColumn("by", F.when(term_found(F.col("text"), F.col("primary")), 0).when(term_found(F.col("text"), F.col("secondary")), 1)).where("by is not null")
    order = F.struct("by", (F.col("section") != section).cast("int").alias("s"), F.length("text").alias("n"), "line_no")
    anchor = hit.groupBy(key, "record_no").agg(F.min_by(F.struct("line_no", "text", "section", "block"), order).alias("a"))
    near = pairs.join(anchor, [key, "record_no"]).where("section = a.section and block = a.block and not is_heading")
    bare = F.lower(
        F.btrim(
            F.regexp_replace(F.regexp_replace("text", DATE, ""), r"(?i)^(?:role|position|job\s*title|designation|degree|course|program)\s*:\s*", ""),
            F.lit(" ()[]-|,:."),
        )
    )
    second = term_found(F.col("text"), F.col("secondary")) & ~F.col("text").rlike(_NOISE)
    second = second & ((bare == F.lower(F.trim("secondary"))) | term_found(F.col("text"), F.col("primary")))
    distance = F.abs(F.col("line_no") - F.col("a.line_no"))
    found = near.groupBy(key, "record_no").agg(
        F.min_by(F.when(second, F.struct("line_no", "text")), F.when(second, F.struct(distance.alias("d"), F.length("text").alias("n"), "line_no"))).alias("s")
    )
    chosen = anchor.join(found, [key, "record_no"], "left")
    dated = near.drop("a").join(chosen, [key, "record_no"]).where(F.col("text").rlike(DATE) & (distance <= 2))
    first, last = F.least("a.line_no", F.coalesce("s.line_no", "a.line_no")), F.greatest("a.line_no", F.coalesce("s.line_no", "a.line_no"))
    gap = F.least(distance, F.abs(F.col("line_no") - F.coalesce("s.line_no", "a.line_no")))
    wrong = F.when(F.lit(kind == "work"), F.col("line_no") < last).otherwise(F.col("line_no") > first).cast("int")
    dates = dated.groupBy(key, "record_no").agg(F.min_by("text", F.struct(gap.alias("g"), wrong.alias("w"), "line_no")).alias("dated"))
    quoted = F.array_compact(F.array("a.text", "s.text"))
    token = F.when(F.array_contains(quoted, F.col("dated")), F.col("dated")).otherwise(F.regexp_extract("dated", DATE, 0))
    out = chosen.join(dates, [key, "record_no"], "left")
    return out.select(
        key, "record_no", F.col("a.section").alias("section"),
        clip_excerpt(F.array_join(F.array_distinct(F.array_compact(F.concat(quoted, F.array(token)))), " | ")).alias("excerpt"),
    )


def candidate_evidence(results: DataFrame, resumes: DataFrame, key: str = "resume_id", text: str = "text") -> DataFrame:
    """What the detail page of a result quotes, one row per result.

    ``results``: key, matched_critical, matched, matched_preferred, missing_critical, missing, experience, education,
    years, experience_req, education_req. Returns key, skills (at most 8: name, kind, section, excerpt),
    skill_total, experience and education (at most 3 each, quoted), their totals, missing (name, kind),
    experience_met and education_met (null where nothing is required).
    """
    from dossiergrid.functions.text import degree_rank

    table = line_table(resumes, key, text)
    named = lambda c, kind: F.transform(c, lambda s: F.struct(s.alias("name"), F.lit(kind).alias("kind")))
    groups = F.concat(named("matched_critical", "Critical"), named("matched", "Required"), named("matched_preferred", "Preferred"))
    listed = results.select(key, F.posexplode(groups).alias("place", "s")).select(key, "place", "s.name", "s.kind").where("trim(name) <> ''")
    first = Window.partitionBy(key, F.lower(F.trim("name"))).orderBy("place")
    listed = listed.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    quoted = listed.join(skill_evidence(table, listed.select(key, F.col("name").alias("skill")), key).withColumnRenamed("skill", "name"), [key, "name"])
    skills = quoted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "name", "kind", "section", "excerpt"))).alias("s"))
    skills = skills.select(key, F.transform(F.slice("s", 1, 8), lambda x: x.dropFields("place")).alias("skills"), F.size("s").alias("skill_total"))

    def records(column: str, primary: str, secondary: str, kind: str, section: str, otherwise: str) -> DataFrame:
        rows = results.select(key, F.posexplode(F.slice(column, 1, 3)).alias("record_no", "rec"))
        found = record_evidence(table, rows.select(key, "record_no", F.col(f"rec.{primary}").alias("primary"), F.col(f"rec.{secondary}").alias("secondary")), kind, key)
        full = rows.join(found, [key, "record_no"], "left").withColumns({"section": F.coalesce("section", F.lit(section)), "excerpt": F.coalesce("excerpt", F.lit(otherwise))})
        out = full.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("record_no", "rec", "section", "excerpt"))).alias(column))
        return out.select(key, F.transform(column, lambda x: F.struct(x["rec"].alias("record"), x["section"].alias("section"), x["excerpt"].alias("excerpt"))).alias(column))

    work = records("experience", "company", "job_title", "work", "Work Experience", "Extracted from the work-history section.")
    school = records("education", "institution", "degree", "education", "Education", "Extracted from the education section.")
    wanted = degree_rank(F.col("education_req"))
    have = F.coalesce(F.array_max(F.transform("education", lambda r: degree_rank(r["degree"]))), F.lit(0))
    base = results.select(
        key,
        F.size("experience").alias("experience_total"),
        F.size("education").alias("education_total"),
        F.concat(named("missing_critical", "Critical"), named("missing", "Required")).alias("missing"),
        F.when(F.col("experience_req") > 0, F.col("years") >= F.col("experience_req")).alias("experience_met"),
        F.when(wanted > 0, have >= wanted).alias("education_met"),
    )
    out = base.join(skills, key, "left").join(work, key, "left").join(school, key, "left")
    return out.withColumn("skill_total", F.coalesce("skill_total", F.lit(0)))
