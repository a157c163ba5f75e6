"""Facts of a resume that only line-by-line parsing finds: name, work history, education, credentials, skills.

One Arrow-batched pass per resume; facts don't depend on a job, so they are made once
and joined with any number of jobs. E-mail, phone, stated years and covered months are
native expressions in ``dossiergrid.functions.text``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossiergrid.batches import bound_batches
from dossiergrid.functions import lexicon as lx
from dossiergrid.functions.text import HEADING_STARTS, date_ranges, email_of, half_even, months_covered, phone_of, ranges_near_work, stated_years, text_or_empty
from dossiergrid.hot_keys import join_split
from dossiergrid.operators.names import applicant
from dossiergrid.operators.records import BULLET, DATE, MONTH, education, experience, plain_letters, tidy, years_of
from dossiergrid.operators.skill_items import listed_skills

__all__ = ["education", "experience", "years_of"]

SCHEMA = (
    "name string, experience array<struct<job_title:string,company:string,location:string,years:double,duration_unknown:boolean>>, "
    "education array<struct<degree:string,institution:string>>, "
    "credentials array<struct<certification_name:string,credential_type:string,issuer:string,date_obtained:string>>, skills array<string>"
)
#: Every heading of a list of skills holds one of these.
_MAY_LIST = r"(?iu)skill|comp[eé]t|expertise|proficienc|technologies|tools"
_SECTIONS = {name: re.compile(f"(?:{pattern})", re.I) for name, pattern in lx.SECTION_HEADINGS.items()}
_CREDENTIAL = re.compile(r"\b(?:certified|certification|certificate|licensed?|licensure|passer|board exam|eligibility|training|seminar|workshop|award(?:ee)?)\b", re.I)
# Credentials known by name, and the kind of each word.
_KNOWN_CREDENTIALS = [
    (r"licensed professional teacher|\blpt\b", "Licensed Professional Teacher", "Professional License"),
    (r"\blet passer\b|licensure examination for teachers", "Licensure Examination for Teachers", "Professional License"),
    (r"civil service (?:eligibility|professional|eligible)", "Civil Service Eligibility", "Eligibility"),
    (r"aws certified [a-z \-]+", None, "Certification"),
    (r"project management professional|\bpmp\b", "Project Management Professional", "Certification"),
    (r"certified public accountant|\bcpa\b", "Certified Public Accountant", "Professional License"),
    (r"registered nurse", "Registered Nurse", "Professional License"),
]
#: One of these is in every text of a known credential.
_CREDENTIAL_WORDS = ("let passer", "licensure examination", "civil service", "aws certified", "project management", "pmp", "public accountant", "cpa", "registered nurse")
_KINDS = [
    (r"licen[sc]|board exam|passer", "Professional License"), (r"eligib", "Eligibility"), (r"training|seminar|workshop", "Training"), (r"award|recognition", "Award"),
]


@dataclass
class Line:
    text: str
    section: str
    heading: bool


def sections(text: str) -> list[Line]:
    """Lines with the section they stand in; the part before any heading is the header."""
    current, out = "header", []
    for raw in text.splitlines():
        found = headings(raw)
        if found:
            current = found[0]
        out.append(Line(raw.strip(), current, bool(found)))
    return out


#: What every line with a heading, case-folded, begins with: signs, "and", perhaps a numbering letter, and the first word of a heading.
_LIKE_HEADING = re.compile(rf"(?:[\W_]|and(?!\w))*(?:[a-z](?:[\W_]|and(?!\w))+)?(?:{HEADING_STARTS})", re.I)
_CUT = re.compile(r"\s*(?:,|&|/|\band\b)\s*", re.I)


def _parts(text: str) -> Iterator[str]:
    """The parts between the cuts, one by one: of a line that is no heading only the first is looked at."""
    at = 0
    for m in _CUT.finditer(text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def headings(line: str) -> list[str]:
    """The sections a heading line names; none unless all its parts are headings."""
    if not _LIKE_HEADING.match(line.casefold()):
        return []
    raw = re.sub(r"^[A-Z]\s*[.)-]\s*", "", BULLET.sub("", line).strip(), flags=re.I).split(":", 1)[0]
    out = []
    for part in filter(None, map(str.strip, _parts(raw))):
        plain = re.sub(r"\s+", " ", part).strip(" ,/&-|.").casefold()
        name = next((n for n, p in _SECTIONS.items() if p.fullmatch(plain)), None)
        if name is None:
            return []
        out.append(name)
    return list(dict.fromkeys(out))


def credentials(lines: list[Line]) -> list[dict]:
    """Credentials known by name anywhere, and the lines of credential, training and award sections."""
    out: dict[str, dict] = {}

    def add(name: str, kind: str, line: str) -> None:
        date = re.search(rf"{MONTH}\s*(?:\d{{1,2}},\s*)?\d{{4}}|\b(?:19|20)\d{{2}}\b", line, re.I)
        issuer = re.search(r"\b(?:by|from)\s+([A-Z][\w&. ]+)", line)
        key = re.sub(r"[^a-z0-9]+", " ", name.lower()).strip()
        new = {"certification_name": name, "credential_type": kind, "issuer": tidy(issuer[1]) if issuer else "", "date_obtained": date[0] if date else ""}
        if key and key in out:
            out[key] = out[key] | {k: v for k, v in new.items() if v and not out[key][k]}
        elif key:
            out[key] = new

    whole = plain_letters("\n".join(x.text for x in lines))
    words = [w for w in _CREDENTIAL_WORDS if w in whole]
    for x in lines:
        low = plain_letters(x.text) if words else ""
        known = any(w in low for w in words) and any(re.search(p, x.text, re.I) for p, _, _ in _KNOWN_CREDENTIALS)
        if known:
            for pattern, name, kind in _KNOWN_CREDENTIALS:
                if m := re.search(pattern, x.text, re.I):
                    add(name or tidy(m[0]).title(), kind, x.text)
        if known or x.heading or x.section not in ("certifications", "training", "awards") or len(x.text) > 200:
            continue
        name = tidy(re.sub(rf"\b(?:by|from)\s+[A-Z][\w&. ]+|{DATE}", " ", BULLET.sub("", x.text), flags=re.I))
        default = {"training": "Training", "awards": "Award"}.get(x.section, "Certification")
        if name and (_CREDENTIAL.search(name) or len(name.split()) <= 12):
            add(name, next((k for p, k in _KINDS if re.search(p, name, re.I)), default), x.text)
    return list(out.values())


@lru_cache(1024)
def _vocabulary(extra: tuple[str, ...] = ()) -> list[list[tuple[str, str]]]:
    """Of every name of the catalog and of ``extra``, its wordings, the longest first, each with its first word."""
    vocabulary: dict[str, list[str]] = {**lx.SKILL_CATALOG, **lx.EDUCATION_SKILLS}
    spelled = {n.lower(): n for n in vocabulary}
    for skill in extra:
        name = spelled.get(skill.lower(), skill)
        vocabulary[name] = [*vocabulary.get(name, []), skill, *lx.SKILL_ALIASES.get(skill.lower(), [])]
    long = ((name, variants) for name, variants in vocabulary.items() if len(re.sub(r"[^A-Za-z0-9]", "", name)) > 2)
    return [sorted(((v, v.lower().split()[0]) for v in {name: 0, **dict.fromkeys(variants)} if v.split()), key=lambda v: len(v[0]), reverse=True) for name, variants in long]


def mentioned_skills(lines: list[Line], extra: list[str] = ()) -> list[str]:
    """Names of the catalog that a resume mentions, as it words them."""
    out: dict[str, str] = {}

    def add(value: str) -> None:
        key = re.sub(r"(?:\s+(?:skills?|proficiency))+$", "", " ".join(re.findall(r"[a-z0-9+#.]+", value.lower())))
        if key:
            out.setdefault(key, value)

    disclaimed = re.compile(lx.DISCLAIMED_BEFORE, re.I)
    open_lines = [x.text for x in lines if x.section not in ("education", "personal", "references", "awards", "certifications", "training", "affiliations")]
    whole = "\n".join(open_lines).lower()
    for variants in _vocabulary(tuple(filter(None, (e.strip() for e in extra)))):
        known = [v for v, first in variants if first in whole]
        said = _first_mention(open_lines, known, disclaimed) if known else None
        if said and not any(said.lower() in x.lower() or x.lower() in said.lower() for x in out.values()):
            add(said)
    return list(out.values())


def _first_mention(lines: list[str], names: list[str], disclaimed: re.Pattern) -> str | None:
    """The resume's own wording of the first name, line by line, that no disclaimer precedes."""
    patterns = [re.compile(re.escape(n) if re.search(r"[^a-z0-9\s]", n, re.I) else r"\b" + r"\s+".join(map(re.escape, n.split())) + r"\b", re.I) for n in names]
    for line in lines:
        for pattern in patterns:
            for m in pattern.finditer(line):
                if not disclaimed.search(line, max(0, m.start() - 1000), m.start()):
                    return m[0]
    return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def skills_for_job(text: pd.Series, extra: pd.Series) -> pd.Series:
    """The skills a resume mentions for a job, whose own skills count as catalog names; for resumes that list none."""
    return pd.Series([mentioned_skills(sections(t or ""), [] if e is None else [x for x in e if x]) for t, e in zip(text, extra, strict=True)])


def parse(text: str | None, as_of: str, listed: list[str] | None = None, mentioned: bool = True) -> dict:
    """All parsed facts of one text, whose listed skills are known; without them, those it mentions, if ``mentioned``; ``own_text`` is the text without a section of referees, null where there is none."""
    text = text or ""
    lines = sections(text)
    own = [(raw, x) for raw, x in zip(text.splitlines(), lines, strict=True) if x.section != "references"]
    own_text = None if len(own) == len(lines) else "\n".join(raw for raw, _ in own)
    email = re.search(lx.EMAIL, text if own_text is None else own_text) if "@" in text else None
    return {
        "name": applicant([x for _, x in own], email[0] if email else ""),
        "experience": experience(lines, as_of),
        "education": education(lines),
        "credentials": credentials(lines),
        "skills": list(listed) if listed is not None else mentioned_skills(lines) if mentioned else [],
        "own_text": own_text,
    }


def with_listed_skills(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``text``) and ``listed``, the skills that the text lists; null where it lists none.

    Rows of one text share one list, whatever their keys; a text of very many rows meets it where they are. Texts without a word
    that headings of lists have are neither looked through nor moved.
    """
    none = F.lit(None).cast("array<string>")
    may = F.coalesce(F.col("text").rlike(_MAY_LIST), F.lit(False))
    some = rows.where(may).withColumn("__text_key", F.sha2("text", 256))
    total = rows.where(may).count()
    if not total:
        return rows.withColumn("listed", none)
    texts = some.groupBy("__text_key").agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("n"))
    lists = listed_skills(texts, "__text_key").withColumnRenamed("skills", "listed")
    known = texts.select("__text_key", "n").join(lists, "__text_key", "left")
    return join_split(some, known, ["__text_key"], total).drop("__text_key").unionByName(rows.where(~may).withColumn("listed", none))


def resume_facts(resumes: DataFrame, as_of: str, key: str = "resume_id", text: str = "text", mentioned: bool = True) -> DataFrame:
    """One row per resume: ``key``, ``text`` and all facts. ``as_of`` (yyyy-mm-dd) is what "present" means.

    Skills are those that the resume lists (``listed`` is true, see ``skill_items``), else those of the catalog that it mentions.
    Not ``mentioned``, a resume that lists none has none: ``evaluate`` looks for them itself, with those of the job.

    Total years: a stated total; else the months that the dated ranges of the work section cover
    together (at most 40 years); else the sum of the records' years. Addresses and numbers below a
    heading of references are the referees' and not taken. A null text counts as empty: unknown
    name and address, no records, 0 years. Rows are not merged, whatever their keys.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [parse(t, as_of, have, mentioned) for t, have in zip(batch["text"], batch["listed"], strict=True)]
            yield pd.concat([batch.drop(columns="listed").assign(listed=batch["listed"].notna()).reset_index(drop=True), pd.DataFrame(found, columns=["name", "experience", "education", "credentials", "skills", "own_text"])], axis=1)

    bound_batches(resumes.sparkSession)
    rows = resumes.select(F.col(key), F.col(text).alias("text"))
    kind = dict(rows.dtypes)[key]
    rows = with_listed_skills(rows).select(key, "text", "listed")
    parsed = rows.mapInPandas(run, f"{key} {kind}, text string, listed boolean, {SCHEMA}, own_text string")
    own = F.coalesce("own_text", "text")
    return parsed.withColumns({"email": email_of(own), "phone": phone_of(own), "years": total_years(F.col("text"), F.col("experience"), as_of)}).drop("own_text")


def total_years(text: Column, records: Column, as_of: str) -> Column:
    """Years of experience from what is stated, from the ranges in the text's work section, from the records, or from ranges near words of work."""
    head = r"(?:(?:work\s+)?experiences?|employment(?:\s+history)?|work\s+history|professional\s+(?:experience|background)|career\s+history|teaching\s+experience|positions?\s+held)"
    stop = r"(?:education(?:al)?(?:\s+background)?|skills?|certifications?|achievements?|awards?|projects?|interests?|languages?|publications?|summary|objective|profile|affiliations?|seminars?|references?|personal\s+(?:information|data)|volunteer)"
    body = F.regexp_extract(text_or_empty(text), rf"(?ims)^\s*{head}\s*:?\s*$\n(.*?)(?=^\s*{stop}\s*:?\s*$|\z)", 1)
    months = months_covered(date_ranges(body, as_of))
    summed = F.aggregate(records, F.lit(0.0), lambda s, r: s + F.coalesce(r["years"], F.lit(0.0)))
    capped = lambda value: F.least(half_even(value, 1), F.lit(40.0))
    found = F.when((F.size(records) > 0) & (months > 0), capped(months / 12)).when(summed > 0, capped(summed))
    found = found.otherwise(capped(months_covered(ranges_near_work(text, as_of)) / 12))
    return F.coalesce(stated_years(text), found)
