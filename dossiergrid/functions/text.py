"""Text, list, date and degree expressions; all of them run inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossiergrid.functions import lexicon as lx

# Java's \s and \b are ASCII by default; (?U) makes them Unicode, (?u) folds case beyond ASCII.
_LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once and the plan no larger for each place it is used in."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def split_lines(text: Column) -> Column:
    """Lines by any line boundary, without a last empty one; none for an empty text."""
    # One character is cut at without compiling an expression for every row.
    broken = F.regexp_replace(text_or_empty(text), _LINE_BREAK, "\n")
    return F.when(text_or_empty(text) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(broken, r"\n\z", ""), "\n"))


def text_signature(text: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single spaces, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(text)), "[^a-z0-9]+", " "))


def phone_signature(phone: Column) -> Column:
    """The digits of a phone number."""
    return F.regexp_replace(text_or_empty(phone), r"\D+", "")


def identity_signature(value: Column) -> Column:
    """A trimmed lower-cased name or address; empty for the placeholders of unknown ones."""
    plain = F.lower(F.trim(text_or_empty(value)))
    return F.when(plain.startswith("unknown"), F.lit("")).otherwise(plain)


def csv_list(value: Column) -> Column:
    """Trimmed, non-empty items of a comma-separated list; null as no items."""
    return F.filter(F.transform(F.split(text_or_empty(value), ","), lambda x: F.trim(x)), lambda x: x != "")


def json_list(value: Column) -> Column:
    """A JSON text as a list of strings; null or empty as no items."""
    return F.coalesce(F.from_json(F.nullif(value, F.lit("")), "array<string>"), F.array().cast("array<string>"))


def email_of(text: Column) -> Column:
    """The first e-mail address, lower-cased, or the placeholder."""
    found = F.when(F.contains(text_or_empty(text), F.lit("@")), F.regexp_extract(text_or_empty(text), lx.EMAIL, 0)).otherwise(F.lit(""))
    return F.when(found == "", F.lit(lx.UNKNOWN_EMAIL)).otherwise(F.lower(F.btrim(found, F.lit(" .,;:"))))


def phone_of(text: Column) -> Column:
    """The first phone number in one of the accepted layouts, or the placeholder."""
    found = F.regexp_extract(text_or_empty(text), lx.PHONE, 0)
    return F.when(found == "", F.lit(lx.UNKNOWN_PHONE)).otherwise(found)


def clip_excerpt(value: Column, limit: int = 220) -> Column:
    """White space collapsed, edges stripped of dashes and bars, cut to ``limit`` characters with three dots."""
    flat = F.btrim(F.regexp_replace(text_or_empty(value), r"(?U)\s+", " "), F.lit(" -|\t"))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))).otherwise(flat)


def pick_phrase(options: list, seed: Column, offset: int = 0) -> Column:
    """One of ``options`` (texts or columns), chosen by the first 32 bits of the seed's MD5."""
    at = (F.conv(F.substring(F.md5(seed.cast("binary")), 1, 8), 16, 10).cast("long") + offset) % len(options)
    return F.element_at(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), (at + 1).cast("int"))


def half_even(value: Column, digits: int) -> Column:
    """Round the exact binary value half to even.

    The decimal expansion of a double has at most 38 significant digits here once it is
    scaled; going through it avoids the double rounding of the shortest decimal form.
    """
    return F.bround(value.cast("decimal(38,20)"), digits).cast("double")


def as_percent(value: Column) -> Column:
    """A number without decimals, as shown in sentences."""
    return half_even(value, 0).cast("long").cast("string")


def local_time(ts: Column, zone: str = "Asia/Manila", pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """A UTC time as local text."""
    return F.date_format(F.from_utc_timestamp(ts, zone), pattern)


def week_of_month(ts: Column) -> Column:
    """Weeks of seven days from the first of the month."""
    return F.floor((F.dayofmonth(ts) - 1) / 7 + 1).cast("int")


def distinct_word_share(text: Column) -> Column:
    """Distinct words by words; 0 without words."""
    words = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit("[a-z][a-z'-]+"), F.lit(0))
    return F.when(F.size(words) > 0, F.size(F.array_distinct(words)) / F.size(words)).otherwise(F.lit(0.0))


def drop_adjacent_duplicates(lines: Column) -> Column:
    """Lines without those whose words equal the line before; an empty line ends a run."""
    # Without other letters the plain class means the same, and is much faster.
    words = lambda line: F.when(F.octet_length(line) == F.length(line), F.regexp_replace(line, r"[^\w]+", " ")).otherwise(F.regexp_replace(line, r"(?U)[^\w]+", " "))
    key = lambda line: F.lower(F.trim(words(line)))

    def kept(lines: Column) -> Column:
        pairs = F.transform(lines, lambda line: F.struct(line.alias("line"), key(line).alias("key")))
        new = lambda p: F.filter(p, lambda x, i: (i == 0) | (x["key"] == "") | (x["key"] != F.get(p, i - 1)["key"]))
        return F.transform(let(pairs, new), lambda x: x["line"])

    return let(lines, kept)


# Headings that design tools export with a space after every letter.
_SPACED_HEADINGS = {
    "CHARACTERREFERENCES": "CHARACTER REFERENCES",
    "CONTACT": "CONTACT",
    "EDUCATION": "EDUCATION",
    "LANGUAGE": "LANGUAGE",
    "LANGUAGES": "LANGUAGES",
    "LICENSES&CERTIFICATIONS": "LICENSES & CERTIFICATIONS",
    "PERSONALINFORMATION": "PERSONAL INFORMATION",
    "PROFESSIONAL&CIVICAFFILIATION": "PROFESSIONAL & CIVIC AFFILIATION",
    "PROFESSIONALPROFILE": "PROFESSIONAL PROFILE",
    "PUBLICATIONS&PRESENTATIONS": "PUBLICATIONS & PRESENTATIONS",
    "SKILLS": "SKILLS",
    "WORKEXPERIENCE": "WORK EXPERIENCE",
}


#: What every line has that is one of them but for other signs between its letters.
_LIKE_SPACED = rf"(?i)^[^A-Za-z&]*+(?:{'|'.join('[^A-Za-z&]*+'.join(k) for k in _SPACED_HEADINGS)})[^A-Za-z&]*+\z"


def plain_heading(line: Column) -> Column:
    """A heading written letter by letter as words; other lines stripped. One match tells most lines, which have other letters."""
    return F.when(line.rlike(_LIKE_SPACED), _plain_heading(line)).otherwise(F.trim(line))


def _plain_heading(line: Column) -> Column:
    flat = F.trim(line)
    tokens = F.split(flat, r"(?U)\s+")
    single = F.size(F.filter(tokens, lambda t: F.length(F.regexp_replace(t, "[^A-Za-z]", "")) <= 1))
    spaced = (F.size(tokens) >= 4) & (single >= 0.75 * F.size(tokens))
    known = F.create_map(*[F.lit(x) for pair in _SPACED_HEADINGS.items() for x in pair])
    return F.when(spaced, F.coalesce(F.try_element_at(known, F.upper(F.regexp_replace(line, "[^A-Za-z&]", ""))), flat)).otherwise(flat)


def clean_text(text: Column) -> Column:
    """Repair what document readers leave behind: odd spaces and quotes, words and dates broken over
    lines, spaced-out headings, repeated lines, runs of empty lines. Null stays null."""
    out = F.translate(text, " ’‘–—•​­", " ''-----")
    for pattern, by in (
        (r"(?U)-(?<=[A-Za-z]{2}-)\s*\n\s*(?=[A-Za-z]{2})", ""),
        (r"(?U)\s+-\s*\n\s*", " - "),
        (r"(?U)\n\s*-\s+", "\n- "),
        (r"\b((?:19|20)\d)\s+(\d)\b", "$1$2"),
    ):
        out = F.regexp_replace(out, pattern, by)
    lines = drop_adjacent_duplicates(let(out, lambda t: F.transform(split_lines(t), plain_heading)))
    out = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return F.when(text.isNotNull(), F.regexp_replace(out, r"(?U)^\s+|\s+$", ""))


_QUALITY_HEADING = (
    r"(?:professional\s+summary|summary|profile|education|(?:professional|work(?:ing)?|teaching|employment)\s+experience|experience"
    r"|technical\s+skills|skills(?:\s*(?:&|and)\s*qualities)?|certifications?|certificates?|licenses?|projects?|contact"
    r"|personal\s+(?:information|data)|scholastic\s+records?)\s*:?[ \t]*"
)


def text_quality(text: Column, cleaned: bool = False) -> Column:
    """How readable and well structured an extracted text is; minus infinity for one without words."""
    return let(text_or_empty(text if cleaned else clean_text(text)), _quality)


def _quality(t: Column) -> Column:
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    words = count(r"[A-Za-z][A-Za-z'\-]*")
    visible = F.length(F.regexp_replace(t, r"(?U)\s+", ""))
    letters = F.length(F.regexp_replace(t, r"\P{L}+", ""))
    contacts = (F.contains(t, F.lit("@")) & t.rlike(r"[\w.+-]+@[\w.-]+\.\w{2,}")).cast("int") + t.rlike(r"\+?\d[\d ()-]{7,}\d").cast("int")
    glued = count(r"(?i)\b(?:WORKEXPERIENCE|PROFESSIONALSUMMARY|TECHNICALSKILLS|PERSONALINFORMATION|EDUCATIONALBACKGROUND)\b")

    def score(words: Column, lines: Column) -> Column:
        too_long = F.aggregate(lines, F.lit(0), lambda s, x: s + F.greatest(F.lit(0), F.length(x) - 220))
        ends_in_heading = F.coalesce(F.try_element_at(lines, F.lit(-1)).rlike(rf"(?i)^{_QUALITY_HEADING}$"), F.lit(False)).cast("int")
        return (
            F.least(words, F.lit(1200)) * 0.035
            + F.least(F.size(lines), F.lit(120)) * 0.18
            + count(rf"(?im)^\s*{_QUALITY_HEADING}$") * 5
            + contacts * 2.5
            + F.least(count(r"\b(?:19|20)\d{2}\b"), F.lit(20)) * 0.35
            + letters / F.greatest(F.lit(1), visible) * 8
            - count("[\ue000-\uf8ff\ufffd]") * 1.5
            - too_long * 0.035
            - glued * 5
            - count(r"\s+[,.!?;:]") * 0.12
            - ends_in_heading * 8
        )

    lines = F.filter(F.transform(split_lines(t), lambda x: F.trim(x)), lambda x: x != "")
    scored = let(F.struct(words.alias("words"), lines.alias("lines")), lambda x: F.when(x["words"] > 0, score(x["words"], x["lines"])).otherwise(F.lit(float("-inf"))))
    return scored


def _best(scored: Column) -> Column:
    return let(F.array_max(scored), lambda b: F.when(b.isNotNull(), F.struct(b["method"].alias("method"), b["text"].alias("text"))))


def _candidate(score: Column, place: Column, method: Column, text: Column) -> Column:
    return F.struct(score.alias("score"), (-place).alias("first"), method.alias("method"), text.alias("text"))


def _worded(text: Column) -> Column:
    return F.trim(text_or_empty(text)) != ""


def best_text(candidates: Column) -> Column:
    """Of ``array<struct<method,text>>`` the element with the best text; the first one on ties, null without text."""
    some = F.filter(candidates, lambda c: _worded(c["text"]))
    return _best(F.transform(some, lambda c, i: _candidate(text_quality(c["text"]), i, c["method"], c["text"])))


def judged(text: Column) -> Column:
    """``struct<quality,method>``: ``text_quality`` of a text, and which is ``best_text`` of it ("raw") and its cleaned form ("clean").

    The text is cleaned once for both.
    """

    def of(x: Column) -> Column:
        both = F.array(_candidate(x["quality"], F.lit(0), F.lit("raw"), x["text"]), _candidate(text_quality(x["clean"]), F.lit(1), F.lit("clean"), x["clean"]))
        return F.struct(x["quality"].alias("quality"), _best(F.filter(both, lambda c: _worded(c["text"])))["method"].alias("method"))

    cleaned = let(clean_text(text), lambda c: F.struct(text.alias("text"), c.alias("clean"), text_quality(c, cleaned=True).alias("quality")))
    return let(cleaned, of)


def _wordings(pattern: str) -> set[str]:
    """All texts that a pattern of optional letters and groups and of sets of letters stands for."""
    found = re.search(r"\(\?:([^)]*)\)\?|\[([^\]]*)\]|(.)\?", pattern)
    if not found:
        return {pattern}
    group, letters, letter = found.groups()
    options = [*group.split("|"), ""] if group is not None else list(letters) if letters is not None else [letter, ""]
    return {text for option in options for text in _wordings(pattern[: found.start()] + option + pattern[found.end() :])}


_HEADINGS = {section: sorted(set().union(*map(_wordings, aliases))) for section, aliases in lx.SECTION_ALIASES.items()}
#: The first words of all headings, as a pattern.
HEADING_STARTS = "|".join(sorted({w.split()[0] for words in _HEADINGS.values() for w in words}))
#: What every line with a heading matches: nothing but signs and "and", and perhaps a numbering letter, before the first word of a heading.
_LIKE_HEADING = rf"(?iuU)^(?:[\s\-*•▪,&/|.]|and\b)*+(?:[A-Z]\s*[.)-](?:[\s\-,&/|.]|and\b)*+)?(?:{HEADING_STARTS})"


def section_of_heading(line: Column) -> Column:
    """All sections a heading line names, in order; none unless every part of it is a heading.

    One match tells most lines, which don't begin like a heading, and a look-up those that are one heading in its plain form; only
    the others are cut and compared.
    """
    none = F.array().cast("array<string>")
    line = text_or_empty(line)
    plain = F.lower(F.trim(F.rtrim(F.trim(line), F.lit(":"))))
    single = {w: section for section, words in reversed(_HEADINGS.items()) for w in words if not re.search(r"\band\b", w)}
    known = F.create_map(*[x for w, section in single.items() for x in (F.lit(w), F.array(F.lit(section)))])
    return F.when(line.rlike(_LIKE_HEADING), F.coalesce(F.try_element_at(known, plain), _sections(line))).otherwise(none)


def _sections(line: Column) -> Column:
    raw = F.regexp_replace(text_or_empty(line), r"^[\s\-*•▪]+", "")
    raw = F.regexp_replace(F.trim(raw), r"(?i)^[A-Z]\s*[.)-]\s*", "")
    raw = F.element_at(F.split(raw, ":"), 1)
    cut = F.regexp_replace(F.translate(raw, "\u0001", "\u0002"), r"(?i)\s*(?:,|&|/|\band\b)\s*", "\u0001")
    parts = F.filter(F.transform(F.split(cut, "\u0001"), lambda x: F.trim(x)), lambda p: p != "")

    plain = lambda part: F.lower(F.btrim(F.regexp_replace(part, r"(?U)\s+", " "), F.lit(" ,/&-|.")))

    def name(plain: Column) -> Column:
        # Letters beyond ASCII may be other forms of those of a heading; only patterns tell.
        out = odd = F.lit(None).cast("string")
        for section, pattern in reversed(lx.SECTION_HEADINGS.items()):
            out = F.when(plain.isin(_HEADINGS[section]), F.lit(section)).otherwise(out)
            odd = F.when(plain.rlike(rf"(?iu)^(?:{pattern})$"), F.lit(section)).otherwise(odd)
        return F.when(plain.rlike(r"[^\x00-\x7f]"), odd).otherwise(out)

    whole = lambda named: F.when(~F.exists(named, lambda x: x.isNull()), F.array_distinct(named)).otherwise(F.array().cast("array<string>"))
    return let(F.transform(parts, lambda part: let(plain(part), name)), whole)


_BEGINS = r"\b"


def degree_rank(degree: Column) -> Column:
    """5 doctorate, 4 master's, 3 bachelor's (and unfinished master's), 2 associate's, 1 school, 0 unknown."""

    def rank_of(low: Column) -> Column:
        out = F.lit(0)
        for rank, pattern in reversed(lx.DEGREE_RANKS):
            value = F.when(low.rlike(lx.UNFINISHED), F.lit(3)).otherwise(F.lit(4)) if rank == 4 else F.lit(rank)
            # Every alternative begins at a word, which one step tells for all of them.
            out = F.when(low.rlike(rf"\b(?:{pattern.removeprefix(_BEGINS).replace(f'|{_BEGINS}', '|')})"), value).otherwise(out)
        return out

    return let(F.lower(text_or_empty(degree)), rank_of)


def degree_field(degree: Column) -> Column:
    """The field of study named by the longest word found; null if none is."""
    words = [(word, field) for field, names in lx.DEGREE_FIELDS.items() for word in names]
    known = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(len(w)).alias("n"), F.lit(-k).alias("k"), F.lit(f).alias("f")) for k, (w, f) in enumerate(words)])
    # The text is lower-cased once, not once a word.
    named = let(F.lower(text_or_empty(degree)), lambda low: F.filter(known, lambda x: F.contains(low, x["word"])))
    return F.array_max(F.transform(named, lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k"), x["f"].alias("f"))))["f"]


def field_relevance(candidate: Column, required: Column) -> Column:
    """1 for the same field or no required one, 0.85 for an unknown one, 0.5 for another one."""
    want, have = degree_field(required), degree_field(candidate)
    return F.when(want.isNull(), F.lit(1.0)).when(have.isNull(), F.lit(0.85)).when(want == have, F.lit(1.0)).otherwise(F.lit(0.5))


def degree_label(rank: Column) -> Column:
    """The name of a degree rank."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in lx.DEGREE_LABELS.items() for x in pair]), rank), F.lit(lx.DEGREE_LABELS[0]))


def month_ordinal(token: Column, as_of: str) -> Column:
    """Months since year 0 of "Mon yyyy", "mm/yyyy", "yyyy" or "present" (the month of ``as_of``); null for anything else."""
    low = F.lower(F.trim(token))
    year, month = int(as_of[:4]), int(as_of[5:7])
    name = F.array_position(F.array(*[F.lit(m) for m in lx.MONTHS]), F.substring(low, 1, 3))
    slashed = F.regexp_extract(low, r"^(\d{1,2})/(\d{4}|\d{2})$", 2)
    short = F.when(F.length(slashed) == 2, slashed.cast("int") + F.when(slashed.cast("int") <= 40, 2000).otherwise(1900)).otherwise(slashed.cast("int"))
    return (
        F.when(low.isin("present", "current", "till date", "to date", "now"), F.lit(year * 12 + month - 1))
        .when(low.rlike(r"^[a-z]{3,9}\.?\s*\d{4}$") & (name > 0), F.regexp_extract(low, r"(\d{4})$", 1).cast("int") * 12 + name.cast("int") - 1)
        .when(low.rlike(r"^\d{1,2}/(?:\d{4}|\d{2})$"), short * 12 + F.regexp_extract(low, r"^(\d{1,2})", 1).cast("int") - 1)
        .when(low.rlike(r"^(?:19|20)\d{2}$"), F.regexp_extract(low, r"^(\d{4})$", 1).cast("int") * 12)
    )


_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?"
_DATE = rf"(?:{_MONTH}\s*\d{{4}}|\d{{1,2}}/\d{{4}}|(?:19|20)\d{{2}})"
DATE_RANGE = rf"(?i)({_DATE})\s*(?:-|–|—|to)\s*(Present|Current|{_DATE})"


def date_ranges(text: Column, as_of: str) -> Column:
    """``array<struct<from,to>>`` of month ordinals of all date ranges, each at least a month and at most 600 months long."""
    t = text_or_empty(text)
    ends = F.arrays_zip(
        F.transform(F.regexp_extract_all(t, F.lit(DATE_RANGE), F.lit(1)), lambda x: month_ordinal(x, as_of)).alias("from"),
        F.transform(F.regexp_extract_all(t, F.lit(DATE_RANGE), F.lit(2)), lambda x: month_ordinal(x, as_of)).alias("to"),
    )
    valid = F.filter(ends, lambda r: (r["to"] >= r["from"]) & (r["to"] - r["from"] <= 600))
    return F.transform(valid, lambda r: F.struct(r["from"].alias("from"), F.greatest(r["to"], r["from"] + 1).alias("to")))


def months_covered(ranges: Column) -> Column:
    """Months that at least one of the ranges covers."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(-1).alias("upto"))
    step = lambda s, r: F.struct(
        (s["sum"] + F.greatest(F.lit(0), r["to"] - F.greatest(r["from"], s["upto"]))).alias("sum"), F.greatest(s["upto"], r["to"]).alias("upto")
    )
    return F.aggregate(F.array_sort(ranges), start, step)["sum"]


def ranges_near_work(text: Column, as_of: str) -> Column:
    """The first date range of each line that, with the lines beside it, tells of work and not of studies or an honour."""
    work = r"(?i)\b(?:" + "|".join(lx.WORK_HINTS) + r")\b"
    none = F.array().cast("array<struct<from:int,to:int>>")

    def of(lines: Column) -> Column:
        beside = lambda i: F.concat_ws(" ", F.slice(lines, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)))
        fits = lambda x, i: beside(i).rlike(work) & ~beside(i).rlike(f"(?i){lx.STUDY_HINTS}") & ~x.rlike(f"(?i){lx.HONOUR_HINTS}")
        return F.flatten(F.transform(lines, lambda x, i: F.when(x.rlike("[0-9]{4}") & x.rlike(DATE_RANGE) & fits(x, i), F.slice(date_ranges(x, as_of), 1, 1)).otherwise(none)))

    return let(F.split(text_or_empty(text), "\n"), of)


def stated_years(text: Column) -> Column:
    """The largest stated total of years of experience over 0 and up to 50; null if none is stated."""
    t = text_or_empty(text)
    kind = r"(?:software\s+|work\s+|professional\s+|relevant\s+|industry\s+|IT\s+)?"
    patterns = (
        rf"(?i)\b(\d+(?:\.\d+)?)\+?\s*years?\s+(?:of\s+)?(?:strong\s+)?{kind}experience\b",
        r"(?i)\bexperience\s+(?:of\s+|totaling\s+|totalling\s+|for\s+|over\s+)?(\d+(?:\.\d+)?)\+?\s*years?\b",
        rf"(?i)\b(\d+(?:\.\d+)?)\s*[- ]year\s+{kind}experience\b",
    )
    found = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in patterns])
    most = F.array_max(F.filter(F.transform(found, lambda x: x.cast("double")), lambda v: (v > 0) & (v <= 50)))
    return F.when(F.contains(F.lower(t), F.lit("experience")), most)  # every pattern has that word


def term_found(text: Column, term: Column) -> Column:
    """Whether a term occurs: as part of the text if it has symbols, else as whole words."""
    low, t = F.lower(text_or_empty(text)), F.lower(F.trim(text_or_empty(term)))
    pattern = F.concat(F.lit(r"\b"), F.regexp_replace(t, r"\s+", r"\\s+"), F.lit(r"\b"))
    return (t != "") & F.when(t.rlike(r"[^a-z0-9\s]"), F.contains(low, t)).otherwise(F.regexp_like(low, pattern))
