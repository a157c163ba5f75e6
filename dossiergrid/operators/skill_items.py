"""Skills as a resume lists them: the items of its skill sections, on the line table.

Sections are switched by headings, wrapped lines are put together by windows over a resume's lines, and a row
is cut into items by expressions. Nothing here knows a list of skills.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossiergrid.functions import lexicon as lx
from dossiergrid.functions.text import any_of, let, section_of_heading, text_or_empty
from dossiergrid.operators.history import toggled
from dossiergrid.operators.lines import line_table

_MARK = r"(?:[-*•·▪●]|\((?i:cid)\s*[:;,]?\s*\d+\))"
_BULLET = rf"^\s*{_MARK}\s*"
_INLINE = rf"(?i)^\s*{_MARK}?\s*skills?\s*:\s*(\S.*)$"
#: A bracket and all up to its end, or to the end of the line where it isn't closed; brackets in it may hold no further ones.
_BRACKET = r"[(\[{](?:[^()\[\]{}]++|[(\[{][^()\[\]{}]*+(?:[)\]}]|$))*+(?:[)\]}]|$)"
_PIECE = rf"{_BRACKET}|[^(\[{{]++|[(\[{{]"
_CUT, _DASH = "\u0001", "\u0002"
_EDGES = " -*•|,;:"
_LABEL = "|".join(lx.SKILL_LABELS)
_BARE_LABEL = "|".join(lx.SKILL_LABELS_WITHOUT_MARK)
_PHRASE = rf"(?i)^(?:{'|'.join([*lx.COMPETENCY_VERBS, *lx.COMPETENCY_STARTS])})\b"
_NEXT_PHRASE = rf"(?<=[a-z0-9)])\s+(?=(?:{'|'.join([*lx.COMPETENCY_VERBS, *lx.COMPETENCY_SEAMS])})\b\s+[a-z])"
#: Lines that a wrapped bullet may go on for where they begin with small letters, and lines that follow an inline list.
LOWER_LINES, INLINE_LINES = 4, 2


def _words(text: Column) -> Column:
    return F.when(F.trim(text) == "", F.lit(0)).otherwise(_count(F.trim(text), r"\s+") + 1)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _outside_brackets(text: Column, change: Callable[[Column], Column]) -> Column:
    """``text`` with ``change`` made to what stands outside of brackets."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^[(\[{]."), F.translate(p, _DASH, "-")).otherwise(change(p))), "")


def _parts(text: Column, edges: str) -> Column:
    return F.filter(F.transform(F.split(text, _CUT), lambda p: F.btrim(p, F.lit(edges))), lambda p: p != "")


def without_label(row: Column) -> Column:
    """A row of skills without its bullet and the name of its category; a name that isn't a category is the first item."""
    row = text_or_empty(row)
    flat = F.trim(F.regexp_replace(row, _BULLET, ""))
    flat = F.when(row.rlike(_BULLET), F.regexp_replace(flat, r"\s+", " ")).otherwise(flat)

    def cut(t: Column) -> Column:
        bare = F.regexp_replace(t, rf"(?i)^(?:{_LABEL})(?:\s*:\s*|\t+|\s{{2,}})(?=\S)", "")
        named = t.rlike(r"^[^:]{1,55}:\s*\S") & (_words(F.substring_index(t, ":", 1)) <= 6)
        out = F.when(bare != t, bare).when(named, F.regexp_replace(t, r"^([^:]{1,55}):\s*", "$1, "))
        out = out.otherwise(F.regexp_replace(t, rf"(?i)^(?:{_BARE_LABEL})\s+(?=(?-i:[A-Z0-9])|[.#/+])", ""))
        return F.when(t.rlike(rf"(?i)^(?:{_LABEL})\s*:?$"), F.lit("")).otherwise(out)

    return let(flat, cut)


def _structural(chunk: Column) -> Column:
    """Parts between bars, bullets, semicolons, wide gaps and spaced hyphens."""
    hyphen = r"(?<=\s)-(?=\s)"
    spread = (_count(chunk, hyphen) >= 2) | chunk.rlike(r"\s-\s.*,") | chunk.rlike(r"^\s*(?:\S+\s+){4}(?:.*\s)?-\s")
    dashed = F.when(spread, F.regexp_replace(chunk, hyphen, _DASH)).otherwise(chunk)
    sentence = chunk.rlike(_PHRASE)
    gaps = rf"[|•·{_DASH}]|(?<![,;:\s])(?:\t\s*|\s{{2,}})"
    cut = lambda p: F.when(sentence, F.regexp_replace(p, gaps, _CUT)).otherwise(F.regexp_replace(p, rf";|{gaps}", _CUT))
    return _parts(_outside_brackets(dashed, cut), _EDGES)


def _listed(part: Column) -> Column:
    """Parts between commas, unless the commas are those of a phrase."""
    first = _words(F.substring_index(part, ",", 1))
    commas = F.size(F.split(part, ","))
    phrase = part.rlike(_PHRASE) | (part.rlike(r"(?i),\s*(?:and|or)\b") & (first >= 2)) | (part.rlike(r"(?i)\bskills?$") & commas.between(2, 4))
    split = _parts(_outside_brackets(part, lambda p: F.regexp_replace(p, ",", _CUT)), " ,")
    return F.when(phrase | ~F.contains(part, F.lit(",")), F.array(part)).otherwise(F.filter(F.transform(split, lambda p: F.regexp_replace(p, r"(?i)^(?:and|or)\s+", "")), lambda p: p != ""))


def is_skill(item: Column) -> Column:
    """No address, no sentence of great length, not only signs, not the rest of a phrase, nothing denied."""
    fits = (item != "") & (F.length(item) <= 300) & (_words(item) <= 50)
    return fits & ~any_of(*[item.rlike(p) for p in (r"(?i)@|https?://|www\.", r"(?U)^[\W\d_]+$", r"(?i)^(?:for|and|or|to|including|catering\s+to|no|not|without|lack(?:s|ing)?|unfamiliar\s+with)\b")])


def items_of(row: Column) -> Column:
    """The skills that a row lists, in order; none for null.

    Cut at bars, bullets, wide gaps, semicolons and commas outside of brackets, at hyphens between words where a list follows, and
    where a new phrase begins; phrases keep their commas.
    """
    chunks = F.split(F.regexp_replace(without_label(row), _NEXT_PHRASE, _CUT), _CUT)
    parts = F.flatten(F.transform(chunks, _structural))
    items = F.filter(F.flatten(F.transform(parts, _listed)), is_skill)
    return F.filter(F.transform(items, lambda i: F.btrim(F.regexp_replace(i, r"\s+", " "), F.lit(_EDGES + "."))), lambda i: i != "")


def same_skill(item: Column) -> Column:
    """What items that differ only in case, signs or an ending "skills" have in common."""
    return F.regexp_replace(F.array_join(F.regexp_extract_all(F.lower(item), F.lit("[a-z0-9+#.]+"), F.lit(0)), " "), r"(?:(?:^| )(?:skills?|proficiency))+$", "")


def skill_rows(lines: DataFrame, key: str = "resume_id", line: str = "line") -> DataFrame:
    """(key, line_no, row): the rows of skill sections and of inline lists, with the lines that a row was broken over put together.

    A line goes on with the row before it where it closes that row's bracket; where both are halves of a phrase
    ("Verbal & Written" / "communication"); below a category, always; below a bullet, if it has at most five words and begins with a
    small letter, or the line before it ends in, or the bullet begins with, words that want more. One line that goes
    on nowhere ends a bullet. A mark on a line of its own is the bullet of the next one. Null lines are empty.
    """
    text = F.trim(text_or_empty(F.col(line)))
    order = Window.partitionBy("__key").orderBy("line_no")
    rows = lines.select(F.col(key).alias("__key"), "line_no", text.alias("t"))
    named = section_of_heading(F.col("t"))
    own = F.trim(F.regexp_extract("t", rf"(?i){lx.SKILL_HEADING}", 1))
    begins = F.col("t").rlike(rf"(?i){lx.SKILL_HEADING}") | ((F.size("named") == 1) & (F.try_element_at("named", F.lit(1)) == "skills") & ~F.col("t").rlike(r":\s*\S"))
    ends = F.col("t").rlike(f"(?i)(?:{lx.EXCLUDED_HEADING})|(?:{lx.INCLUDED_HEADING})|(?:{lx.SKILLS_END})") | ((F.size("named") > 0) & (F.try_element_at("named", F.lit(1)) != "skills"))
    rows = rows.withColumn("named", named).withColumns({"on": begins, "off": ends & ~begins})
    rows = toggled(rows, F.col("on"), F.col("off"), False, "__key", "inside")
    marked = F.coalesce(F.lag("t").over(order).rlike(rf"^{_MARK}$"), F.lit(False))
    inline = F.regexp_extract("t", _INLINE, 1)
    rows = rows.withColumns({"own": own, "inline": F.when(F.col("inside"), F.lit("")).otherwise(inline), "bullet": F.col("t").rlike(_BULLET) | marked})
    labelled = F.col("t").rlike(rf"(?i)^(?:{_LABEL})(?:\s*:\s*|\t+|\s{{2,}})\S|^(?:{_BARE_LABEL})\s+(?=(?-i:[A-Z0-9])|[.#/+])")
    kind = (
        F.when(F.col("inline") != "", "inline").when(~F.col("inside") & ~F.col("on"), F.when(F.col("off") | F.col("bullet") | (F.col("t") == ""), "out"))
        .when(F.col("on"), "heading").when(F.col("t") == "", "empty").when(F.col("bullet"), "bullet").when(labelled, "category")
    )
    rows = rows.withColumn("kind", kind)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.last(F.when(F.col("kind").isNotNull(), F.struct("line_no", "kind", "t")), ignorenulls=True).over(upto)
    rows = rows.withColumns({"anchor": anchor, "before": F.lag("t").over(order)})
    behind = F.col("line_no") - F.col("anchor.line_no") - 1
    item = F.regexp_replace("anchor.t", _BULLET, "")
    short = _words(F.col("t")) <= 5
    small = F.col("t").rlike(r"^\p{Ll}")
    wants = F.col("before").rlike(rf"(?i)\b(?:{'|'.join(lx.WRAPS_AFTER)})\s*$")
    more = item.rlike(rf"(?i)^(?:{'|'.join(lx.WRAPS_FROM)})") & (behind < F.when(item.rlike(r"(?i)^integrating\b"), 2).otherwise(1))
    wrapped = short & F.when(small, behind < LOWER_LINES).otherwise(wants | more)
    goes_on = F.when(F.col("anchor.kind") == "category", True).when(F.col("anchor.kind") == "inline", behind < INLINE_LINES).when(F.col("anchor.kind") == "bullet", wrapped).otherwise(False)
    closes = short & (_count(F.col("before"), r"\(") > _count(F.col("before"), r"\)")) & (_count(F.col("t"), r"\)") > _count(F.col("t"), r"\("))
    halves = F.col("before").rlike(r"^.{3,60}(?:&|and)\s+[A-Za-z]+$") & F.col("t").rlike("^[a-z]")
    run = Window.partitionBy("__key", "anchor.line_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    # The anchor itself doesn't end its run.
    rows = rows.withColumn("unbroken", F.min(F.when(F.col("kind").isNull(), F.coalesce(goes_on, F.lit(False))).otherwise(True)).over(run))
    plain = F.col("kind").isNull() & F.col("inside")
    after = ~F.coalesce(F.lag("kind").over(order), F.lit("")).isin("heading", "empty", "out")
    joined = (F.col("kind").isNull() & F.col("unbroken")) | (plain & after & F.coalesce(closes | halves, F.lit(False)))
    rows = rows.withColumn("head", F.last(F.when(~joined, F.col("line_no")), ignorenulls=True).over(upto))
    said = F.when(F.col("inline") != "", F.col("inline")).when(F.col("kind") == "heading", F.col("own")).otherwise(F.col("t"))
    kept = rows.where((F.col("inside") | (F.col("inline") != "") | (F.col("anchor.kind") == "inline") & F.col("unbroken")) & (said != "") & ~F.col("t").rlike(rf"^{_MARK}$"))
    out = kept.groupBy("__key", F.col("head").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("n"), said.alias("s"), (F.col("bullet") & F.col("kind").isin("bullet")).alias("b")))).alias("l"))
    row = F.array_join(F.col("l.s"), " ")
    # The spaces of a bullet's row mean nothing, also where its mark stood on a line of its own.
    return out.select(F.col("__key").alias(key), "line_no", F.when(F.try_element_at("l", F.lit(1))["b"], F.regexp_replace(row, r"\s+", " ")).otherwise(row).alias("row"))


def skill_items(lines: DataFrame, key: str = "resume_id", line: str = "line") -> DataFrame:
    """(key, line_no, item_no, item): every item of every row of ``skill_rows``; repeated ones are all there."""
    rows = skill_rows(lines, key, line)
    return rows.select(key, "line_no", F.posexplode(items_of(F.col("row"))).alias("item_no", "item"))


def skill_inventory(lines: DataFrame, key: str = "resume_id", line: str = "line") -> DataFrame:
    """(key, skills): the items of each resume in order, of equal ones the first, in the resume's own words.

    Resumes that list nothing have no row. Equal items of a resume meet before its list is made, so a list costs its distinct items.
    """
    items = skill_items(lines, key, line).groupBy(key, same_skill(F.col("item")).alias("same")).agg(F.min(F.struct("line_no", "item_no", "item")).alias("first"))
    whole = F.array_sort(F.collect_list("first"))
    return items.groupBy(key).agg(whole["item"].alias("skills"))


def listed_skills(resumes: DataFrame, key: str = "resume_id", text: str = "text") -> DataFrame:
    """``skill_inventory`` of resumes, one row each by ``key``."""
    return skill_inventory(line_table(resumes, key, text), key)
