"""Work history on the line table: flags of lines, what stands around a date, and roles that swallowed their employer.

Every function works on rows of lines or records; a line is told by what stands up to ``REACH`` lines
before or behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossiergrid.functions import lexicon as lx
from dossiergrid.functions.text import DATE_RANGE, section_of_heading, text_or_empty, text_signature

#: Lines before and after a date that may name its role and its employer.
REACH = 20
#: Longest line that can be a role or an employer.
LONGEST = 140


def line_flags(lines: DataFrame, title: str, employer: str, date: str = DATE_RANGE, line: str = "line") -> DataFrame:
    """``lines`` with ``flags``: ``struct<date,title,employer,heading>``, what each line looks like.

    ``title``, ``employer`` and ``date`` are patterns that a line must hold. Headings, long lines and those that end in a colon are
    neither roles nor employers. Null lines are nothing.
    """
    # Told once per line: every flag needs both.
    rows = lines.withColumns({"__text": F.trim(text_or_empty(F.col(line))), "__heading": F.size(section_of_heading(F.col(line))) > 0})
    text, heading = F.col("__text"), F.col("__heading")
    short = (text != "") & (F.length(text) <= LONGEST) & ~text.endswith(":") & ~heading
    flags = F.struct(
        text.rlike(date).alias("date"),
        (short & text.rlike(title)).alias("title"),
        (short & text.rlike(employer) & ~text.rlike(title)).alias("employer"),
        heading.alias("heading"),
    )
    return rows.withColumn("flags", flags).drop("__text", "__heading")


def _nearest(key: str, flag: str, line: str, reach: int) -> tuple[Column, Column]:
    """The nearest flagged line (line_no, text) before, and the one behind, within ``reach`` lines; a heading isn't crossed.

    The frames only grow, from either end, so a line costs one step whatever the reach.
    """
    seen = F.when(F.col(f"flags.{flag}") | F.col("flags.heading"), F.struct(F.col("line_no").alias("at"), F.col(line).alias("text"), F.col("flags.heading").alias("wall")))
    upto = lambda order: F.last(seen, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    near = lambda x: F.when(~x["wall"] & (F.abs(x["at"] - F.col("line_no")) <= reach), x)
    return near(upto(F.col("line_no"))), near(upto(F.col("line_no").desc()))


def dated_roles(lines: DataFrame, key: str = "resume_id", line: str = "line", reach: int = REACH) -> DataFrame:
    """(key, line_no, dates, role, role_line, employer, employer_line) of every line with a date.

    ``lines`` has ``line_no`` and ``flags``. A date line that is a role or an employer itself names it. Else the nearest line counts,
    the one before among equally near ones, and none beyond a heading or ``reach`` lines. Lines of one resume are sorted in
    one task.
    """

    def of(flag: str) -> Column:
        back, ahead = _nearest(key, flag, line, reach)
        own = F.when(F.col(f"flags.{flag}"), F.struct(F.col("line_no").alias("at"), F.col(line).alias("text"), F.lit(False).alias("wall")))
        nearer = F.when(back.isNull() | (ahead["at"] - F.col("line_no") < F.col("line_no") - back["at"]), F.coalesce(ahead, back)).otherwise(back)
        return F.coalesce(own, nearer)

    rows = lines.withColumns({"__role": of("title"), "__employer": of("employer")}).where("flags.date")
    return rows.select(
        key, "line_no", F.col(line).alias("dates"), F.col("__role.text").alias("role"), F.col("__role.at").alias("role_line"), F.col("__employer.text").alias("employer"), F.col("__employer.at").alias("employer_line")
    )


def drop_absorbed(records: DataFrame, key: str = "resume_id", title: str = "job_title", years: str = "years") -> DataFrame:
    """``records`` without those whose title ends in the title of another one of the same resume and duration.

    Such a title has swallowed the employer's line. Titles are compared by their signature, durations to two digits; records
    without a title or a positive duration stay and drop nothing. As ends of ends are ends, the order of records
    doesn't matter. Each title meets others by those of its proper ends that are as long as another title beside it, an
    equality, so no pair of records is compared: a resume with very many records of one duration costs their
    titles' different lengths. All of it is by windows within one resume and duration, which one exchange puts together.
    """
    rows = records.withColumn("__title", text_signature(F.col(title))).withColumn("__years", F.round(F.col(years).cast("decimal(20,6)"), 2))
    able = F.coalesce((F.col("__title") != "") & (F.col("__years") > 0), F.lit(False)) & F.col(key).isNotNull()
    same = [F.col(key), F.col("__years")]
    rows = rows.withColumn("__length", F.when(able, F.length("__title"))).withColumn("__lengths", F.collect_set("__length").over(Window.partitionBy(*same)))
    # The title itself, and the ends that another title can be; the rest is told apart by the row's number.
    shorter = F.filter("__lengths", lambda n: n < F.col("__length"))
    end = lambda n: F.struct(F.substring(F.col("__title"), F.col("__length") - n + 1, n).alias("end"), F.lit(False).alias("whole"))
    ends = F.concat(F.array(F.struct(F.when(able, F.col("__title")).alias("end"), F.lit(True).alias("whole"))), F.coalesce(F.transform(shorter, end), F.array()))
    rows = rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__end", F.explode(ends)).drop("__lengths", "__length", "__title")
    rows = rows.withColumn("__known", F.max("__end.whole").over(Window.partitionBy(*same, "__end.end")))
    gone = F.max(F.col("__known") & ~F.col("__end.whole")).over(Window.partitionBy(*same, "__row"))
    return rows.withColumn("__gone", gone).where("__end.whole and not __gone").select(*records.columns)


# Toggled sections ------------------------------------------------------------


def toggled(lines: DataFrame, on: Column, off: Column, begins: bool, key: str = "resume_id", name: str = "inside") -> DataFrame:
    """``lines`` with a boolean that the lines of ``on`` set and those of ``off`` clear, from each of them on; ``off`` wins on a line that is both.

    Before the first of them it is ``begins``. Null conditions count as false.
    """
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    signal = F.when(off, F.lit(False)).when(on, F.lit(True))
    return lines.withColumn("__signal", signal).withColumn(name, F.coalesce(F.last("__signal", ignorenulls=True).over(order), F.lit(begins))).drop("__signal")


def claimed_lines(lines: DataFrame, key: str = "resume_id", line: str = "line") -> DataFrame:
    """The lines that aren't empty, without sections that only list what someone is learning; such a section ends at the next heading."""
    text = F.trim(text_or_empty(F.col(line)))
    head = (F.length(text) <= 60) & ~text.rlike("[.,;]$") & ((text.rlike(r"\p{L}") & (text == F.upper(text))) | text.rlike(_any(lx.SKILL_HEADING, lx.INCLUDED_HEADING, lx.EXCLUDED_HEADING)))
    rows = toggled(lines.where(text != ""), head, text.rlike(f"(?i){lx.ASPIRATIONAL_HEADING}"), True, key, "__claimed")
    return rows.where("__claimed").drop("__claimed")


def work_lines(lines: DataFrame, key: str = "resume_id", line: str = "line") -> DataFrame:
    """The lines below headings of work experience; all lines that aren't empty where none stands below one."""
    text = F.trim(text_or_empty(F.col(line)))
    begins = text.rlike(f"(?i){lx.EXPERIENCE_HEADING}")
    rows = toggled(lines.where(text != ""), begins, text.rlike(_any(lx.SKILL_HEADING, lx.EXCLUDED_HEADING)) & ~begins, False, key, "__work")
    rows = rows.withColumn("__work", F.col("__work") & ~begins)
    some = F.max("__work").over(Window.partitionBy(key))
    return rows.withColumn("__some", some).where("__work or not __some").drop("__work", "__some")


def _any(*patterns: str) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)
