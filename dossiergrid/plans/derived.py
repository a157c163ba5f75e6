"""Registered queries on texts put together from table columns, so that SQL can tell the facts from the same columns.

The test tables hold no resumes; every text here varies with the row it is made from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossiergrid.functions import text
from dossiergrid.operators import lines
from dossiergrid.plans.catalog import query, table

_PHONE = """CASE WHEN c_acctbal < 0 THEN left(c_custkey::VARCHAR, 5) WHEN c_acctbal < 3000 THEN '0917 ' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || ' ' || lpad((c_custkey % 9973)::VARCHAR, 4, '0')
  WHEN c_acctbal < 6000 THEN '+63 917 ' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 9973)::VARCHAR, 4, '0') ELSE '(02) 812-' || lpad((c_custkey % 9973)::VARCHAR, 4, '0') END"""


@query(
    "derived_phones",
    f"""
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'Unknown Phone' ELSE p END AS phone, CASE WHEN c_acctbal < 0 THEN '' ELSE regexp_replace(p, '[^0-9]', '', 'g') END AS digits
    FROM (SELECT *, {_PHONE} AS p FROM customer)
    """,
)
def derived_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mobile, international and landline numbers made from customers' keys."""
    low = lambda n, width: F.lpad((F.col("c_custkey") % n).cast("string"), width, "0")
    number = (
        F.when(F.col("c_acctbal") < 0, F.substring(F.col("c_custkey").cast("string"), 1, 5)).when(F.col("c_acctbal") < 3000, F.concat(F.lit("0917 "), low(1000, 3), F.lit(" "), low(9973, 4)))
        .when(F.col("c_acctbal") < 6000, F.concat(F.lit("+63 917 "), low(1000, 3), F.lit("-"), low(9973, 4))).otherwise(F.concat(F.lit("(02) 812-"), low(9973, 4)))
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("call "), number, F.lit(" or write")).alias("t"))
    found = text.phone_of(F.col("t"))
    return rows.select("c_custkey", found.alias("phone"), text.phone_signature(found).alias("digits"))


@query(
    "derived_years",
    """
    SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN greatest(p_size, p_size // 2 + 3) WHEN p_type = 'SMALL' THEN p_size // 2 + 3 END::DOUBLE AS years FROM part
    """,
)
def derived_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated years of experience; years of study, and totals over 50, are none."""
    size = F.col("p_size").cast("string")
    first = F.when(F.col("p_type") == "ECONOMY", F.concat(size, F.lit(" years of work experience"))).otherwise(F.concat(size, F.lit(" years of study, 70 years of experience")))
    second = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), F.concat(F.lit("; experience of "), F.floor(F.col("p_size") / 2 + 3).cast("string"), F.lit(" years")))
    return table(spark, sf_dir, "part").select("p_partkey", text.stated_years(F.concat_ws("", "p_name", F.lit(" with "), first, second)).alias("years"))


@query(
    "derived_headings",
    """
    SELECT p_partkey, CASE WHEN p_size > 40 OR p_retailprice > 990 AND p_retailprice <= 1000 THEN '' ELSE
             CASE WHEN p_size <= 10 THEN 'skills' WHEN p_size <= 25 THEN 'education' ELSE 'experience' END || CASE WHEN p_retailprice <= 950 THEN '' WHEN p_retailprice <= 990 THEN ',certifications' ELSE ',projects' END END AS sections
    FROM part
    """,
)
def derived_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of one or two sections; a line with a part's name in it is none."""
    first = F.when(F.col("p_size") <= 10, "SKILLS").when(F.col("p_size") <= 25, "Education").when(F.col("p_size") <= 40, "Work Experience").otherwise(F.col("p_name"))
    price = F.col("p_retailprice")
    second = F.when(price <= 950, ":").when(price <= 990, " & Certifications").when(price <= 1000, F.concat(F.lit(" and "), "p_name")).otherwise(", Projects:")
    heading = text.section_of_heading(text.plain_heading(F.concat(first, second)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(heading, ",").alias("sections"))


@query(
    "derived_degrees",
    """
    WITH d AS (
      SELECT p_partkey, CASE WHEN p_size <= 8 THEN 5 WHEN p_size <= 16 THEN 4 WHEN p_size <= 32 THEN 3 WHEN p_size <= 40 THEN 2 ELSE 1 END AS rank,
             CASE WHEN p_size > 40 THEN NULL WHEN p_retailprice <= 930 THEN 'health' WHEN p_retailprice <= 960 THEN 'arts' WHEN p_retailprice <= 980 THEN 'computing' END AS field FROM part
    )
    SELECT p_partkey, rank, field, CASE field WHEN 'health' THEN 1.0 WHEN 'arts' THEN 0.5 WHEN 'computing' THEN 0.5 ELSE 0.85 END::DOUBLE AS relevance FROM d
    """,
)
def derived_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees by level and subject: their rank, field, and relevance for a job in nursing."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    level = F.when(size <= 8, "PhD in ").when(size <= 16, "Master of ").when(size <= 32, "Bachelor of ").when(size <= 40, "Associate in ").otherwise("High School of ")
    subject = F.when(size > 40, "Anywhere").when(price <= 930, "Nursing").when(price <= 960, "Music").when(price <= 980, "Computer Science").otherwise("Something")
    degree = F.concat(level, subject)
    rows = table(spark, sf_dir, "part").select("p_partkey", degree.alias("degree"))
    return rows.select("p_partkey", text.degree_rank(F.col("degree")).alias("rank"), text.degree_field(F.col("degree")).alias("field"), text.field_relevance(F.col("degree"), F.lit("BS Nursing")).alias("relevance"))


@query(
    "derived_work_checks",
    """
    WITH r AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax > 0.06 THEN 'missing role' WHEN l_tax > 0.05 THEN 'role resembles a heading' WHEN l_tax > 0.04 THEN 'role resembles a responsibility'
             WHEN l_discount > 0.08 THEN 'missing employer' WHEN l_discount > 0.06 THEN 'malformed employer' WHEN l_quantity > 45 THEN 'invalid duration' END AS reason, l_quantity, l_extendedprice FROM lineitem
    )
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, reason, reason IS NULL AS valid FROM r
    """,
)
def derived_work_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as work records, with the first thing that is wrong with each."""
    tax, off, part = F.col("l_tax"), F.col("l_discount"), F.col("l_partkey").cast("string")
    title = F.when(tax > 0.06, "  ").when(tax > 0.05, "Skills:").when(tax > 0.04, F.concat(F.lit("Managed a team of five in plant "), part)).otherwise(F.concat(F.lit("Clerk "), part))
    company = F.when(off > 0.08, "").when(off > 0.06, F.concat(F.lit("jobs@shop"), part)).otherwise(F.concat(F.lit("Shop "), F.col("l_suppkey").cast("string")))
    years = F.when(F.col("l_quantity") > 45, F.col("l_quantity") + 10).otherwise(F.col("l_quantity"))
    rows = table(spark, sf_dir, "lineitem").withColumn("c", lines.check_experience(title, company, years, F.lit(False)))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "c.reason", "c.valid")


@query(
    "derived_school_checks",
    """
    SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'missing or oversized credential' WHEN p_size <= 10 THEN 'credential resembles non-education content' WHEN p_size <= 15 THEN 'credential contains unrelated content'
                           WHEN p_retailprice <= 930 THEN 'missing institution value' WHEN p_retailprice <= 960 THEN 'invalid institution' END AS reason
    FROM part
    """,
)
def derived_school_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    degree = F.when(size <= 5, "").when(size <= 10, "Education").when(size <= 15, F.concat(F.lit("Awards for "), "p_name")).otherwise(F.concat(F.lit("BS "), "p_name"))
    school = F.when(price <= 930, " ").when(price <= 960, (F.lit(1960) + size).cast("string")).otherwise(F.concat("p_brand", F.lit(" University")))
    return table(spark, sf_dir, "part").select("p_partkey", lines.check_education(degree, school)["reason"].alias("reason"))


@query(
    "derived_clean_text",
    """
    SELECT p_partkey, replace(p_name, ' ', '') || ' in ' || (1960 + p_size)::VARCHAR || chr(10) || p_brand || CASE WHEN p_size > 25 THEN chr(10) || chr(10) || 'WORK EXPERIENCE' ELSE '' END AS cleaned FROM part
    """,
)
def derived_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words broken over lines, broken years, repeated lines, runs of empty lines and headings spelt letter by letter."""
    year = (F.lit(1960) + F.col("p_size")).cast("string")
    broken = F.concat(F.replace("p_name", F.lit(" "), F.lit("-\n")), F.lit(" in "), F.substring(year, 1, 3), F.lit(" "), F.substring(year, 4, 1), F.lit("\n"), "p_brand", F.lit("\n"), "p_brand")
    rest = F.when(F.col("p_size") > 25, "\n\n\n\nW O R K E X P E R I E N C E\n").otherwise("\n\n")
    return table(spark, sf_dir, "part").select("p_partkey", text.clean_text(F.concat(F.lit("\n "), broken, rest)).alias("cleaned"))


@query(
    "derived_skill_evidence",
    """
    SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'Skills' WHEN c_acctbal > -500 THEN 'Work Experience' ELSE 'Resume' END AS section,
           CASE WHEN c_acctbal > 0 THEN '- ' || lower(c_mktsegment) WHEN c_acctbal > -500 THEN 'Sold ' || lower(c_mktsegment) || ' goods' ELSE 'Matched in the extracted resume text.' END AS excerpt
    FROM customer
    """,
)
def derived_skill_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that shows a customer's segment: one of the skills before one of the work, the shortest first."""
    low = F.lower("c_mktsegment")
    skills = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("SKILLS\n- trade in "), low, F.lit(" and more\n- "), low))
    work = F.when(F.col("c_acctbal") > -500, F.concat(F.lit("WORK EXPERIENCE\nSold "), low, F.lit(" goods")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.concat_ws("\n", "c_name", work, skills, F.lit("EDUCATION\nSome school")).alias("t"))
    asked = rows.select("c_custkey", F.col("c_mktsegment").alias("skill"))
    found = lines.skill_evidence(lines.line_table(rows, "c_custkey", "t"), asked, "c_custkey")
    return found.select("c_custkey", "section", F.concat(F.when(F.col("section") == "Skills", "- ").otherwise(""), "excerpt").alias("excerpt"))


@query(
    "derived_record_evidence",
    """
    WITH r AS (SELECT p_partkey, p_brand || ' School' AS employer, p_name || ' teacher' AS role, 'May ' || (1970 + p_size)::VARCHAR || ' - June ' || (1972 + p_size)::VARCHAR AS dates, p_size, p_retailprice FROM part)
    SELECT p_partkey, 'Work Experience' AS section, employer || CASE WHEN p_size <= 25 THEN ' | ' || role ELSE '' END || CASE WHEN p_retailprice <= 1000 THEN ' | ' || dates ELSE '' END AS excerpt FROM r
    """,
)
def derived_record_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as work records: the employer's line with its role and dates, where the resume has them."""
    size = F.col("p_size")
    dates = F.concat(F.lit("May "), (size + 1970).cast("string"), F.lit(" - June "), (size + 1972).cast("string"))
    employer, role = F.concat("p_brand", F.lit(" School")), F.concat("p_name", F.lit(" teacher"))
    said = F.concat_ws("\n", "p_type", F.lit("\nWORK EXPERIENCE"), employer, F.when(size <= 25, role), F.when(F.col("p_retailprice") <= 1000, dates), F.lit("\nEDUCATION"), F.lit("Some University"))
    rows = table(spark, sf_dir, "part").select("p_partkey", said.alias("t"), employer.alias("primary"), role.alias("secondary"))
    record = rows.select("p_partkey", F.lit(0).alias("record_no"), "primary", "secondary")
    return lines.record_evidence(lines.line_table(rows, "p_partkey", "t"), record, "work", "p_partkey").select("p_partkey", "section", "excerpt")


@query(
    "derived_sections",
    """
    WITH s AS (
      SELECT p_partkey, unnest(CASE WHEN p_size > 25 THEN [0, 1, 2, 3] ELSE [0, 1, 2] END) AS segment,
             unnest(CASE WHEN p_size > 25 THEN ['header', 'skills', 'experience', 'education'] ELSE ['header', 'skills', 'education'] END) AS section,
             unnest(CASE WHEN p_size > 25 THEN [NULL, 'SKILLS', 'Work Experience:', 'Education'] ELSE [NULL, 'SKILLS', 'Education'] END) AS heading,
             unnest(CASE WHEN p_size > 25 THEN ['', '|' || p_name || '|' || p_type, '|' || p_brand, '|BS ' || p_name] ELSE ['', '|' || p_name || '|' || p_type, '|BS ' || p_name] END) AS body, p_brand FROM part
    )
    SELECT p_partkey, segment, section, heading, CASE WHEN segment = 0 THEN 'About ' || p_brand ELSE substr(body, 2) END AS body FROM s
    """,
)
def derived_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as resumes with two or three sections, and the lines of each."""
    work = F.when(F.col("p_size") > 25, F.concat(F.lit("Work Experience:\n"), "p_brand"))
    said = F.concat_ws("\n", F.concat(F.lit("About "), "p_brand"), F.lit("SKILLS"), "p_name", "p_type", work, F.lit("Education"), F.concat(F.lit("BS "), "p_name"))
    found = lines.segments(lines.line_table(table(spark, sf_dir, "part").select("p_partkey", said.alias("t")), "p_partkey", "t"), "p_partkey")
    return found.select("p_partkey", F.col("segment").cast("int").alias("segment"), "section", "heading", F.array_join("lines", "|").alias("body"))


@query(
    "derived_entities",
    """
    WITH e AS (
      SELECT p_partkey, 'education_role' AS type, 'Teacher' AS name, CASE WHEN p_size > 25 THEN 'high' ELSE 'medium' END AS confidence, 1 AS line_no, p_name || ' Teacher' AS evidence FROM part
      UNION ALL SELECT p_partkey, 'grade_level', 'Grade ' || (p_size % 12 + 1)::VARCHAR, 'high', 3, 'Grade ' || (p_size % 12 + 1)::VARCHAR || ' in ' || p_brand FROM part
      UNION ALL SELECT p_partkey, 'subject', 'Physics', 'medium', 4, 'Physics of a ' || p_name FROM part WHERE p_retailprice > 950
      UNION ALL SELECT p_partkey, 'license', 'LPT', 'high', 5, 'LPT ' || p_partkey::VARCHAR FROM part
    )
    SELECT p_partkey, type, name, confidence, line_no, evidence FROM e
    """,
)
def derived_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles, grades, subjects and licences of the teaching domain, surer in the sections where they belong."""
    first = F.when(F.col("p_size") > 25, "Work Experience").otherwise("Skills")
    grade = F.concat(F.lit("Grade "), (F.col("p_size") % 12 + 1).cast("string"), F.lit(" in "), "p_brand")
    subject = F.when(F.col("p_retailprice") > 950, F.concat(F.lit("Physics of a "), "p_name")).otherwise(F.lit(""))
    said = F.concat_ws("\n", first, F.concat("p_name", F.lit(" Teacher")), F.lit("Education"), grade, subject, F.concat(F.lit("LPT "), F.col("p_partkey").cast("string")))
    found = lines.entities(lines.line_table(table(spark, sf_dir, "part").select("p_partkey", said.alias("t")), "p_partkey", "t"), "p_partkey")
    return found.select("p_partkey", "type", "name", "confidence", "line_no", "evidence")
