"""Parsers and evaluation on short resumes whose facts are stated beside them."""

import json

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from dossiergrid.functions import text
from dossiergrid.operators import evaluation, facts, lines, matching

AS_OF = "2026-06-23"
CASES = {}


def case(name, expected):
    """Register a function of the texts' rows with what it must give for each text."""
    return lambda fn: CASES.setdefault(name, (fn, *expected))


def known_sql(columns, rows):
    return columns.split(", "), rows


def known_texts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "p_partkey long, text string")


def joined(values: Column, *fields: str) -> Column:
    """A list of records as text."""
    return F.array_join(F.transform(values, lambda r: F.concat_ws(" / ", *[r[f].cast("string") for f in fields])), "; ")


# Resumes whose facts are stated below, one by one.
TEACHER = (
    "JANE A. DOE\njane.doe@mail.org | 0917 123 4567\n\nSKILLS\n- Lesson Planning\n- Communication (oral and\nwritten)\n- Classroom Management\n\n"
    "WORK EXPERIENCE\nMathematics Teacher\nGreenfield High School\nJune 2018 - May 2021\n- Prepared lessons for grade 7\n\n"
    "EDUCATION\nBachelor of Secondary Education\nState University, 2014 - 2018\n\nCERTIFICATIONS\nLicensed Professional Teacher 2018\n\n"
    "REFERENCES\nJohn Smith\njohn@ref.org 0999 888 7777\n"
)
ENGINEER = (
    "Name: Rey Cruz\nSummary\nBackend engineer with 6 years of experience. No experience with Java. Eager to learn Kotlin.\n"
    "Technologies I am currently learning\nRust\nEXPERIENCE\nSoftware Engineer - Acme Solutions - Jan 2019 - Dec 2022\nBuilt APIs with Django and PostgreSQL\n"
    "EDUCATION\nBS Computer Science | Tech University\n"
)
CLIENTS = (
    "PROFESSIONAL EXPERIENCE\nClient: Capital One                  Mar 17 - Feb 19\nLocation: Mclean, VA\nRole: Java Developer\n\n"
    "Client: Cigna Healthcare             Nov 13 - Nov 15 Location: Windsor, CT\nRole: Tester and Analyst\n"
)
EMPTY = ""
RESUMES = [TEACHER, ENGINEER, CLIENTS, EMPTY]


@case("known_facts",
    known_sql(
        "email, phone, years, n_skills",
        [("jane.doe@mail.org", "0917 123 4567", 2.9, 3), ("Unknown Email", "Unknown Phone", 6.0, 2), ("Unknown Email", "Unknown Phone", 3.9, 1), ("Unknown Email", "Unknown Phone", 0.0, 0)],
    ),
)
def known_facts(spark):
    """Contacts without the referees', total years (stated, covered or summed), skills put together over line breaks."""
    found = facts.resume_facts(known_texts(spark, RESUMES), AS_OF, "p_partkey")
    return found.select("p_partkey", "email", "phone", "years", F.size("skills").alias("n_skills"))


@case("known_work",
    known_sql(
        "work",
        [
            ("Mathematics Teacher / Greenfield High School / Not Identified / 2.92",), ("Software Engineer / Acme Solutions / Not Identified / 3.92",),
            ("Java Developer / Capital One / Mclean, VA / 1.92; Tester and Analyst / Cigna Healthcare / Windsor, CT / 2.0",), ("",),
        ],
    ),
)
def known_work(spark):
    found = facts.resume_facts(known_texts(spark, RESUMES), AS_OF, "p_partkey")
    return found.select("p_partkey", joined(F.col("experience"), "job_title", "company", "location", "years").alias("work"))


@case("known_education",
    known_sql("school, names", [
        ("Bachelor of Secondary Education / State University", "Jane A. Doe"), ("BS Computer Science / Tech University", "Rey Cruz"), ("", "Unknown Candidate"), ("", "Unknown Candidate"),
    ]),
)
def known_education(spark):
    found = facts.resume_facts(known_texts(spark, RESUMES), AS_OF, "p_partkey")
    return found.select("p_partkey", joined(F.col("education"), "degree", "institution").alias("school"), F.col("name").alias("names"))


@case("known_credentials",
    known_sql("credentials, skills", [
        ("Licensed Professional Teacher / Professional License / 2018", "Lesson Planning; Communication (oral and written); Classroom Management"),
        ("", "PostgreSQL; Django"), ("", "Java"), ("", ""),
    ]),
)
def known_credentials(spark):
    found = facts.resume_facts(known_texts(spark, RESUMES), AS_OF, "p_partkey")
    said = joined(F.col("credentials"), "certification_name", "credential_type", "date_obtained")
    return found.select("p_partkey", said.alias("credentials"), F.array_join("skills", "; ").alias("skills"))


_JOB = "array('Lesson Planning', 'SQL', 'REST API', 'Rust', 'Java', 'Classroom Managment')"


@case("known_claims",
    known_sql("matched, missing, implied", [
        ("Lesson Planning,Classroom Managment", "SQL,REST API,Rust,Java", "{}"),
        ("SQL,REST API", "Lesson Planning,Rust,Java,Classroom Managment", '{"REST API":"django"}'),
        ("Java", "Lesson Planning,SQL,REST API,Rust,Classroom Managment", "{}"),
        ("", "Lesson Planning,SQL,REST API,Rust,Java,Classroom Managment", "{}"),
    ]),
)
def known_claims(spark):
    """Named, misspelt, disclaimed, only being learned, and entailed skills."""
    rows = known_texts(spark, RESUMES).withColumn("job_id", F.lit(1))
    jobs = spark.range(1).select(F.lit(1).alias("job_id"), F.expr(_JOB).alias("skills"))
    found = matching.analyze_skills(rows, jobs, "p_partkey")
    return found.select("p_partkey", F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"), F.to_json("implied").alias("implied"))


@case("known_evaluation",
    # Teacher: skills 100 (2 of 2), experience 2.9 of 2 years at related work, education of the same rank and field.
    # Engineer: SQL entailed, 1 of 2; without the critical skill.
    known_sql("label, skill_score, experience_score, education_score, reason", [
        ("Qualified", 100.0, 100.0, 100.0, None),
        ("Not Qualified", 0.0, 40.0, 50.0, "the resume is missing required critical skill(s): Lesson Planning"),
        ("Not Qualified", 0.0, 40.0, 0.0, "the resume is missing required critical skill(s): Lesson Planning"),
        ("Not Qualified", 0.0, 0.0, 0.0, "the resume is missing required critical skill(s): Lesson Planning"),
    ]),
)
def known_evaluation(spark):
    found = facts.resume_facts(known_texts(spark, RESUMES), AS_OF, "p_partkey").withColumn("job_id", F.lit(1))
    jobs = spark.range(1).selectExpr(
        "1 as job_id", "'Mathematics Teacher' as title", "array('Lesson Planning', 'Classroom Management') as required", "array('Lesson Planning') as critical",
        "cast(null as array<string>) as preferred", "'Bachelor of Secondary Education' as education_req", "2 as experience_req", "50.0D as min_fit_score", "true as requires_all_critical",
    )
    out = evaluation.evaluate(found, jobs, "p_partkey")
    return out.select("p_partkey", F.col("recommendation_label").alias("label"), "skill_score", "experience_score", "education_score", F.col("disqualification_reason").alias("reason"))


@case("known_evidence",
    known_sql("section, excerpt", [
        ("Skills", "Classroom Management"), ("Resume", "Matched in the extracted resume text."), ("Resume", "Matched in the extracted resume text."), ("Resume", "Matched in the extracted resume text."),
    ]),
)
def known_evidence(spark):
    """The line that shows a skill; without one the resume is named."""
    rows = known_texts(spark, RESUMES)
    asked = rows.select("p_partkey", F.lit("Classroom Management").alias("skill"))
    return lines.skill_evidence(lines.line_table(rows, "p_partkey"), asked, "p_partkey").select("p_partkey", "section", "excerpt")


@case("known_record_evidence",
    known_sql("section, excerpt", [("Work Experience", "Greenfield High School | Mathematics Teacher | June 2018 - May 2021")]),
)
def known_record_evidence(spark):
    """A work record with its employer's line, its role and the nearest dates."""
    rows = known_texts(spark, [TEACHER])
    record = rows.select("p_partkey", F.lit(0).alias("record_no"), F.lit("Greenfield High School").alias("primary"), F.lit("Mathematics Teacher").alias("secondary"))
    return lines.record_evidence(lines.line_table(rows, "p_partkey"), record, "work", "p_partkey").select("p_partkey", "section", "excerpt")


_CHECKS = [
    ("Teacher", "State University", 2.0, True, None), ("", "State University", 2.0, False, "missing role"), ("Skills", "Acme", 1.0, False, "role resembles a heading"),
    ("Managed a team of five people", "Acme", 1.0, False, "role resembles a responsibility"), ("Clerk", "", 1.0, False, "missing employer"),
    ("Clerk", "- Acme", 1.0, False, "malformed employer"), ("Clerk", "a@b.org", 1.0, False, "malformed employer"), ("Clerk", "Acme", 51.0, False, "invalid duration"),
]


@case("known_work_checks", known_sql("valid, reason", [r[3:] for r in _CHECKS]))
def known_work_checks(spark):
    rows = known_texts(spark, [json.dumps(r[:3]) for r in _CHECKS])
    part = lambda i: F.get_json_object("text", f"$[{i}]")
    checked = rows.withColumn("c", lines.check_experience(part(0), part(1), part(2).cast("double"), F.lit(False)))
    return checked.select("p_partkey", "c.valid", "c.reason")


_SCHOOL_CHECKS = [
    ("BS Biology", "State University", True, None), ("", "State University", False, "missing or oversized credential"), ("Education", "X", False, "credential resembles non-education content"),
    ("Awards of the year", "X", False, "credential contains unrelated content"), ("BS Biology", "", False, "missing institution value"), ("BS Biology", "2019", False, "invalid institution"),
]


@case("known_school_checks", known_sql("valid, reason", [r[2:] for r in _SCHOOL_CHECKS]))
def known_school_checks(spark):
    rows = known_texts(spark, [json.dumps(r[:2]) for r in _SCHOOL_CHECKS])
    checked = rows.withColumn("c", lines.check_education(F.get_json_object("text", "$[0]"), F.get_json_object("text", "$[1]")))
    return checked.select("p_partkey", "c.valid", "c.reason")


_HEADINGS = [("WORK EXPERIENCE", "experience"), ("Skills & Certifications:", "skills,certifications"), ("A. Education", "education"), ("Built many things", ""), ("S K I L L S", "skills")]


@case("known_headings", known_sql("sections", [r[1:] for r in _HEADINGS]))
def known_headings(spark):
    """Headings, also those spelt letter by letter, with all sections they name."""
    rows = known_texts(spark, [r[0] for r in _HEADINGS])
    return rows.select("p_partkey", F.array_join(text.section_of_heading(text.plain_heading(F.col("text"))), ",").alias("sections"))


_DEGREES = [
    ("Bachelor of Science in Nursing", "BS Nursing", 1.0, "Bachelor's degree"), ("Bachelor of Arts in Music", "BS Nursing", 0.5, "Bachelor's degree"),
    ("Master of Something", "BS Nursing", 0.85, "Master's degree"), ("High School", None, 1.0, "High School diploma"), ("none", None, 1.0, "unverified education"),
]


@case("known_degrees", known_sql("relevance, label", [r[2:] for r in _DEGREES]))
def known_degrees(spark):
    rows = known_texts(spark, [json.dumps(r[:2]) for r in _DEGREES])
    have, want = F.get_json_object("text", "$[0]"), F.get_json_object("text", "$[1]")
    return rows.select("p_partkey", text.field_relevance(have, want).alias("relevance"), text.degree_label(text.degree_rank(have)).alias("label"))


_STATED = [("12 years of IT experience and 3 years experience", 12.0), ("experience of 4 years", 4.0), ("a 7-year professional experience", 7.0), ("60 years of experience", None), ("4 years of study", None)]


@case("known_stated_years", known_sql("years", [r[1:] for r in _STATED]))
def known_stated_years(spark):
    return known_texts(spark, [r[0] for r in _STATED]).select("p_partkey", text.stated_years(F.col("text")).alias("years"))


_PHONES = [("call 0917 123 4567 now", "0917 123 4567", "09171234567"), ("+63 917 123 4567", "+63 917 123 4567", "639171234567"), ("(02) 812-4567", "(02) 812-4567", "028124567"), ("12345", "Unknown Phone", "")]


@case("known_phones", known_sql("phone, digits", [r[1:] for r in _PHONES]))
def known_phones(spark):
    found = text.phone_of(F.col("text"))
    return known_texts(spark, [r[0] for r in _PHONES]).select("p_partkey", found.alias("phone"), text.phone_signature(found).alias("digits"))


_DIRTY = [("infor-\nmation  here", "information  here"), ("in 201 9", "in 2019"), ("a\na\n\n\n\nb", "a\n\nb"), ("W O R K E X P E R I E N C E", "WORK EXPERIENCE"), ("", "")]


@case("known_clean_text", known_sql("cleaned", [r[1:] for r in _DIRTY]))
def known_clean_text(spark):
    return known_texts(spark, [r[0] for r in _DIRTY]).select("p_partkey", text.clean_text(F.col("text")).alias("cleaned"))


_LEVELS = ["PhD in Music", "Master of Science, ongoing", "MBA", "BS Computer Science", "Associate in Business", "High School", "Certificate of Nursing"]


@case("degree_ranks", known_sql("rank, field", [(5, "arts"), (3, None), (4, "business"), (3, "computing"), (2, "business"), (1, None), (0, "health")]))
def degree_ranks(spark):
    return known_texts(spark, _LEVELS).select("p_partkey", text.degree_rank(F.col("text")).alias("rank"), text.degree_field(F.col("text")).alias("field"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_known(spark, name):
    fn, columns, rows = CASES[name]
    got = fn(spark).orderBy("p_partkey").select(*columns).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in rows]
