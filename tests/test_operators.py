"""Operators on small resumes and tables with known answers."""

import io
import random
import re
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dossiergrid.functions import claims, lexicon
from dossiergrid.functions.similarity import all_stems_near, common_length, common_lengths, irregular_forms, kept_by_stem, phrase_like, stem
from dossiergrid.operators import duplicates, evaluation, facts, lines, matching, metrics, review, scoring
from dossiergrid.operators.similarity import bag_of_words, text_similarity
from dossiergrid.sources import documents
from dossiergrid.streaming import ingest

AS_OF = "2026-06-23"

TEACHER = """JANE A. DOE
jane.doe@mail.org | 0917 123 4567

SKILLS
Lesson Planning, Classroom Management, Python (pandas, numpy)
Microsoft Excel

WORK EXPERIENCE
Mathematics Teacher
Greenfield High School
June 2018 - May 2021
- Prepared lessons for grade 7

Instructor | Northside College | 2021 - 2023

EDUCATION
Bachelor of Secondary Education
State University, 2014 - 2018

CERTIFICATIONS
Licensed Professional Teacher 2018
Civil Service Eligibility, 2019

REFERENCES
John Smith 0999 888 7777
"""

ENGINEER = """Name: Rey de la Cruz
rey@dev.io
Summary
Backend engineer with 6 years of experience. No experience with Java. Eager to learn Kotlin.
Technologies I am currently learning
Rust
EXPERIENCE
Software Engineer at Acme Solutions Inc
Jan 2019 - Dec 2022
Built APIs with Django and PostgreSQL
EDUCATION
BS Computer Science
Tech University
"""


def resumes(spark, *texts):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "resume_id long, text string")


def test_facts(spark):
    rows = {r.resume_id: r for r in facts.resume_facts(resumes(spark, TEACHER, ENGINEER, None, "", "x" * 300_000), AS_OF).collect()}
    teacher, engineer = rows[0], rows[1]
    assert (teacher.name, teacher.email, teacher.phone) == ("Jane A. Doe", "jane.doe@mail.org", "0917 123 4567")
    assert [(r.job_title, r.company, r.years) for r in teacher.experience] == [("Mathematics Teacher", "Greenfield High School", 2.92), ("Instructor", "Northside College", 2.0)]
    assert teacher.years == 4.6  # June 2018 to January 2023, overlaps counted once
    assert [tuple(r) for r in teacher.education] == [("Bachelor of Secondary Education", "State University")]
    assert [r.certification_name for r in teacher.credentials] == ["Licensed Professional Teacher", "Civil Service Eligibility"]
    assert teacher.skills == ["Lesson Planning", "Classroom Management", "Python (pandas, numpy)", "Microsoft Excel"]
    assert engineer.name == "Rey De La Cruz" or engineer.name == "Rey de la Cruz"
    assert engineer.years == 6 and engineer.experience[0].company == "Acme Solutions Inc" and engineer.education[0].institution == "Tech University"
    for k in (2, 3, 4):
        assert rows[k].name == "Unknown Candidate" and rows[k].email == "Unknown Email" and rows[k].years == 0 and rows[k].experience == []


@pytest.mark.parametrize(
    ("line", "years"),
    [("April - May 2019", 0.08), ("June 26, 2018 - February 8, 2019", 0.67), ("2019 - 2023", 4.0), ("18 months", 1.5), ("3 yrs", 3.0), ("no date", None), ("2023 - 2019", None)],
)
def test_years_of_a_line(line, years):
    assert facts.years_of(line, AS_OF) == years


def test_skill_claims(spark):
    jobs = spark.createDataFrame([(1, ["Java", "SQL", "Kotlin", "Rust", "rest api", "Go", " ", "software engineering"])], "job_id int, skills array<string>")
    rows = resumes(spark, ENGINEER, "recruiter of algorithms\nC# and Go", None).withColumn("job_id", F.lit(1))
    got = {r.resume_id: r for r in matching.analyze_skills(rows, jobs).collect()}
    assert got[0].matched == ["SQL", "rest api", "software engineering"] and got[0].missing == ["Java", "Kotlin", "Rust", "Go"]
    assert got[0].implied == {"rest api": "django"}
    assert got[1].matched == ["Go"] and got[2].matched == [] and len(got[2].missing) == 7
    plain = {r.resume_id: r.matched for r in matching.analyze_skills(rows, jobs, implied=False).collect()}
    assert plain[0] == ["SQL", "software engineering"]
    bonus = spark.range(1).select(matching.preferred_bonus(F.array(F.lit("a"), F.lit("b")), F.lit(3)), matching.preferred_bonus(F.array(), F.lit(0))).first()
    assert tuple(bonus) == (6.67, 0.0)


def test_claims_against_plain_comparison():
    """The bounds on lengths and letters lose no window, on words close to the skills."""
    rng = random.Random(5)
    words = ["lesson", "lessons", "planing", "planning", "plan", "classroom", "manage", "managing", "management", "rest", "api", "apis", "no", "agile", "agil", "é", "ﬁt", "data", "date"]
    skills = ["lesson planning", "classroom management", "agile", "rest api", "data", "go", "planning lesson lesson", "é"]
    texts = [[" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 4))] for _ in range(400)]

    def plain(lines, skill):
        if claims.named(lines, "\n".join(lines), skill):
            return True
        return any(phrase_like(x, skill) or all_stems_near(x, skill) for x in lines if not re.search(f"{lexicon.NEGATION}|{lexicon.ASPIRATION}", x))

    got = claims.claimed(texts, [skills] * len(texts))
    assert got == [{s for s in skills if plain(lines, s)} for lines in texts]
    assert 0 < sum(map(len, got)) < len(texts) * len(skills)


def test_only_words_like_a_skill_are_worked_on(monkeypatch):
    """Words that don't begin like a skill's stem are not stemmed, and what shares too few letters isn't compared."""
    stemmed, compared = [], []
    monkeypatch.setattr(claims, "stem", lambda w: stemmed.append(w) or stem(w))
    monkeypatch.setattr(claims, "common_lengths", lambda a, others: compared.extend(others) or common_lengths(a, others), raising=False)
    rng = random.Random(3)
    texts = [[" ".join("".join(rng.choices("bcdfghjkmnou", k=6)) for _ in range(50))] for _ in range(40)]
    texts += [["it was planed and lesson-planning too"], ["agill work"], ["resting and apis"]]
    got = claims.claimed(texts, [["agile", "lesson planning", "rest api"]] * len(texts))
    assert got == [set()] * 40 + [{"lesson planning"}, {"agile"}, {"rest api"}]
    assert len(set(stemmed)) <= 12 and len(compared) <= 12


def test_stems_keep_what_words_begin_with():
    rng = random.Random(4)
    ends = "ational tional enci anci izer bli biliti bility logi icate ful ness ement ion ous e y s ed ing ies ied ll eed sses".split()
    words = {"".join(rng.choices("abeilstyz", k=rng.randint(1, 5))) + "".join(rng.choices(ends, k=rng.randint(0, 2))) for _ in range(20000)} | {"dying", "skies", "sensibility"}
    assert [w for w in words if not w.startswith(kept_by_stem(stem(w))) and w not in irregular_forms(stem(w))] == []


def test_common_lengths_of_many_texts():
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab é\U0001f600", k=rng.randint(0, 70))) for _ in range(300)]
    for a in ["abba é", "\U0001f600b", "ab " * 21, "ab " * 22, "", "a\0b"]:
        assert common_lengths(a, texts).tolist() == [common_length(a, b) for b in texts]
    assert common_lengths("a", []).tolist() == []


def test_many_jobs_are_joined_by_salted_key(spark, monkeypatch):
    monkeypatch.setattr(matching, "MOST_JOBS", 1)
    jobs = spark.createDataFrame([(1, ["SQL"]), (2, [None, "Go"]), (3, None)], "job_id int, skills array<string>")
    rows = spark.createDataFrame([(i, i % 4, "sql\nand go") for i in range(40)] + [(40, None, "go"), (41, 1, None)], "resume_id long, job_id int, text string")
    got = {r.resume_id: (r.matched, r.missing) for r in matching.analyze_skills(rows, jobs).collect()}
    assert got == {i: {1: (["SQL"], []), 2: (["Go"], []), 3: ([], [])}[i % 4] for i in range(40) if i % 4} | {41: ([], ["SQL"])}
    assert matching.analyze_skills(rows.limit(0), jobs.limit(0)).count() == 0


def test_fit_weighs_the_unrounded_skill_score(spark):
    one, three = F.array(F.lit("a")), F.array(*[F.lit(x) for x in "abc"])
    lit = F.lit
    row = spark.range(1).select(scoring.fit_score(scoring.skill_score(one, three, lit(0.0)), lit(100.0), lit(100.0), lit(0.0))).first()
    assert row[0] == 56.67


def test_contacts_of_referees_are_not_the_applicants(spark):
    text = "JANE DOE\nSKILLS\nChess\nREFERENCES\nName: John Smith\njohn@ref.org 0999 888 7777\n"
    after = text + "PERSONAL INFORMATION\njane@own.org\n"
    a, b = facts.resume_facts(resumes(spark, text, after), AS_OF).orderBy("resume_id").collect()
    assert (a.email, a.phone, a.name) == ("Unknown Email", "Unknown Phone", "Jane Doe") and b.email == "jane@own.org"


def test_years_near_words_of_work(spark):
    texts = ["Ann Lee\nBarista\n2018 - 2020\nplain\nBachelor of Arts\n2010 - 2014\nteacher", "Dean's list 2018 - 2020\nclerk", "nothing 2018 - 2020", "clerk 2019 - 2020\nclerk 2019 - 2021", None]
    assert [r.years for r in facts.resume_facts(resumes(spark, *texts), AS_OF).orderBy("resume_id").collect()] == [2.0, 0.0, 0.0, 2.0, 0.0]


def test_skills_of_the_job_in_the_inventory_and_implied_critical_skills(spark):
    text = "Ann Lee\nEXPERIENCE\nBuilt underwater robots with Django for Acme Inc\nNo experience with falconry\n"
    found = facts.resume_facts(resumes(spark, text), AS_OF).withColumn("job_id", F.lit(1))
    jobs = spark.createDataFrame(
        [(1, "Diver", ["Underwater Robots", "falconry"], ["rest api"], None, None, 0, 50.0, True)],
        "job_id int, title string, required array<string>, critical array<string>, preferred array<string>, education_req string, experience_req int, min_fit_score double, requires_all_critical boolean",
    )
    row = evaluation.evaluate(found, jobs).first()
    assert "underwater robots" in row.skills and "falconry" not in row.skills
    assert row.implied == {"rest api": "django"} and row.missing_critical == [] and row.matched == ["Underwater Robots"]


@pytest.mark.parametrize(
    ("fit", "minimum", "label"),
    [(75.0, 50.0, "Qualified"), (74.99, 50.0, "For Review"), (50.0, 50.0, "For Review"), (49.99, 50.0, "Not Qualified"), (80.0, 85.0, "Not Qualified"), (60.0, 60.0, "For Review")],
)
def test_labels(spark, fit, minimum, label):
    assert spark.range(1).select(scoring.fit_label(F.lit(fit), F.lit(minimum))).first()[0] == label


def test_scores(spark):
    lit = F.lit
    row = spark.range(1).select(
        scoring.fit_score(lit(80.0), lit(50.0), lit(100.0)), scoring.fit_score(lit(80.0), lit(50.0), lit(100.0), lit(None).cast("double")),
        scoring.fit_score(lit(120.0), lit(100.0), lit(100.0), lit(100.0)), scoring.years_score(lit(1.0), lit(3)), scoring.experience_score(lit(0.0), lit(0), lit(0.4)),
        scoring.experience_score(lit(5.0), lit(3), lit(0.4)), scoring.education_score(lit(3), lit(4), lit(0.5)), scoring.education_score(lit(0), lit(0), lit(0.5)),
    ).first()
    assert tuple(row) == (75.0, 75.0, 100.0, 33.33, 40.0, 40.0, 37.5, 100.0)


def test_similarity(spark):
    left = spark.createDataFrame([(1, "red blue green"), (2, "red blue green"), (3, "one two"), (4, ""), (5, "red blue")], "a long, text string")
    right = spark.createDataFrame([(1, "red blue green")], "b long, text string")
    pairs = left.select("a", F.lit(1).cast("long").alias("b"))
    got = {r.a: r.similarity for r in text_similarity(pairs, left, right, "a", "b").collect()}
    assert got[1] == got[2] == 100.0 and got[3] == got[4] == 0.0 and 0 < got[5] < 100
    assert spark.range(1).select(bag_of_words(F.lit("The R&D of 3 teams, a plan"))).first()[0] == "teams plan"


def test_evaluation_end_to_end(spark):
    found = facts.resume_facts(resumes(spark, TEACHER, ENGINEER, None), AS_OF).withColumn("job_id", F.lit(1))
    jobs = spark.createDataFrame(
        [(1, "Mathematics Teacher", ["Lesson Planning", "Classroom Management"], ["Lesson Planning"], ["Microsoft Excel", "Python", "Chess"], "Bachelor of Education", 3, None, True)],
        "job_id int, title string, required array<string>, critical array<string>, preferred array<string>, education_req string, experience_req int, min_fit_score double, requires_all_critical boolean",
    )
    got = {r.resume_id: r for r in evaluation.evaluate(found, jobs).collect()}
    good, bad, empty = got[0], got[1], got[2]
    assert good.recommendation_label == "Qualified" and good.skill_score == 100.0 and good.preferred_bonus == 6.67 and good.education_score == 100.0
    assert good.confidence.level == "High" and "strong match" in good.summary and good.decision_explanation.count("\n\n") == 4
    assert bad.recommendation_label == "Not Qualified" and bad.disqualification_reason == "the resume is missing required critical skill(s): Lesson Planning"
    assert "marked Not Qualified" in bad.summary and bad.missing == ["Lesson Planning", "Classroom Management"]
    assert empty.recommendation_label == "Not Qualified" and empty.confidence.level == "Low" and empty.fit_score == 0.0


def test_overrides(spark):
    def verdict(label, **e):
        e = {"requires_all_critical": False, "missing_critical": [], "required": ["a"], "matched": ["a"], "missing": [], "experience_req": 0, "years_score": 100.0} | e
        cols = {k: F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v) for k, v in e.items()}
        return spark.range(1).select(scoring.overruled(F.lit(label), cols)["label"]).first()[0]

    assert verdict("Qualified", requires_all_critical=True, missing_critical=["b"]) == "Not Qualified"
    assert verdict("Qualified", matched=[], missing=["a"]) == "Not Qualified"
    assert verdict("Qualified", required=["a", "b"], missing=["b"], experience_req=5, years_score=10.0) == "For Review"
    assert verdict("For Review", experience_req=5, years_score=49.0) == "Not Qualified"
    assert verdict("Qualified", experience_req=5, years_score=60.0) == "For Review"
    assert verdict("Qualified") == "Qualified"


def test_segments_entities_and_evidence(spark):
    table = lines.line_table(resumes(spark, TEACHER))
    assert [r.section for r in lines.segments(table).orderBy("segment").collect()] == ["header", "skills", "experience", "education", "certifications", "references"]
    found = {(r.type, r.name.lower(), r.confidence) for r in lines.entities(table).collect()}
    assert {("education_role", "teacher", "high"), ("education_skill", "lesson planning", "high"), ("grade_level", "grade 7", "high"), ("subject", "mathematics", "medium")} <= found
    skills = spark.createDataFrame([(0, "Classroom Management"), (0, "Chess")], "resume_id long, skill string")
    quoted = {r.skill: (r.section, r.excerpt) for r in lines.skill_evidence(table, skills).collect()}
    assert quoted["Classroom Management"] == ("Skills", "Lesson Planning, Classroom Management, Python (pandas, numpy)") and quoted["Chess"][0] == "Resume"
    records = spark.createDataFrame([(0, 0, "Greenfield High School", "Mathematics Teacher"), (0, 1, "Nowhere", None)], "resume_id long, record_no int, primary string, secondary string")
    got = lines.record_evidence(table, records, "work").collect()
    assert [(r.record_no, r.section, r.excerpt) for r in got] == [(0, "Work Experience", "Greenfield High School | Mathematics Teacher | 2018 - May 2021")] or (
        len(got) == 1 and got[0].excerpt.startswith("Greenfield High School | Mathematics Teacher")
    )


def test_record_checks(spark):
    work = [("Teacher", "School", 2.0, False), ("", "School", 1.0, False), ("Skills", "School", 1.0, False), ("Prepared the weekly lesson plans", "School", 1.0, False), ("Cook", "", 1.0, False), ("Cook", "a@b", 1.0, False), ("Cook", "Inn", 0.0, False), ("Cook", "Inn", 0.0, True), ("Cook", "Inn", 60.0, False)]
    rows = spark.createDataFrame(work, "t string, c string, y double, u boolean").select(lines.check_experience(F.col("t"), F.col("c"), F.col("y"), F.col("u")).alias("r")).collect()
    assert [r.r.reason for r in rows] == [None, "missing role", "role resembles a heading", "role resembles a responsibility", "missing employer", "malformed employer", "invalid duration", None, "invalid duration"]
    school = [("BS Biology", "State University"), (None, "x"), ("Education", "x"), ("Honors roll", "x"), ("BS", ""), ("BS", "2019"), ("BS", "Unknown Institution")]
    rows = spark.createDataFrame(school, "d string, i string").select(lines.check_education(F.col("d"), F.col("i")).alias("r")).collect()
    assert [r.r.valid for r in rows] == [True, False, False, False, False, False, True]


def test_blocking_depends_on_order(spark):
    """A meets B, B meets C, A doesn't meet C: B is refused, and so C is accepted."""
    rows = [
        (1, "f1", "a@x.io", "1", "Ann", "text one"), (2, "f2", "a@x.io", "2222222", "Bo", "text two"), (3, "f3", "c@x.io", "2222222", "Cy", "text three"),
        (4, "f1", None, None, None, None), (5, "f5", None, "", "Unknown Candidate", "TEXT -- one!"), (6, "f6", "Unknown Email", None, "Unknown Candidate", "x"), (7, "f7", "Unknown Email", None, "Unknown Candidate", "y"),
    ]
    table = spark.createDataFrame(rows, "id long, file_hash string, email string, phone string, name string, text string")
    table = table.selectExpr("*", "array() :: array<struct<job_title:string,company:string,years:double>> as experience", "array() :: array<struct<degree:string,institution:string>> as education")
    got = {r.id: (r.accepted, r.duplicate_of) for r in duplicates.block_duplicates(duplicates.duplicate_keys(table), table.select("id")).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (False, 1), 5: (False, 1), 6: (True, None), 7: (True, None)}


def test_same_name_needs_the_same_history(spark):
    work = lambda y: f"array(named_struct('job_title', 'Cook', 'company', 'Inn', 'years', cast({y} as double)))"
    base = "select cast({i} as long) id, 'f{i}' file_hash, 'Unknown' email, '' phone, 'Ann' name, 't{i}' text, {w} experience, array() :: array<struct<degree:string,institution:string>> education"
    table = spark.sql(" union all ".join(base.format(i=i, w=work(y)) for i, y in ((1, "2.0"), (2, "3.0"), (3, "2.001"))))
    got = {r.id: r.accepted for r in duplicates.block_duplicates(duplicates.duplicate_keys(table), table.select("id")).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_review_state(spark):
    base = spark.createDataFrame([(1, "Pending Review", None), (2, "Pending Review", None)], "id long, reviewer_status string, reviewer_notes string")
    base = base.selectExpr("*", "cast(null as long) reviewed_by", "cast(null as timestamp) reviewed_at", "'For Review' label")
    at = datetime(2026, 1, 1)
    reviews = [(1, "Reviewed", "ok", 5, at), (1, "Rejected", "x" * 3001, 6, datetime(2026, 2, 1)), (2, "Nonsense", "", 7, at), (1, "Rejected", "no", 4, at)]
    got = {r.id: r for r in review.apply_reviews(base, spark.createDataFrame(reviews, "id long, reviewer_status string, reviewer_notes string, reviewed_by long, reviewed_at timestamp")).collect()}
    assert (got[1].reviewer_status, got[1].reviewer_notes, got[1].label) == ("Reviewed", "ok", "For Review") and got[2].reviewer_status == "Pending Review"
    assert review.result_order("bogus")[0]._jc.toString() == review.result_order("fit_desc")[0]._jc.toString()
    seeded = review.insert_absent(base.select("id"), spark.createDataFrame([(2,), (3,)], "id long"), "id")
    assert sorted(r.id for r in seeded.collect()) == [1, 2, 3]


def test_set_counts(spark):
    row = spark.range(1).select(metrics.set_counts(F.array(*map(F.lit, ("A", "b", "b"))), F.array(*map(F.lit, ("a", "c")))).alias("x")).first().x
    assert tuple(row) == (1, 1, 1)


def docx(body, header=""):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {ns}>{header}</w:hdr>")
    return out.getvalue()


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def tbl(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def test_docx():
    box = "<w:p><w:r><w:t>Own</w:t></w:r><w:txbxContent><w:p><w:r><w:t>Boxed  text</w:t></w:r></w:p></w:txbxContent></w:p>"
    body = p("First") + tbl(("Company", "Position", "Place", "From", "To"), ("Acme", "Cook", "Cebu", "2019", "2020")) + box + tbl(("Level", "School Name", "Course"), ("Elementary", "Rizal School", "N/A"))
    assert documents.docx_text(docx(body, p("Jane"))).split("\n") == [
        "Jane", "First", "WORK EXPERIENCE", "Cook | Acme | Cebu | 2019 - 2020", "Own", "Boxed text", "EDUCATION", "Elementary Education", "Rizal School",
    ]
    assert documents.docx_text(docx(tbl(("a", "b"), ("c", "")))) == "a  b\nc"
    assert documents.docx_text(b"no zip") is None


def test_two_column_page():
    left = [{"text": f"l{i}", "x0": 20, "x1": 90, "top": 10 + i * 12} for i in range(15)]
    right = [{"text": f"r{i}", "x0": 300, "x1": 500, "top": 5 + i * 12} for i in range(25)]
    lines_of_page = documents.page_text(left + right, 600).split("\n")
    assert lines_of_page[:25] == [f"r{i}" for i in range(25)] and lines_of_page[25:] == [f"l{i}" for i in range(15)]
    assert documents.column_gutter(left, 600) is None
    words = [{"text": "a", "x0": 0, "x1": 10, "top": 1}, {"text": "b", "x0": 30, "x1": 40, "top": 2}, {"text": "c", "x0": 43, "x1": 50, "top": 3}, {"text": "d", "x0": 0, "x1": 5, "top": 20}]
    assert documents.words_to_lines(words) == ["a  b c", "d"]


def test_paths(spark):
    assert documents.inside("/up/a/b.pdf", "/up") and not documents.inside("/up/../etc/x", "/up") and not documents.inside("/up", "/up") and not documents.inside("/upper/x", "/up")
    name = spark.range(1).select(documents.safe_name(F.lit("../My résumé (1).PDF"))).first()[0]
    assert name.startswith("My_r_sum_1_") or name.startswith("My_r_sum_")
    assert name.endswith(".pdf") and "/" not in name


def test_incremental_screening(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    text = lambda s: "".join(p(x) for x in s.splitlines() if x.strip())
    (incoming / "a.docx").write_bytes(docx(text(TEACHER)))
    (incoming / "b.docx").write_bytes(docx(text(ENGINEER)))
    (incoming / "broken.docx").write_bytes(b"nothing")
    (incoming / "note.txt").write_text("no upload")
    accepted, rejected = str(tmp_path / "accepted"), str(tmp_path / "rejected")

    def go():
        query = ingest.screen_stream(spark, str(incoming), accepted, rejected, str(tmp_path / "checkpoint"), AS_OF).trigger(availableNow=True).start()
        query.awaitTermination(120)

    go()
    assert {r.name for r in spark.read.parquet(accepted).collect()} == {"Jane A. Doe", "Rey de la Cruz"}
    (incoming / "copy.docx").write_bytes(docx(text(TEACHER), p("")))
    go()
    assert spark.read.parquet(accepted).count() == 2
    why = {r.path.rsplit("/", 1)[1]: r.reason for r in spark.read.parquet(rejected).collect()}
    assert set(why) == {"broken.docx", "copy.docx"} and why["copy.docx"].startswith("duplicate of")
    # The same batch again changes nothing.
    files = documents.read_files(spark, str(incoming)).where("path like '%copy.docx'")
    ingest.screen_batch(files, accepted, rejected, AS_OF, 1)
    assert spark.read.parquet(accepted).count() == 2


def test_uploads_per_week(spark):
    rows = spark.createDataFrame([(datetime(2026, 1, 1),), (datetime(2026, 1, 2),), (datetime(2026, 1, 20),)], "uploaded_at timestamp")
    assert sorted(r.uploads for r in ingest.uploads_per_week(rows).collect()) == [1, 2]


def test_candidate_evidence(spark):
    found = facts.resume_facts(resumes(spark, TEACHER), AS_OF)
    lists = {"matched_critical": ["Lesson Planning"], "matched": ["lesson planning", "Classroom Management"], "matched_preferred": ["Chess"], "missing_critical": [], "missing": ["SQL"]}
    rows = found.withColumns({k: F.array(*[F.lit(x) for x in v]).cast("array<string>") for k, v in lists.items()})
    rows = rows.withColumn("experience_req", F.lit(3)).withColumn("education_req", F.lit("Master of Arts"))
    got = lines.candidate_evidence(rows, rows.select("resume_id", "text")).first()
    assert [(s.name, s.kind, s.section) for s in got.skills] == [("Lesson Planning", "Critical", "Skills"), ("Classroom Management", "Required", "Skills"), ("Chess", "Preferred", "Resume")]
    assert (got.skill_total, got.experience_total, got.education_total, got.experience_met, got.education_met) == (3, 2, 1, True, False)
    assert [tuple(m) for m in got.missing] == [("SQL", "Required")] and got.education[0].excerpt.startswith("State University")
    assert [r.record.company for r in got.experience] == ["Greenfield High School", "Northside College"]


def test_entities_move_only_lines_that_begin_a_term_or_a_section(spark):
    """Every term is still found; other lines are dropped before they are moved and ordered."""
    terms = [w for name, more in lexicon.EDUCATION_SKILLS.items() for w in (name, *more)]
    terms += ["Teacher", "dean", "pre-k", "PRE K", "prek", "Grades 1 to 12", "Junior High", "Edukasyon sa Pagpapakatao", "TLE", "Let Passer", "Guidance Counselor"]
    texts = [(n, f"no word of it\n  SKILLS:\nplain words ({w}) here\nmore of them") for n, w in enumerate(terms)]
    table = lines.line_table(spark.createDataFrame(texts, "resume_id int, text string"))
    got = lines.entities(table)
    assert {r.resume_id for r in got.collect()} == set(range(len(terms))) and {r.section for r in got.collect()} == {"skills"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert lines._LIKE_SKILL in plan[plan.rindex("Window ") :]


def test_texts_go_to_python_in_bounded_batches(spark):
    """Operators that hand whole texts to Python lower the rows of a batch, so a worker holds no more at a larger table."""
    key, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.createDataFrame([(1, 1, "sql")], "resume_id int, job_id int, text string")
    jobs = spark.createDataFrame([(1, ["sql"], "sql")], "job_id int, skills array<string>, text string")
    before = spark.conf.get(key)
    for make in (
        lambda: matching.claimed_skills(docs, ["sql"]), lambda: matching.analyze_skills(docs, jobs), lambda: facts.resume_facts(docs, "2026-06-23"),
        lambda: text_similarity(docs.select("resume_id", "job_id"), docs, jobs, "resume_id", "job_id"),
    ):
        spark.conf.set(key, "10000")
        make()
        assert int(spark.conf.get(key)) == 1024
    spark.conf.set(key, before)
