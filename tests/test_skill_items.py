"""Skill inventories of short resumes whose items are stated beside them."""

import pytest
from pyspark.sql import functions as F

from dossiergrid import hot_keys
from dossiergrid.operators import facts, skill_items
from dossiergrid.operators.lines import line_table

CASES = [
    ("TRAININGS, SKILLS & AWARDS\n▪ Skills: Book Keeping; Filing; Care of\nArchives; Cash-Handling\n▪ Awards: Best Clerk", ["Book Keeping", "Filing", "Care of Archives", "Cash-Handling"]),
    ("Skills\nTime Management\nTime-Management Skills\nEducation\nBachelor of Arts", ["Time Management"]),
    ("Technical Skills\nScala, Spark, Hive, Git\nWork Experience\nWrote Kotlin", ["Scala", "Spark", "Hive", "Git"]),
    ("Skills: TS, TypeScript, MS Word", ["TS", "TypeScript", "MS Word"]),
    ("Core Competencies\nAbility to plan, rank, and finish many tasks\nSpoken and written reports\nEducation", ["Ability to plan, rank, and finish many tasks", "Spoken and written reports"]),
    ("Skills\nDesigns lively lessons Communicates well with parents\nEducation", ["Designs lively lessons", "Communicates well with parents"]),
    ("Technical Skills\nCloud Technologies  Object Stores (S3, Blob (cool, hot), GCS), Queues\nFrontend  Svelte, HTML\nIDE s: Emacs, Vim\nEducation", ["Object Stores (S3, Blob (cool, hot), GCS)", "Queues", "Svelte", "HTML", "Emacs", "Vim"]),
    ("Technical Skills: Rust, SQL\nEDUCATION: Bachelor of Science", ["Rust", "SQL"]),
    ("Technical Skills\nTest Driven Development (TDD) - JUnit, Mockito\nEducation", ["Test Driven Development (TDD)", "JUnit", "Mockito"]),
    ("Technical Skills\nPerl    Podman\nOperating Systems  Debian 12, Windows 2000/NT\nEducation", ["Perl", "Podman", "Debian 12", "Windows 2000/NT"]),
    ("Skills & Qualities\n  Prepare Exams\nChecks: Robot - Web\nSkilful in Mediation, Planning and Review\nEducation", ["Prepare Exams", "Checks", "Robot - Web", "Skilful in Mediation, Planning and Review"]),
    ("Technical Skills\nRuby Framework: Rails, Hanami\nDesign Methodologies: UML, BPMN\nProject Management tools  Jira, Asana, and Trello\nEducation", ["Ruby Framework", "Rails", "Hanami", "UML", "BPMN", "Jira", "Asana", "Trello"]),
    (
        "SKILLS & QUALITIES\n Verbal and Written\nReports\n Leadership\nClass Planning\n Integrating Tablets in\nMaths and\nPhysics\n Care\nEducation",
        ["Verbal and Written Reports", "Leadership", "Class Planning", "Integrating Tablets in Maths and Physics", "Care"],
    ),
    ("SKILLS\n● Able  in Word, Excel, and Power\npoint\n● Strong  will  and patience\nPERSONAL INFORMATION\nBorn", ["Able in Word, Excel, and Power point", "Strong will and patience"]),
    ("SKILLS:\n(cid:0)\nGood talks and Notes\n(cid:0)\nVideo, photo, sound editing skills\nWORK EXPERIENCE:\nClerk", ["Good talks and Notes", "Video, photo, sound editing skills"]),
    ("SKILLS\nOffice Suites (Writer and\nCalc)\nQuick Typing\nOTHER EDUCATIONAL ACHIEVEMENTS AND EXPERIENCES\nBoard Passer", ["Office Suites (Writer and Calc)", "Quick Typing"]),
    ("SKILLS\nTeamwork\nVerbal & Written\nreports\nCONTACT\nhttps://site.example", ["Teamwork", "Verbal & Written reports"]),
    ("TECHNICAL SKILLS\nFrameworks & Libraries: Qt (Desktop & Web), Boost,\nEigen-Core\nCore Concepts: Graphs (DAGs, trees), Load\nTests\nCERTIFICATIONS\nOther", ["Qt (Desktop & Web)", "Boost", "Eigen-Core", "Graphs (DAGs, trees)", "Load Tests"]),
    ("Summary\nNo work with Go.\nSkills: Without Helm", None),
    ("Education\nPython Institute", None),
    ("Skills\nnone@mail.org, www.a.b, 2020, for others\n" + "word " * 51 + "\nDance", ["Dance"]),
    ("Skills\nGo (open, and, never closed, Perl", ["Go (open, and, never closed, Perl"]),
    ("Skills\nA1 | B2 • C3; D4\tE5", ["A1", "B2", "C3", "D4", "E5"]),
    ("", None),
    (None, None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame(list(enumerate(t for t, _ in CASES)), "resume_id long, text string")
    return {r.resume_id: r.skills for r in skill_items.listed_skills(rows).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_inventory(found, case):
    assert found.get(case) == CASES[case][1]


def test_very_long_lines_and_many_of_them(spark):
    """One line of 20,000 items, brackets among them, and 5,000 lines: all there, once each."""
    long = ", ".join(f"s{i} (a, b{i})" for i in range(20_000))
    many = "\n".join(f"- item {i}" for i in range(5_000))
    rows = spark.createDataFrame([(1, f"Skills\n{long}"), (2, f"Skills\n{many}\nEducation\nno item")], "resume_id long, text string")
    got = {r.resume_id: r.skills for r in skill_items.listed_skills(rows).collect()}
    assert got[1] == [f"s{i} (a, b{i})" for i in range(20_000)]
    assert got[2] == [f"item {i}" for i in range(5_000)]


def test_clashing_columns_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "Skills\nDance")], "resume_id long, text string")
    lines = line_table(rows).withColumns({c: F.lit("x") for c in ("kind", "t", "anchor", "inside", "named", "__key")})
    assert [tuple(r) for r in skill_items.skill_inventory(lines).collect()] == [(1, ["Dance"])]
    assert skill_items.skill_inventory(lines.where("false")).collect() == []


@pytest.mark.parametrize("least", [1, 1000])
def test_every_row_of_repeated_texts_has_its_list(spark, monkeypatch, least):
    """Copies of one text, as a hot key and as a plain one; texts without a list, empty and null ones stay."""
    monkeypatch.setattr(hot_keys, "LEAST", least)
    texts = ["Skills\nDance"] * 40 + ["Skills\nSong"] + ["skilled in nothing"] * 5 + ["plain", "", None]
    rows = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "resume_id long, text string")
    got = sorted((r.resume_id, str(r.text), r.listed) for r in facts.with_listed_skills(rows).collect())
    lists = {"Skills\nDance": ["Dance"], "Skills\nSong": ["Song"]}
    assert got == sorted((i % 7, str(t), lists.get(t)) for i, t in enumerate(texts))
    assert [r.listed for r in facts.with_listed_skills(rows.where("text = 'plain'")).collect()] == [None]
