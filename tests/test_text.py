"""Expressions on single values, against plain Python and known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dossiergrid.functions import similarity
from dossiergrid.functions import text as t


@pytest.fixture(scope="module")
def value(spark):
    """Evaluate an expression over columns given as keyword arguments."""

    def run(expression, **cols):
        names = list(cols)
        return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} {'string' if not isinstance(cols[n], (int, float)) else 'double'}" for n in names)).select(expression).first()[0]

    return run


def test_rounding_is_half_even_on_the_binary_value(spark):
    rng = random.Random(1)
    values = [2.675, 1.005, 0.125, 0.375, 2.5, *(rng.randrange(10**6) / 10**rng.randrange(1, 5) for _ in range(2000)), *(k / 12 for k in range(600))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", t.half_even(F.col("v"), 2).alias("two"), t.half_even(F.col("v"), 1).alias("one")).collect()
    wrong = [r.v for r in rows if r.two != round(r.v, 2) or r.one != round(r.v, 1)]
    assert len(wrong) <= 0.02 * len(rows), wrong[:10]
    assert not [v for v in wrong if v in [k / 12 for k in range(600)]]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("Develop-\nment of  things", "Development of  things"),
        ("W O R K  E X P E R I E N C E\nTeacher", "WORK EXPERIENCE\nTeacher"),
        ("Same line\nSame  line!\n\nSame line", "Same line\n\nSame line"),
        ("20 1\n201 9 - 202 1", "20 1\n2019 - 2021"),
        ("a\n\n\n\n\nb", "a\n\nb"),
        ("soft­hyphen and​ zero, ’quotes’ – dash", "softhyphen and zero, 'quotes' - dash"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_text(value, raw, clean):
    assert value(t.clean_text(F.col("x")), x=raw) == clean
    if clean:
        assert value(t.clean_text(F.col("x")), x=clean) == clean


@pytest.mark.parametrize(
    ("line", "sections"),
    [
        ("WORK EXPERIENCE:", ["experience"]),
        ("Education & Certifications", ["education", "certifications"]),
        ("B. Technical Skills", ["skills"]),
        ("Compétences techniques", ["skills"]),
        ("Activities/Game", []),
        ("• References", ["references"]),
        ("Taught mathematics", []),
        ("", []),
        (None, []),
    ],
)
def test_headings(value, line, sections):
    from dossiergrid.operators.facts import headings

    assert value(t.section_of_heading(F.col("x")), x=line) == sections
    assert headings(line or "") == sections


@pytest.mark.parametrize(
    ("degree", "rank", "field"),
    [
        ("Ph.D. in Education", 5, "education"),
        ("Master of Arts in Teaching (36 units)", 3, "education"),
        ("MBA", 4, "business"),
        ("Bachelor of Science in Computer Science", 3, "computing"),
        ("BSIT", 3, "computing"),
        ("Associate in Electronics", 2, "engineering"),
        ("High School Diploma", 1, None),
        ("Diploma", 1, None),
        ("programs and phases", 0, None),
        (None, 0, None),
    ],
)
def test_degrees(value, degree, rank, field):
    assert value(t.degree_rank(F.col("x")), x=degree) == rank
    assert value(t.degree_field(F.col("x")), x=degree) == field


def test_field_relevance(value):
    say = lambda a, b: value(t.field_relevance(F.col("a"), F.col("b")), a=a, b=b)
    assert [say("BS Computer Science", "Information Technology"), say("BA Music", "Computer Science"), say("BS", "Computer Science"), say("BA Music", "Any")] == [1.0, 0.5, 0.85, 1.0]


@pytest.mark.parametrize(
    ("text", "months"),
    [
        ("2019 - 2023\n2017 - 2019", 72),
        ("Jan 2018 - Jan 2023", 60),
        ("Jan 2020 - Jun 2020 and Mar 2020 to Dec 2020", 11),
        ("June 2025 - Present", 12),
        ("2020 - 2020", 1),
        ("2023 - 2019, 1900 - 2020", 0),
        ("nothing", 0),
    ],
)
def test_months_covered(value, text, months):
    assert value(t.months_covered(t.date_ranges(F.col("x"), "2026-06-23")), x=text) == months


@pytest.mark.parametrize(
    ("text", "years"),
    [("over 7+ years of experience", 7), ("experience of 3 years; 12 years of relevant experience", 12), ("a 5-year work experience", 5), ("99 years of experience", None), ("12 years old", None)],
)
def test_stated_years(value, text, years):
    assert value(t.stated_years(F.col("x")), x=text) == years


def test_quality_prefers_readable_text(spark):
    good = "Profile\nJane Doe jane@x.org\nEducation\nBS Biology 2012\nExperience\nTeacher at School 2013 - 2019"
    bad = "ProfileJaneDoe WORKEXPERIENCE  , . ;"
    pair = F.array(F.struct(F.lit("a").alias("method"), F.lit(bad).alias("text")), F.struct(F.lit("b").alias("method"), F.lit(good).alias("text")))
    row = spark.range(1).select(t.best_text(pair)["method"], t.text_quality(F.lit("")), t.text_quality(F.lit("!!! 123")), t.text_quality(F.lit(good))).first()
    assert row[0] == "b" and row[1] == row[2] == -math.inf and row[3] > 20


def test_small_helpers(value):
    assert value(t.csv_list(F.col("x")), x=" a, ,b,, c d ") == ["a", "b", "c d"]
    assert value(t.csv_list(F.col("x")), x=None) == [] == value(t.json_list(F.col("x")), x="")
    assert value(t.json_list(F.col("x")), x='["a", "b"]') == ["a", "b"]
    assert value(t.email_of(F.col("x")), x="mail: A.B@Ex-ample.Org, or c@d.ee") == "a.b@ex-ample.org"
    assert value(t.phone_of(F.col("x")), x="call 0917 123 4567 now") == "0917 123 4567"
    assert value(t.identity_signature(F.col("x")), x=" Unknown Email") == ""
    assert value(t.term_found(F.col("x"), F.lit("R")), x="recruiter") is False
    assert value(t.term_found(F.col("x"), F.lit("c++")), x="uses C++ daily") is True
    assert value(t.split_lines(F.col("x")), x="a\r\nb\x0bc\n") == ["a", "b", "c"]


def test_indel_and_stems():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 30))) for _ in range(2))
        assert similarity.indel_ratio(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))
    assert similarity.token_set_ratio("lesson planning", "planning of lesson") == 100
    known = {"caresses": "caress", "ponies": "poni", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "relational": "relat", "planning": "plan",
             "managing": "manag", "management": "manag", "happy": "happi", "electricity": "electr", "sky": "sky", "engaging": "engag", "lessons": "lesson"}
    assert {w: similarity.stem(w) for w in known} == known
    assert similarity.all_stems_near("managing the classroom", "classroom management")
    assert not similarity.phrase_like("go", "go") and similarity.phrase_like("comunication skill", "communication skills")


def test_all_wordings_of_headings_are_found(spark):
    """Lines that don't begin like a heading are told by one match; every wording of every heading has to pass it, with its numbering and signs."""
    names = list(t.lx.SECTION_HEADINGS)
    rows = [(f"{before}{w.upper()}{behind}", next(n for n in names if w in t._HEADINGS[n])) for n in names for w in t._HEADINGS[n] for before, behind in (("", ""), (" • b) ", " :"), ("and ", ": x")) if "and" not in w]
    found = spark.createDataFrame(rows, "line string, section string").select("line", "section", t.section_of_heading(t.F.col("line")).alias("found")).collect()
    assert len(rows) > 300 and all(r.found == [r.section] for r in found), [r for r in found if r.found != [r.section]]


def test_judged_is_quality_and_best_text(spark):
    """Both from one cleaning: the plan has it once for the text and once for its cleaned form."""
    good = "EXPERIENCE\nTeacher at Some School 2019\nTeacher at Some School 2019\nmail a.b@c.org"
    texts = [None, "", " \n ", "!!! 123", good, "S K I L L S\nS K I L L S\nwords here  �", "con-\ntinued 201 9\nÉtude é\nétude É", "\n- x\n\n\n\n- y ", "E D U-C A T I O N\nx"]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(texts)], "n int, x string")
    pair = F.array(F.struct(F.lit("raw").alias("method"), F.col("x").alias("text")), F.struct(F.lit("clean").alias("method"), t.clean_text(F.col("x")).alias("text")))
    want = rows.select("n", t.text_quality(F.col("x")).alias("quality"), t.best_text(pair)["method"].alias("method")).collect()
    got = rows.select("n", t.judged(F.col("x")).alias("j")).select("n", "j.quality", "j.method")
    assert sorted(got.collect()) == sorted(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 2
