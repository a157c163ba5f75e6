"""The evaluation looks at a text once: for all its skills, and never again behind the table that it writes."""

import re

import pytest

from dossiergrid.functions import claims
from dossiergrid.functions import lexicon as lx
from dossiergrid.operators import records, similarity
from dossiergrid.operators.facts import headings
from dossiergrid.plans import catalog

PROSE = "Wrote lesson plans for the class.\nManaged classrooms with python scripts"
TEXTS = [PROSE, f"Skills:\nsql\nWORK EXPERIENCE\n{PROSE}\nEDUCATION\nrest api", "", "No python.\nWORK EXPERIENCE\nTeacher at a school", "flask service\nagile teams"]
NEEDED = [["classroom management", "python"], ["sql", "python"], ["sql"], ["python"], ["rest api", "python"]]
PREFERRED = [["agile"], ["rest api"], [], ["sql"], ["agile", "python"]]
TITLES = ["Teacher", "Engineer", "", "Teacher", "Clerk"]


def test_skills_of_both_kinds_are_told_from_one_numbering(monkeypatch):
    have, by = claims.with_implied([claims.claimed_lines(t) for t in TEXTS], NEEDED)
    liked = claims.claimed([claims.claimed_lines(t) for t in TEXTS], PREFERRED)
    related = claims.related_work(TEXTS, [[*a, *b] for a, b in zip(NEEDED, PREFERRED, strict=True)], TITLES)
    assert claims.screened(TEXTS, NEEDED, PREFERRED, TITLES) == (have, by, liked, related)
    assert {True, False} == set(related) and any(have) and any(liked)
    made = []
    plain = claims._Batch.__init__
    monkeypatch.setattr(claims._Batch, "__init__", lambda self, texts: made.append(plain(self, texts)))
    claims.screened([PROSE] * 3, [["database design"]] * 3, [["team leadership"]] * 3, ["Engineer"] * 3)
    assert len(made) == 1


def test_texts_are_not_read_again_behind_the_table(spark):
    plan = catalog.queries()["screening_results"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert not re.search(r"ReadSchema: \S*\btext:string", plan)


@pytest.mark.parametrize("line", ["A. Education", "• WORK EXPERIENCE & TRAINING", "Proﬁle", "and Skills:", "Compétences", "EXPÉRIENCE professionnelle", "Work, Experience", "The skills of the team"])
def test_headings_are_those_of_the_patterns(line, monkeypatch):
    quick = headings(line)
    monkeypatch.setattr("dossiergrid.operators.facts._LIKE_HEADING", re.compile(""))
    assert quick == headings(line)


@pytest.mark.parametrize("text", ["MA in Arts", "m.s in physics", "Bs in Nursing", "B.S.C Computer", "Ph.D", "Senıor High", "BSIT", "Master's", "Associate of Arts", "college graduate", "M.S.C in", "b.a in"])
def test_every_degree_is_told_by_its_words(text):
    low = records.plain_letters(text)
    assert records.DEGREE.search(text)
    assert any(w in low for w in records._DEGREE_WORDS) or records._SHORT_DEGREE.search(low)


def test_cosine_is_the_plain_formula():
    a, b = "the cat and the cat sat on the mat", "the cat sat and sat"
    (x, all_x), (y, all_y) = similarity.term_weights(a), similarity.term_weights(b)
    shared = x.keys() & y.keys()
    norm = [similarity.C2 * (s - sum(w[t] ** 2 for t in shared)) + sum(w[t] ** 2 for t in shared) for w, s in ((x, all_x), (y, all_y))]
    assert similarity.cosine(a, b) == pytest.approx(100 * sum(x[t] * y[t] for t in shared) / (norm[0] * norm[1]) ** 0.5)
    assert similarity.cosine(a, "dog") == similarity.cosine("", b) == 0.0


def test_ranks_of_degrees_begin_at_words():
    assert all(part.startswith(r"\b") for _, pattern in lx.DEGREE_RANKS for part in re.split(r"\|(?![^(]*\))", pattern))
