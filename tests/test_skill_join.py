"""Skills joined with line windows, against every skill tried on every line."""

import random

import pytest
from pyspark.sql import functions as F

from dossiergrid.functions.similarity import phrase_like, token_set_ratio
from dossiergrid.operators import skill_join as op

WORDS = "java script data science database of and project management c++ react.js nurse nursing ward communication skills lab x é".split()


def typo(rng, text):
    """Some letters dropped, put in or swapped."""
    out = list(text)
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(out) or 1)
        out[at : at + rng.randrange(2)] = rng.choice(["", "e", "s", " "])
    return "".join(out)


def case(seed, n_skills, n_lines):
    rng = random.Random(seed)
    skills = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 5))) for _ in range(n_skills)]
    lines = []
    for _ in range(n_lines):
        parts = [typo(rng, rng.choice(skills)) if rng.random() < 0.5 else rng.choice(WORDS) for _ in range(rng.randrange(6))]
        lines.append(" ".join(parts))
    return skills, lines


def test_all_pairs_of_the_exhaustive_test(spark):
    """Every pair that trying all skills on all lines finds, with the same ratio, and no other."""
    skills, lines = case(5, 80, 250)
    lines += [None, "", "   ", "a", "data data", "Data\u00a0Science", "management project", "java " * 300]
    skills += [None, "", "c", "sql", "a b", "Data  Science ", "data data"]
    got = op.similar_skills(spark.createDataFrame(list(enumerate(lines)), "id_ long, line string"), spark.createDataFrame([(s,) for s in skills], "skill string")).collect()
    names = {" ".join(s.lower().split()) for s in skills if s}
    want = {(i, s) for i, line in enumerate(lines) for s in names if line and phrase_like(line.lower(), s)}
    assert len(got) == len({(r.id_, r.skill) for r in got})
    assert {(r.id_, r.skill) for r in got} == want and len(want) > 1000
    for r in got:
        words, n = lines[r.id_].lower().split(), len(r.skill.split())
        runs = [" ".join(words[i : i + k]) for k in range(n, n + 3) for i in range(len(words) - k + 1)]
        assert r.ratio == pytest.approx(max(token_set_ratio(r.skill, x) for x in runs))


def test_candidates_lose_nothing_and_are_few(spark):
    """Of all products of runs and skills, those that are compared: all that reach the ratio, and a small part of the rest."""
    skills, lines = case(6, 120, 200)
    sets = [(0, x) for x in {tuple(sorted(set(line.split()))) for line in lines if line.strip()}] + [(1, x) for x in {tuple(sorted(set(s.split()))) for s in skills}]
    rows = [(i, side, list(x), len(" ".join(x))) for i, (side, x) in enumerate(sets)]
    got = {(r.run, r.skill_id) for r in op.candidates(spark.createDataFrame(rows, "id long, side int, words array<string>, letters int")).collect()}
    every = [(a, b) for a in rows for b in rows if a[1] == 0 and b[1] == 1]
    like = {(a[0], b[0]) for a, b in every if token_set_ratio(" ".join(a[2]), " ".join(b[2])) >= op.THRESHOLD}
    assert like <= got and len(got) < len(like) + 0.05 * len(every)


def test_hot_runs_and_lost_threshold(spark):
    """A line that most rows hold, empty tables, no skill that can be compared, and names that clash."""
    rows = spark.range(30_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, "uses data scence daily").otherwise("none").alias("line"))
    skills = spark.createDataFrame([("data science",)], "skill string")
    assert op.similar_skills(rows, skills).groupBy("skill").count().collect()[0]["count"] == 20_000
    assert op.similar_skills(rows.limit(0), skills).count() == 0
    assert op.similar_skills(rows, skills.limit(0)).count() == 0
    assert op.similar_skills(rows, spark.createDataFrame([("go",)], "skill string")).columns == ["k", "skill", "ratio"]
    with pytest.raises(ValueError, match="clash"):
        op.similar_skills(rows.withColumnRenamed("k", "run"), skills)
    with pytest.raises(ValueError, match="above 80"):
        op.similar_skills(rows, skills, threshold=70)


def test_equal_lines_are_cut_into_runs_once(spark, monkeypatch):
    """Each row's line was cut into runs of its own before; rows that have one key and different lines still count together."""
    written = {}
    real = op.materialize
    monkeypatch.setattr(op, "materialize", lambda df, name: written.setdefault(name, real(df, name)))
    rows = [(i // 2, ["uses data scence daily", "database work", "makes nothing", None][i % 4]) for i in range(4000)]
    skills = spark.createDataFrame([("data science",), ("database",)], "skill string")
    got = op.similar_skills(spark.createDataFrame(rows, "k long, line string"), skills).groupBy("skill").count().collect()
    assert {r["skill"]: r["count"] for r in got} == {"data science": 1000, "database": 1000}
    assert written["skill-runs"].count() < 40
