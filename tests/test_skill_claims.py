"""Skills named on the line table, against the plain search and on stated cases."""

import random

from pyspark.sql import functions as F

from dossiergrid.functions import claims
from dossiergrid.operators import skill_claims
from dossiergrid.operators.lines import line_table

TEXTS = [
    "Wrote Django services.\nNo experience with SQL",
    "Built on PostgreSQL and   Node.js; not C#",
    "Technologies I am currently learning\nRust, SQL\nEXPERIENCE\nUsed Git",
    "Unfamiliar  with\tkubernetes: docker daily",
    "Not only " + "x" * 70 + " sql",
    "Javascript\nsqlite", "", None, "c# and c++, .net (asp.net)", "no sql, yes: sql", "Éclair and naïve Bayes", "SQL " * 5000,
]
SKILLS = ["SQL", " Django ", "Node.js", "C#", "c sharp", "Rust", "Git", "kubernetes", "Docker", "java", "C++", ".NET", "naïve bayes", "classroom  management", "Version Control", "containerization", "", None, "SQL"]


def frames(spark, texts, skills):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "resume_id long, text string")
    wanted = spark.createDataFrame([(i, skills) for i in range(len(texts))], "resume_id long, skills array<string>")
    return line_table(rows), wanted


def plain(text, skill):
    low = [x.lower() for x in claims.claimed_lines(text or "")]
    return claims.named(low, "\n".join(low), skill)


def test_names_like_the_plain_search(spark):
    rng = random.Random(5)
    words = ["no", "not", "sql", "c#", "node.js", "eager to", "learning", ".", ";", "rust", "git", "with", "xsql", "java", "javascript", "without", "interested in", "a", "currently", "docker"]
    texts = TEXTS + ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(3)) for _ in range(80)]
    got = {(r.resume_id, r.skill): r.named for r in skill_claims.skill_claims(*frames(spark, texts, SKILLS)).collect()}
    asked = {s.strip() for s in SKILLS if s and s.strip()}
    assert got == {(i, s): plain(t, s) for i, t in enumerate(texts) for s in asked}
    assert any(got.values()) and not all(got.values())


def test_what_entails_a_skill(spark):
    lines, wanted = frames(spark, TEXTS, SKILLS)
    by = {(r.resume_id, r.skill): r.implied_by for r in skill_claims.skill_claims(lines, wanted).collect() if r.implied_by}
    assert by == {(2, "Version Control"): "git", (3, "containerization"): "docker"}
    assert all(r.implied_by is None for r in skill_claims.skill_claims(lines, wanted, implied=False).collect())


def test_sides_keep_order_and_repeats(spark):
    lines, wanted = frames(spark, ["Wrote Django services. No git", "uses  Podman, kubernetes", None], ["Git", "containerization", "Django", "containerization", " ", None])
    sides = {r.resume_id: (r.matched, r.missing, r.implied) for r in skill_claims.skill_sides(skill_claims.skill_claims(lines, wanted), wanted).collect()}
    assert sides[0] == (["Django"], ["Git", "containerization", "containerization"], {})
    assert sides[1] == (["containerization", "containerization"], ["Git", "Django"], {"containerization": "kubernetes"})
    assert sides[2] == ([], ["Git", "containerization", "Django", "containerization"], {})


def test_empty_and_clashing(spark):
    lines, wanted = frames(spark, ["uses git", "uses git"], ["git"])
    lines = lines.withColumns({c: F.lit(1) for c in ("flat", "asked", "hit", "skill", "__key", "__claimed")})
    assert sorted(tuple(r) for r in skill_claims.skill_claims(lines, wanted).collect()) == [(0, "git", True, None), (1, "git", True, None)]
    assert skill_claims.skill_claims(lines, wanted.where("false")).collect() == []
    assert [r.named for r in skill_claims.skill_claims(lines.where("false"), wanted).collect()] == [False, False]
