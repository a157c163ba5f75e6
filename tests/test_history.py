"""Ranking against all jobs, and the line-table operators, against plain versions."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dossiergrid import hot_keys
from dossiergrid.functions import claims
from dossiergrid.operators import corpus_terms, history, lines, ranking


def terms(text):
    w = re.findall(r"\b\w\w+\b", (text or "").lower())
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])


def vector(text, df, n):
    return {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df.get(t, 0))) + 1) for t, c in terms(text).items()}


def cosine(a, b):
    dot = sum(w * b[t] for t, w in a.items() if t in b)
    return dot / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values())) * 100 if dot else 0.0


def some_texts(seed, n, length=30):
    rng = random.Random(seed)
    return [" ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(2, length))) for _ in range(n)]


RESUMES = [*enumerate(some_texts(1, 60)), (100, None), (101, ""), (102, "!"), (103, "only here"), (104, "w1 " * 4000)]
JOBS = [(i + 500, t) for i, t in enumerate(some_texts(2, 25, 12))] + [(600, None), (601, "")] + [(700 + i, "w5 w6 w7") for i in range(3)]


def frames(spark):
    return spark.createDataFrame(RESUMES, "resume_id long, text string"), spark.createDataFrame(JOBS, "job_id long, text string")


@pytest.mark.parametrize("k", [1, 4, 100])
@pytest.mark.parametrize("piece", [None, 5])
def test_best_jobs_are_those_of_the_full_product(spark, monkeypatch, k, piece):
    """With small pieces, terms are dealt; with many jobs asked for, nothing can be ruled out."""
    if piece:
        monkeypatch.setattr(hot_keys.join_dealt, "__defaults__", (piece,))
        monkeypatch.setattr(hot_keys, "LEAST", piece)
    texts = [t for _, t in RESUMES + JOBS if t]
    df = Counter(t for x in texts for t in terms(x))
    want = {}
    for i, a in RESUMES:
        scored = [(-round(cosine(vector(a, df, len(texts)), vector(b, df, len(texts))), 6), j) for j, b in JOBS]
        want |= {(i, p + 1): (j, -s) for p, (s, j) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])}
    resumes, jobs = frames(spark)
    got = {(r.resume_id, r.place): (r.job_id, r.similarity) for r in ranking.rank_jobs(resumes, jobs, k).collect()}
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=2e-6) for x in want)


def test_bounds_rule_jobs_out(spark, monkeypatch):
    """Texts on a subject of their own with words that all share: hardly a job of another subject is completed."""
    written = {}
    real = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, name: written.setdefault(name, real(df, name)))
    rng = random.Random(6)
    said = lambda subject: " ".join(rng.sample([f"s{subject}x{k}" for k in range(12)], 9) + [f"common{rng.randrange(6)}" for _ in range(5)])
    resumes = spark.createDataFrame([(i, said(i % 20)) for i in range(80)], "resume_id long, text string")
    jobs = spark.createDataFrame([(j, said(j % 20)) for j in range(40)], "job_id long, text string")
    best = ranking.rank_jobs(resumes, jobs, 2).collect()
    assert len(best) == 160 and all(r.resume_id % 20 == r.job_id % 20 for r in best)
    assert written["ranking-found"].count() < 80 * 40 / 8


@pytest.mark.parametrize("run", ["rank", "pairs"])
def test_terms_of_texts_are_never_rows(spark, monkeypatch, run):
    """Every term of every text was a row of several tables before; small chunks, buckets and index blocks give the same result."""
    written = {}
    for module in (ranking, corpus_terms):
        monkeypatch.setattr(module, "materialize", lambda df, name, real=module.materialize: written.setdefault(name, real(df, name)))
    resumes, jobs = frames(spark)
    pairs = resumes.select("resume_id").crossJoin(jobs.select("job_id"))
    result = lambda: sorted(map(tuple, (ranking.rank_jobs(resumes, jobs, 3) if run == "rank" else ranking.corpus_similarity(pairs, resumes, jobs, "resume_id", "job_id")).collect()))
    whole = result()
    texts = [t for _, t in RESUMES + JOBS if t]
    assert written["corpus-terms"].count() < sum(len(terms(t)) for t in texts) / 10
    written.clear()
    monkeypatch.setattr(corpus_terms, "CHUNK", 40)
    monkeypatch.setattr(corpus_terms, "BUCKET", 300)
    monkeypatch.setattr(ranking, "BLOCK", 100)
    cut = result()
    assert [r[:3] for r in cut] == [r[:3] for r in whole] if run == "rank" else [r[:2] for r in cut] == [r[:2] for r in whole]
    assert [r[-1] for r in cut] == pytest.approx([r[-1] for r in whole], abs=0.0101 if run == "pairs" else 2e-6)
    made = written["corpus-terms"]
    assert made.where("bucket < 0").count() > 20 and made.where("bucket >= 0").select("bucket").distinct().count() > 10


def test_bounds_complete_few_jobs(spark, monkeypatch):
    """How many jobs get a whole score, not only how many of the best are listed."""
    written = {}
    real = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, name: written.setdefault(name, real(df, name)))
    said = lambda k: " ".join(f"s{k % 20}x{i}" for i in range(12)) + " common0 common1"
    rows = lambda n: [(i, said(i)) for i in range(n)]
    ranking.rank_jobs(spark.createDataFrame(rows(80), "resume_id long, text string"), spark.createDataFrame(rows(40), "job_id long, text string"), 2).collect()
    assert written["ranking-found"].selectExpr("max(completed)").first()[0] <= 4


def test_corpus_similarity(spark):
    """Weights are fitted over both texts of the pair and all other resumes."""
    resumes, jobs = frames(spark)
    pairs = [(i, JOBS[(i * 7) % len(JOBS)][0]) for i, _ in RESUMES] + [(3, 503), (3, 504)]
    left, right = dict(RESUMES), dict(JOBS)
    n = sum(bool(t) for t in left.values()) + 1
    base = Counter(t for x in left.values() for t in terms(x))
    want = []
    for i, j in pairs:
        df = base + Counter(dict.fromkeys(terms(right[j]), 1))
        want.append((i, j, round(cosine(vector(left[i], df, n), vector(right[j], df, n)), 2)))
    got = ranking.corpus_similarity(spark.createDataFrame(pairs, "resume_id long, job_id long"), resumes, jobs, "resume_id", "job_id").collect()
    got, want = sorted(map(tuple, got)), sorted(want)
    assert [r[:2] for r in got] == [r[:2] for r in want] and any(r[2] for r in want)
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=0.0101)
    assert ranking.corpus_similarity(resumes.where("false").select("resume_id", F.lit(500).cast("long").alias("job_id")), resumes, jobs, "resume_id", "job_id").count() == 0


TEXTS = [
    (1, "Ana\nMath Teacher\nGreen School\nJune 2018 - May 2021\n- taught\nEDUCATION\n2014 - 2018\nState School"),
    (2, "June 2018 - May 2021\nNorth School\nTeacher: Science\nAug 2022 - Present\nAid"),
    (3, "Physics Teacher at West School, June 2018 - May 2021"), (4, None), (5, ""), (6, "Teacher\n" + "x\n" * 25 + "June 2018 - May 2021"),
]


def test_roles_and_employers_around_dates(spark):
    table = lines.line_table(spark.createDataFrame(TEXTS, "resume_id long, text string"))
    found = history.dated_roles(history.line_flags(table, "(?i)teacher", "(?i)school")).collect()
    got = {(r.resume_id, r.line_no): (r.role, r.employer) for r in found}
    assert got == {
        (1, 3): ("Math Teacher", "Green School"), (1, 6): (None, "State School"), (2, 0): ("Teacher: Science", "North School"), (2, 3): ("Teacher: Science", "North School"),
        (3, 0): ("Physics Teacher at West School, June 2018 - May 2021", None), (6, 26): (None, None),
    }


def test_absorbed_records(spark):
    rng = random.Random(4)
    words = ["clerk", "senior clerk", "acme senior clerk", "x", "clerk x", "", None, "Acme, Senior   Clerk"]
    rows = [(rng.randrange(6), rng.choice(words), rng.choice([0.0, 1.0, 1.004, 2.5, None]), n) for n in range(120)]
    norm = lambda t: re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip()

    def absorbed(a):
        return any(
            a[0] == b[0] and (a[2] or 0) > 0 and (b[2] or 0) > 0 and round(a[2], 2) == round(b[2], 2) and norm(a[1]) and norm(b[1]) and norm(a[1]) != norm(b[1]) and norm(a[1]).endswith(norm(b[1]))
            for b in rows
        )

    table = spark.createDataFrame(rows, "resume_id long, job_title string, years double, n int")
    got = sorted(r.n for r in history.drop_absorbed(table).collect())
    assert got == [r[3] for r in rows if not absorbed(r)] and len(got) < len(rows)
    assert history.drop_absorbed(table.where("false")).count() == 0


def test_absorbed_records_are_exchanged_once(spark):
    """Every end of every title was sent to its own key before; records without a resume stay."""
    rows = [(None, "clerk", 1.0, 0), (None, "acme clerk", 1.0, 1), (1, "clerk", 1.0, 2), (1, "acme clerk", 1.0, 3), (1, "acme clerk", 2.0, 4)]
    kept = history.drop_absorbed(spark.createDataFrame(rows, "resume_id long, job_title string, years double, n int"))
    assert sorted(r.n for r in kept.collect()) == [0, 1, 2, 4]
    assert kept._jdf.queryExecution().sparkPlan().toString().count("Join") == 0 and kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_toggled_sections_are_those_of_one_text(spark):
    """The line table gives the lines that a walk over one text gives."""
    rng = random.Random(9)
    pool = ["Skills", "EXPERIENCE", "Work Experience:", "Currently learning", "Technologies I am currently learning", "EDUCATION", "Rust", "built things.", "A LOUD LINE,", "", "  ", "REFERENCES", "Projects", "Java, SQL"]
    texts = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(120)] + [(500, None), (501, "")]
    table = lines.line_table(spark.createDataFrame(texts, "resume_id long, text string"))
    for on_table, on_text in ((history.claimed_lines, claims.claimed_lines), (history.work_lines, claims.work_lines)):
        got = {}
        for r in on_table(table).orderBy("resume_id", "line_no").collect():
            got.setdefault(r.resume_id, []).append(r.line.strip())
        assert got == {i: kept for i, t in texts if (kept := on_text(t or ""))}
