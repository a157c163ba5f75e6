"""Resumes by jobs: everything a screening result holds, as one chain of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossiergrid.functions import lexicon as lx
from dossiergrid.functions.text import degree_rank, field_relevance, half_even
from dossiergrid.operators import scoring
from dossiergrid.operators.facts import skills_for_job
from dossiergrid.operators.matching import SIDES, matched_in, preferred_bonus, screened, trimmed, with_jobs
from dossiergrid.operators.similarity import pair_similarity
from dossiergrid.scratch import materialize


def evaluate(facts: DataFrame, jobs: DataFrame, key: str = "resume_id") -> DataFrame:
    """Screening results of ``facts`` (of ``resume_facts``, with ``job_id``) against their jobs.

    ``jobs``: job_id, title, required, critical, preferred (arrays), education_req, experience_req,
    min_fit_score, requires_all_critical; one row a job. A resume meets its own job only, in one
    join, and everything else is an expression over the joined row. Null texts and lists count as
    empty; resumes whose job is null or unknown are left out; repeated resumes are each evaluated.
    """
    empty = F.array().cast("array<string>")
    listed = [F.coalesce(c, empty).alias(c) for c in SIDES]
    words = F.concat_ws(" ", "title", *[F.array_join(c, " ") for c in SIDES])
    jobs = jobs.select(
        "job_id", "title", *listed, "education_req",
        F.coalesce("experience_req", F.lit(0)).alias("experience_req"), F.coalesce("min_fit_score", F.lit(lx.DEFAULT_MINIMUM)).alias("minimum"),
        F.coalesce("requires_all_critical", F.lit(False)).alias("requires_all_critical"),
    )
    jobs = jobs.withColumns({f"wanted_{s}": trimmed(F.col(s)) for s in SIDES} | {"job_words": words})
    jobs = jobs.withColumns({"needed": F.array_union("wanted_required", "wanted_critical"), "every": F.array_union("wanted_required", F.array_union("wanted_critical", "wanted_preferred"))})
    c = F.col
    # All that reads the text is told before the table is written: behind it, an expression is made again for each place it is used in.
    degrees = F.array_join(F.transform("education", lambda r: r["degree"]), " ")
    some = F.size("education") > 0
    rank = F.when(some, F.array_max(F.transform("education", lambda r: degree_rank(r["degree"])))).otherwise(degree_rank(c("text")))
    rows = with_jobs(facts, jobs).withColumns(
        {
            "screened": screened(c("text"), c("needed"), c("wanted_preferred"), c("title")),
            "similarity": pair_similarity(c("text"), c("job_words"), bags=True),
            "readability": scoring.readability(c("text")),
            "candidate_rank": rank,
            "field_relevance": field_relevance(F.when(some, degrees).otherwise(c("text")), c("education_req")),
        }
    )
    # No score needs what is mentioned, so it isn't looked for where the skills aren't asked for.
    mentioned = skills_for_job(F.when(~c("listed"), c("text")), c("every"))
    rows = materialize(rows, "skills-found").withColumns({"similarity": half_even(c("similarity"), 2), "skills": F.when(c("listed"), c("skills")).otherwise(mentioned)})
    rows = rows.withColumns({"found": c("screened.found"), "related": c("screened.related")})
    lists = {}
    for side in SIDES:
        parts = matched_in(F.col(f"wanted_{side}"), F.struct(c("screened.preferred").alias("claimed"), c("found.inferred").alias("inferred")) if side == "preferred" else c("found"), implied=side != "preferred")
        lists |= {n if side == "required" else f"{n}_{side}": parts[n] for n in ("matched", "missing")}
    rows = rows.withColumns(lists | {"implied": F.col("found.inferred")})
    rows = rows.withColumns(
        {
            "bonus": preferred_bonus(c("matched_preferred"), F.size("wanted_preferred")),
            "relevance": F.when(c("related"), 1.0).otherwise(0.4),
            "years_score": scoring.years_score(c("years"), c("experience_req")),
        }
    )
    rows = rows.withColumns(
        {
            "skill_score": scoring.skill_score(c("matched"), c("required"), c("bonus")),
            "experience_score": scoring.experience_score(c("years"), c("experience_req"), c("relevance")),
            "education_score": scoring.education_score(c("candidate_rank"), degree_rank(c("education_req")), c("field_relevance")),
        }
    )
    rows = rows.withColumn("fit", scoring.fit_score(c("skill_score"), c("experience_score"), c("education_score"), c("similarity")))
    e = {n: c(n) for n in rows.columns} | {"missing_critical": c("missing_critical"), "matched_critical": c("matched_critical"), "job_title": c("title")}
    rows = rows.withColumn("verdict", scoring.overruled(scoring.fit_label(c("fit"), c("minimum")), e))
    e |= {"label": c("verdict.label"), "reason": c("verdict.reason")}
    return rows.select(
        key, "job_id", c("verdict.label").alias("recommendation_label"), c("verdict.reason").alias("disqualification_reason"), half_even(c("skill_score"), 2).alias("skill_score"), "experience_score",
        "education_score", c("similarity").alias("text_similarity"), c("fit").alias("fit_score"), "matched", "missing", "implied", "matched_critical", "missing_critical",
        "matched_preferred", c("bonus").alias("preferred_bonus"), "name", "email", "phone", "years", "experience", "education", "credentials", "skills",
        scoring.confidence(e).alias("confidence"), scoring.narrative(e).alias("summary"), scoring.decision_explanation(e).alias("decision_explanation"),
        F.create_map(*[x for n, w in zip(("skills", "experience", "education", "similarity"), lx.FIT_WEIGHTS, strict=True) for x in (F.lit(n), F.lit(w))]).alias("weights"),
    )
