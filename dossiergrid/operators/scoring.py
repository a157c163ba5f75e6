"""Scores, labels, confidence and the sentences that explain them; column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossiergrid.functions import lexicon as lx
from dossiergrid.functions import wording as say
from dossiergrid.functions.text import as_percent, degree_label, degree_rank, half_even, let, pick_phrase, split_lines, text_or_empty


def weighted_score(skill: Column, experience: Column, education: Column, similarity: Column | None = None) -> Column:
    """``fit_score`` before it is rounded."""
    a, b, c = lx.FIT_WEIGHTS_WITHOUT_SIMILARITY
    three = skill * a + experience * b + education * c
    if similarity is None:
        return F.least(three, F.lit(100.0))
    a, b, c, d = lx.FIT_WEIGHTS
    four = skill * a + experience * b + education * c + similarity * d
    return F.least(F.when(similarity.isNull(), three).otherwise(four), F.lit(100.0))


def fit_score(skill: Column, experience: Column, education: Column, similarity: Column | None = None) -> Column:
    """The weighted score, at most 100; without a similarity (or with a null one) the other three share its weight."""
    return half_even(weighted_score(skill, experience, education, similarity), 2)


def fit_label(fit: Column, minimum: Column | float = lx.DEFAULT_MINIMUM) -> Column:
    """Qualified from 75 or the job's minimum if that is higher, For Review from the minimum."""
    minimum = minimum if isinstance(minimum, Column) else F.lit(minimum)
    return (
        F.when(fit >= F.greatest(F.lit(lx.QUALIFIED_AT), minimum), F.lit(lx.QUALIFIED)).when(fit >= minimum, F.lit(lx.REVIEW)).otherwise(F.lit(lx.NOT_QUALIFIED))
    )


def skill_score(matched: Column, required: Column, bonus: Column) -> Column:
    """The share of required skills (blank entries count as required) plus the bonus, at most 100; 100 without requirements. Not rounded: it is weighed as it is."""
    share = F.size(matched) / F.size(required) * 100
    return F.when(F.size(required) == 0, F.lit(100.0)).otherwise(F.least(share + bonus, F.lit(100.0)))


def years_score(years: Column, required: Column) -> Column:
    """Experience by years alone."""
    enough = (F.coalesce(required, F.lit(0)) <= 0) | (years >= required)
    return F.when(enough, F.lit(100.0)).otherwise(half_even(years / required * 100, 2))


def experience_score(years: Column, required: Column, relevance: Column) -> Column:
    """Experience by years, discounted for irrelevant work, also where no experience is required."""
    return half_even(years_score(years, required) * relevance, 2)


def education_score(candidate_rank: Column, required_rank: Column, relevance: Column) -> Column:
    """The candidate's rank by the required one, at most 100, times the relevance of the field."""
    level = F.least(candidate_rank / required_rank * 100, F.lit(100.0))
    return F.when(required_rank == 0, F.lit(100.0)).otherwise(half_even(level * relevance, 2))


def overruled(label: Column, e: dict[str, Column]) -> Column:
    """``struct<label,reason>``: the label after the rules, of which the first that applies counts.

    ``e``: requires_all_critical, missing_critical, required, matched, missing, experience_req,
    years_score, years.
    """
    some = lambda name: F.size(e[name]) > 0
    needs_years = F.coalesce(e["experience_req"], F.lit(0)) > 0
    critical = F.concat(F.lit(say.RESUME_MISSING_REQUIRED), F.array_join(e["missing_critical"], ", "))
    rule = lambda label, reason: F.struct(F.lit(label).alias("label"), reason.alias("reason"))
    return (
        F.when(e["requires_all_critical"] & some("missing_critical"), rule(lx.NOT_QUALIFIED, critical))
        .when(some("required") & ~some("matched"), rule(lx.NOT_QUALIFIED, F.lit(say.NONE_CONFIGURED_REQUIRED)))
        .when(some("missing") & (label == lx.QUALIFIED), rule(lx.REVIEW, F.concat(F.lit(say.REQUIRED_SKILL_NOT), F.array_join(e["missing"], ", "))))
        .when(needs_years & (e["years_score"] < 50), rule(lx.NOT_QUALIFIED, F.lit(say.DETECTED_WORK_EXPERIENCE)))
        .when(needs_years & (e["years_score"] < 100) & (label == lx.QUALIFIED), rule(lx.REVIEW, F.lit(None).cast("string")))
        .otherwise(F.struct(label.alias("label"), F.lit(None).cast("string").alias("reason")))
    )


def readability(text: Column) -> Column:
    """``struct<length,words,variety,lines>``: how much a text says. Put it in a column of its own where it is used more than once."""
    text = text_or_empty(text)
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z'-]+"), F.lit(0))

    def of(w: Column) -> Column:
        variety = F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(0.0))
        lines = F.size(F.filter(split_lines(text), lambda x: F.trim(x) != ""))
        return F.struct(F.length(F.trim(text)).alias("length"), F.size(w).alias("words"), variety.alias("variety"), lines.alias("lines"))

    return let(words, of)


def confidence(e: dict[str, Column]) -> Column:
    """``struct<score,level,reason>``: how far the evidence supports the result.

    ``e``: label, readability (of the text), name, email, phone, education (array<struct<degree,institution>>), experience
    (array<struct<job_title,company,years>>), years, required, matched, missing, matched_critical,
    missing_critical, experience_score, education_score, fit, experience_req, education_req, minimum.
    """
    length, n, variety, lines = (e["readability"][k] for k in ("length", "words", "variety", "lines"))
    some = lambda name: F.size(e[name]) > 0
    both = lambda a, b: lambda r: (F.coalesce(r[a], F.lit("")) != "") & (F.coalesce(r[b], F.lit("")) != "")
    none = F.lit(None).cast("string")
    items: list[tuple[Column, Column, Column]] = []  # points, support, concern

    def add(*cases: tuple[Column, int | Column, str | None, str | None]) -> None:
        """The first case that holds gives its points and its remark."""
        points, good, bad = F.lit(0), none, none
        for test, p, plus, minus in reversed(cases):
            points = F.when(test, p if isinstance(p, Column) else F.lit(p)).otherwise(points)
            good = F.when(test, F.lit(plus) if plus else none).otherwise(good)
            bad = F.when(test, F.lit(minus) if minus else none).otherwise(bad)
        items.append((points, good, bad))

    true = F.lit(True)
    add(
        ((length >= 700) & (n >= 100) & (variety >= 0.18) & (lines >= 8), 25, say.RESUME_TEXT_SUBSTANTIAL, None),
        ((length >= 300) & (n >= 45) & (variety >= 0.12), 16, say.RESUME_TEXT_READABLE, None),
        (length > 0, 4, None, say.RESUME_TEXT_SPARSE),
        (true, 0, None, say.NO_READABLE_RESUME),
    )
    name = F.lower(F.trim(text_or_empty(e["name"])))
    add(
        (~name.isin("", "unknown candidate", "unknown", "n/a"), 7, say.CANDIDATE_IDENTITY_DETECTED, None),
        (true, 0, None, say.CANDIDATE_NAME_NOT),
    )
    # The placeholder of an unknown address counts as an address.
    add(((text_or_empty(e["email"]) != "") | (text_or_empty(e["phone"]) != ""), 3, say.CONTACT_EVIDENCE_DETECTED, None))
    required = F.size(F.filter(e["required"], lambda s: F.trim(s) != ""))
    matched = F.size(e["matched"])
    add((required > 0, 15, None, None), (true, 0, None, say.NO_REQUIRED_SKILL))
    add(
        ((required > 0) & (matched + F.size(e["missing"]) == required), 5, say.EVERY_CONFIGURED_REQUIRED, None),
        (required > 0, 0, None, say.REQUIRED_SKILL_RESULTS),
    )
    so_far = sum((p for p, _, _ in items), F.lit(0))
    add(
        ((required > 0) & (matched == required), 5, say.ALL_REQUIRED_SKILLS, None),
        ((required > 0) & (matched == 0) & (so_far < 40), 0, None, say.MISSING_SKILLS_MAY),
    )
    readable = (length >= 300) & (n >= 45)
    add(
        (some("missing_critical") & readable, 5, say.CRITICAL_SKILL_RULE, None),
        (some("missing_critical"), 0, None, say.CRITICAL_SKILLS_APPEAR),
        (some("matched_critical"), 5, say.CRITICAL_SKILL_EVIDENCE, None),
    )
    needs = F.coalesce(e["experience_req"], F.lit(0)) > 0
    dated = F.exists(e["experience"], lambda r: F.coalesce(r["years"], F.lit(0.0)) > 0)
    total = F.aggregate(e["experience"], F.lit(0.0), lambda s, r: s + F.greatest(F.lit(0.0), F.coalesce(r["years"], F.lit(0.0))))
    complete = F.size(F.filter(e["experience"], both("job_title", "company")))
    add(
        (needs & (dated | (e["years"] > 0)), 10, say.WORK_EXPERIENCE_EVIDENCE, None),
        (needs & some("experience"), -8, None, say.WORK_ROLES_WERE),
        (needs, 0, None, say.WORK_EXPERIENCE_REQUIREMENT),
        (some("experience") | (e["years"] > 0), 0, say.WORK_HISTORY_DETECTED, None),
    )
    add(
        (needs & (complete > 0), F.least(F.lit(8), complete * 3), None, None),
        (needs & some("experience"), 0, None, say.WORK_HISTORY_RECORDS),
    )
    known = needs & (total > 0) & (e["years"] > 0)
    add(
        (known & (F.abs(total - e["years"]) > F.greatest(F.lit(2.0), e["years"] * 0.5)), -8, None, say.TOTAL_EXPERIENCE_CONFLICTS),
        (known, 4, say.EXPERIENCE_TOTALS_AGREE, None),
    )
    score = e["experience_score"]
    add((needs & (score.between(45, 55) | ((score >= 90) & (score < 100))), -5, None, say.EXPERIENCE_SCORE_NEAR))
    schooled = degree_rank(e["education_req"]) > 0
    add(
        (schooled & (some("education") | (e["education_score"] >= 100)), 8, say.EDUCATION_EVIDENCE_DETECTED, None),
        (schooled, 0, None, say.EDUCATION_REQUIREMENT_EXISTS),
        (some("education"), 0, say.EDUCATION_HISTORY_DETECTED, None),
    )
    add(
        (schooled & F.exists(e["education"], both("degree", "institution")), 4, None, None),
        (schooled & some("education"), 0, None, say.EDUCATION_RECORD_MISSING),
    )
    add((schooled & (e["education_score"] >= 80) & (e["education_score"] < 100), -4, None, say.EDUCATION_SCORE_CLOSE))
    distance = F.least(F.abs(e["fit"] - lx.QUALIFIED_AT), F.abs(e["fit"] - e["minimum"]))
    add(
        (distance <= 3, 0, None, say.FIT_SCORE_CLOSE),
        (distance >= 12, 10, say.FIT_SCORE_WELL, None),
        (true, 5, None, None),
    )
    add((e["label"] == lx.REVIEW, 0, None, say.DECISION_INTENTIONALLY_ROUTED))

    points = F.greatest(F.lit(0), F.least(F.lit(100), sum((p for p, _, _ in items), F.lit(0))))
    level = F.when((points >= 75) & (e["label"] != lx.REVIEW), "High").when(points >= 45, "Medium").otherwise("Low")
    first = lambda k: F.array_join(F.slice(F.array_compact(F.array(*[x[k] for x in items])), 1, 3), "; ")
    part = lambda head, k: F.when(first(k) != "", F.concat(F.lit(head), first(k), F.lit(".")))
    reason = F.concat_ws(
        " ", F.format_string(say.EVIDENCE_CONFIDENCE_SCORE, points), part("Confidence support: ", 1), part(say.REVIEWER_SHOULD_VERIFY, 2)
    )
    return F.struct(points.alias("score"), level.alias("level"), reason.alias("reason"))


def _list(items: Column, n: int | None = None) -> Column:
    return F.array_join(items if n is None else F.slice(items, 1, n), ", ")


def _some(items: Column) -> Column:
    return F.size(items) > 0


def _more(items: Column) -> Column:
    return F.concat(_list(items, 5), F.when(F.size(items) > 5, F.concat(F.lit(" and "), (F.size(items) - 5).cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def _say(template: str, *values: Column) -> Column:
    """A sentence with the values in place of its braces."""
    parts = template.split("{}")
    out: list[Column] = [F.lit(parts[0])]
    for value, text in zip(values, parts[1:], strict=True):
        out += [value.cast("string"), F.lit(text)]
    return F.concat(*out)


def _years(years: Column) -> Column:
    return F.format_string("%.1f", half_even(years, 1))


def narrative(e: dict[str, Column]) -> Column:
    """Five sentences on the result: verdict, skills, experience, education, advice.

    ``e``: job_title, fit, skill_score, experience_score, education_score, matched, missing, years,
    education, experience_req, education_req, reason, matched_preferred, bonus, matched_critical,
    missing_critical.
    """
    fit, title, reason = as_percent(e["fit"]), e["job_title"], e["reason"]
    strong, moderate = e["fit"] >= 75, e["fit"] >= 50
    opening = (
        F.when(
            reason.isNotNull(),
            _say(
                say.CANDIDATE_MARKED_NOT,
                title, reason, fit,
            ),
        )
        .when(strong, _say(say.CANDIDATE_STRONG_MATCH, title, fit))
        .when(moderate, _say(say.CANDIDATE_SHOWS_MODERATE, title, fit))
        .otherwise(_say(say.CANDIDATE_DOES_NOT, title, fit))
    )
    m, x = F.size(e["matched"]), F.size(e["missing"])
    bonus = F.when(
        _some(e["matched_preferred"]),
        _say(
            say.CANDIDATE_ALSO_MATCHED,
            F.size(e["matched_preferred"]), _list(e["matched_preferred"], 3), F.when(F.size(e["matched_preferred"]) > 3, "...").otherwise(""), as_percent(e["bonus"]),
        ),
    ).otherwise(F.lit(""))
    skills = (
        F.when(m + x == 0, F.lit(say.NO_SPECIFIC_REQUIRED))
        .when(x == 0, _say(say.NOTABLY_CANDIDATE_DEMONSTRATES, m, _list(e["matched"])))
        .when(m == 0, _say(say.RESUME_DID_NOT, x, _list(e["missing"])))
        .otherwise(
            _say(
                say.OUT_REQUIRED_SKILL,
                m + x, m, _more(e["matched"]), x, _more(e["missing"]), as_percent(e["skill_score"]), bonus,
            )
        )
    )
    critical = F.concat_ws(
        "; ",
        F.when(_some(e["matched_critical"]), F.concat(F.lit(say.MATCHED_CRITICAL_SKILL), _list(e["matched_critical"]))),
        F.when(_some(e["missing_critical"]), F.concat(F.lit(say.MISSING_CRITICAL_SKILL), _list(e["missing_critical"]))),
    )
    skills = F.concat(skills, F.when(critical != "", _say(say.CRITICAL_SKILL_CHECK, critical)).otherwise(F.lit("")))
    needs = F.coalesce(e["experience_req"], F.lit(0)) > 0
    exp, req = as_percent(e["experience_score"]), e["experience_req"]
    experience = (
        F.when(
            needs & (e["years"] >= req),
            _say(say.THEIR_WORK_HISTORY, _years(e["years"]), req, exp),
        )
        .when(
            needs & (e["years"] > 0),
            _say(say.THEIR_WORK_HISTORY_REFLECTS, _years(e["years"]), req, exp),
        )
        .when(
            needs,
            _say(say.NO_VERIFIABLE_WORK, req),
        )
        .when(
            e["years"] > 0,
            _say(say.NO_MINIMUM_EXPERIENCE, _years(e["years"])),
        )
        .otherwise(F.lit(say.NO_MINIMUM_EXPERIENCE_SPECIFIED))
    )
    have = F.coalesce(F.array_max(F.transform(e["education"], lambda r: degree_rank(r["degree"]))), F.lit(0))
    want = degree_rank(e["education_req"])
    edu = as_percent(e["education_score"])
    education = (
        F.when(want == 0, _say(say.NO_SPECIFIC_EDUCATION, degree_label(have)))
        .when(
            have >= want,
            _say(say.CANDIDATE_DETECTED_EDUCATION, degree_label(have), degree_label(want), edu),
        )
        .otherwise(_say(say.CANDIDATE_DETECTED_EDUCATION_DOES, degree_label(have), degree_label(want), edu))
    )
    closing = (
        F.when(reason.isNotNull(), say.RECOMMENDATION_DO_NOT)
        .when(strong, say.RECOMMENDATION_ADVANCE_TO)
        .when(moderate, say.RECOMMENDATION_HUMAN_REVIEW)
        .otherwise(say.RECOMMENDATION_NOT_ADVISED)
    )
    return F.concat_ws(" ", opening, skills, experience, education, closing)


def decision_explanation(e: dict[str, Column]) -> Column:
    """Five paragraphs: decision, strengths, gaps, scoring, risk and advice; the wording is picked by a seed of the result."""
    title, label, fit = e["job_title"], e["label"], as_percent(e["fit"])
    m, total = F.size(e["matched"]), F.size(e["matched"]) + F.size(e["missing"])
    needs = F.coalesce(e["experience_req"], F.lit(0)) > 0
    req = e["experience_req"]
    seed = F.concat_ws(
        "|", title, label, F.format_string("%.2f", half_even(e["fit"], 2)), F.array_join(e["matched"], ","), F.array_join(e["missing"], ","), _years(e["years"])
    )

    def by_label(options: dict[str, Column]) -> Column:
        return F.when(label == lx.QUALIFIED, options[lx.QUALIFIED]).when(label == lx.REVIEW, options[lx.REVIEW]).otherwise(options[lx.NOT_QUALIFIED])

    def pick(offset: int, *templates: str, values: tuple[Column, ...] = ()) -> Column:
        return pick_phrase([_say(t, *values) for t in templates], seed, offset)

    verdict = by_label(
        {
            lx.QUALIFIED: F.concat(
                pick(0, say.DECISION_QUALIFIED, say.DECISION_APPLICANT_QUALIFIED, say.DECISION_RESUME_REACHED, values=(title,)),
                _say(say.FIT_SCORE_NO, fit),
            ),
            lx.REVIEW: F.concat(
                pick(0, say.DECISION_REVIEW, say.DECISION_APPLICANT_NEEDS, say.DECISION_RESUME_NOT, values=(title,)),
                _say(say.FIT_SCORE_SOME, fit),
            ),
            lx.NOT_QUALIFIED: F.concat(
                pick(0, say.DECISION_NOT_QUALIFIED, say.DECISION_APPLICANT_NOT, say.DECISION_RESUME_DID, values=(title,)),
                _say(say.FIT_SCORE_ONE, fit),
            ),
        }
    )
    when = lambda test, text: F.when(test, text if isinstance(text, Column) else F.lit(text))
    years = _years(e["years"])
    worked = e["years"] > 0
    strengths = F.array_compact(
        F.array(
            when(_some(e["matched"]), F.concat(F.lit("required skill(s): "), _list(e["matched"], 5))),
            when(_some(e["matched_critical"]), F.concat(F.lit("critical skill(s): "), _list(e["matched_critical"], 5))),
            when(_some(e["matched_preferred"]), F.concat(F.lit("preferred skill(s): "), _list(e["matched_preferred"], 5))),
            when(worked & needs & (e["years"] >= req), _say(say.WORK_EXPERIENCE_ADVANTAGE, years, req)),
            when(worked & needs & (e["years"] < req), _say(say.WORK_EXPERIENCE_ADVANTAGE_ABOUT, years, req)),
            when(worked & ~needs, _say(say.WORK_EXPERIENCE_ADVANTAGE_ABOUT_YEAR, years)),
            when(~worked & ~needs, say.NO_MINIMUM_EXPERIENCE_REQUIREMENT),
            when(e["education_score"] >= 100, say.EDUCATION_REQUIREMENT_APPEARS),
        )
    )
    rest = lambda items, head: when(F.size(items) > 1, _say(head, F.array_join(F.slice(items, F.lit(2), F.greatest(F.lit(0), F.size(items) - 1)), "; ")))
    head = F.try_element_at(strengths, F.lit(1))
    strong = F.when(
        _some(strengths),
        F.concat_ws(
            "",
            pick(1, say.STRENGTHS_APPLICANT_MAIN, say.STRENGTHS_STRONGEST_EVIDENCE, say.STRENGTHS_WHAT_WORKS, values=(head,)),
            rest(strengths, " Also found: {}."),
        ),
    ).otherwise(F.lit(say.STRENGTHS_NO_CLEAR))
    gaps = F.array_compact(
        F.array(
            when(_some(e["missing_critical"]), F.concat(F.lit(say.MISSING_CRITICAL_SKILL), _list(e["missing_critical"]))),
            when(_some(e["missing"]), F.concat(F.lit(say.MISSING_REQUIRED_SKILL), _list(e["missing"]))),
            when(needs & (e["experience_score"] < 100), _say(say.EXPERIENCE_SCORE_DID, req)),
            when(
                e["education_score"] < 100,
                _say(say.EDUCATION_DID_NOT, F.coalesce(F.nullif(e["education_req"], F.lit("")), F.lit("not specified"))),
            ),
        )
    )
    first_gap = F.try_element_at(gaps, F.lit(1))
    weak = F.when(
        _some(gaps), F.concat_ws("", pick(2, "Concern: {}.", "Gap: {}.", "Weakness: {}.", values=(first_gap,)), rest(gaps, " Also check: {}."))
    ).otherwise(F.lit(say.CONCERN_NO_MAJOR))
    risks = F.array_compact(
        F.array(
            when(_some(e["missing_critical"]), F.concat(F.lit(say.MISSING_CRITICAL_SKILL), _list(e["missing_critical"]))),
            when((total > 0) & (m == 0), say.ZERO_REQUIRED_SKILLS),
            when((total > 0) & (m > 0) & (m * 2 < total), say.LESS_THAN_HALF),
            when(needs & (e["experience_score"] < 50), say.EXPERIENCE_FAR_BELOW),
            when(needs & (e["experience_score"] >= 50) & (e["experience_score"] < 100), say.EXPERIENCE_BELOW_STATED),
            when(_some(e["missing"]) & (label != lx.NOT_QUALIFIED), say.SOME_REQUIRED_SKILLS),
        )
    )
    named = F.array_join(risks, ", ")
    risk = F.when(
        _some(risks), pick(3, say.RISK_TO_REVIEW, say.MANUAL_REVIEW_SHOULD, say.MOST_IMPORTANT_RISK, values=(named,))
    ).otherwise(
        pick(
            4,
            say.RISK_TO_REVIEW_NO,
            say.MANUAL_REVIEW_FOCUS,
            say.MOST_IMPORTANT_RISK_NO,
        )
    )
    scores = tuple(as_percent(e[k]) for k in ("skill_score", "experience_score", "education_score"))
    requirements = F.when(
        total > 0, _say(say.MATCHED_OUT_REQUIRED, m, total, *scores)
    ).otherwise(_say(say.NO_REQUIRED_SKILL_LIST, *scores[1:]))
    preferred = F.when(
        _some(e["matched_preferred"]), _say(say.PREFERRED_SKILL_BONUS, F.format_string("%.2f", half_even(e["bonus"], 2)))
    ).otherwise(F.lit(say.NO_PREFERRED_SKILL))
    similarity = F.when(e["similarity"].isNotNull(), _say(say.TEXT_SIMILARITY_FIT, as_percent(e["similarity"]))).otherwise(
        F.lit(say.TEXT_SIMILARITY_NOT)
    )
    weights = say.SKILLS_EXPERIENCE_EDUCATION
    scoring = F.concat_ws(" ", pick(5, f"Scoring: {weights}", f"Score basis: {weights}", f"Fit score weights: {weights}"), requirements, preferred, similarity)
    advice = by_label(
        {
            lx.QUALIFIED: pick(
                6,
                say.REVIEWER_RECOMMENDATION_ADVANCE,
                say.REVIEWER_RECOMMENDATION_CONSIDER,
                say.REVIEWER_RECOMMENDATION_SUITABLE,
            ),
            lx.REVIEW: pick(
                7,
                say.REVIEWER_RECOMMENDATION_REVIEW,
                say.REVIEWER_RECOMMENDATION_CHECK,
                say.REVIEWER_RECOMMENDATION_USE,
            ),
            lx.NOT_QUALIFIED: pick(
                8,
                say.REVIEWER_RECOMMENDATION_DO,
                say.REVIEWER_RECOMMENDATION_HOLD,
                say.REVIEWER_RECOMMENDATION_CURRENT,
            ),
        }
    )
    return F.concat_ws("\n\n", verdict, strong, weak, scoring, F.concat_ws(" ", risk, advice))
