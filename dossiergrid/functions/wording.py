"""What results say about candidates."""

# The words of labels, confidence, narratives and explanations, in the order in which they are used.
RESUME_MISSING_REQUIRED = "the resume is missing required critical skill(s): "
NONE_CONFIGURED_REQUIRED = "none of the configured required skills were found in the resume"
REQUIRED_SKILL_NOT = "required skill(s) not evidenced in the resume: "
DETECTED_WORK_EXPERIENCE = "the detected work experience is far below the configured minimum requirement"
RESUME_TEXT_SUBSTANTIAL = "resume text is substantial and structurally readable"
RESUME_TEXT_READABLE = "resume text is readable but has limited extraction coverage"
RESUME_TEXT_SPARSE = "resume text is sparse or repetitive, so extraction may be incomplete"
NO_READABLE_RESUME = "no readable resume text was available"
CANDIDATE_IDENTITY_DETECTED = "candidate identity was detected"
CANDIDATE_NAME_NOT = "candidate name was not confidently detected"
CONTACT_EVIDENCE_DETECTED = "contact evidence was detected"
NO_REQUIRED_SKILL = "no required-skill list was configured"
EVERY_CONFIGURED_REQUIRED = "every configured required skill was evaluated"
REQUIRED_SKILL_RESULTS = "required-skill results do not reconcile with the configured list"
ALL_REQUIRED_SKILLS = "all required skills have direct text evidence"
MISSING_SKILLS_MAY = "missing skills may reflect incomplete text extraction"
CRITICAL_SKILL_RULE = "critical-skill rule was evaluated against readable text"
CRITICAL_SKILLS_APPEAR = "critical skills appear missing from incomplete resume text"
CRITICAL_SKILL_EVIDENCE = "critical-skill evidence was found"
WORK_EXPERIENCE_EVIDENCE = "work experience evidence was detected"
WORK_ROLES_WERE = "work roles were detected but their dates were not provided, so duration cannot be verified"
WORK_EXPERIENCE_REQUIREMENT = "work experience requirement exists but no work history was extracted"
WORK_HISTORY_DETECTED = "work history was detected"
WORK_HISTORY_RECORDS = "work-history records are missing a title or employer"
TOTAL_EXPERIENCE_CONFLICTS = "total experience conflicts with extracted work-history durations"
EXPERIENCE_TOTALS_AGREE = "experience totals agree with extracted work history"
EXPERIENCE_SCORE_NEAR = "experience score is near a review boundary"
EDUCATION_EVIDENCE_DETECTED = "education evidence was detected"
EDUCATION_REQUIREMENT_EXISTS = "education requirement exists but no education history was extracted"
EDUCATION_HISTORY_DETECTED = "education history was detected"
EDUCATION_RECORD_MISSING = "education record is missing a degree or institution"
EDUCATION_SCORE_CLOSE = "education score is close but not a full match"
FIT_SCORE_CLOSE = "fit score is close to a decision threshold"
FIT_SCORE_WELL = "fit score is well separated from decision thresholds"
DECISION_INTENTIONALLY_ROUTED = "decision is intentionally routed for human review"
EVIDENCE_CONFIDENCE_SCORE = "Evidence confidence score: %d/100."
REVIEWER_SHOULD_VERIFY = "Reviewer should verify: "
CANDIDATE_MARKED_NOT = (
    "This candidate is marked Not Qualified for the {} role because {}. The overall fit score remains {}% to "
    "reflect the weighted skills, experience, and education evidence separately from the rule outcome."
)
CANDIDATE_STRONG_MATCH = (
    "This candidate is a strong match for the {} role, achieving an overall fit score of {}% - well above the "
    "qualification threshold."
)
CANDIDATE_SHOWS_MODERATE = (
    "This candidate shows a moderate fit for the {} role with an overall fit score of {}%, placing them in the 'For"
    " Review' category."
)
CANDIDATE_DOES_NOT = (
    "This candidate does not meet the minimum qualifications for the {} role, scoring {}% overall - below the "
    "required threshold."
)
CANDIDATE_ALSO_MATCHED = " The candidate also matched {} preferred skill(s) ({}{}), earning a +{}pt bonus."
NO_SPECIFIC_REQUIRED = "No specific required skills were defined for this role, so skill matching was not evaluated."
NOTABLY_CANDIDATE_DEMONSTRATES = "Notably, the candidate demonstrates all {} required skill(s) ({}), achieving a perfect skills match score."
RESUME_DID_NOT = "The resume did not surface any of the {} required skill(s) ({}). This is the primary driver of the low overall score."
OUT_REQUIRED_SKILL = (
    "Out of {} required skill(s), {} matched: {}. The {} missing skill(s) - {} - account for the skills gap and "
    "result in a required skills score of {}%.{}"
)
MATCHED_CRITICAL_SKILL = "matched critical skill(s): "
MISSING_CRITICAL_SKILL = "missing critical skill(s): "
CRITICAL_SKILL_CHECK = " Critical-skill check: {}."
THEIR_WORK_HISTORY = (
    "Their work history indicates approximately {} year(s) of relevant experience, meeting or exceeding the {}-year"
    " requirement (experience score: {}%)."
)
THEIR_WORK_HISTORY_REFLECTS = (
    "Their work history reflects around {} year(s) of experience, which falls short of the {}-year requirement "
    "(experience score: {}%)."
)
NO_VERIFIABLE_WORK = (
    "No verifiable work experience timeline was detected in the resume. The role requires {} year(s) of experience,"
    " resulting in an experience score of 0%."
)
NO_MINIMUM_EXPERIENCE = (
    "No minimum experience was specified for this role; the candidate's resume indicates approximately {} year(s) "
    "of relevant work history."
)
NO_MINIMUM_EXPERIENCE_SPECIFIED = "No minimum experience was specified for this role, and no explicit experience timeline was detected in the resume."
NO_SPECIFIC_EDUCATION = "No specific education requirement was set for this role. The candidate's highest detected credential is a {}."
CANDIDATE_DETECTED_EDUCATION = "The candidate's detected education level ({}) meets or exceeds the required {} for this role (education score: {}%)."
CANDIDATE_DETECTED_EDUCATION_DOES = "The candidate's detected education ({}) does not meet the required {} for this role (education score: {}%)."
RECOMMENDATION_DO_NOT = "Recommendation: Do not advance unless the rule-triggering gap is resolved or verified differently during human review."
RECOMMENDATION_ADVANCE_TO = (
    "Recommendation: Advance to the next stage. This candidate presents a compelling profile and is well-suited for"
    " further evaluation."
)
RECOMMENDATION_HUMAN_REVIEW = (
    "Recommendation: Human review advised. The candidate shows promise but has gaps that should be explored further"
    " during an interview or assessment."
)
RECOMMENDATION_NOT_ADVISED = (
    "Recommendation: Not advised for advancement at this stage. The candidate's profile does not meet the minimum "
    "criteria required for this position."
)
DECISION_QUALIFIED = "Decision: Qualified for {}."
DECISION_APPLICANT_QUALIFIED = "Decision: This applicant is qualified for {}."
DECISION_RESUME_REACHED = "Decision: The resume reached Qualified status for {}."
FIT_SCORE_NO = " Fit score: {}%. No hard disqualification rule was triggered."
DECISION_REVIEW = "Decision: For Review for {}."
DECISION_APPLICANT_NEEDS = "Decision: This applicant needs manual review for {}."
DECISION_RESUME_NOT = "Decision: The resume is not a clear pass or fail for {}."
FIT_SCORE_SOME = " Fit score: {}%. Some useful evidence was found, but important gaps still need checking."
DECISION_NOT_QUALIFIED = "Decision: Not Qualified for {}."
DECISION_APPLICANT_NOT = "Decision: This applicant is not qualified for {}."
DECISION_RESUME_DID = "Decision: The resume did not meet the minimum screening standard for {}."
FIT_SCORE_ONE = " Fit score: {}%. One or more screening rules found a gap that is too large to ignore."
WORK_EXPERIENCE_ADVANTAGE = "work experience advantage: about {} year(s), meeting the {}-year requirement"
WORK_EXPERIENCE_ADVANTAGE_ABOUT = "work experience advantage: about {} year(s), but below the {}-year requirement"
WORK_EXPERIENCE_ADVANTAGE_ABOUT_YEAR = "work experience advantage: about {} year(s)"
NO_MINIMUM_EXPERIENCE_REQUIREMENT = "no minimum experience requirement was set"
EDUCATION_REQUIREMENT_APPEARS = "education requirement appears satisfied"
STRENGTHS_APPLICANT_MAIN = "Strengths: the applicant's main advantage is {}."
STRENGTHS_STRONGEST_EVIDENCE = "Strengths: the strongest evidence is {}."
STRENGTHS_WHAT_WORKS = "Strengths: what works in the applicant's favor is {}."
STRENGTHS_NO_CLEAR = "Strengths: no clear advantage was detected from the configured requirements."
MISSING_REQUIRED_SKILL = "missing required skill(s): "
EXPERIENCE_SCORE_DID = "experience score did not fully clear the {}-year requirement"
EDUCATION_DID_NOT = "education did not fully match the configured requirement ({})"
CONCERN_NO_MAJOR = "Concern: no major gap was detected, but the extracted resume details should still be verified."
ZERO_REQUIRED_SKILLS = "zero required skills were matched"
LESS_THAN_HALF = "less than half of the required skills were matched"
EXPERIENCE_FAR_BELOW = "experience is far below the minimum requirement"
EXPERIENCE_BELOW_STATED = "experience is below the stated minimum requirement"
SOME_REQUIRED_SKILLS = "some required skills are still missing"
RISK_TO_REVIEW = "Risk to review: {}."
MANUAL_REVIEW_SHOULD = "Manual review should focus on: {}."
MOST_IMPORTANT_RISK = "Most important risk: {}."
RISK_TO_REVIEW_NO = "Risk to review: no major rule-based risk was detected."
MANUAL_REVIEW_FOCUS = "Manual review focus: verify that the extracted resume details are accurate."
MOST_IMPORTANT_RISK_NO = "Most important risk: no high-risk issue was detected by the configured rules."
MATCHED_OUT_REQUIRED = "Matched {} out of {} required skill(s). Scores: skills {}%, experience {}%, education {}%."
NO_REQUIRED_SKILL_LIST = "No required-skill list was provided. Scores: experience {}%, education {}%."
PREFERRED_SKILL_BONUS = "Preferred skill bonus: +{}; it does not replace required skills."
NO_PREFERRED_SKILL = "No preferred-skill bonus was applied."
TEXT_SIMILARITY_FIT = "Text similarity: {}% (10% of the fit score)."
TEXT_SIMILARITY_NOT = "Text similarity was not available and did not affect the decision."
SKILLS_EXPERIENCE_EDUCATION = "skills 50%, experience 25%, education 15%, text similarity 10%."
REVIEWER_RECOMMENDATION_ADVANCE = "Reviewer recommendation: advance to the next screening stage after verifying the extracted evidence."
REVIEWER_RECOMMENDATION_CONSIDER = "Reviewer recommendation: consider moving forward, but confirm the resume details manually."
REVIEWER_RECOMMENDATION_SUITABLE = "Reviewer recommendation: suitable for next-stage screening, pending human verification."
REVIEWER_RECOMMENDATION_REVIEW = "Reviewer recommendation: review the gaps before deciding whether to move forward."
REVIEWER_RECOMMENDATION_CHECK = "Reviewer recommendation: check the weaker areas manually before advancing."
REVIEWER_RECOMMENDATION_USE = "Reviewer recommendation: use this as a review queue item, not a final decision."
REVIEWER_RECOMMENDATION_DO = "Reviewer recommendation: do not advance unless clearer evidence addresses the missing requirements."
REVIEWER_RECOMMENDATION_HOLD = "Reviewer recommendation: hold from advancement unless additional information resolves the gaps."
REVIEWER_RECOMMENDATION_CURRENT = "Reviewer recommendation: current resume evidence is not strong enough for next-stage screening."
