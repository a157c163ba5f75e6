"""Work and education records of resumes in many layouts."""

import pytest

from dossiergrid.operators import records
from dossiergrid.operators.facts import sections

AS_OF = "2026-06-23"
NONE = records.NOT_IDENTIFIED


def work(text):
    return [(r["job_title"], r["company"], r["location"]) for r in records.experience(sections(text), AS_OF)]


WORK = [
    ("Work Experience\n- Strong hands-on experience in developing applications using Java\n- IBM Rational Application Developer, Eclipse\nExcellent team player", []),
    (
        "Work Experience\nCVS, Woonsocket, Rhode Island            Full Stack Java Developer\nApril 2016 - Present\nResponsibilities:\nBuilt web apps.\n\n"
        "Toll Brothers, Horsham Township,  Pennsylvania        Software Engineer\nDecember 2015 -  March 2016\nWorked on backend services.",
        [("Full Stack Java Developer", "CVS", "Woonsocket, Rhode Island"), ("Software Engineer", "Toll Brothers", "Horsham Township, Pennsylvania")],
    ),
    (
        "PROFESSIONAL EXPERIENCE\nClient: Capital One                 Mar 17 - Till date\nLocation: Mclean, VA\nRole:  Full Stack Java Developer\nResponsibilities:\n\n"
        "Client: Cigna Healthcare             Nov 13- Dec 15 Location: Windsor, CT\nRole: Java Developer",
        [("Full Stack Java Developer", "Capital One", "Mclean, VA"), ("Java Developer", "Cigna Healthcare", "Windsor, CT")],
    ),
    ("Professional Experience\nSoftware Engineer\njane.santos@gmail.com\nJanuary 2020 - January 2022\nResponsibilities:", [("Software Engineer", NONE, NONE)]),
    (
        "Teaching Experience\nSchool: San Isidro National High School        June 2019 - Present\nLocation: Quezon City\nDesignation: Mathematics Teacher\n"
        "Responsibilities:\nPrepared lesson plans.\n\nInstitution: Bright Minds Learning Center      May 2017 - March 2019\nLocation: Manila\nPosition: Tutor",
        [("Mathematics Teacher", "San Isidro National High School", "Quezon City"), ("Tutor", "Bright Minds Learning Center", "Manila")],
    ),
    ("Work Experience\nRecruitment Assistant\nPeopleFirst Inc.\n01/2024 - 06/2024\nAssisted with records.", [("Recruitment Assistant", "PeopleFirst Inc", NONE)]),
    ("Employment History\nCashier | FreshMart Retail | Makati\nJune 2022 - August 2023\nHandled payments.", [("Cashier", "FreshMart Retail", "Makati")]),
    (
        "Work Experience\nAcme Digital Solutions - Software Engineer - January 2020 - Present\nNorthwind Services, Project Manager, March 2018 - December 2019",
        [("Software Engineer", "Acme Digital Solutions", NONE), ("Project Manager", "Northwind Services", NONE)],
    ),
    ("Experience\nSoftware Engineer, Acme Digital Solutions (January 2020 - Present)\nBuilt APIs.", [("Software Engineer", "Acme Digital Solutions", NONE)]),
    (
        "Professional Experience\nWind Stream Communication, Dallas, TX        SEP-2016 - TILL DATE\nRole: Sr Java Programmer\nResponsibilities:\nBuilt web services.\n"
        "IBM DALLAS,TEXASSEP 2015-AUG 2016\nRole: Sr Java Programmer\nResponsibilities:",
        [("Sr Java Programmer", "Wind Stream Communication", "Dallas, TX"), ("Sr Java Programmer", "IBM", "DALLAS, TEXAS")],
    ),
    (
        "Professional Experience\nClient: Datacard Software India Pvt Ltd, Bangalore    Jan 2003 - July 2007\nRole: Java Developer, Lead in Java based\nProduct Title: Affina\n"
        "Client: Infosys Technologies Pvt Ltd, Bangalore       August 2002 to January 2003\nRole: Software Automation Test Engineer",
        [("Java Developer, Lead in Java based", "Datacard Software India Pvt Ltd", "Bangalore"), ("Software Automation Test Engineer", "Infosys Technologies Pvt Ltd", "Bangalore")],
    ),
    ("Work Experience\nNurse\nCity Hospital\n\nDriver\nNorth Company", [("Nurse", "City Hospital", NONE), ("Driver", "North Company", NONE)]),
    ("", []),
    ("Work Experience\n", []),
]


@pytest.mark.parametrize(("text", "want"), WORK)
def test_work(text, want):
    assert work(text) == want


def test_a_long_history_is_whole():
    text = "Professional Experience\n" + "\n\n".join(f"C{k} Company  Software Engineer\nJanuary {2000 + k} - January {2001 + k}" for k in range(12))
    assert len(work(text)) == 12


@pytest.mark.parametrize(
    ("token", "month"),
    [("Mar 17", 2017 * 12 + 2), ("01/99", 1999 * 12), ("06/41", 1941 * 12 + 5), ("SEP-2016", 2016 * 12 + 8), ("May, 2017", 2017 * 12 + 4), ("June 26, 2018", 2018 * 12 + 5), ("TILL DATE", 2026 * 12 + 5), ("x", None)],
)
def test_dates(token, month):
    assert records.ordinal(token, AS_OF) == month


def made(title, company, years=1.0, **more):
    return {"job_title": title, "company": company, "location": NONE, "years": years, "duration_unknown": years == 0.0} | more


def test_merging():
    kept = lambda *rows: [(r["job_title"], r["company"]) for r in records.merged(list(rows))]
    assert kept(made("Clerk", "A Inc"), made("clerk", "a inc")) == [("Clerk", "A Inc")]
    assert kept(made("Clerk", NONE), made("Clerk", "A Inc")) == [("Clerk", "A Inc")]
    assert kept(made("Clerk", "A Inc"), made("Senior Clerk", "A Inc")) == [("Senior Clerk", "A Inc")]
    assert kept(made("Principal Consultant", "Bundok Industries"), made("Bundok Industries Houston, TX - Principal Consultant", "duty")) == [("Principal Consultant", "Bundok Industries")]
    assert kept(made("Clerk", "A Inc", 0.0), made("Clerk", "A Inc", 2.0))[0] == ("Clerk", "A Inc") and records.merged([made("Clerk", "A Inc", 0.0), made("Clerk", "A Inc", 2.0)])[0]["years"] == 2.0
    assert kept(made("Dean's Lister", "State University")) == []
    assert kept(made("Clerk", "A Inc"), made("Clerk", "B Inc"), made("Driver", "A Inc")) == [("Clerk", "A Inc"), ("Clerk", "B Inc"), ("Driver", "A Inc")]


SCHOOLS = [
    ("Education\nBSEd major in Mathematics\nInstitution: Philippine Normal University\n2018 - 2022", [("BSEd major in Mathematics", "Philippine Normal University")]),
    (
        "SUMMARY:\nProduct management.\nEDUCATION: Bachelor of Engineering (Electronics & Communication) 1998, .Karnataka University India\nCERTIFICATIONS:\nPMP",
        [("Bachelor of Engineering (Electronics & Communication)", "Karnataka University India")],
    ),
    ("Professional Summary\nCertified Scrum Master with ten years.\nProfessional Experience\nScrum Master\nABC Corporation\n2018 - Present", []),
    (
        "Academic Background\nPhilippine Normal University\nMaster of Arts in Education, 2022\n\nUniversity of Santo Tomas\nBSEd major in English, 2018",
        [("Master of Arts in Education", "Philippine Normal University"), ("BSEd major in English", "University of Santo Tomas")],
    ),
    (
        "Education\nBachelor of Science in Information Technology\n\nCentral State University\nMaster of Arts in Education",
        [("Bachelor of Science in Information Technology", "Unknown Institution"), ("Master of Arts in Education", "Central State University")],
    ),
    ("EDUCATIONAL BACKGROUND\nBACHELOR OF SECONDARY EDUCATION\nPAMPANGA STATE UNIVERSITY, BACOLOR, PAMPANGA\n2022 - 2026", [("BACHELOR OF SECONDARY EDUCATION", "PAMPANGA STATE UNIVERSITY")]),
    ("Education\nBachelor of Science in Information Technology\nInstitution: PUP\n2019 - 2023", [("Bachelor of Science in Information Technology", "PUP")]),
    ("Education\nBachelor of Science in Computer Science | Polytechnic University of the Philippines", [("Bachelor of Science in Computer Science", "Polytechnic University of the Philippines")]),
    ("Education\nBachelor of Science in Computer Science\nTraining sponsored by Acme Corporation\nWork Experience\nSoftware Engineer", [("Bachelor of Science in Computer Science", "Unknown Institution")]),
    ("Work Experience\nEnglish Teacher\nEducation\nBachelor of Secondary Education\nPampanga Colleges", [("Bachelor of Secondary Education", "Pampanga Colleges")]),
]


@pytest.mark.parametrize(("text", "want"), SCHOOLS)
def test_schools(text, want):
    assert [(r["degree"], r["institution"]) for r in records.education(sections(text))] == want
