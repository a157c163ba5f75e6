"""Names of applicants in many headers."""

import re

import pytest

from dossiergrid.functions import lexicon
from dossiergrid.operators import names
from dossiergrid.operators.facts import sections

CASES = [
    ("Teacher Candidate 2\nSummary\nEnthusiastic teacher effective.\nSkills\nCritical thinker\n", "Unknown Candidate"),
    ("Word\nword@example.com\nProfessional Summary\nExperienced applicant.", "Unknown Candidate"),
    ("LETICIA\nAKILAL\nRecherche d'un contrat d'apprentissage en IT dans le cadre\nd'une L3 MIAGE\nE-mail : akilallaeticia@gmail.com", "Leticia Akilal"),
    ("BBOORRHHAANN GGHHEENNNNAAII\nTTEECCHHNNIICCIIEENN SSUUPPÉÉRRIIEEUURR\nborhan.g@live.fr", "Borhan Ghennai"),
    ("Name: Abi ral Pandey\nEmail: abiral.pandey88@gmail.com\nPhone: 940-242-3303", "Abiral Pandey"),
    ("Java Developer\njuan.delacruz@gmail.com\n09171234567\nProfessional Summary\nExperienced Java developer.", "Juan Delacruz"),
    ("Maria Santos\nFull Stack Java Developer\nmaria.santos@gmail.com", "Maria Santos"),
    ("Teacher\nana.reyes@gmail.com\n09181234567\nProfessional Summary\nLicensed educator.", "Ana Reyes"),
    ("Teacher\nana.reyes@gmail.com\n09181234567\nTeaching Experience\nSchool: San Isidro National High School\nLocation: Quezon City", "Ana Reyes"),
    ("MARIA DELA CRUZ\nLicensed Professional Teacher\nmaria.delacruz@example.com\n+63 917 123 4567", "Maria Dela Cruz"),
    ("Full Name: juan miguel santos\nEmail: juan.santos@example.com", "Juan Miguel Santos"),
    ("QUEZON CITY\nABC CORPORATION\nSoftware Engineer\npaolo.reyes@example.com", "Paolo Reyes"),
    ("Achyuth\n540-999-8048\nachyuth.java88@gmail.com\nOBJECTIVE:\nAround 8 years of software experience.", "Achyuth"),
    ("Anudeep\nSr Java Programmer\nanudeepreddynallamada@gmail.com\nProfessional Summary:\nEight years of software.", "Anudeep"),
    ("Applicant Name: SANTOS, JUAN DELA CRUZ\nEmail: juan.santos@example.com", "Juan Dela Cruz Santos"),
    ("Full Name: Dr. ANNE-MARIE O'NEIL, RN\nEmail: anne.oneil@example.com", "Anne-Marie O'Neil"),
    ("ALYSSA MAE RAMOS | Licensed Professional Teacher | alyssa.ramos@example.com\n0917 555 0101", "Alyssa Mae Ramos"),
    ("CURRICULUM VITAE OF LUZVIMINDA REYES\nTeacher\nluzviminda.reyes@example.com", "Luzviminda Reyes"),
    ("Makati Philippines\nJOHN MICHAEL SANTOS\nSoftware Engineer\njohnmichaelsantos@example.com", "John Michael Santos"),
    ("Senior Accountant\nBright Future Solutions\nroberto.garcia@example.com", "Roberto Garcia"),
    ("JANE A. DOE\njane.doe@mail.org | 0917 123 4567\n", "Jane A. Doe"),
    ("Name: Rey de la Cruz\nrey@dev.io", "Rey de la Cruz"),
    ("", "Unknown Candidate"),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_names(text, want):
    email = re.search(lexicon.EMAIL, text)
    assert names.applicant(sections(text), email[0] if email else "") == want


def test_prose_is_left_before_it_is_rebuilt(monkeypatch):
    """A line of more words than a name has is told from its words; what stays is found as before."""
    prose = "this long line has many more plain words than any name can have"
    assert names._wordy(prose) and not names._wordy("Dr. Ana Maria de la Cruz Jr., CPA, MBA, PhD, RN, LPT")
    seen = []
    whole = names._name_in
    monkeypatch.setattr(names, "_name_in", lambda value: seen.append(value) or whole(value))
    line = lambda text: type("Line", (), {"text": text, "section": "header"})()
    assert names.applicant([line(prose), line("Ana Cruz"), line("x " * 40 + "linkedin: y")], "") == "Ana Cruz"
    assert prose not in seen and "Ana Cruz" in seen
