"""Work and education records from the lines of a resume's sections.

Every entry grows from an anchor: a line with dates, or one that names an employer by a
label. What is written on the anchor's line is cut at labels, separators and wide gaps;
what is still missing comes from labelled lines below it and from plain lines next to it that
no other entry uses. Roles without dates are read from what is left. The candidates of
both ways are then merged.
"""

from __future__ import annotations

import re

from dossiergrid.functions import lexicon as lx

NOT_STATED = "Position Not Stated"
NOT_IDENTIFIED = "Not Identified"
UNKNOWN_SCHOOL = "Unknown Institution"
MOST_RECORDS = 25

MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?"
DATE = (
    rf"(?:{MONTH}[\s,\-']*(?:\d{{1,2}},\s*)?(?:19|20)\d{{2}}(?!\d)|{MONTH}[\s\-']+\d{{2}}(?![\d,])|\d{{1,2}}/(?:\d{{4}}|\d{{2}})(?!\d)"
    r"|(?<!\d)(?:19|20)\d{2}(?!\d))"
)
RANGE = re.compile(rf"\(?\s*({DATE}|{MONTH})\s*(?:-|–|—|\bto\b)\s*(present|current|till\s+date|to\s+date|now|{DATE})\s*\)?", re.I)
DURATION = re.compile(r"\b(\d+(?:\.\d+)?)\+?\s*(years?|yrs?|months?)\b", re.I)
BULLET = re.compile(r"^[\s\-*•▪·]+(?=\S)")
TITLE = re.compile(
    r"\b(?:developer|engineer|manager|analyst|consultant|architect|lead|specialist|programmer|administrator|officer|designer|director|coordinator"
    r"|supervisor|intern|associate|executive|scientist|teacher|instructor|professor|lecturer|faculty|principal|dean|tutor|librarian|educator|trainer"
    r"|advis[eo]r|accountant|auditor|nurse|physician|therapist|assistant|technician|clerk|cashier|representative|agent|secretary|receptionist"
    r"|aide|bookkeeper|caregiver|chef|cook|counsell?or|driver|electrician|mechanic|operator|pharmacist|recruiter|volunteer|worker|writer|editor)\b",
    re.I,
)
EMPLOYER = re.compile(
    r"\b(?:inc|corp(?:oration)?|company|co\.|llc|ltd|limited|group|solutions|technologies|systems|services|bank|hospital|school|university|college"
    r"|institute|academy|department|agency|foundation|center|centre|clinic|hotel|restaurant|store)\b",
    re.I,
)
DUTY = re.compile(
    r"^(?:responsibilit|responsible|managed?|developed?|created?|implement(?:ed)?|prepared?|provided?|assist(?:ed)?\b|collaborated?|communicated?|conduct(?:ed)?|facilitat"
    r"|maintain(?:ed)?|organiz|coordinated?|handled?|taught|design(?:ed)?|support(?:ed)?|ensur|observ|supervised|participat|promot|built|led|worked)\w*\b(?!\s*$)"
    r"|^responsibilit",
    re.I,
)
HONOR = re.compile(r"dean'?s\s+list|honor|scholar|awardee|recognition|medal|rank\s+\d|magna\s+cum|president'?s\s+list", re.I)
DEGREE = re.compile(
    r"\b(?:ph\.?d\b|doctor(?:ate|al)?\b|master'?s\b|master\s+(?:of|in|degree)\b|m\.?s\.?c?\b(?=\s+in)|mba\b|m\.?a\.?\b(?=\s+in)|bachelor(?:'?s)?\b"
    r"|b\.?s\.?(?:c\.?)?\b(?=\s+(?:in\b|[A-Z]))|b\.?a\.?\b(?=\s+in)|bsed|beed|bsit|bscs|bsba|bsn|associate(?:'?s)?\s+(?:degree|of|in)|diploma\b"
    r"|senior\s+high|high\s+school|college\s+graduate)",
    re.I,
)
SCHOOL = re.compile(r"\b(?:universit(?:y|ies)|colleges?|institutes?|schools?|academy|polytechnic|universidad|université|seminary)\b", re.I)
#: One of these is in every text with a degree, or ``_SHORT_DEGREE`` finds its letters before a space; one of the others in every text with a school.
_DEGREE_WORDS = (
    "ph.d", "phd", "doctor", "master", "mba", "bachelor", "bsed", "beed", "bsit", "bscs", "bsba", "bsn", "associate", "diploma", "senior", "high", "college",
)
_SHORT_DEGREE = re.compile(r"[mb](?<!\w[mb])\.?[sa]\.?(?:c\.?)?(?=\s)")
_SCHOOL_WORDS = ("universi", "college", "institute", "school", "academy", "polytechnic", "seminary")
# Labels in front of an entry's parts, and the states that end a place.
_LABELS = {
    "client": "company", "company": "company", "employer": "company", "school": "company", "institution": "company", "organization": "company",
    "location": "place", "role": "title", "position": "title", "designation": "title", "job title": "title", "title": "title",
    "duration": "dates", "period": "dates",
}
_STATES = (
    "alabama alaska arizona arkansas california colorado connecticut delaware florida georgia hawaii idaho illinois indiana iowa kansas kentucky louisiana "
    "maine maryland massachusetts michigan minnesota mississippi missouri montana nebraska nevada ohio oklahoma oregon pennsylvania tennessee texas utah "
    "vermont virginia washington wisconsin wyoming"
).split() + ["new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "rhode island", "south carolina", "south dakota", "west virginia"]
_LABEL = re.compile(rf"(?:^|(?<=\s)(?=(?:location|role|position|designation|duration|period)\s*:))({'|'.join(k.replace(' ', ' *') for k in _LABELS)})\s*:\s*", re.I)
_GAP = re.compile(r"\s+[|–—-]\s+|\s*\|\s*|\t+|(?<![,\s])\s{2,}|\s+at\s+(?=[A-Z])|\s+@\s+")


def plain_letters(text: str) -> str:
    """Lower case, with the letters that a pattern takes for i and s whatever their case; what such a pattern spells is in it."""
    return (text if text.isascii() else text.replace("\u0130", "i").replace("\u0131", "i").replace("\u017f", "s")).lower()


def ordinal(token: str, as_of: str) -> int | None:
    """Months since year 0; a bare year is its January, a year of two digits is 20xx up to 40 and 19xx beyond."""
    low = re.sub(r"\s+", " ", token.strip().lower())
    year = lambda v: int(v) if len(v) == 4 else int(v) + (2000 if int(v) <= 40 else 1900)
    if low in ("present", "current", "till date", "to date", "now"):
        return int(as_of[:4]) * 12 + int(as_of[5:7]) - 1
    if m := re.fullmatch(r"(\d{1,2})/(\d{4}|\d{2})", low):
        return year(m[2]) * 12 + int(m[1]) - 1
    if (m := re.fullmatch(r"([a-z]+)\.?[\s,\-']*(?:\d{1,2},\s*)?(\d{4}|\d{2})", low)) and m[1][:3] in lx.MONTHS:
        return year(m[2]) * 12 + lx.MONTHS.index(m[1][:3])
    return int(low) * 12 if re.fullmatch(r"\d{4}", low) else None


def years_of(line: str, as_of: str) -> float | None:
    """The duration a line states: a date range of at least a month, or a number of years or months."""
    if m := RANGE.search(line):
        first, last = m[1], m[2]
        if not re.search(r"\d", first) and (y := re.search(r"\d{4}", last)):
            first = f"{first} {y[0]}"
        a, b = ordinal(first, as_of), ordinal(last, as_of)
        if a is not None and b is not None and 0 <= b - a <= 600:
            return round(max(1, b - a) / 12, 2)
        return None
    if m := DURATION.search(line):
        n = float(m[1])
        return round(n / 12, 2) if m[2].lower().startswith("m") else n
    return None


def tidy(value: str) -> str:
    """One line without separators at its ends; brackets stay if they close."""
    value = re.sub(r"\s+", " ", value).strip(" -–—|,;:•*\t.")
    if value.count("(") != value.count(")"):
        value = value.strip("() ")
    return value


def _fields(line: str) -> list[tuple[str | None, str]]:
    """(kind, value): the labelled parts of a line, and what stands before the first label without a kind."""
    cuts = list(_LABEL.finditer(line))
    ends = [*(m.start() for m in cuts), len(line)]
    out: list[tuple[str | None, str]] = [(None, line[: ends[0]])]
    for m, end in zip(cuts, ends[1:], strict=True):
        out.append((_LABELS[re.sub(r"job\s*title", "job title", m[1].lower())], line[m.end() : end]))
    return [(k, tidy(v)) if k else (k, v.strip()) for k, v in out if v.strip()]


def _state(value: str) -> bool:
    return bool(re.fullmatch(r"[A-Z]{2}", value)) or value.lower() in _STATES


def _employer_and_place(value: str) -> tuple[str, str]:
    """"Employer, Place" or "EMPLOYER CITY,STATE" as its two parts."""
    parts = [p for p in map(tidy, value.split(",")) if p]
    if len(parts) == 2 and _state(parts[1]):
        words = parts[0].split()
        return (" ".join(words[:-1]), f"{words[-1]}, {parts[1]}") if len(words) > 1 else ("", ", ".join(parts))
    if len(parts) > 2 and re.fullmatch(r"(?:inc|llc|ltd|corp)", parts[1], re.I):
        parts = [f"{parts[0]} {parts[1]}", *parts[2:]]
    return (parts[0], ", ".join(parts[1:])) if parts else ("", "")


class _Entry:
    """A record in the making; what was found first stays."""

    def __init__(self) -> None:
        self.title = self.company = self.place = ""

    def take(self, line: str) -> None:
        for kind, value in _fields(RANGE.sub("   ", line)):
            if kind == "title":
                self.title = self.title or value
            elif kind == "place":
                self.place = self.place or value
            elif kind == "company":
                self._employer(value)
            elif kind is None:
                self._plain([s for s in (x.strip() for x in _GAP.split(value)) if tidy(s)])

    def _employer(self, value: str) -> None:
        company, place = _employer_and_place(value)
        if "@" not in company and not self.company:
            self.company = company
            self.place = self.place or place

    def _plain(self, parts: list[str]) -> None:
        titled = [p for p in parts if TITLE.search(p)]
        # With a role beside it, what names an employer is one though it holds a role's word.
        if len(titled) > 1:
            titled = [p for p in titled if not EMPLOYER.search(p)] or titled[:1]
        for part in parts:
            pieces = [p for p in map(tidy, part.split(",")) if p]
            if part in titled and not self.title:
                own = [p for p in pieces if TITLE.search(p) and not (len(pieces) > 1 and EMPLOYER.search(p))] or pieces[:1]
                rest = [p for p in pieces if p not in own]
                self.title = ", ".join(own)
                if rest:
                    self._employer(", ".join(rest))
            elif part not in titled and not self.company:
                self._employer(part)
            elif part not in titled and not self.place and len(pieces) <= 3:
                self.place = ", ".join(pieces)

    def record(self, years: float | None) -> dict:
        return {
            "job_title": self.title or NOT_STATED, "company": self.company or NOT_IDENTIFIED, "location": self.place or NOT_IDENTIFIED,
            "years": years or 0.0, "duration_unknown": years is None,
        }


def experience(lines: list, as_of: str) -> list[dict]:
    """The work history below the headings of work experience, merged, at most 25 records."""
    text = [x.text for x in lines if x.section == "experience" and not x.heading]
    bullet = [bool(BULLET.match(t)) for t in text]
    dated = [bool(RANGE.search(t)) and not HONOR.search(t) for t in text]
    anchor = [
        d or (_LABEL.match(t) is not None and _fields(t)[0][0] == "company") or (not b and len(t) <= 90 and not t.endswith(".") and bool(TITLE.search(t) and DURATION.search(t)))
        for t, d, b in zip(text, dated, bullet, strict=True)
    ]
    used: set[int] = set()

    def plain(i: int) -> bool:
        if not 0 <= i < len(text) or not text[i] or i in used or anchor[i] or bullet[i] or DUTY.match(text[i]) or "@" in text[i]:
            return False
        flat = re.sub(r"\s+", " ", text[i])
        return len(flat) <= 90 and (not flat.endswith((".", ":")) or (len(flat.split()) <= 5 and EMPLOYER.search(flat) is not None))

    def labelled(i: int) -> bool:
        return 0 <= i < len(text) and not anchor[i] and _LABEL.match(text[i]) is not None

    found: list[dict] = []
    for i in (k for k, a in enumerate(anchor) if a):
        entry = _Entry()
        entry.take(text[i])
        when = text[i]
        used.add(i)
        below = i + 1
        while labelled(below) and below - i <= 4:
            entry.take(text[below])
            when = when if dated[i] else f"{when} {text[below]}"
            used.add(below)
            below += 1
        above: list[int] = []
        k = i - 1
        while len(above) < 2 and k >= 0 and (plain(k) or "@" in text[k]):
            above += [k] if plain(k) else []
            k -= 1
        if above and not (entry.title and entry.company):
            one = " | ".join(text[k] for k in reversed(above))
            entry.take(one)
            used.update(above)
        while not (entry.title and entry.company) and plain(below) and below - i <= 3:
            entry.take(text[below])
            used.add(below)
            below += 1
        if entry.title or entry.company:
            found.append(entry.record(years_of(when, as_of)))
    # Roles without dates: all of them where nothing is dated, else those with a sure employer.
    for i, t in enumerate(text):
        if not plain(i) or not TITLE.search(t) or len(t.split()) > 12:
            continue
        entry = _Entry()
        entry.take(t)
        if not entry.company and plain(i + 1) and not TITLE.search(text[i + 1]):
            entry.take(text[i + 1])
        if entry.title and (not any(anchor) or EMPLOYER.search(entry.company)):
            found.append(entry.record(None))
    return merged(found)


def _quality(r: dict) -> int:
    """How sure the employer of a record is."""
    same = r["company"].casefold() == r["job_title"].casefold()
    return 3 * bool(EMPLOYER.search(r["company"])) - 4 * same - 2 * (r["company"] == NOT_IDENTIFIED)


def merged(records: list[dict]) -> list[dict]:
    """Candidates in their order, the better one of each pair that tells of the same work.

    The same: equal role and employer; equal role and duration where one employer is unknown; equal
    employer and duration where one role holds the other. Last, of two records of one duration the
    role that ends with the other's has swallowed its employer and goes. Honours are no work.
    """
    out: list[dict] = []
    for r in (x for x in records if not HONOR.search(x["job_title"])):
        title, company = r["job_title"].casefold(), r["company"].casefold()
        for k, known in enumerate(out):
            t, c = known["job_title"].casefold(), known["company"].casefold()
            alike = abs(known["years"] - r["years"]) < 0.05
            if title == t and company == c:
                better = r if known["duration_unknown"] and not r["duration_unknown"] else known
                if not alike and not known["duration_unknown"] and not r["duration_unknown"]:
                    continue
            elif title == t and alike and NOT_IDENTIFIED in (known["company"], r["company"]):
                better = max(known, r, key=_quality)
            elif company == c and alike and (title in t or t in title):
                better = max(known, r, key=lambda x: len(x["job_title"]))
            else:
                continue
            out[k] = better
            break
        else:
            out.append(r)
    return [r for r in out if not any(_absorbed(r, other) for other in out)][:MOST_RECORDS]


def _absorbed(outer: dict, inner: dict) -> bool:
    """Whether the outer record's role is another one's of the same duration with more in front of it."""
    plain = lambda r: re.sub(r"[^a-z0-9]+", " ", r["job_title"].lower()).strip()
    a, b = plain(outer), plain(inner)
    return outer is not inner and outer["years"] > 0 and round(outer["years"], 2) == round(inner["years"], 2) and a != b and bool(b) and a.endswith(b)


def education(lines: list) -> list[dict]:
    """Degrees of the education sections (of all lines where there is none), each with the school of its own block.

    A block ends at an empty line. In a block that begins with a school, schools stand before
    their degrees, else behind them. A school beside the degree or behind a label comes first.
    """
    own = [x.text.partition(":")[2].strip() if x.heading else x.text for x in lines if x.section == "education"]
    if not any(own):
        rest = [x.text for x in lines if x.section != "experience"]
        low = plain_letters("\n".join(rest))
        # What the whole can't have, no line has; without a degree there is no record.
        if not (any(w in low for w in _DEGREE_WORDS) or _SHORT_DEGREE.search(low)):
            return []
        schools = any(w in low for w in _SCHOOL_WORDS)
        own = [t if DEGREE.search(t) or (schools and SCHOOL.search(t)) else "" for t in rest]
    out: list[dict] = []
    for block in "\n".join(own).split("\n\n"):
        rows = [r for r in block.split("\n") if r and not HONOR.search(r) and len(r) <= 200]
        facts = [(_degree_of(r), _school_of(r)) for r in rows]
        before = next((s is not None and d is None for d, s in facts if d or s), False)
        for i, (degree, school) in enumerate(facts):
            if degree is None:
                continue
            near = range(i - 1, -1, -1) if before else range(i + 1, len(facts))
            for j in near:
                if school is not None or facts[j][0] is not None:
                    break
                school = facts[j][1]
            out.append({"degree": degree, "institution": school or UNKNOWN_SCHOOL})
    return list({(r["degree"].lower(), r["institution"].lower()): r for r in reversed(out)}.values())[::-1]


def _undated(row: str) -> list[str]:
    row = re.sub(DATE, " ", RANGE.sub(" ", row), flags=re.I)
    return [p for p in map(tidy, re.split(rf"{_GAP.pattern}|,\s+|,(?=\.)", row)) if p]


def _degree_of(row: str) -> str | None:
    return next((p for p in _undated(row) if DEGREE.search(p) and not (SCHOOL.search(p) and not re.search(r"(?i)bachelor|master|diploma|senior\s+high|^high\s+school", p))), None)


def _school_of(row: str) -> str | None:
    kinds = _fields(row)
    if kinds and kinds[0][0] == "company":
        return tidy(re.sub(DATE, " ", kinds[0][1], flags=re.I)) or None
    degree = _degree_of(row)
    return next((p for p in _undated(row) if p != degree and SCHOOL.search(p)), None)
