import math
import re
from collections import defaultdict

import pytest

from dossiergrid.llm import pii as op
from tests.llm.helpers import docs

# The contract's expressions, matched as they stand.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def holds(kind, value):
    d = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) <= 255 for p in re.findall("[0-9]+", value)) if kind == "ip" else None, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m[0])]


def brute(rows):
    """Per text, its base spans and the terms that give an entity away, with their rest of bits."""
    near, df = {}, defaultdict(int)
    for n, (_, text) in enumerate(rows):
        text = text or ""
        for w in {m[0] for m in re.finditer(r"[^\W_]{3,}", text.lower())}:
            df[w] += 1
        spans, near[n] = base(text), []
        inside = lambda m: any(a < m.end() and m.start() < b for _, a, b in spans)  # noqa: B023, E731
        words = [m for m in re.finditer(r"[^\W_]{3,}", text) if not inside(m)]
        for k, a, b in spans:
            left = [m for m in words if m.end() <= a and m.start() >= a - op.REACH][-op.WINDOW :]
            right = [m for m in words if m.start() >= b and m.end() <= b + op.REACH][: op.WINDOW]
            value = text[a:b].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])
            context = " ".join(m[0].lower() for m in left + right)
            near[n] += [((k, value), m[0].lower(), context, m.start(), m.end()) for m in left + right]
    together, contexts = defaultdict(set), defaultdict(set)
    for n, found in near.items():
        for e, t, c, _, _ in found:
            together[e, t].add(n)
            contexts[e, t].add(c)
    out = []
    for n, (i, text) in enumerate(rows):
        terms = {}
        for e, t, _, a, b in near[n]:
            rest = -math.log2(len(together[e, t]) / df[t])
            if len(contexts[e, t]) >= op.LEAST_CONTEXTS and rest <= op.GENERALISE_BITS:
                terms[a, b] = terms.get((a, b), False) or rest <= op.REMOVE_BITS
        spans = base(text or "")
        out.append((i, ",".join(f"{k}:{a}:{b}" for k, a, b in spans), tuple((a, b, r) for (a, b), r in sorted(terms.items()))))
    return out


MAIL, CARD = "anna.lee@mail.example.org", "4556 7375 8689 9855"
ROWS = [
    (1, f"quick brown write to Zelda Marsh {MAIL} before monday or later"), (2, f"other words then Zelda Marsh at {MAIL.upper()} again and again"),
    (3, f"nothing like it Zelda {MAIL} tuesday is fine for Marsh maybe"), (4, f"once more the card {CARD} of Quorn and {MAIL} Zelda"),
    (5, f"the card 4556737586899855 of Quorn was used here today"), (6, f"who paid with {CARD.replace(' ', '-')} asks Quorn in town"), (7, "the card of nobody and the word again"),
    (8, "Quorn alone without any number"), (8, "Quorn alone without any number"), (9, None), (10, ""), (11, "see 10.0.0.1 or 300.1.1.1 or 1.2.3.4.5.6.7.8 or 0001.02.3.255"),
    (12, "a@b@c.d.e a@b.c@d.e @x.y ..@z.q-r é@ü.com x+y%z@a-b.co."), (13, "call +1 (017) 555-7713 or +63 917 123 4567 8901 2345 or +12 or ++49-30-1234567."), (None, "1234567890123 4539578763621486 4 5 3 9 5 7 8 7 6 3 6 2 1 4 8 6"),
    (14, "word " * 30_000 + MAIL + " Zelda " + "1" * 20_000 + " " + "a" * 20_000), (15, f"{MAIL} " * 300), (16, f"same passage around Vex {'b@c.de'} here"), (17, f"same passage around Vex {'b@c.de'} here"),
    (18, f"same passage around Vex {'b@c.de'} here"),
]


@pytest.mark.parametrize("most", [op.MOST_TERMS, 0])
def test_against_brute_force(spark, monkeypatch, most):
    """With ``most`` 0 all words are counted instead of the candidates only."""
    monkeypatch.setattr(op, "MOST_TERMS", most)
    got = op.find_personal_data(docs(spark, ROWS)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(brute(ROWS), key=key)
    assert sorted(((r.doc_id, r.base, tuple(tuple(t) for t in r.terms)) for r in got), key=key) == want
    assert any(t for _, _, t in want) and all(not t for i, _, t in want if i in (7, 8, 9, 10, 16, 17, 18))
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got if r.doc_id in (4, 11)} == {4: (1, 0, 1, 0), 11: (0, 4, 0, 0)}


def test_terms_by_their_rest(spark):
    got = {r.doc_id: r.text for r in op.sanitise(docs(spark, ROWS)).collect()}
    assert "Zelda" not in got[1] and "[REMOVED]" in got[1] and MAIL not in got[1] and "[EMAIL]" in got[1]
    # Quorn also stands in two rows without the card: 3 of 5 leave less than a bit.
    assert "Quorn" in got[8] and "Quorn" not in got[5] and "[CARD]" in got[5]
    assert got[9] is None and got[10] == "" and len(got) == len({i for i, _ in ROWS})


def test_spans_column(spark):
    got = {r.doc_id: r.s for r in op.find_personal_data(docs(spark, ROWS)).withColumn("s", op.all_spans(op.F.col("base"), op.F.col("terms"))).collect()}
    assert got[10] == "" and got[16] == "email:24:30" and got[1].startswith("email:33:58,term:")


def test_empty_table(spark):
    assert op.find_personal_data(docs(spark, [])).count() == 0 and op.sanitise(docs(spark, [])).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: b for i, b, _ in brute(rows)}
    got = {r.doc_id: r for r in op.op11_personal_data(spark, sf).collect()}
    assert {i: ",".join(x for x in r.spans.split(",") if not x.startswith("term")) for i, r in got.items()} == want and any(want.values())


def test_terms_anywhere_in_the_text(spark):
    """A term gives an entity away wherever it stands: here 40 words and some 2000 code points off, on either side."""
    far = lambda n: " ".join(f"w{n}x{k}" + "y" * 45 for k in range(40))
    rows = [(n, f"Zelda {far(n)} {MAIL} {far(n + 10)} Marsh") for n in range(3)] + [(8, "Marsh and many others"), (9, "nobody here")]
    got = {r.doc_id: r for r in op.find_personal_data(docs(spark, rows)).collect()}
    for n, text in rows[:3]:
        assert [(text[t.start : t.end], t.removed) for t in got[n].terms] == [("Zelda", True), ("Marsh", True)]
    assert not got[8].terms and not got[9].terms
