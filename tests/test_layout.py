"""Lines of pages against the layout of one page at a time."""

import random

import pytest

from dossiergrid.operators import layout
from dossiergrid.sources import documents

WORDS = "page long, text string, x0 double, x1 double, top double"


def page(rng, kind):
    out = []
    for row in range(rng.randrange(8, 30)):
        top = 50.0 + row * 13 + (rng.random() * 2 if rng.random() < 0.3 else 0)
        spans = {"two": [(40, 270), (320, 560)], "one": [(40, 560)], "narrow": [(40, 300), (310, 560)], "left": [(40, 190), (240, 560)]}[kind]
        for k, (a, b) in enumerate(spans):
            x = a + rng.randrange(4)
            while x < b - 45 and rng.random() < 0.92:
                w = rng.randrange(10, 40)
                out.append((f"{k}w{row}x{int(x)}", float(x), float(min(b, x + w)), top + (k and rng.random())))
                x += w + rng.choice([4, 4, 5, 14])
        if rng.random() < 0.03:
            out.append(("crosses", 250.0, 340.0, top))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pages(spark, seed):
    rng = random.Random(seed)
    pages = {i: page(rng, rng.choice(["two", "two", "one", "narrow", "left"])) for i in range(40)}
    pages |= {100: pages[0][:20], 101: [("  ", 1.0, 2.0, 3.0)]}
    rows = [(i, *w) for i, ws in pages.items() for w in ws] + [(102, None, 1.0, 2.0, 3.0), (102, "no place", None, 2.0, 3.0), (103, "unsized", 1.0, 2.0, 3.0)]
    sizes = [(i, 600.0 if i % 5 else 612.0) for i in pages] + [(102, 0.0), (103, None), (104, 600.0)]
    words, sized = spark.createDataFrame(rows, WORDS), spark.createDataFrame(sizes, "page long, width double")
    plain = {i: [dict(zip(("text", "x0", "x1", "top"), w, strict=True)) for w in ws] for i, ws in pages.items()}
    want = {i: g for i, _ in sizes if i in plain and (g := documents.column_gutter(plain[i], dict(sizes)[i]))}
    got = {r.page: (r.left, r.right) for r in layout.gutters(words, sized).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want) and 5 < len(want) < 40
    text = {}
    for r in layout.page_lines(words, sized).orderBy("page", "line_no").collect():
        text.setdefault(r.page, []).append(r.line)
    expected = {i: documents.page_text(ws, dict(sizes)[i]).split("\n") for i, ws in plain.items()}
    assert text == {i: t for i, t in expected.items() if t != [""]} | {103: ["unsized"]}


def test_no_pages(spark):
    words, sized = spark.createDataFrame([], WORDS), spark.createDataFrame([], "page long, width double")
    assert layout.page_lines(words, sized).count() == 0 and layout.gutters(words, sized).count() == 0
