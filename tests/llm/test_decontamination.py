import hashlib

import pytest

from dossiergrid.llm import decontamination as op
from tests.llm.helpers import ALNUM_WORD, corpus, docs, lower, words


def brute(rows, items, width=10):
    split = lambda t: [lower(x) for x in ALNUM_WORD.findall(t or "")]
    wins = {}
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - width + 1)) if w else ():
            wins.setdefault(tuple(w[s : s + width]), set()).add(i)
    sizes, out = {len(x) for x in wins}, []
    for d, t in rows:
        w = split(t)
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (key := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[key]
        text = ",".join(sorted(str(i) for i in found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(text.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def items_of(rows):
    """Items cut from documents, short ones, one of a single word, repeated ones, and some without words."""
    import random

    rng = random.Random(5)
    items = []
    for k, (_, t) in enumerate(rows[:25]):
        w = ALNUM_WORD.findall(t or "")
        n = [12, 30, 4, 10, 2][k % 5]
        items.append((k, "  ".join(w[len(w) // 3 : len(w) // 3 + n])))
    return items + [(90, " ".join(words(rng, 40))), (91, None), (92, "..."), (93, items[1][1]), (94, "w1"), (95, "W7, w7")]


@pytest.mark.parametrize("few", [True, False])
def test_against_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(op, "BROADCAST_ROWS", -1)
    rows = corpus() + [(None, corpus()[2][1]), (7, "w7 w7 w7 w7")]
    items = items_of(rows)
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as term", "2 as window_id")
    got = op.decontaminate(docs(spark, rows), table).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, items)


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = op.decontaminate(docs(spark, [(1, "a b c"), (2, None)]), none).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got) == [(1, 3, 0, False), (2, 0, 0, False)]
    assert op.decontaminate(docs(spark, []), none).count() == 0


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = [(1, "gamma x alpha y z beta"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "beta gamma alpha"), (4, "alpha beta")]
    index = op.build_index(docs(spark, rows), items)
    met = op.proximity_matches(index, slop=3).join(index.rows, "row_id")
    assert sorted({r.doc_id for r in met.collect()}) == [1, 3]
    assert op.exact_matches(index).count() == 0


def test_proximity_against_brute_force(spark):
    import random

    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 60), 12))) for i in range(60)] + [(None, "w1 w2 w3"), (70, None), (3, "w3 w2 w2 w1")]
    items = [(1, "w1 w2 w3"), (2, "w4 w4"), (3, "w5 w6 w7 w8 w9"), (4, "w1 zzz"), (5, None), (6, "w2")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in op.near_items(docs(spark, rows), table, width=4, slop=2).collect()), key=repr)
    lower_words = lambda t: [w.lower() for w in ALNUM_WORD.findall(t or "")]
    count = {}
    for _, t in rows:
        for w in lower_words(t):
            count[w] = count.get(w, 0) + 1
    want = []
    for i, t in rows:
        w = lower_words(t)
        for k, x in items:
            own = lower_words(x)
            cuts = [own[s : s + 4] for s in range(max(1, len(own) - 3))] if own else []
            if any(
                any(all(any(w[q] == term for q in range(max(0, p - len(c) - 2), min(len(w), p + len(c) + 3))) for term in c) for p in range(len(w)) if w[p] == r)
                for c in cuts if all(term in count for term in c)
                for r in [min(enumerate(c), key=lambda e: (count[e[1]], e[0]))[1]]
            ):
                want.append((i, k))
    assert got == sorted(want, key=repr) and len(got) > 20
