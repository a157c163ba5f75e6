import random

import numpy as np
import pytest

from dossiergrid.llm import jaccard_join as op
from dossiergrid.components import connected_components
from tests.llm.helpers import SPACE_WORD, corpus, docs, lower, words


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = [lower(x) for x in SPACE_WORD.findall(t or "")]
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min((x for x in (least.get(find(k)), i) if x is not None), default=None)
    return sorted(((i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near_copies(n=40):
    rng = random.Random(9)
    base, out = words(rng, 150), []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
        out.append((7000 + i, " ".join(w)))
    return out


@pytest.mark.parametrize(("width", "percent", "many"), [(4, 85, True), (5, 80, False)])
def test_against_brute_force(spark, monkeypatch, width, percent, many):
    if many:
        monkeypatch.setattr(op, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(op, "LIST", 4)
        monkeypatch.setattr(op, "DEALT", 3)
    rows = corpus(n=80) + near_copies() + [(None, "lonely words here"), (8000, "a b c"), (8001, "A  b\nC"), (8002, "a b")]
    # A repeated identifier with another text is one document of two sets.
    got = op.jaccard_components(docs(spark, rows), op.Rule(width, percent)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, width, percent)


def test_empty(spark):
    assert op.jaccard_components(docs(spark, [])).count() == 0
    got = op.jaccard_components(docs(spark, [(2, None), (1, " "), (3, "")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_suffix_filter_rejects_no_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(rng.integers(0, 200, 60).astype(np.uint64))
        y = np.unique(np.where(rng.random(len(x)) < 0.8, x, rng.integers(0, 200, len(x)).astype(np.uint64)))
        differ = len(x) + len(y) - 2 * len(np.intersect1d(x, y))
        assert op.suffix_filter(x, y, differ)
    assert not op.suffix_filter(np.arange(50, dtype=np.uint64), np.arange(1000, 1050, dtype=np.uint64), 10)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 200), (301, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {x: 100 for x in range(101, 130)} | {301: 300}
