import hashlib
import random
import zlib

import pytest

from dossiergrid.llm import manifest as op
from tests.llm.helpers import docs, lower


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tower(nodes):
    """The root, and per node its siblings from level to level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            paths[i].append((run[: p % 16], run[p % 16 + 1 :]))
        nodes, at = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)], [p // 16 for p in at]
    return nodes[0], paths


def brute(rows):
    """``rows``: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    towers = {s: tower([leaf(r) for r in own[s]]) for s in names}
    root, tops = tower([towers[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for r, path in zip(own[s], towers[s][1], strict=True):
            path = path + top
            forged = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf((*r[:4], None if r[4] is None else lower(r[4]))) if forged else leaf(r)
            for a, b in path:
                node = h(*a, node, *b)
            out.append((r[0], leaf(r), towers[s][0], root, h(*(x for a, b in path for x in a + b)), node, node == root))
    return sorted(out, key=str)


def made(spark, rows):
    full = [(i, t, lang, s, n, 1, "x", "y", 2, "z", "q") for i, s, lang, n, t in rows]
    return spark.createDataFrame(full, docs(spark, []).schema)


def rows_of(n, sources, seed=3):
    rng = random.Random(seed)
    out = [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, i]), f"Text {i} É") for i in range(n)]
    return out + [(None, "b", "en", 1, "No Id"), (None, "b", "en", 1, "No Id"), (7, "b", None, None, None), (8, "c", "", 0, ""), (7, "b", None, None, None), (9, None, "en", 1, "A" * 100_000)]


@pytest.mark.parametrize(("levels", "n", "sources"), [(3, 40, ["a", "b", None]), (1, 700, ["a", "a", "a", "b", "", None]), (2, 300, ["é", "z", "Z"])])
def test_against_brute_force(spark, levels, n, sources):
    """Fewer levels a block make more tiers."""
    rows = rows_of(n, sources)
    got = op.manifest(made(spark, rows), levels=levels).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert {r.verified for r in got} == {True, False}


def test_many_sources(spark):
    rows = [(i, f"s{i}", "en", 1, "T") for i in range(40)] + [(100 + i, "s1", "en", 1, "T") for i in range(20)]
    assert sorted((tuple(r) for r in op.manifest(made(spark, rows), levels=1).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 1000])
def test_traversal(n):
    """The paths of a traversal are those of the whole tree, and it never holds it."""
    leaves = [h(str(i)) for i in range(n)]
    root, want = tower(list(leaves))
    walk = op.Traversal(leaves, op.height(n))
    assert walk.root == root
    for path, expected in zip(walk, want, strict=True):
        assert path == expected
        held = sum(map(len, walk.existing)) + sum(len(x) for g in walk.desired for x in g.open)
        assert held <= 16 * (walk.levels + 1) ** 2


def test_one_row_and_no_rows(spark):
    assert op.manifest(made(spark, [])).count() == 0
    row = (1, "a", "en", 1, "lower")
    got = op.manifest(made(spark, [row])).first()
    assert got.leaf == got.subroot == got.root == leaf(row) and got.proof_sha256 == h("") and got.verified
