import hashlib
import math

import numpy as np
import pytest

from dossiergrid.llm import vector_codes as op

SCHEMA = "vec_id long, embedding array<float>, label int, part int, position string, n long, entry int"


def made(spark, rows):
    """(vec_id, vector, label), with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, v, y, 1, "x", 2, 3) for i, v, y in rows], SCHEMA)


def brute(rows):
    """Plain Lloyd rounds over all rows, without folding equal parts."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    w = len(kept[0][1]) // 4
    part = lambda v, k: v[k * w : (k + 1) * w]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))[:256]
    books = [[part(v, k) for _, v, _ in first] for k in range(4)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(4):
        for k in range(4):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(part(v, k), books[k])[1], []).append(part(v, k))
            books[k] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[k])]
    out = []
    for i, v, y in kept:
        best = [near(part(v, k), books[k]) for k in range(4)]
        out.append((i, y, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    by = {}
    for _, y, _, e in out:
        by[y] = by.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, y, c, e, by[y]) for i, y, c, e in out), key=str), digest


def vectors(n, width=8, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, spread, (max(1, n // 3), width)).astype(np.float32)
    return [(i, [float(x) for x in (base[rng.integers(len(base))] if rng.random() < 0.5 else rng.normal(0, spread, width).astype(np.float32))], int(rng.integers(4)) if rng.random() < 0.9 else None) for i in range(n)]


NAN, INF = float("nan"), float("inf")
ODD = [(900, None, 1), (901, [None] + [0.5] * 7, 1), (902, [NAN] + [0.5] * 7, 2), (903, [-INF] + [0.5] * 7, None), (904, [-0.0001] * 8, None), (904, [-0.0001] * 8, None), (5000, [0.25] * 8, 7)]


@pytest.mark.parametrize(("n", "spread"), [(330, 1.0), (40, 60.0), (300, 0.004)])
def test_against_brute_force(spark, n, spread):
    """Wide and narrow components, fewer vectors than entries, and many ties."""
    rows = vectors(n, spread=spread) + ODD
    found = op.compress(made(spark, rows))
    want, digest = brute(rows)
    assert sorted((tuple(r) for r in found.rows.select("vec_id", "label", "code", "error", "label_error").collect()), key=str) == want
    assert found.codebooks_sha256 == digest


def test_hot_vector(spark, monkeypatch):
    """Equal vectors by the hundred meet their codes by a broadcast, and each keeps its row."""
    from dossiergrid import hot_keys

    monkeypatch.setattr(hot_keys, "LEAST", 10)
    rows = vectors(60) + [(1000 + i, [0.125] * 8, 1) for i in range(150)] + [(None, [0.125] * 8, 1)] * 3
    found = op.compress(made(spark, rows))
    want, digest = brute(rows)
    assert sorted((tuple(r) for r in found.rows.select("vec_id", "label", "code", "error", "label_error").collect()), key=str) == want and found.codebooks_sha256 == digest


def test_large_components_are_exact():
    rng = np.random.default_rng(5)
    x, book = rng.integers(-(2**25), 2**25, (50, 64)), rng.integers(-(2**25), 2**25, (20, 64))
    apart = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    code, error = op.nearest(x, book)
    assert (code == apart.argmin(axis=1)).all() and (error == apart.min(axis=1)).all()


def test_nothing_and_unequal_lengths(spark):
    none = op.compress(made(spark, [(1, None, 2)]))
    assert none.rows.count() == 0 and len(none.codebooks_sha256) == 64 and op.compress(made(spark, [])).rows.count() == 0
    for bad in ([(1, [0.5] * 8, 1), (2, [0.5] * 4, 1)], [(1, [0.5] * 6, 1)], [(1, [1e9] * 8, 1)]):
        with pytest.raises(Exception, match="must"):
            op.compress(made(spark, bad)).rows.collect()
