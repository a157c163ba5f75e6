from collections import defaultdict

import numpy as np
import pytest

from dossiergrid.llm.line_dedup import CuckooFilter, LineIndex
from tests.llm.helpers import docs, lower

LONG = "a line of more than forty characters, number "


def brute(rows, min_docs=5, min_chars=40):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    top = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in top or i == top[key(x)]]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def rows(n=30):
    out = []
    for i in range(n):
        lines = [f"own line {i} " + "x" * 40, LONG + str(i % 4), "short", "É" * 40 + str(i % 7)]
        if i % 3 == 0:
            lines.append("  " + (LONG + str(i % 4)).upper() + "\t")
        out.append((i, "\n".join(lines)))
    return out + [(100, None), (101, ""), (102, "\n\n"), (103, (LONG + "1\n") * 3000), (None, LONG + "2\nz"), out[7]]


def got(index, table):
    return sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in index.apply(table).collect()), key=repr)


def test_against_brute_force(spark):
    table = docs(spark, rows())
    assert got(LineIndex.empty(spark).insert(table), table) == brute(rows())
    assert LineIndex.empty(spark).insert(docs(spark, [])).apply(docs(spark, [])).count() == 0
    assert got(LineIndex.empty(spark), table) == sorted([(i, t or "", (t or "").count("\n") + 1, 0) for i, t in rows()], key=repr)


def test_insertions_and_deletions_are_reversible(spark):
    old, new = rows()[:24], [(200 + i, t) for i, t in rows()[:20] if i is not None]
    a, b = docs(spark, old), docs(spark, new)
    first = LineIndex.empty(spark, shards=4).insert(a)
    both = first.insert(b)
    whole = docs(spark, old + new)
    assert got(both, whole) == brute(old + new)
    assert both.insert(b).counts.exceptAll(both.counts).isEmpty()
    back = both.delete(b.select("doc_id"))
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, first.counts.collect()))
    assert got(back, a) == brute(old)
    # No frequent key is missing in the filters, and the deleted ones are gone from them but for false positives.
    from dossiergrid.llm.line_dedup import _hashes

    filters = {r.shard: CuckooFilter.from_bytes(bytes(r.blob)) for r in back.filters.collect()}
    frequent = [r for r in back.counts.collect() if r.n_docs >= 5]
    assert frequent and all(filters[r.shard].might_hold(_hashes([bytes(r.key)]))[0] for r in frequent)


def test_more_shards_merged_changes_and_full_filters(spark, monkeypatch):
    """Many small changes with tiny shards give the tables of one insertion."""
    from dossiergrid.llm import line_dedup as op

    monkeypatch.setattr(op, "SHARD_KEYS", 2)
    monkeypatch.setattr(op, "DELTAS", 2)
    all_rows = rows() + [(300 + i, LONG + str(i // 6)) for i in range(60)]
    index = LineIndex.empty(spark, shards=1)
    for k in range(0, len(all_rows), 30):
        index = index.insert(docs(spark, all_rows[k : k + 30]))
    index = index.delete(docs(spark, [(7, ""), (303, "")]).select("doc_id"))
    kept = [r for r in all_rows if r[0] not in (7, 303)]
    assert index.shards > 1 and len(index.steps) <= 2
    assert got(index, docs(spark, kept)) == brute(kept)


@pytest.mark.parametrize("n", [0, 1, 1000, 20000])
def test_cuckoo_filter(n):
    rng = np.random.default_rng(n)
    hashes = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    held = CuckooFilter.sized(n)
    assert held.add(hashes) and held.might_hold(hashes).all()
    held = CuckooFilter.from_bytes(held.to_bytes())
    other = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert held.might_hold(other).mean() < 0.01
    held.remove(hashes[: n // 2])
    assert held.might_hold(hashes[n // 2 :]).all()
    held.remove(hashes[n // 2 :])
    assert not held.table.any()


def test_overfull_filter():
    held = CuckooFilter(np.zeros((16, 4), np.uint16))
    assert not held.add(np.random.default_rng(0).integers(0, 1 << 63, 80, dtype=np.uint64))


def test_lines_of_a_shard_without_a_filter(spark, monkeypatch):
    """Where no filter can be built, the exact counts alone decide, and later changes try again."""
    from dossiergrid.llm import line_dedup as op

    real = op._updated
    monkeypatch.setattr(op, "_updated", lambda *a: real(*a).withColumn("blob", op.F.lit(None).cast("binary")))
    all_rows = rows()
    table = docs(spark, all_rows)
    index = LineIndex.empty(spark, shards=4).insert(table)
    assert {bytes(r.blob) for r in index.filters.collect()} == {b""}
    want = brute(all_rows)
    assert got(index, table) == want and sum(r[3] for r in want) > 0
    monkeypatch.setattr(op, "_updated", real)
    more = [(500 + i, LONG + f"new {i // 8}") for i in range(32)]
    later = index.insert(docs(spark, more))
    assert got(later, docs(spark, all_rows + more)) == brute(all_rows + more)
    assert any(len(r.blob) for r in later.filters.collect())
