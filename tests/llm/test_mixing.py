import math

import pytest

from dossiergrid.llm import mixing as op
from tests.llm.helpers import SPACE_WORD, corpus, docs


def water_fill(sizes, weights, cap):
    """The targets by repeated sharing, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_w = sum(w[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * w[s] / open_w for s in names}
        over = {s for s in names if s not in full and target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


def rows_with_sources():
    # The corpus with sources of very different size, one null, one without words.
    return [(i, t, ["big", "big", "big", "small", None][k % 5] if k % 11 else "tiny") for k, (i, t) in enumerate(corpus())] + [(5000, None, "void")]


def test_contract(spark):
    rows = rows_with_sources()
    mix = op.mix_sources(docs(spark, rows))
    got = mix.documents.collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(SPACE_WORD.findall(t or ""))
    target = water_fill(sizes, (5, 2, 1), 3)
    assert sorted((r.doc_id, r.size, r.source or "") for r in got) == sorted((i, len(SPACE_WORD.findall(t or "")), s or "") for i, t, s in rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 8 for s in sizes)


def test_schedule_is_whole_and_repeats(spark):
    first = op.mix_sources(docs(spark, rows_with_sources()))
    again = op.mix_sources(docs(spark, list(reversed(rows_with_sources()))))
    a, b = (sorted((r.slot, r.source or "", r.doc_id, r.epoch, r.first_word, r.n_words) for r in m.schedule.collect()) for m in (first, again))
    assert a == b and min(x[5] for x in a) > 0
    per_slot = {}
    for slot, source, *_ in a:
        per_slot.setdefault(slot, set()).add(source)
    assert all(len(s) == 1 for s in per_slot.values())


def test_low_discrepancy(spark):
    """Any stretch of the schedule has about the right share of each source."""
    mix = op.mix_sources(docs(spark, [(i, "a " * 997, s) for i, s in enumerate("aabbbbbbccccccccc")]))
    slots = sorted({(r.slot, r.source) for r in mix.schedule.collect()})
    share = {r.source: r.hi - r.lo for r in mix.sources.collect()}
    for at in range(0, len(slots) - 500, 500):
        for s, p in share.items():
            assert abs(sum(x[1] == s for x in slots[at : at + 500]) - 500 * p) < 8


def test_empty(spark):
    assert op.mix_sources(docs(spark, [])).documents.count() == 0
    got = op.mix_sources(docs(spark, [(1, None, None), (2, " ", "a"), (None, "", "a")])).documents.collect()
    assert [r.taken for r in got] == [0, 0, 0] and {r.target for r in got} == {0.0}


def test_small_sources_in_a_large_total(spark):
    """A source whose target is below one slot, or a few, is neither lost nor taken up to its cap."""
    big = spark.range(16 * 42).selectExpr("id doc_id", "repeat('a ', 10000) text", "concat('big', id % 16) source")
    tail = spark.range(64).selectExpr("10000 + id doc_id", "repeat('b ', int(3 + 7 * (id % 32))) text", "if(id % 32 = 9, null, concat('tail', id % 32)) source")
    mix = op.mix_sources(big.union(tail))
    got, pieces = mix.documents.collect(), mix.schedule.collect()
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    target, taken, per_slot, owner = {r.source: r.target for r in got}, {}, {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(taken) == 48 and min(taken.values()) > 0
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 0.5 for s in taken)
    for r in pieces:
        per_slot[r.slot] = per_slot.get(r.slot, 0) + r.n_words
        owner.setdefault(r.slot, set()).add(r.source)
    assert min(r.n_words for r in pieces) > 0 and all(len(s) == 1 for s in owner.values())
    assert max(per_slot.values()) == 102 and sum(per_slot.values()) == sum(taken.values())


def test_long_tail_against_sql(spark, tmp_path):
    """Small sources beside large ones, whose targets whole slots miss, take what the SQL says."""
    import random

    import duckdb

    rng = random.Random(11)
    rows = [(i, "w " * rng.randrange(900, 1100), f"big{i % 3}") for i in range(300)] + [(1000 + i, "x y z", f"tail{i % 20:02d}") for i in range(60)] + [(2000, "a b", None), (2001, None, "tail00")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = op.op9_mix_sources(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.sql(op.OP9_SQL)
    order = [found.columns.index(c) for c in ("doc_id", "size", "source_size", "target", "taken")]
    want = {r[order[0]]: [r[i] for i in order[1:]] for r in found.fetchall()}
    assert {r.doc_id: [r["size"], r.source_size, pytest.approx(r.target), r.taken] for r in got} == want
    assert sum(r.taken for r in got if r.doc_id // 20 == 50) > 0
