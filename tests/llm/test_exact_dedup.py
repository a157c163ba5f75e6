import hashlib
from collections import defaultdict

import pytest

from dossiergrid.llm import exact_dedup as op
from tests.llm.helpers import corpus, docs, lower


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t or "")].append(i)
    best = {t: (max if keep == "max" else min)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return sorted((i, best[lower(t or "")], len(groups[lower(t or "")]), hashlib.sha256(lower(t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("least", [64, 1])
def test_against_brute_force(spark, monkeypatch, keep, least):
    """With ``least`` 1 the large groups are dealt into pieces and joined again."""
    monkeypatch.setattr(op, "LEAST_HOT_ROWS", least)
    rows = corpus() + [(2000 + i, "One Text") for i in range(150)]
    got = op.exact_dedup(docs(spark, rows), keep=keep).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(rows, keep)
    kept = defaultdict(list)
    for r in got:
        kept[r.text_sha256] += [r.doc_id] if r.kept else []
    assert all(len(ids) == 1 for ids in kept.values())
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_null_identifiers_and_case(spark):
    got = op.exact_dedup(docs(spark, [(None, "a"), (None, "A"), (5, "B"), (None, "b"), (6, "É"), (7, "é")]), keep="min").collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 4
    pairs = sorted(((r.doc_id, r.keep_id, r.kept) for r in got if r.group_size == 2), key=repr)
    assert sorted(pairs, key=repr) == sorted([(None, None, True), (None, None, False), (5, 5, True), (None, 5, False)], key=repr)


def test_empty_table_and_carry(spark):
    assert op.exact_dedup(docs(spark, [])).count() == 0
    got = op.exact_dedup(docs(spark, [(1, "Ab", "s"), (2, "aB", "t")]), carry=("text", "source")).where("kept").collect()
    assert [(r.doc_id, r.text, r.source) for r in got] == [(1, "Ab", "s")]
    with pytest.raises(ValueError):
        op.exact_dedup(docs(spark, []), keep="any")


def test_hot_text_without_own_identifiers(spark, monkeypatch):
    """Rows of a hot text are dealt to all its pieces also where they share an identifier or have none, and one of them stays."""
    monkeypatch.setattr(op, "LEAST_HOT_ROWS", 16)
    written = []
    real = op.materialize
    monkeypatch.setattr(op, "materialize", lambda df, name: written.append(real(df, name)) or written[-1])
    for shared in (None, 7):
        rows = [(shared, "Hot Text")] * 400 + [(9, "other"), (shared, "x")]
        got = op.exact_dedup(docs(spark, rows).repartition(4), keep="max").collect()
        assert len(got) == 402 and sum(r.kept for r in got) == 3
        hot = [r for r in got if r.group_size == 400]
        assert len(hot) == 400 and sum(r.kept for r in hot) == 1 and {r.keep_id for r in hot} == {shared}
        pieces = written[-1].where("__s >= 0").groupBy("__s").count().collect()
        assert len(pieces) > 10 and max(r["count"] for r in pieces) < 100
