import random

import numpy as np
import pytest

from dossiergrid.llm import substring_dedup as op
from tests.llm.helpers import SPACE_WORD, corpus, docs, words


def brute(rows, window):
    first, out = {}, []
    split = [SPACE_WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, split, strict=True):
        for s in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, i), i)
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for s in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def shared_passages():
    """Passages cut and joined at many places, loops of few words, and documents that start or end inside a passage."""
    rng = random.Random(4)
    long = words(rng, 400)
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            a = rng.randrange(350)
            parts += long[a : a + rng.randrange(20, 200)] + words(rng, rng.randrange(0, 15), 30)
        rows.append((9000 - i, "  ".join(parts)))
    return rows + [(1, "loop " * 120), (2, "loop " * 300), (3, "a b " * 80), (4, "b a " * 80), (None, " ".join(long))]


@pytest.mark.parametrize(("window", "many"), [(50, False), (50, True), (12, False), (3, False), (1, False)])
def test_against_brute_force(spark, monkeypatch, window, many):
    if many:
        monkeypatch.setattr(op, "BROADCAST_ROWS", -1)
    rows = corpus() + shared_passages()
    got = op.substring_dedup(docs(spark, rows), window).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, window)


def test_empty(spark):
    assert op.substring_dedup(docs(spark, [])).count() == 0
    got = op.substring_dedup(docs(spark, [(1, None), (2, "a  b")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, ""), (2, 2, 0, "a b")]


def test_samples_depend_on_the_window_alone():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    start, node = op.sampled(op.Runs(text), np.zeros(500, int), 20, 50)
    assert list(start) == list(range(451))
    for s in range(0, 451, 7):
        _, alone = op.sampled(op.Runs(text[s : s + 50]), np.zeros(50, int), 20, 50)
        assert alone[0] == node[s] - s


def test_hot_pieces_and_words_at_the_source(spark, monkeypatch):
    """With every repeated hash counted as hot the result is the same; a span's digest is that of the words at its source."""
    from dossiergrid import hot_keys

    monkeypatch.setattr(hot_keys, "LEAST", 0)
    monkeypatch.setattr(hot_keys, "SHARE", 0.0)
    rows = shared_passages()
    assert sorted(map(tuple, op.substring_dedup(docs(spark, rows), 12).collect()), key=repr) == brute(rows, 12)
    texts = spark.createDataFrame([(1, 7, bytearray(b"a b c d"))], "doc_id long, text_key long, text binary")
    spans = spark.createDataFrame([(2, 8, 0, 2, 1, 7, 1)], "doc_id long, text_key long, from_word int, to_word int, s_doc long, s_key long, s_from int")
    assert bytes(op._verified(texts, spans).first().digest) == op._digest([b"b", b"c"])
