import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossiergrid.llm import language_id, quality
from tests.llm.helpers import docs

SF = "/root/testdata/sf0.01"


def test_codewords():
    for n in (2, 3, 4, 5, 6, 20):
        code = language_id.codewords(n)
        distance = [(a != b).sum() for k, a in enumerate(code) for b in code[:k]]
        assert code.shape[0] == n and min(distance) >= (1 if n < 3 else 2)
        assert all(abs(c.sum()) < n for c in code.T)
    assert language_id.codewords(4).shape[1] == 7
    assert language_id.codewords(1).shape == (1, 0)


def test_features_of_long_and_grouped_texts(monkeypatch):
    texts = [b"abc def", b"", b"\xc3\xa9t\xc3\xa9", b"word " * 500]
    whole = np.concatenate(list(language_id.features(texts)))
    alone = np.concatenate([x for t in texts for x in language_id.features([t])])
    assert np.allclose(whole, alone) and whole.shape == (4, language_id.FEATURES)
    monkeypatch.setattr(language_id, "BLOCK", 1000)
    assert np.allclose(np.concatenate(list(language_id.features(texts))), whole, atol=0.02)


def test_language_of_held_out_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(table, language_id.train(table)).join(table.select("doc_id", "lang"), "doc_id")
    got = got.where(language_id.held_out(F.col("doc_id"))).select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"), "score")
    right, n = got.agg(F.sum("ok"), F.count("ok")).first()
    assert n > 200 and right / n > 0.97
    assert got.where("score < 0 or score > 1").isEmpty()


def test_language_edge_cases(spark):
    rng = random.Random(1)
    vocabulary = {"en": ["the", "house", "with"], "fr": ["été", "où", "maison"]}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(30)), "s", lang) for i, lang in enumerate(["en", "fr"] * 30)]
    rows += [(100, None, "s", "en"), (101, "12 34 !!", "s", "fr"), (None, "the house", "s", None), (None, "", None, None), (5, rows[5][1], "s", "fr")]
    rows += [(102, "maison été " * 200_000, "s", None)]
    table = docs(spark, rows)
    got = language_id.identify(table, language_id.train(table), carry=("source", "key")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[100].lang_pred == by[101].lang_pred == "und" and by[100].score == 0
    assert by[102].lang_pred == "fr" and by[0].lang_pred == "en" and by[0].key == "y"
    # One language, and none.
    one = docs(spark, [(1, "abc", "s", "xx"), (2, "abd", "s", "xx")])
    assert {r.lang_pred for r in language_id.identify(one, language_id.train(one)).collect()} == {"xx"}
    none = docs(spark, [(1, "abc"), (2, None)])
    assert {r.lang_pred for r in language_id.identify(none, language_id.train(none)).collect()} == {"und"}
    assert language_id.identify(docs(spark, []), language_id.train(docs(spark, []))).count() == 0


def test_trust_is_of_rows_left_out_and_decoding_is_the_least_weighted_loss():
    rng = np.random.default_rng(3)
    y = [f"l{k}" for k in rng.integers(0, 6, 60)]
    x = np.abs(rng.normal(size=(60, language_id.FEATURES))).astype(np.float32)
    for i, lang in enumerate(y):
        x[i, 100 * int(lang[1]) : 100 * int(lang[1]) + 80] += 1.0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = language_id.fit(x, y)
    who = [model.langs.index(v) for v in y]
    share = 1 / np.bincount(who)[who]
    share *= len(who) / share.sum()
    bits = model.codes[who].astype(float)
    for i in (0, 17, 59):  # each fitted anew without the row
        rest = np.arange(60) != i
        kernel = (x[rest] @ x[rest].T).astype(float) + np.diag(0.5 / share[rest])
        out = (x[i] @ x[rest].T) @ np.linalg.solve(kernel, bits[rest] - model.bias) + model.bias
        full = (x @ x.T).astype(float) + np.diag(0.5 / share)
        inverse = np.linalg.inv(full)
        alpha = inverse @ (bits - model.bias)
        assert np.allclose(out, bits[i] - alpha[i] / inverse[i, i], atol=1e-4)
    assert model.trust.std() > 0 and ((model.trust >= 0.05) & (model.trust <= 1)).all()
    model.trust = rng.random(len(model.trust)) + 0.05
    best, score, margin = model.decode(x)
    for row, k, s, m in zip(x, best, score, margin, strict=True):
        out = [4 * (float(row @ model.weights[:, b]) + model.bias[b]) for b in range(len(model.trust))]
        loss = [sum(t * np.log1p(np.exp(-o * c)) for o, c, t in zip(out, code.astype(float), model.trust, strict=True)) for code in model.codes]
        first, second = sorted(loss)[:2]
        assert loss.index(first) == k and m == pytest.approx((second - first) / np.mean(loss), rel=1e-3, abs=1e-6)
        assert s == pytest.approx(1 / sum(np.exp(-(v - first) * 4 / model.trust.sum()) for v in loss), rel=1e-3)


def test_label_model_against_row_by_row_maximisation():
    rng = np.random.default_rng(4)
    rows = ["".join(rng.choice(list("-+."), 3, p=[0.3, 0.5, 0.2])) for _ in range(300)]
    good = [0.1 if "-" in r else 0.9 for r in rows]
    for _ in range(40):
        prior = (sum(good) + 1) / (len(rows) + 2)
        table = [[{"-": m, "+": p} for _ in range(3)] for m, p in ((0.6, 0.4), (0.1, 0.9))]
        for r, g in zip(rows, good, strict=True):
            for j, v in enumerate(r):
                if v != ".":
                    table[0][j][v] += 1 - g
                    table[1][j][v] += g
        table = [[{v: n / sum(t.values()) for v, n in t.items()} for t in side] for side in table]
        for i, r in enumerate(rows):
            bad_p, good_p = 1 - prior, prior
            for j, v in enumerate(r):
                if v != ".":
                    bad_p, good_p = bad_p * table[0][j][v], good_p * table[1][j][v]
            good[i] = good_p / (good_p + bad_p)
    counts = {r: rows.count(r) for r in rows}
    model = quality.fit_labels(counts, rounds=40)
    assert model.prior == pytest.approx(prior, abs=1e-6)
    assert all(model.posterior(r) == pytest.approx(g, abs=1e-4) for r, g in zip(rows, good, strict=True))


def test_quality_against_plain_scoring_and_identifiers_don_t_matter(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(200).collect()]
    named = docs(spark, list(enumerate(texts)))
    model = quality.train(named)
    for ids in ([None] * len(texts), [7] * len(texts)):
        other = quality.train(docs(spark, list(zip(ids, texts, strict=True))))
        assert np.allclose(other.weight, model.weight, atol=1e-4) and model.weight.any()
    for r in quality.score_quality(named, model).collect():
        stats = quality.statistics((texts[r.doc_id] or "").encode())
        said = quality.votes(stats)
        x = quality.shape_features([(texts[r.doc_id] or "").encode()], [stats])[0]
        score = 0.0 if stats[0] == 0 else float(1 / (1 + np.exp(-np.clip(x @ model.weight + model.bias, -50, 50))))
        assert r.votes == said and r.posterior == pytest.approx(model.labels.posterior(said)) and r.score == pytest.approx(score, abs=1e-5)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    right = [0.95, 0.9, 0.8, 0.85, 0.9, 0.7, 0.75, 0.9]
    patterns = {}
    truth = rng.random(20_000) < 0.8
    for good in truth:
        said = ["." if rng.random() < 0.2 else "+" if (rng.random() < p) == good else "-" for p in right]
        patterns["".join(said)] = patterns.get("".join(said), 0) + 1
    model = quality.fit_labels(patterns)
    assert abs(model.prior - 0.8) < 0.03 and np.abs(np.array(model.accuracies()) - right).max() < 0.05


def test_quality_on_labelled_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(table)
    got = quality.score_quality(table, model).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good, bad = [r.keep for r in got if r.quality == 1], [r.keep for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and 1 - sum(bad) / len(bad) > 0.9


def test_quality_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word"), (None, "!!! ### $$$"), (5, "plain words of the text and more " * 50_000), (4, "word")]
    table = docs(spark, rows)
    got = quality.score_quality(table, quality.train(table)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert not any(r.keep for r in got if r.doc_id in (1, 2, 3))
    empty = docs(spark, [])
    assert quality.score_quality(empty, quality.train(empty)).count() == 0


@pytest.mark.parametrize("text", [b"", b"\xff\xfe broken \x00", b"a" * 100_000])
def test_statistics_of_odd_texts(text):
    stats = quality.statistics(text)
    assert len(stats) == 1 + len(quality.LABELLERS) and len(quality.votes(stats)) == len(quality.LABELLERS)
