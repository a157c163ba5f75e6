"""The stages of the pipeline, each against a brute-force version of its decision on its own input."""

import pytest

import corpus_pipeline as pipeline
from tests.llm.helpers import ALNUM_WORD, SPACE_WORD, lower
from tests.llm.test_jaccard_join import brute as components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def flow(spark):
    """The rows before and after every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    extra = [(9001, None, "en", "s", 0), (9002, "", "fr", None, 0), (9003, "12 !!", None, "s", 5)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for name, stage in pipeline.STAGES:
        after = stage(spark, docs, SF)
        rows = after.collect()
        out.append((name, docs.collect(), rows))
        docs = spark.createDataFrame(rows, after.schema)
    return {name: (before, after) for name, before, after in out}


def test_stages(flow):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "decontamination", "mix_sources"]
    for name in list(flow)[:-1]:
        before, after = flow[name]
        assert after and tuple(after[0].__fields__) == pipeline.COLUMNS and set(after) <= set(before)


def test_language(flow):
    before, after = flow["language_id"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {9001, 9002, 9003} <= gone and len(gone) <= 3 + 0.02 * len(before)


def test_exact(flow):
    before, after = flow["exact_dedup"]
    least = {}
    for r in before:
        least[lower(r.text)] = min(r.doc_id, least.get(lower(r.text), r.doc_id))
    assert {r.doc_id for r in after} == set(least.values()) and len(after) < len(before)


def test_near(flow):
    before, after = flow["jaccard_join"]
    want = {i for i, _, c in components([(r.doc_id, r.text) for r in before], 5, 80) if i == c}
    assert {r.doc_id for r in after} == want and len(after) < len(before)


def test_benchmark(spark, flow):
    before, after = flow["decontamination"]
    split = lambda t: [lower(w) for w in ALNUM_WORD.findall(t or "")]
    wins = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r.text)
        wins |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in wins}
    hit = lambda w: any(tuple(w[i : i + n]) in wins for n in sizes for i in range(len(w) - n + 1))
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not hit(split(r.text))} and len(after) < len(before)


def test_mix(flow):
    before, after = flow["mix_sources"]
    assert sorted((r.doc_id, r.size) for r in after) == sorted((r.doc_id, len(SPACE_WORD.findall(r.text))) for r in before)
    assert all(r.taken <= 3 * r.size for r in after) and sum(r.taken for r in after) == pytest.approx(sum(r.size for r in after), rel=0.01)


def test_run(spark):
    """The whole run gives what its stages give one after another."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        after = stage(spark, docs, SF)
        rows = after.collect()
        docs = spark.createDataFrame(rows, after.schema)
    got = pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_no_documents(spark):
    """Every stage gives an empty table with its columns for an empty one."""
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in pipeline.STAGES:
        after = stage(spark, empty, SF)
        assert after.count() == 0, name
        assert len(after.columns) == 6 if name == "mix_sources" else tuple(after.columns) == pipeline.COLUMNS


def test_rows_without_their_own_id(spark):
    """Rows with a null or shared doc_id are judged by their own text."""
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    a, b, c = (" ".join(f"{p}{k}" for k in range(80)) for p in "abc")
    rows = [(None, a), (None, a + " end"), (7, b + " end"), (7, b), (8, c), (8, item), (None, c + " " + item), (None, "left alone")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.text for r in pipeline.near(spark, docs, SF).collect()]
    assert sum(t in kept for t in (a, a + " end")) == 1 and sum(t in kept for t in (b, b + " end")) == 1 and "left alone" in kept
    left = {(r.doc_id, r.text) for r in pipeline.benchmark(spark, docs, SF).collect()}
    assert left == {(i, t) for i, t in rows if item not in t}
