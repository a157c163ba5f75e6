import random

import public_tokenizers
import pytest
import sentencepiece

from dossiergrid.llm.token_counts import Counter, Proof, prove, spaces_only, token_counts
from tests.llm.helpers import corpus, docs


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_counts_equal_the_library(model):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    proof = prove(model)
    assert proof.splits and len(proof.whole) > 10_000
    counters = Counter(model, proof), Counter(model, Proof(False, frozenset()))
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\r\n", "\t", "a", "the", " of", "ing", "é", "日本", "▁", ".", "!!", "<s>", "</s>", "|", "\0", "ﬁ", " ", "é", "😀"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert {c.count(text) for c in counters} == {len(sp.encode(text))}, repr(text)
    long = "word " * 50_000 + "x" * 20_000
    assert counters[0].count(long) == len(sp.encode(long))


def test_proof_reads_the_normaliser_of_the_model(model):
    assert spaces_only(model)
    field = lambda number, body: bytes([number << 3 | 2, len(body)]) + body
    flag = lambda number, value: bytes([number << 3, value])
    bpe, plain = field(2, flag(3, 2)), flag(3, 1) + flag(4, 0) + flag(5, 1)
    assert spaces_only(bpe + field(3, plain))
    for other in (field(2, b"x"), flag(3, 0), flag(4, 1), flag(5, 0), field(6, b"rule")):
        assert not spaces_only(bpe + field(3, plain + other))
    assert not spaces_only(field(3, plain)) and not spaces_only(bpe)  # unigram model; extra spaces removed by default


def test_table(spark, model):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = corpus() + [(None, "null id"), (None, None)]
    got = token_counts(docs(spark, rows), model, limit=100).collect()
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts(docs(spark, []), model).count() == 0
