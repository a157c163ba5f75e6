"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. They overlap, so
expectation maximisation over the counts of their vote patterns (there are at most
3 ** labellers of them, however large the corpus) estimates how often each is
right on good and on bad documents, and gives each pattern the posterior
probability of being good. A hashed linear scorer is trained on the posteriors
and scores all documents, also those on which the labellers are silent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossiergrid.scratch import materialize, spread

#: Frequent function words of four languages.
FUNCTION_WORDS = {
    "en": "a an and are as at be by for from has he in is it of on or she that the they this to was were will with you",
    "de": "als am an auch auf aus bei das dem den der des die ein eine er es für im in ist mit nicht sich sie und von war wie zu",
    "es": "a al como con de del el en es esta la las lo los más no o para pero por que se su sus un una y",
    "fr": "à au aux avec ce dans de des du elle en est et il la le les ne pas par pour plus que qui sa se son sur un une",
}
_FUNCTION = frozenset(w.encode() for words in FUNCTION_WORDS.values() for w in words.split())

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|<>{}=~^+@_\\"

#: (name, least words, good range, bad range) over the statistics below; in neither range a labeller is silent.
LABELLERS = (
    ("symbols", 1, (-1, 0.01), (0.05, 9)),
    ("shouting", 1, (-1, 0.2), (0.5, 9)),
    ("exclaiming", 5, (-1, 0.02), (0.2, 9)),
    ("stuttering", 5, (-1, 0.05), (0.25, 9)),
    ("bare_tokens", 5, (-1, 0.03), (0.2, 9)),
    ("function_words", 20, (0.12, 9), (-1, 0.02)),
    ("distinct_words", 50, (0.2, 9), (-1, 0.1)),
    ("word_length", 5, (3, 9), (20, 1e9)),
)
#: Hashed n-grams of character shapes, buckets of each statistic, and the bound of the training sample.
FEATURES = 4096
BUCKETS = 16
SAMPLE = 3000
BLOCK = 1 << 20


def statistics(text: bytes) -> list[float]:
    """The labellers' statistics, in their order, after the number of words."""
    words = text.split()
    n = max(1, len(words))
    size = max(1, len(text))
    letters = max(1, size - len(text.translate(None, _LETTERS)))
    bare = sum(1 for w in words if not w.translate(None, _BARE))
    return [
        len(words),
        (len(text) - len(text.translate(None, _SYMBOLS))) / size,
        (len(text) - len(text.translate(None, _UPPER))) / letters,
        text.count(b"!!") / n,
        sum(map(eq, words, words[1:])) / n,
        bare / n,
        sum(map(_FUNCTION.__contains__, text.lower().split())) / n,
        len(set(words)) / n,
        (size - len(words)) / n,
    ]


_BARE = bytes(b for b in range(128) if not chr(b).isalnum())


def votes(stats: list[float]) -> str:
    """One of ``+``, ``-`` and ``.`` per labeller."""
    out = []
    for (_, least, good, bad), value in zip(LABELLERS, stats[1:], strict=True):
        if stats[0] < least:
            out.append(".")
        else:
            out.append("+" if good[0] <= value <= good[1] else "-" if bad[0] <= value <= bad[1] else ".")
    return "".join(out)


@dataclass
class LabelModel:
    """``prior`` of good; ``table[c, j, v]``: probability of vote v (-, +) by labeller j on class c (bad, good), if it votes."""

    prior: float
    table: np.ndarray

    def posterior(self, pattern: str) -> float:
        # Silence is no evidence: a short text is silent because it is short.
        log = np.log([1 - self.prior, self.prior])
        for j, vote in enumerate(pattern):
            if vote != ".":
                log = log + np.log(self.table[:, j, "-+".index(vote)])
        return float(1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50))))

    def accuracies(self) -> list[float]:
        """How often each labeller is right when it votes."""
        bad, good = self.table
        return ((1 - self.prior) * bad[:, 0] + self.prior * good[:, 1]).tolist()


def fit_labels(patterns: dict[str, int], rounds: int = 200) -> LabelModel:
    """Expectation maximisation over counted patterns, begun with the belief that any bad vote means bad.

    There are several kinds of bad documents, and most labellers find nothing wrong with
    the other kinds; a majority of votes would be a poor start.
    """
    names = sorted(patterns) or ["." * len(LABELLERS)]
    count = np.array([patterns.get(p, 0) for p in names], float)
    hot = np.array([[[v == "-", v == "+"] for v in p] for p in names], float)
    good = np.array([0.1 if "-" in p else 0.9 for p in names])
    for _ in range(rounds):
        weight = np.stack([(1 - good) * count, good * count])
        prior = (weight[1].sum() + 1) / (count.sum() + 2)
        table = np.einsum("cp,pjv->cjv", weight, hot) + np.array([[[0.6, 0.4]], [[0.1, 0.9]]])
        table /= table.sum(axis=2, keepdims=True)
        log = np.einsum("pjv,cjv->cp", hot, np.log(table)) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return LabelModel(float(prior), table)


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[48:58] = 48
_SHAPE[128:] = 97
_SHAPE[:33] = 32


def shape_features(texts: list[bytes], stats: list[list[float]]) -> np.ndarray:
    """Unit-length hashed counts of 4-grams of character shapes, and the bucket of each statistic."""
    out = np.zeros((len(texts), FEATURES + len(LABELLERS) * BUCKETS), np.float32)
    for i, text in enumerate(texts):
        counts = np.zeros(FEATURES)
        for at in range(0, len(text), BLOCK):
            x = _SHAPE[np.frombuffer(text[at : at + BLOCK + 3], np.uint8)].astype(np.uint32)
            if len(x) >= 4:
                gram = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
                counts += np.bincount((gram * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=FEATURES)
        counts = np.sqrt(counts)
        out[i, :FEATURES] = counts / max(np.linalg.norm(counts), 1e-9)
        for j, value in enumerate(stats[i][1:]):
            out[i, FEATURES + j * BUCKETS + min(BUCKETS - 1, int(BUCKETS * value / (value + 0.3)))] = 0.35
    return out


def fit_scorer(x: np.ndarray, posterior: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes weighing the same, by accelerated gradient descent."""
    weight, bias = np.zeros(x.shape[1], np.float32), 0.0
    share = np.where(posterior > 0.5, 0.5 / max(1, (posterior > 0.5).sum()), 0.5 / max(1, (posterior <= 0.5).sum()))
    speed, speed_bias = np.zeros_like(weight), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weight + bias, -50, 50)))
        error = ((p - posterior) * share).astype(np.float32)
        speed = 0.9 * speed - 2.0 * (x.T @ error + np.float32(1e-5) * weight)
        speed_bias = 0.9 * speed_bias - 2.0 * error.sum()
        weight, bias = (weight + speed).astype(np.float32), bias + speed_bias
    return weight, float(bias)


@dataclass
class QualityModel:
    labels: LabelModel
    weight: np.ndarray
    bias: float


def train(docs: DataFrame, sample: int = SAMPLE, text_col="text") -> QualityModel:
    """Label model over all documents; scorer on a bounded sample.

    ``sample`` bounds the texts the scorer is fitted on: an equal part of it from each
    vote pattern's share would drown rare patterns, so half goes to patterns that are
    probably good and half to the others. Distinct texts are chosen by a hash of the text,
    each once, whatever identifiers (null, repeated) their rows have.
    """
    text = docs[text_col].cast("binary")
    names = ["h1", "h2"]
    rows = docs.select(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text")).where("text is not null")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [votes(statistics(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string())], [*names, "pattern"])

    said = materialize(rows.mapInArrow(vote, "h1 long, h2 long, pattern string"), "quality-votes")
    patterns = {r["pattern"]: r["count"] for r in said.groupBy("pattern").count().collect()}  # at most 3 ** labellers
    labels = fit_labels(patterns)
    posterior = {p: labels.posterior(p) for p in patterns}
    sizes = {side: sum(n for p, n in patterns.items() if (posterior[p] > 0.5) == side) for side in (True, False)}
    luck = F.pmod(F.xxhash64(*names, F.lit("quality")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    wanted = None
    for side, n in sizes.items():
        own = [p for p in patterns if (posterior[p] > 0.5) == side]
        if own:
            few = said.where(F.col("pattern").isin(own)).withColumn("luck", luck).where(F.col("luck") * n < sample).distinct()
            few = few.orderBy("luck", *names).limit(sample // 2).select(*names, "pattern")
            wanted = few if wanted is None else wanted.unionByName(few)
    if wanted is None:
        return QualityModel(labels, np.zeros(FEATURES + len(LABELLERS) * BUCKETS, np.float32), 0.0)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(1).to_pylist()
                x = shape_features(texts, [statistics(t) for t in texts])
                full = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([a.astype(np.int16).tobytes() for a in full], pa.binary()),
                        pa.array([r[a].tobytes() for r, a in zip(x, full, strict=True)], pa.binary()),
                    ],
                    ["pattern", "at", "value"],
                )

    # At most ``sample`` texts: a bounded broadcast, and one row of each, put together before any shuffle.
    once = F.broadcast(wanted).join(rows, names).groupBy(*names, "pattern").agg(F.first("text").alias("text"))
    got = once.select("pattern", "text").mapInArrow(featured, "pattern string, at binary, value binary")
    got = got.orderBy("pattern", "at", "value").limit(2 * sample).collect()
    x = np.zeros((len(got), FEATURES + len(LABELLERS) * BUCKETS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["value"], np.float32)
    weight, bias = fit_scorer(x, np.array([posterior[r["pattern"]] for r in got]))
    return QualityModel(labels, weight, bias)


def score_quality(docs: DataFrame, model: QualityModel, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row: ``doc_id``, ``votes``, ``posterior``, ``score``, ``keep``.

    ``score`` is the linear scorer's probability of good, ``keep`` whether it is at
    least one half. Null texts and texts without words have nothing to judge: no
    votes, posterior equal to the prior, score 0, not kept. Rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    kind = rows.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(1).to_pylist()
                stats = [statistics(t) for t in texts]
                said = [votes(s) for s in stats]
                for p in set(said):
                    if p not in known:
                        known[p] = m.labels.posterior(p)
                score = 1 / (1 + np.exp(-np.clip(shape_features(texts, stats) @ m.weight + m.bias, -50, 50)))
                score = np.where([s[0] == 0 for s in stats], 0.0, score).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(said, pa.string()), pa.array([known[p] for p in said], pa.float64()), pa.array(score), pa.array(score >= 0.5)],
                    ["doc_id", "votes", "posterior", "score", "keep"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, votes string, posterior double, score double, keep boolean")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return score_quality(docs, train(docs))
