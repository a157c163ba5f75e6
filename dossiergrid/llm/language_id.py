"""Language identification by error-correcting output codes.

Every learned language has a codeword; one binary classifier per bit of it works
on hashed byte n-grams of the whole text. Decoding adds up, for each language,
the logistic losses of all bits against its codeword, each weighted by how well
that bit was predicted for sample rows by classifiers that had not seen them, and
takes the language with the least. A text whose two nearest codewords are almost
equally far is flagged ambiguous.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossiergrid.scratch import spread

#: Hashed n-gram features. Training keeps at most SAMPLE rows, dealt evenly to the languages
#: (never fewer than LEAST of a language, so the bound grows only with the number of languages).
FEATURES = 8192
SAMPLE = 2000
LEAST = 32
#: Bytes of text counted at a time; longer texts are counted in such pieces.
BLOCK = 1 << 20
#: Share of the total loss by which the second codeword must be farther than the nearest.
MARGIN = 0.02
#: Factor of a classifier's output (about -1 to 1) in its logistic loss.
SHARPNESS = 4
NOT_KNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def _ngram_rows(data: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Counts of hashed 2- and 3-grams; ``doc`` is the document of each byte."""
    x = _FOLD[data].astype(np.uint32)
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] + x[2:] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)
    out = np.zeros(n_docs * FEATURES)
    for gram, n in ((two, 2), (three, 3)):
        gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        at = (gram >> np.uint32(19)).astype(np.int64)
        same = doc[: len(at)] == doc[n - 1 :]
        at += doc[: len(at)] * FEATURES
        out += np.bincount(at[same], minlength=len(out))
    return out.reshape(n_docs, FEATURES)


def features(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Unit-length rows of square roots of n-gram counts, a few hundred texts at a time.

    Texts are framed by spaces. Memory is bounded by BLOCK however long a text is.
    """
    group: list[bytes] = []
    size = 0

    def rows(group: list[bytes]) -> np.ndarray:
        joined = np.frombuffer(b"".join(b" " + t + b" " for t in group), np.uint8)
        doc = np.repeat(np.arange(len(group)), [len(t) + 2 for t in group])
        return _ngram_rows(joined, doc, len(group))

    def scaled(counts: np.ndarray) -> np.ndarray:
        counts = np.sqrt(counts)
        return (counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    for text in texts:
        if len(text) > BLOCK:
            if group:
                yield scaled(rows(group))
                group, size = [], 0
            # Pieces overlap by two bytes, so only the few n-grams at their frames differ.
            yield scaled(sum(rows([text[at : at + BLOCK + 2]]) for at in range(0, len(text), BLOCK)))
            continue
        if group and (size + len(text) > BLOCK or len(group) == 256):
            yield scaled(rows(group))
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield scaled(rows(group))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A matrix of ``n`` codewords of +1 and -1, no column constant, no two alike up to sign.

    Up to five languages get all possible columns; more get the best of seeded draws
    by least distance between codewords.
    """
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 5:
        half = np.arange(1, 2 ** (n - 1))
        return np.array([[1] * len(half)] + [[1 - 2 * (c >> k & 1) for c in half] for k in range(n - 1)], np.int8)
    bits = int(np.ceil(10 * np.log2(n)))
    rng, best, least = np.random.default_rng(seed), None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        m = m[:, np.abs(m.sum(axis=0)) < n]
        m = np.unique(m * m[0], axis=1)
        distance = int(((m.shape[1] - m.astype(int) @ m.T) // 2 + np.eye(n, dtype=int) * bits).min())
        if distance > least:
            best, least = m, distance
    return best


@dataclass
class LanguageModel:
    """``weights``: FEATURES x bits, ``bias`` and ``trust``: per bit, ``codes``: languages x bits."""

    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score in 0..1, and the margin to the second."""
        if len(self.langs) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.ones(len(x))
        out = (x @ self.weights + self.bias) * SHARPNESS
        loss = np.stack([(np.logaddexp(0, -out * code) * self.trust).sum(axis=1) for code in self.codes], axis=1)
        order = np.argsort(loss, axis=1, kind="stable")
        row = np.arange(len(x))
        near, second = loss[row, order[:, 0]], loss[row, order[:, 1]]
        p = np.exp(-(loss - near[:, None]) * SHARPNESS / self.trust.sum())
        return order[:, 0], 1 / p.sum(axis=1), (second - near) / np.maximum(loss.mean(axis=1), 1e-9)


def fit(x: np.ndarray, y: list[str], ridge: float = 0.5) -> LanguageModel:
    """Ridge regression of every codeword bit, solved in the space of the (few) samples."""
    langs = sorted(set(y))
    codes = codewords(len(langs))
    if len(langs) < 2:
        return LanguageModel(langs, codes, np.zeros((FEATURES, 0), np.float32), np.zeros(0), np.zeros(0))
    who = np.array([langs.index(v) for v in y])
    share = 1 / np.bincount(who)[who]
    share *= len(who) / share.sum()
    bits = codes[who].astype(np.float64)
    bias = (bits * share[:, None]).mean(axis=0)
    kernel = (x @ x.T).astype(np.float64)
    kernel[np.diag_indices(len(x))] += ridge / share
    inverse = np.linalg.inv(kernel)
    alpha = inverse @ (bits - bias)
    weights = (x.T @ alpha.astype(np.float32)).astype(np.float32)
    return LanguageModel(langs, codes, weights, bias, trusted(bits, alpha, inverse))


def trusted(bits: np.ndarray, alpha: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Per bit, one less its mean logistic loss (in bits, at least 0.05) on each row as fitted without that row.

    Leaving row i out of a ridge regression changes its prediction by alpha[i] / inverse[i, i].
    """
    unseen = bits - alpha / np.diag(inverse)[:, None]
    loss = np.logaddexp(0, -SHARPNESS * unseen * bits).mean(axis=0) / np.log(2)
    return np.maximum(1 - loss, 0.05)


def held_out(doc_id: Column) -> Column:
    """True for the fold that training never sees; a null identifier is not in it."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, id_col="doc_id", text_col="text", lang_col="lang") -> LanguageModel:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    ``sample`` bounds the rows; each language gets an equal part of it, chosen by a
    hash of the identifier. A single task fits the model.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("most", F.greatest(F.lit(LEAST), F.floor(F.lit(sample) / F.count(F.lit(1)).over(Window.partitionBy()))))
    # Twice the wanted rows pass the hash on average, so that no language is gathered whole in one task.
    luck = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = rows.where(F.col("text").rlike(r"\p{L}")).join(F.broadcast(sizes), "lang").withColumn("luck", luck)
    few = few.where(F.col("luck") * F.col("n") < 2 * F.col("most") + 64)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("luck", "doc_id"))
    few = few.withColumn("r", rank).where("r <= most").select("lang", F.col("text").cast("binary").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for x in features(batch.column(1).to_pylist()):
                at = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(x)),
                        pa.array([a.astype(np.int16).tobytes() for a in at], pa.binary()),
                        pa.array([r[a].tobytes() for r, a in zip(x, at, strict=True)], pa.binary()),
                    ],
                    ["lang", "at", "value"],
                )
                done += len(x)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(zip(*columns, strict=True)) if (columns := _columns(batches)) else []
        x = np.zeros((len(rows), FEATURES), np.float32)
        for i, (_, at, value) in enumerate(rows):
            x[i, np.frombuffer(at, np.int16)] = np.frombuffer(value, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(x, [lang for lang, _, _ in rows]))], pa.binary())], ["model"])

    # The sample is bounded, so one task fits the model; the driver gets the weights only.
    sampled = few.mapInArrow(counted, "lang string, at binary, value binary").repartition(1)
    made = sampled.mapInArrow(fitted, "model binary").first()  # none if Spark knows that there is no row
    return pickle.loads(made["model"]) if made else fit(np.zeros((0, FEATURES), np.float32), [])


def _columns(batches: Iterator[pa.RecordBatch]) -> list[list]:
    """The columns of all batches as lists."""
    all_batches = list(batches)
    return [[v for b in all_batches for v in b.column(c).to_pylist()] for c in range(all_batches[0].num_columns)] if all_batches else []


def identify(docs: DataFrame, model: LanguageModel, id_col="doc_id", text_col="text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``margin``, ``ambiguous`` of every row, from its text alone,
    and the columns to ``carry`` along unseen.

    Texts that are null or hold no letter get ``und``, score 0, and are not called
    ambiguous; so does every text if no language was learned. Equal losses go to
    the language first in code point order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        docs[id_col].alias("doc_id"), F.when(docs[text_col].rlike(r"\p{L}"), docs[text_col].cast("binary")).alias("__text"), *[docs[c] for c in carry]
    )
    kind = rows.dtypes[0][1]
    carried = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema) if carry else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, score, margin = [NOT_KNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
            at = [i for i, t in enumerate(texts) if t is not None] if m.langs else []
            done = 0
            for x in features([texts[i] for i in at]):
                here = at[done : done + len(x)]
                best, score[here], margin[here] = m.decode(x)
                for i, k in zip(here, best.tolist(), strict=True):
                    lang[i] = m.langs[k]
                done += len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(margin), pa.array(margin < MARGIN), *batch.columns[2:]],
                ["doc_id", "lang_pred", "score", "margin", "ambiguous", *carry],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, margin double, ambiguous boolean{carried}")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    return identify(docs, train(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "ambiguous"
    )
