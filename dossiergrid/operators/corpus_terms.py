"""Terms of two sets of texts with their document frequencies, in packed arrays.

A corpus has far more pairs of text and term than texts, so these are never rows. Texts are taken in chunks. A chunk lists
its different terms once, as sorted 64-bit hashes with the number of its texts that hold each, cut into buckets by the hash.
All chunks' entries of a bucket meet in one group, which is of bounded size (the number of buckets follows from the size of the
texts) and has no hot term (a term is there once a chunk); the frequencies go back to their chunks in the order of the hashes.
Hashes are shuffled once and stored nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossiergrid.batches import bound_batches
from dossiergrid.operators.similarity import WORD
from dossiergrid.scratch import materialize, spread

#: Words in a chunk, but for the last text's, and the most texts of one (their numbers have two bytes).
CHUNK, MOST = 3 << 17, 1 << 16
#: Words that are kept as objects at a time.
PACKED = 1 << 16
#: Characters of text for every bucket; some 600,000 entries.
BUCKET = 5_000_000

_U8, _U4, _U2 = np.dtype("<u8"), np.dtype("<u4"), np.dtype("<u2")


def _planes(hashes: np.ndarray) -> bytes:
    """Sorted hashes byte by byte, so that what they begin with compresses."""
    return hashes.astype(_U8).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(_U8).ravel()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in their order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, sorted, and the place of each value among them."""
    codes, found = pd.factorize(values)
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[codes]


def _counted(words: pa.ChunkedArray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different terms of some texts (sorted hashes), and of each term and text (by term) the term's place, the text's number and the count."""
    coded = words.combine_chunks().dictionary_encode()
    del words
    own = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False)
    of = own[coded.indices.to_numpy()]
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = text[1:] == text[:-1]
    terms, place = _numbered(np.concatenate([of, _mixed(of[:-1], of[1:])[inside]]))
    code, count = np.unique((place << 32) | np.concatenate([text, text[1:][inside]]), return_counts=True)
    return terms, code >> 32, code & 0xFFFFFFFF, count


def _packed(texts: DataFrame, key: str, side: int, buckets: int) -> DataFrame:
    """A row of every chunk and bucket (hashes, counts), and one of every chunk alone (a negative bucket): its texts' keys, and of its terms the texts' numbers and counts."""
    rows = spread(texts.select(F.col(key).alias("key"), F.col("text").alias("text")).where("text <> ''"))
    kind = rows.dtypes[0][1]

    def chunk_rows(chunk: int, keys: list, keys_type: pa.DataType, words: pa.ChunkedArray, sizes: list[int]) -> pa.RecordBatch:
        terms, place, text, count = _counted(words, sizes)
        cuts = np.searchsorted(((terms >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))
        held = np.bincount(place, minlength=len(terms)).astype(_U4)
        some = np.flatnonzero(np.diff(cuts)).tolist()
        cut = lambda values, packed: pa.array([packed(values[cuts[b] : cuts[b + 1]]) for b in some] + [None], pa.binary())
        alone = lambda value, of: pa.array([None] * len(some) + [value], of)
        n = len(some) + 1
        columns = {
            "side": pa.array([side] * n, pa.int32()), "chunk": pa.array([chunk] * n, pa.int64()), "bucket": pa.array([*some, -1 - chunk], pa.int64()),
            "hashes": cut(terms, _planes), "counts": cut(held, np.ndarray.tobytes), f"keys{side}": alone(keys, pa.list_(keys_type)),
            "texts": alone(text.astype(_U2).tobytes(), pa.binary()), "tfs": alone(count.astype(_U4).tobytes(), pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = side << 56 | TaskContext.get().partitionId() << 32
        keys, words, sizes, keys_type, packed, n = [], [], [], pa.null(), [], 0
        strings = lambda: pa.array(words, pa.string())
        for batch in batches:
            keys_type = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = WORD.findall(text.lower())
                if found:
                    keys.append(name)
                    words += found
                    sizes.append(len(found))
                if len(words) >= PACKED:  # as objects, words take several times their letters
                    packed, n, words = [*packed, strings()], n + len(words), []
                if n + len(words) >= CHUNK or len(keys) == MOST:
                    yield chunk_rows(chunk, keys, keys_type, pa.chunked_array([*packed, strings()]), sizes)
                    chunk, keys, words, sizes, packed, n = chunk + 1, [], [], [], [], 0
        if keys:
            yield chunk_rows(chunk, keys, keys_type, pa.chunked_array([*packed, strings()]), sizes)

    return rows.mapInArrow(run, f"side int, chunk long, bucket long, hashes binary, counts binary, keys{side} array<{kind}>, texts binary, tfs binary")


def _joined(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _frequencies(rows: DataFrame, both: bool) -> DataFrame:
    """For every row with hashes: ``dfs`` of them, whether a right text has them (``held``), and those that one has (``names``); the others as they are."""
    kept = [f for f in rows.schema.fields if f.name != "hashes"]
    names = [f.name for f in kept]

    def count(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            none = pa.nulls(table.num_rows, pa.binary())
            return pa.table([*[table[c] for c in names], none, none, none], [*names, "dfs", "held", "names"])
        parts = [_from_planes(x) for x in table["hashes"].to_pylist()]
        hashes, counts, size = np.concatenate(parts), _joined(table["counts"], _U4), [len(x) for x in parts]
        right = np.repeat(table["side"].to_numpy() == 1, size)
        terms, place = _numbered(hashes)
        has = np.bincount(place[right], minlength=len(terms)) > 0
        df = np.bincount(place, counts if both else np.where(right, 0, counts), len(terms)).astype(_U4)[place]
        held = has[place]
        ends = np.cumsum(size)[:-1]
        cut = lambda values: pa.array([x.tobytes() for x in np.split(values, ends)], pa.binary())
        named = pa.array([h[m].tobytes() for h, m in zip(parts, np.split(held, ends), strict=True)], pa.binary())
        return pa.table([*[table[c] for c in names], cut(df), cut(held), named], [*names, "dfs", "held", "names"])

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return rows.groupBy("bucket").applyInArrow(count, f"{out}, dfs binary, held binary, names binary")


class Chunk:
    """The texts of a chunk: ``keys``, and of each text and term (by text) its number ``text``, the ``tf`` (1 + ln of the count), the ``df`` and, where ``held`` by a right text, its ``name``."""

    def __init__(self, table: pa.Table, keys: str):
        order = np.argsort(table["bucket"].to_numpy())
        own, told = table.slice(int(order[0]), 1), table.take(pa.array(order[1:]))
        df, held = _joined(told["dfs"], _U4), _joined(told["held"], np.dtype(bool))
        names = np.zeros(len(df), _U8)
        names[held] = _joined(told["names"], _U8)
        text = _joined(own["texts"], _U2)
        by = np.argsort(text, kind="stable")
        place = np.repeat(np.arange(len(df)), _joined(told["counts"], _U4))[by]
        self.keys, self.text = own[keys][0].values, text[by].astype(np.int64)
        self.tf, self.df = 1 + np.log(_joined(own["tfs"], _U4)[by]), df[place].astype(np.float64)
        self.held, self.name = held[place], names[place]


def corpus(left: DataFrame, right: DataFrame, left_key: str, right_key: str, both: bool) -> Callable[[int, Callable[[Chunk], pa.Table], str], DataFrame]:
    """A function of (side, make, schema) that gives ``make`` of every ``Chunk`` of the left (0) or right (1) texts.

    Texts are in columns ``text``; those that are null or without a word are in no chunk. Frequencies are of ``both`` sides' texts or the left ones'.
    """
    bound_batches(left.sparkSession)
    chars = sum(t.agg(F.sum(F.length("text"))).first()[0] or 0 for t in (left, right))
    buckets = 1 + chars // BUCKET
    sides = [_packed(t, k, i, buckets) for i, (t, k) in enumerate(((left, left_key), (right, right_key)))]
    told = materialize(_frequencies(sides[0].unionByName(sides[1], allowMissingColumns=True), both), "corpus-terms")

    def chunks(side: int, make: Callable[[Chunk], pa.Table], schema: str) -> DataFrame:
        keys = f"keys{side}"
        rows = told.where(F.col("side") == side).select("chunk", "bucket", "counts", "dfs", "held", "names", keys, "texts", "tfs")
        return rows.groupBy("chunk").applyInArrow(lambda table: make(Chunk(table, keys)), schema)

    return chunks
