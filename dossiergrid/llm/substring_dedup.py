"""Dedup of repeated word spans by a compacted, sparse de Bruijn graph.

Nodes are the sampled k-mers of words: of the k-mers inside a window of ``window``
words, the one with the least hash. Equal windows sample the same k-mer, so every
window that occurs twice holds a node that occurs twice. An edge is the run of
words from one sampled k-mer of a document to the end of the next; it is known by
the hash of those words. A node with one edge in and one edge out, over all its
occurrences, is nonbranching: whoever reads it reads the same words around it.
Joins with the node table cut every document's sequence of nodes at its branching
ones; what is between is one compacted path, held by one row per document instead
of one per window. Windows at branching nodes keep a row each. Paths and windows meet
by two independent 64-bit hashes of their words; the least of a group is the source of
the others. What follows each other in a document and in its source makes one span, and
a span goes only if its words have the SHA-256 of the words at the source coordinates.

A node, path or window may be in a large part of all documents. The rows of such a hash
are not shuffled by it; they meet what is known of it by a broadcast of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossiergrid.llm.batches import bound_batches
from dossiergrid.llm.hashed_words import hashed_words, mix
from dossiergrid.hot_keys import join_split
from dossiergrid.scratch import materialize

#: Identifiers are sent to all executors up to this number (of 16 bytes).
BROADCAST_ROWS = 500_000

_BASE = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Runs:
    """Hashes of any run of words of a block, from prefix sums."""

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        power, back = np.full(n, _BASE, np.uint64), np.full(n, _BACK, np.uint64)
        power[0] = back[0] = 1
        power, self.back = np.multiply.accumulate(power), np.multiply.accumulate(back)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:-1])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.total[end] - self.total[start]) * self.back[start]
        return mix(value + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def sampled(runs: Runs, text: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, node): all windows of one text in a block, and the start of the k-mer each samples.

    Of equal least hashes the leftmost is taken, so the choice depends on the window alone.
    """
    n_windows, inside = len(text) - window + 1, window - k + 1
    if n_windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(text) - k + 1)
    # The place in the low bits finds the least again and breaks ties to the left.
    low = np.uint64(max(24, int(len(text)).bit_length()))
    least = (runs.of(at, at + k) >> low << low) | at.astype(np.uint64)
    width = 1
    while width * 2 <= inside:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < inside:
        least = np.minimum(least[: len(least) - (inside - width)], least[inside - width :])
    node = (least[:n_windows] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    start = np.flatnonzero(text[:n_windows] == text[window - 1 :])
    return start, node[start]




def _nodes(rows: DataFrame, k: int, window: int) -> DataFrame:
    """(doc_id, text_key, at, h, before, after): the nodes of every text with the edges around them."""
    kind = rows.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in hashed_words(batch.column(2).to_pylist(), lower=False):
                runs = Runs(block.hash)
                _, node = sampled(runs, block.text, k, window)
                if not len(node):
                    continue
                at = np.unique(node)
                edge = runs.of(at[:-1], at[1:] + k).view(np.int64)
                joined = block.text[at[:-1]] == block.text[at[1:]]
                after, before = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                after[:-1], before[1:] = edge, edge
                ends, begins = np.append(~joined, True), np.append(True, ~joined)
                first = np.cumsum(np.append(0, block.counts))[:-1]
                row = pa.array(block.first + block.text[at])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(row),
                        batch.column(1).take(row),
                        pa.array((at - first[block.text[at]]).astype(np.int32)),
                        pa.array(runs.of(at, at + k).view(np.int64)),
                        pa.array(before, mask=begins),
                        pa.array(after, mask=ends),
                    ],
                    ["doc_id", "text_key", "at", "h", "before", "after"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, at int, h long, before long, after long")


def _pieces(rows: DataFrame, k: int, window: int) -> DataFrame:
    """(doc_id, text_key, hash, check, from_word, to_word): compacted paths and single windows of texts with repeated nodes.

    ``rows`` has doc_id, text_key, text, ``at`` (sorted starts of repeated nodes), ``plain`` (nonbranching or not).
    """
    kind = rows.dtypes[0][1]

    def of(text: bytes, at: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        (block,) = hashed_words([text], lower=False, second=True)
        runs, other = Runs(block.hash), Runs(block.second)
        start, node = sampled(runs, block.text, k, window)
        state = np.zeros(len(block.hash), np.int8)
        state[at] = np.where(plain, 2, 1)
        all_nodes = np.unique(node)
        # The path of a nonbranching node reaches from the branching node before it to the one behind it.
        cut = state[all_nodes] != 2
        index = np.arange(len(all_nodes))
        left = np.maximum.accumulate(np.where(cut, index, 0))
        right = np.minimum.accumulate(np.where(cut, index, len(index) - 1)[::-1])[::-1]
        mine = np.searchsorted(all_nodes, node)
        path_from, path_to = all_nodes[left[mine]], all_nodes[right[mine]] + k
        in_path = (state[node] == 2) & (start >= path_from) & (start + window <= path_to)
        alone = (state[node] > 0) & ~in_path
        # Windows of one path that follow each other make one row.
        inside = np.flatnonzero(in_path)
        new = np.ones(len(inside), bool)
        new[1:] = (np.diff(inside) != 1) | (path_from[inside][1:] != path_from[inside][:-1])
        head = inside[new]
        tail = inside[np.append(np.flatnonzero(new)[1:] - 1, len(inside) - 1)] if len(inside) else inside
        single = start[alone]
        # A path's stretches are told apart by their place in it.
        salt = mix((start[head] - path_from[head]).astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))

        def value(of: Runs) -> np.ndarray:
            return np.concatenate([mix(of.of(path_from[head], path_to[head]) ^ salt), of.of(single, single + window)])

        return value(runs), value(other), np.concatenate([start[head], single]), np.concatenate([start[tail] + window, single + window])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text, at, plain = (batch.column(c)[row].as_py() for c in (2, 3, 4))
                value, check, first, last = of(text, np.array(at), np.array(plain))
                same = pa.array(np.full(len(value), row))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(same),
                        batch.column(1).take(same),
                        pa.array(value.view(np.int64)),
                        pa.array(check.view(np.int64)),
                        pa.array(first.astype(np.int32)),
                        pa.array(last.astype(np.int32)),
                    ],
                    ["doc_id", "text_key", "hash", "check", "from_word", "to_word"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, hash long, check long, from_word int, to_word int")


def _only(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The rows whose document is among the ``n`` wanted ones, found without a shuffle of the texts if those are few."""
    keys = ["doc_id", "text_key"]
    return rows.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, keys, "left_semi")


def repeated_spans(rows: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, text_key, from_word, to_word, digest): words of windows that start in a document with a smaller doc_id too.

    ``rows`` has doc_id (not null), text_key and text (binary).
    """
    k = max(1, window * 2 // 5)
    nodes = materialize(_nodes(rows, k, window), "substring-nodes")
    one_edge = lambda c: (F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1)))
    table = nodes.groupBy("h").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"), F.coalesce(one_edge("before") & one_edge("after"), F.lit(False)).alias("plain")
    )
    marked = join_split(nodes.select("doc_id", "text_key", "at", "h"), table.where("lo < hi").select("h", "plain", "n"), ["h"], nodes.count())
    marked = marked.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("at", "plain"))).alias("nodes"))
    marked = materialize(marked.select("doc_id", "text_key", F.col("nodes.at").alias("at"), F.col("nodes.plain").alias("plain")), "substring-marked")
    some = _only(rows, marked.select("doc_id", "text_key"), marked.count()).dropDuplicates(["doc_id", "text_key"])
    pieces = materialize(_pieces(some.join(marked, ["doc_id", "text_key"]), k, window), "substring-pieces")
    # What repeats by the first hash alone is few; only that is grouped by both.
    twice = pieces.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("hash", "n")
    twice = materialize(join_split(pieces, twice, ["hash"], pieces.count()), "substring-repeated")
    both = ["hash", "check"]
    first = twice.groupBy(*both).agg(F.min(F.struct("doc_id", "text_key", "from_word")).alias("src"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    found = join_split(twice, first.where("src.doc_id < hi").drop("hi"), both, twice.count()).where("doc_id > src.doc_id")
    span = F.struct("from_word", "to_word", F.col("src.doc_id").alias("s_doc"), F.col("src.text_key").alias("s_key"), F.col("src.from_word").alias("s_from"))
    per_text = found.groupBy("doc_id", "text_key").agg(F.collect_list(span).alias("spans"))
    return _verified(rows, materialize(_merged(per_text), "substring-found"))


def _merged(per_text: DataFrame) -> DataFrame:
    """Spans that overlap or touch in a text and, at the same distance, in one source, as one."""
    kind = per_text.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for k, spans in enumerate(batch.column(2).to_pylist()):
                by_source: dict[tuple, list[tuple[int, int]]] = {}
                for x in spans:
                    by_source.setdefault((x["s_doc"], x["s_key"], x["s_from"] - x["from_word"]), []).append((x["from_word"], x["to_word"]))
                for (doc, key, shift), own in by_source.items():
                    own.sort()
                    a, b = own[0]
                    for c, d in [*own[1:], (None, None)]:
                        if c is not None and c <= b:
                            b = max(b, d)
                            continue
                        row.append(k)
                        out.append((a, b, doc, key, a + shift))
                        a, b = c, d
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int32(), pa.int32(), batch.schema.field(0).type, pa.int64(), pa.int32())
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                ["doc_id", "text_key", "from_word", "to_word", "s_doc", "s_key", "s_from"],
            )

    return per_text.mapInArrow(run, f"doc_id {kind}, text_key long, from_word int, to_word int, s_doc {kind}, s_key long, s_from int")


def _verified(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` with ``digest``: SHA-256 of the words at the source coordinates, which the removal compares with the words it removes."""
    at = ["s_doc", "s_key", "s_from", "length"]
    spans = spans.withColumn("length", F.col("to_word") - F.col("from_word"))
    asked = spans.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    wanted = asked.groupBy(F.col("s_doc").alias("doc_id"), F.col("s_key").alias("text_key")).agg(F.collect_list(F.struct("s_from", "length")).alias("asked"))
    wanted = materialize(wanted, "substring-sources")
    texts = _only(rows, wanted.select("doc_id", "text_key"), wanted.count()).dropDuplicates(["doc_id", "text_key"]).join(wanted, ["doc_id", "text_key"])
    kind = rows.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, first, length, digest = [], [], [], []
            for k, (text, asked) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = text.split()
                for x in asked:
                    row.append(k)
                    first.append(x["s_from"])
                    length.append(x["length"])
                    digest.append(_digest(words[x["s_from"] : x["s_from"] + x["length"]]))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(first, pa.int32()), pa.array(length, pa.int32()), pa.array(digest, pa.binary())],
                ["s_doc", "s_key", "s_from", "length", "digest"],
            )

    known = texts.select("doc_id", "text_key", "text", "asked").mapInArrow(run, f"s_doc {kind}, s_key long, s_from int, length int, digest binary")
    return join_split(spans, asked.join(known, at), at, spans.count()).select("doc_id", "text_key", "from_word", "to_word", "digest")


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of ``window``
    consecutive words that covers it also starts in a document with a smaller
    identifier; windows are judged on the input. Kept words are joined by one space.
    A null text has no words. Rows with a null identifier keep all their words and
    are no source for others; rows that repeat an identifier are one document with
    several texts. A text shorter than a window keeps all its words, as does an empty table.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    spans = materialize(repeated_spans(rows.where("doc_id is not null"), window), "substring-spans")
    gone = spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("from_word", "to_word", "digest")).alias("gone"))
    gone = materialize(gone, "substring-gone")
    n = gone.count()
    ids = gone.select("doc_id", "text_key")
    hit = _only(rows, ids, n).join(gone, ["doc_id", "text_key"])
    clean = rows.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, ["doc_id", "text_key"], "left_anti")
    kind = rows.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept_text = [], [], []
            gone = batch.column(3).to_pylist() if batch.num_columns > 3 else [()] * batch.num_rows
            for text, spans in zip(batch.column(2).to_pylist(), gone, strict=True):
                words = text.split()
                total.append(len(words))
                if spans:
                    change = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        if _digest(words[s["from_word"] : s["to_word"]]) == s["digest"]:
                            change[s["from_word"]] += 1
                            change[s["to_word"]] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                removed.append(total[-1] - len(words))
                kept_text.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_text, pa.binary())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    schema = f"doc_id {kind}, n_words long, n_removed long, kept_text binary"
    done = hit.select("doc_id", "text_key", "text", "gone").mapInArrow(run, schema).unionByName(clean.mapInArrow(run, schema))
    return done.select("doc_id", "n_words", "n_removed", F.col("kept_text").cast("string").alias("kept_text"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = substring_dedup(docs)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), p AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), f AS (SELECT win, min(doc_id) AS lo FROM p GROUP BY win),
h AS (SELECT p.doc_id, p.i FROM p JOIN f ON f.win = p.win AND p.doc_id > f.lo),
s AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM h
), gone AS (SELECT doc_id, unnest(range(i, least(i + 50, coalesce(nxt, i + 50)))) AS pos FROM s),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
k AS (
  SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.pos) AS kept, count(*) AS n
  FROM t ANTI JOIN gone ON gone.doc_id = t.doc_id AND gone.pos = t.pos GROUP BY t.doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
