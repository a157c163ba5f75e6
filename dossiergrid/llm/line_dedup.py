"""Incremental, reversible line dedup.

An index holds three tables in the shared folder, each a list of changes that is only
added to: the exact references (a step of +1 or -1 per line key and document), the exact
counts per key (the latest row of a key holds), and one cuckoo filter per shard over the
keys that enough documents hold (the latest of a shard holds). Inserting or deleting
documents writes rows for the references, keys and shards it touches and no others;
deleting what was inserted restores the former state. After ``DELTAS`` changes they are
merged into one table. Shards are added as the index grows, so that one holds some
thousand keys, whatever the corpus.

Applying the index sends every line key to its shard's filter: keys and filters are dealt
by shard, and by one of ``PIECES`` pieces of the documents, sorted so that the filter comes
first, and pass through it as a stream. Only lines that a filter doesn't rule out reach the
exact counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossiergrid.llm.batches import bound_batches
from dossiergrid.hot_keys import join_split
from dossiergrid.scratch import materialize

SPACE = b" \t\n\x0b\x0c\r"
SLOTS = 4
#: Largest part of the slots that may be filled.
LOAD = 0.85
#: Frequent keys of a shard, about; twice as many make the shards double.
SHARD_KEYS = 4096
LEAST_SHARDS = 64
#: Lines of one shard are dealt to so many pieces, each with the shard's filter.
PIECES = 32
#: Changes a table holds before they are merged.
DELTAS = 8
#: Rounds of moves after which a filter counts as too full.
ROUNDS = 500


class CuckooFilter:
    """Sixteen-bit fingerprints of 64-bit hashes in buckets of four; items can be deleted."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = len(table) - 1

    @classmethod
    def sized(cls, items: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, items) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @property
    def capacity(self) -> int:
        return int(self.table.size * LOAD)

    @property
    def items(self) -> int:
        return int(np.count_nonzero(self.table))

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marks = (hashes >> np.uint64(48)).astype(np.uint16)
        marks[marks == 0] = 1
        first = (hashes & np.uint64(self.mask)).astype(np.int64)
        return marks, first, self._other(first, marks)

    def _other(self, at, mark):
        return at ^ ((np.asarray(mark).astype(np.int64) * 0x5BD1E995 >> 7) & self.mask)

    def _put(self, marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place marks in free slots of their buckets; returns which found none."""
        order = np.argsort(at, kind="stable")
        free = self.table[at[order]] == 0
        rank = _rank(at[order])
        fits = rank < free.sum(axis=1)
        slot = np.argmax(np.cumsum(free, axis=1) == (rank + 1)[:, None], axis=1)
        self.table[at[order][fits], slot[fits]] = marks[order][fits]
        left = np.ones(len(at), bool)
        left[order[fits]] = False
        return left

    def add(self, hashes: np.ndarray) -> bool:
        """False if the filter is too full; some of the hashes are in it then."""
        marks, at, _ = self._places(hashes)
        rng = np.random.default_rng(len(hashes))
        for _ in range(ROUNDS):
            for _ in range(2):
                left = self._put(marks, at)
                marks = marks[left]
                at = self._other(at[left], marks)
                if not len(marks):
                    return True
            # One mark of each full bucket takes the place of another, which goes on to its other bucket.
            bucket, one = np.unique(at, return_index=True)
            slot = rng.integers(0, SLOTS, len(bucket))
            out = self.table[bucket, slot].copy()
            self.table[bucket, slot] = marks[one]
            marks[one] = out
            at[one] = self._other(bucket, out)
        return False

    def remove(self, hashes: np.ndarray) -> None:
        """Delete hashes that were added."""
        marks, at, other = self._places(hashes)
        for _ in range(2):
            order = np.lexsort((marks, at))
            marks, at, other = marks[order], at[order], other[order]
            held = self.table[at] == marks[:, None]
            rank = _rank(at * (1 << 16) + marks)
            there = rank < held.sum(axis=1)
            slot = np.argmax(np.cumsum(held, axis=1) == (rank + 1)[:, None], axis=1)
            self.table[at[there], slot[there]] = 0
            marks, at, other = marks[~there], other[~there], at[~there]

    def might_hold(self, hashes: np.ndarray) -> np.ndarray:
        marks, first, second = self._places(hashes)
        return ((self.table[first] == marks[:, None]) | (self.table[second] == marks[:, None])).any(axis=1)


def _rank(values: np.ndarray) -> np.ndarray:
    """The place of each of the sorted values among its equals."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.arange(len(values)) - np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of the SHA-256 of the stripped line with A-Z lower-cased; None if it is too short."""
    line = line.strip(SPACE)
    if len(line) < min_chars or (not line.isascii() and sum((b & 0xC0) != 0x80 for b in line) < min_chars):
        return None
    return hashlib.sha256(line.lower()).digest()[:16]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), np.uint64)


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("key", 9, 6)), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard")


@dataclass
class LineIndex:
    """The state: keys held by at least ``min_docs`` documents lose all lines but those of the largest doc_id.

    Null identifiers count as one document, below all others. A document counts a
    key once however often it repeats the line, and in however many rows. The three
    tables are lists of changes; ``references``, ``counts`` and ``filters`` read them.
    """

    spark: SparkSession
    id_type: str
    min_docs: int = 5
    min_chars: int = 40
    shards: int = LEAST_SHARDS
    steps: tuple[DataFrame, ...] = ()  # key, doc_id, step
    recounts: tuple[DataFrame, ...] = ()  # key, n_docs, max_doc
    blobs: tuple[DataFrame, ...] = ()  # shard, blob

    @classmethod
    def empty(cls, spark: SparkSession, min_docs: int = 5, min_chars: int = 40, shards: int = LEAST_SHARDS, id_type: str = "bigint") -> LineIndex:
        return cls(spark, id_type, min_docs, min_chars, shards)

    def _table(self, deltas: tuple[DataFrame, ...], schema: str) -> DataFrame:
        if not deltas:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, [d.withColumn("version", F.lit(k)) for k, d in enumerate(deltas)])

    @property
    def references(self) -> DataFrame:
        """(key, doc_id): the exact references."""
        if len(self.steps) == 1:
            return self.steps[0].select("key", "doc_id")
        table = self._table(self.steps, f"key binary, doc_id {self.id_type}, step int, version int")
        return table.groupBy("key", "doc_id").agg(F.sum("step").alias("step")).where("step > 0").select("key", "doc_id")

    @property
    def counts(self) -> DataFrame:
        """(shard, key, n_docs, max_doc): the exact counts."""
        table = self._table(self.recounts, f"key binary, n_docs long, max_doc {self.id_type}, version int")
        return _latest(table, len(self.recounts), "key").where("n_docs > 0").select(_shard(self.shards), "key", "n_docs", "max_doc")

    @property
    def filters(self) -> DataFrame:
        """(shard, blob): the filters."""
        return _latest(self._table(self.blobs, "shard int, blob binary, version int"), len(self.blobs), "shard").select("shard", "blob")

    def _keys_of(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(key, doc_id, text_key): the distinct line keys of every row."""
        min_chars = self.min_chars
        text = F.coalesce(docs[text_col], F.lit("")).cast("binary")
        rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
        kind = rows.dtypes[0][1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys: list[bytes] = []
                at: list[int] = []
                for i, text in enumerate(batch.column(1)):
                    found = {line_key(x, min_chars) for x in text.as_py().split(b"\n")} - {None}
                    keys += found
                    at += [i] * len(found)
                row = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0).take(row), batch.column(2).take(row)], ["key", "doc_id", "text_key"])

        return rows.mapInArrow(run, f"key binary, doc_id {kind}, text_key long")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with these documents in it; those it holds already change nothing."""
        bound_batches(self.spark)
        new = self._keys_of(docs, id_col, text_col).select("key", "doc_id").distinct()
        if self.steps:
            known = self.references.select(F.col("key").alias("known"), F.col("doc_id").alias("known_doc"))
            new = new.join(known, (F.col("key") == F.col("known")) & F.col("doc_id").eqNullSafe(F.col("known_doc")), "left_anti")
        new = materialize(new.withColumn("step", F.lit(1)), "line-references")
        added = new.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        if not self.steps:
            return self._with(new, materialize(added.select("key", F.col("n").alias("n_docs"), F.col("top").alias("max_doc")), "line-counts"))
        was = self.counts.select("key", "n_docs", "max_doc")
        now = added.join(was, "key", "left").select("key", (F.col("n") + F.coalesce("n_docs", F.lit(0))).alias("n_docs"), F.greatest("top", "max_doc").alias("max_doc"))
        return self._with(new, materialize(now, "line-counts"))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """The index without the documents whose identifiers ``ids`` lists."""
        gone_ids = ids.select(ids[id_col].alias("gone_id")).distinct()
        gone = self.references.join(gone_ids, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_semi")
        gone = materialize(gone.select("key", "doc_id", F.lit(-1).alias("step")), "line-references")
        lost = gone.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        left = replace(self, steps=(*self.steps, gone)).references.join(lost.select("key"), "key", "left_semi")
        tops = left.groupBy("key").agg(F.max("doc_id").alias("max_doc"))
        was = self.counts.select("key", "n_docs")
        now = lost.join(was, "key").join(tops, "key", "left").select("key", (F.col("n_docs") - F.col("n")).alias("n_docs"), "max_doc")
        return self._with(gone, materialize(now, "line-counts"))

    def _with(self, steps: DataFrame, recounts: DataFrame) -> LineIndex:
        """The index with these changes, and with the keys among them that crossed the threshold carried into the filters."""
        out = replace(self, steps=(*self.steps, steps), recounts=(*self.recounts, recounts))
        if len(out.steps) > DELTAS:
            whole = materialize(out.references.withColumn("step", F.lit(1)), "line-references")
            counts = materialize(out.counts.select("key", "n_docs", "max_doc"), "line-counts")
            out = replace(out, steps=(whole,), recounts=(counts,))
        often = F.col("n_docs") >= self.min_docs
        n = out.counts.where(often).count()
        if n > 2 * SHARD_KEYS * out.shards:
            # More shards: all filters are made anew.
            more = 1 << int(np.ceil(np.log2(n / SHARD_KEYS)))
            grown = replace(out, shards=more, blobs=())
            return grown._built(grown.counts.where(often).select("shard", "key", F.lit(1).alias("step")))
        now = recounts.select("key", often.cast("int").alias("now"))
        was = self.counts.where(often).select("key", F.lit(1).alias("was")) if self.recounts else None
        step = F.col("now") if was is None else F.col("now") - F.coalesce("was", F.lit(0))
        crossed = now if was is None else now.join(was, "key", "left")
        return out._built(crossed.select(_shard(out.shards), "key", step.alias("step")).where("step <> 0"))

    def _built(self, crossed: DataFrame) -> LineIndex:
        """The index with the filters of the shards that ``crossed`` (shard, key, step) touches brought up to date.

        A filter without room is built anew, twice as large, from the exact counts. A shard for which none can be built
        gets an empty blob, which rules out nothing. The first filters are made for every shard, so that a missing one is never taken for one without keys.
        """
        if not self.blobs:
            every = self.spark.range(self.shards).select(F.col("id").cast("int").alias("shard"), F.lit(None).cast("binary").alias("key"), F.lit(0).alias("step"))
            crossed = crossed.unionByName(every)
        crossed = materialize(crossed, "line-crossed")
        out = self
        made = materialize(_updated(self.filters if self.blobs else None, crossed), "line-filters")
        out = replace(out, blobs=(*out.blobs, made.where("blob is not null")))
        for grow in (1, 2, 4, 8, 16):
            full = made.where("blob is null").select("shard")
            if full.isEmpty():
                break
            frequent = self.counts.where(F.col("n_docs") >= self.min_docs).join(full, "shard", "left_semi")
            made = materialize(_updated(None, frequent.select("shard", "key", F.lit(1).alias("step")), grow), "line-filters")
            out = replace(out, blobs=(*out.blobs, made.where("blob is not null")))
        else:
            out = replace(out, blobs=(*out.blobs, made.where("blob is null").select("shard", F.lit(b"").alias("blob"))))
        if len(out.blobs) > DELTAS:
            out = replace(out, blobs=(materialize(out.filters, "line-filters"),))
        return out

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id``, ``kept_text``, ``n_lines``, ``n_dropped``: each row's text without the lines it loses.

        A null or empty text is one empty line. Repeated rows are treated alike.
        """
        bound_batches(self.spark)
        keys = self._keys_of(docs, id_col, text_col)
        piece = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(PIECES)).cast("int")
        none = F.lit(None).cast("binary").alias("blob")
        lines = keys.select(_shard(self.shards), piece.alias("piece"), none, "key", "doc_id", "text_key")
        every = F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("piece")
        held = self.filters.select("shard", every, "blob", *[F.lit(None).cast(t).alias(c) for c, t in keys.dtypes])
        both = lines.unionByName(held).repartition("shard", "piece").sortWithinPartitions("shard", "piece", F.col("blob").isNull())

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, held = None, None
            for batch in batches:
                at = batch.column(0).to_numpy().astype(np.int64) * PIECES + batch.column(1).to_numpy()
                maybe = np.zeros(len(at), bool)
                cuts = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if at[a] != place:
                        place, held = at[a], None
                    blob = batch.column(2)[a]
                    if blob.is_valid:
                        held, a = CuckooFilter.from_bytes(blob.as_py()) if len(blob.as_py()) else None, a + 1
                    if held is None:
                        maybe[a:b] = True  # no filter rules these lines out: the exact counts decide
                    elif a < b:
                        maybe[a:b] = held.might_hold(_hashes(batch.column(3).slice(a, b - a).to_pylist()))
                yield batch.filter(pa.array(maybe)).select(["key", "doc_id", "text_key"])

        keys = materialize(both.mapInArrow(probe, keys.schema), "line-probed")
        # The exact counts decide; false positives of a filter end here.
        frequent = self.counts.where(F.col("n_docs") >= self.min_docs).select("key", "max_doc")
        met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        lost = join_split(keys, met.join(frequent, "key"), ["key"], keys.count()).where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
        lost = lost.groupBy(F.col("doc_id").alias("lost_doc"), F.col("text_key").alias("lost_text")).agg(F.collect_set("key").alias("lost"))
        text = F.coalesce(docs[text_col], F.lit("")).cast("binary")
        rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
        same = (rows["text_key"] == lost["lost_text"]) & rows["doc_id"].eqNullSafe(lost["lost_doc"])
        rows = rows.join(lost, same, "left").select("doc_id", "text", "lost")
        min_chars, kind = self.min_chars, rows.dtypes[0][1]

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept_text, n_lines, n_dropped = [], [], []
                for text, lost in zip(batch.column(1), batch.column(2), strict=True):
                    text = text.as_py()
                    if not lost.is_valid:
                        kept_text.append(text)
                        n_lines.append(text.count(b"\n") + 1)
                        n_dropped.append(0)
                        continue
                    gone, lines = set(lost.as_py()), text.split(b"\n")
                    kept = [x for x in lines if line_key(x, min_chars) not in gone]
                    kept_text.append(b"\n".join(kept))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(kept_text, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                    ["doc_id", "kept_text", "n_lines", "n_dropped"],
                )

        done = rows.mapInArrow(rewrite, f"doc_id {kind}, kept_text binary, n_lines long, n_dropped long")
        return done.select("doc_id", F.col("kept_text").cast("string").alias("kept_text"), "n_lines", "n_dropped")


def _latest(table: DataFrame, versions: int, key: str) -> DataFrame:
    """The row of the highest version of each key."""
    if versions <= 1:
        return table.drop("version")
    rest = [c for c in table.columns if c not in (key, "version")]
    return table.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("row")).select(key, "row.*")


def _updated(old: DataFrame | None, crossed: DataFrame, grow: int = 1) -> DataFrame:
    """(shard, blob) of every shard in ``crossed``; a null blob where the keys don't fit into the filter."""

    def change(held: CuckooFilter | None, steps: pa.Table) -> pa.Table:
        keys, way = steps["key"].to_pylist(), steps["step"].to_pylist()
        plus, minus = (_hashes([k for k, w in zip(keys, way, strict=True) if w * sign > 0]) for sign in (1, -1))
        held = CuckooFilter.sized(2 * grow * len(plus)) if held is None else held
        held.remove(minus)
        blob = held.to_bytes() if held.items + len(plus) <= held.capacity and held.add(plus) else None
        return pa.table({"shard": pa.array([steps["shard"][0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

    def one(steps: pa.Table) -> pa.Table:
        return change(None, steps)

    def both(was: pa.Table, steps: pa.Table) -> pa.Table:
        if not steps.num_rows:  # not touched: its last filter holds
            return pa.table({"shard": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        if was.num_rows and not len(was["blob"][0].as_py()):  # without a filter so far: it is built anew
            return pa.table({"shard": was["shard"][:1], "blob": pa.array([None], pa.binary())})
        return change(CuckooFilter.from_bytes(was["blob"][0].as_py()) if was.num_rows else None, steps)

    if old is None:
        return crossed.groupBy("shard").applyInArrow(one, "shard int, blob binary")
    return old.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(both, "shard int, blob binary")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = LineIndex.empty(spark).insert(docs).apply(docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped
  FROM k LEFT JOIN f ON f.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
