"""N-gram Jaccard self-join with rare-first prefix filtering, and its components.

Texts with the same set of word n-grams form one class; classes are joined. The
n-grams of a class are put in one global order, rarest first (two classes can
link only if they share an n-gram of their prefixes, whatever the order; a good
order keeps the lists short). Rarity is judged by counters of fixed size over the
whole corpus: first by how far the n-gram's counter stands out of the noise of
n-grams that share it, then by the frequencies of its words. What the lists of
prefix n-grams bring together passes the length and the positional filter, then a
parity bitmap of each set (its bits that differ are no more than the members that
do), then the suffix filter, and is verified once by its exact intersection.

A list may hold a large part of the corpus. Pairs within a component need no
verification, so the lists are worked through in two steps: first every member
of a list is tried against a pivot and its neighbours in a random order (linear in
the list), twice; then, for exactness, every member outside the largest component
of its list is joined with all members of other components that pass the filters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossiergrid.llm.batches import bound_batches
from dossiergrid.components import connected_components
from dossiergrid.llm.hashed_words import Words, hashed_words, mix, windows
from dossiergrid.hot_keys import join_split
from dossiergrid.scratch import materialize

#: Counters of words and of n-grams (powers of two), counters of one piece of the sketch, and bytes of a parity bitmap.
WORD_BITS = 20
GRAM_BITS = 22
PIECE = 1 << 16
BITMAP = 256
#: Words of 64 bits of the folded bitmap that the last join compares.
FOLDED = 8
#: Members of a list worked on together; longer lists (by the sketch of n-grams) are dealt into pieces.
LIST = 256
#: Members of a piece of a list in the last, exact join.
DEALT = 4096
#: Members before it in a random order of its list that each member is tried against, besides the pivot.
BACK = 3
#: Pairs are sent to all executors up to this number (of two rows of 48 bytes).
BROADCAST_ROWS = 100_000
#: Classes a task remembers, so as not to repeat the entries of copies.
REMEMBERED = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Linked: ``100 * |a & b| >= percent * |a | b|`` over the distinct runs of ``width`` words."""

    width: int = 5
    percent: int = 80


def _slots(value: np.ndarray, bits: int) -> np.ndarray:
    """The counter of each hash."""
    return (value >> np.uint64(64 - bits)).astype(np.int64)


def shingle_sets(block: Words, width: int, commonness: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, commonness) of the distinct shingles of every text, by text and hash.

    A text of fewer words than ``width`` is one shingle. ``commonness`` has the logarithm
    of the frequency behind each counter; a shingle gets the sum over its words.
    """
    at, value = windows(block, width)
    text, size = block.text[at], np.full(len(at), width)
    for n in range(1, width):
        if (block.counts == n).any():
            start, short = windows(block, n)
            own = block.counts[block.text[start]] == n
            at = np.concatenate([at, start[own]])
            text = np.concatenate([text, block.text[start[own]]])
            value = np.concatenate([value, mix(short[own] + np.uint64(n))])
            size = np.concatenate([size, np.full(own.sum(), n)])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    if commonness is None:
        return text[new], value[new], np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(commonness[_slots(block.hash, WORD_BITS)], dtype=np.int64)])
    return text[new], value[new], (total[at + size] - total[at])[order][new]


def _class_keys(value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A key of 128 bits of each set, as two columns: sums of mixed hashes, which no order changes."""
    one, two = mix(value ^ np.uint64(0xA5A5A5A55A5A5A5A)), mix(value + np.uint64(0x1234567887654321))
    return np.column_stack([mix(np.add.reduceat(one, start)), mix(np.add.reduceat(two, start))])


def _as_binary(key: np.ndarray) -> pa.Array:
    """Keys as binary values of 16 bytes."""
    return pa.Array.from_buffers(pa.binary(16), len(key), [None, pa.py_buffer(key.astype(">u8").tobytes())]).cast(pa.binary())


@dataclass
class _Sets:
    """The sets of a block's texts that have any: text and start of each set, all hashes, class keys."""

    block: Words
    text: np.ndarray
    start: np.ndarray
    value: np.ndarray
    common: np.ndarray
    key: np.ndarray


def _sets(texts: list[bytes | None], width: int, commonness: np.ndarray | None = None) -> Iterator[_Sets]:
    for block in hashed_words(texts, lower=True):
        text, value, common = shingle_sets(block, width, commonness)
        if len(text):
            start = np.flatnonzero(np.diff(text, prepend=-1))
            yield _Sets(block, text[start], start, value, common, _class_keys(value, start))


def _bitmaps(s: _Sets) -> tuple[list[bytes], np.ndarray]:
    """Per set, the parity of the number of members that fall on each bit, and the same folded to eight words."""
    bits = BITMAP * 8
    of = np.repeat(np.arange(len(s.start)), np.diff(np.append(s.start, len(s.value))))
    hits = np.bincount(of * bits + (s.value & np.uint64(bits - 1)).astype(np.int64), minlength=len(s.start) * bits)
    parity = (hits & 1).astype(np.uint8).reshape(len(s.start), bits)
    folded = np.packbits(parity.reshape(len(s.start), -1, 64 * FOLDED).sum(axis=1, dtype=np.uint8) & 1, axis=1).view(np.int64)
    return [row.tobytes() for row in np.packbits(parity, axis=1)], folded


def _scan(docs: DataFrame, rule: Rule) -> DataFrame:
    """One pass: a row per document (doc_id, n, k, counts with its bitmap), and each task's pieces of the
    counters of words and of documents with an n-gram."""
    kind = docs.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((1 << WORD_BITS) + (1 << GRAM_BITS), np.uint32)
        salt = TaskContext.get().partitionId() % 64
        names = ["doc_id", "n", "k", "salt", "piece", "counts", "folded"]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            size = batch.num_rows
            n, k = np.zeros(size, np.int64), np.zeros((size, 2), np.uint64)
            bitmap: list[bytes | None] = [None] * size
            folded = np.zeros((size, FOLDED), np.int64)
            for s in _sets(batch.column(1).to_pylist(), rule.width):
                at = s.block.first + s.text
                n[at], k[at] = np.diff(np.append(s.start, len(s.value))), s.key
                bits, words = _bitmaps(s)
                folded[at] = words
                for i, own in zip(at.tolist(), bits, strict=True):
                    bitmap[i] = own
                np.add.at(counts, _slots(s.block.hash, WORD_BITS), 1)
                np.add.at(counts, _slots(s.value, GRAM_BITS) + (1 << WORD_BITS), 1)
            small = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * FOLDED), pa.array(folded.ravel()))
            last = pa.nulls(size, pa.int32()), pa.array(bitmap, pa.binary()), small
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), _as_binary(k), pa.nulls(size, pa.int64()), *last], names)
        if id_type is not None:
            for piece in range(len(counts) // PIECE):
                part = counts[piece * PIECE : (piece + 1) * PIECE]
                if part.any():
                    row = [pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([salt], pa.int64())]
                    sent = zlib.compress(part.tobytes(), 1)
                    yield pa.RecordBatch.from_arrays([*row, pa.array([piece], pa.int32()), pa.array([sent], pa.binary()), pa.nulls(1, pa.list_(pa.int64()))], names)

    return docs.mapInArrow(run, f"doc_id {kind}, n long, k binary, salt long, piece int, counts binary, folded array<long>")


def _add_up(pieces: DataFrame, wide: bool, *by: str) -> DataFrame:
    """Sum counters of the same piece within a task, to eight bytes each; ``by`` places them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(counts), np.uint64 if wide else np.uint32).astype(np.uint64)
                total[piece] = total[piece] + got if piece in total else got
        for piece, counts in total.items():
            sent = zlib.compress(counts.tobytes(), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece], pa.int32()), pa.array([0], pa.int64()), pa.array([sent], pa.binary())], ["piece", "salt", "counts"]
            )

    return pieces.select("piece", "salt", "counts").repartition(*[F.col(c) for c in by]).mapInArrow(run, "piece int, salt long, counts binary")


def _sketch(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By word counter: the logarithm of the frequency; by n-gram counter: how far it stands out, and pieces of its list."""
    total = np.zeros((1 << WORD_BITS) + (1 << GRAM_BITS), np.uint64)
    for r in _add_up(_add_up(scanned.where("piece is not null"), False, "piece", "salt"), True, "piece").toLocalIterator():
        total[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint64)
    grams = total[1 << WORD_BITS :]
    mean = float(grams.mean(dtype=np.float64))
    standing, pieces = np.zeros(len(grams), np.uint8), np.ones(len(grams), np.uint16)
    for at in range(0, len(grams), PIECE):  # in pieces: the driver's memory is small
        part = grams[at : at + PIECE].astype(np.float64)
        out = np.maximum(1, (part - mean) / (2 * np.sqrt(mean) + 1))
        standing[at : at + PIECE] = np.round(4 * np.log2(out))
        # Only what stands far out of the average is a long list.
        pieces[at : at + PIECE] = np.where(part > max(LIST, 4 * mean), np.minimum(part // LIST + 1, 65535), 1)
    return np.round(8 * np.log2(total[: 1 << WORD_BITS] + 1.0)).astype(np.int16), standing, pieces


def _prefixes(docs: DataFrame, rule: Rule, sketch) -> DataFrame:
    """(g, pieces, k, n, pos): the prefix n-grams of every class, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        commonness, standing, pieces = sketch.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for s in _sets(batch.column(1).to_pylist(), rule.width, commonness):
                n = np.diff(np.append(s.start, len(s.value)))
                new = np.ones(len(n), bool)
                for i, k in enumerate(map(tuple, s.key.tolist())):
                    new[i] = k not in seen
                    seen.add(k)
                if len(seen) > REMEMBERED:
                    seen.clear()
                of = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((s.value, s.common, standing[_slots(s.value, GRAM_BITS)], of))
                pos = np.arange(len(s.value)) - np.repeat(s.start, n)
                length = n - (-(-rule.percent * n // 100)) + 1
                use = (pos < np.repeat(length, n)) & np.repeat(new, n)
                g, of = s.value[order][use], of[use]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(g.view(np.int64)),
                        pa.array(pieces[_slots(g, GRAM_BITS)].astype(np.int32)),
                        _as_binary(s.key[of]),
                        pa.array(n[of].astype(np.int32)),
                        pa.array(pos[use].astype(np.int32)),
                    ],
                    ["g", "pieces", "k", "n", "pos"],
                )

    return docs.mapInArrow(run, "g long, pieces int, k binary, n int, pos int")


def _lists(entries: DataFrame) -> DataFrame:
    """The entries of n-grams that more than one class has in its prefix."""
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("k"), F.col("pieces"))).otherwise(0).alias("piece")
    dealt = entries.select("g", piece, "pieces", "k", "n", "pos").repartition("g", "piece")
    one = dealt.groupBy("g", "piece", "k").agg(F.first("pieces").alias("pieces"), F.first("n").alias("n"), F.first("pos").alias("pos"))
    several = F.count(F.lit(1)).over(Window.partitionBy("g", "piece")) > 1
    # A piece of a dealt list may hold one member of many.
    return one.withColumn("several", several | (F.col("pieces") > 1)).where("several").drop("several", "piece")


def _passes(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Length filter, and positional filter: with a shared n-gram at these places, enough can still be shared."""
    need = F.ceil((n1 + n2) * percent / (100 + percent))
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (F.least(n1 - p1, n2 - p2) >= need)


def _pivot_pairs(lists: DataFrame, labels: DataFrame | None, rule: Rule, seed: int) -> DataFrame:
    """Pairs of each member with the first and the preceding members of its list in a seeded order.

    Members whose n-gram stands early enough to link with their like come first: two
    others can only link if their sizes differ.
    """
    rows = _labelled(lists, labels)
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("k", F.lit(seed)), F.col("pieces"))).otherwise(0)
    late = F.col("n") - F.col("pos") < F.ceil(F.col("n") * 2 * rule.percent / (100 + rule.percent))
    order = Window.partitionBy("g", "piece").orderBy("late", "r", "k")
    me = F.struct("k", "n", "pos", "c")
    rows = rows.withColumn("piece", piece).withColumn("r", F.xxhash64("g", "k", F.lit(seed))).withColumn("late", late)
    pivot = F.first(me).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("tried", F.array(pivot, *[F.lag(me, back).over(order) for back in range(1, BACK + 1)]))
    fits = lambda o: o.isNotNull() & (o["c"] != F.col("c")) & _passes(F.col("n"), F.col("pos"), o["n"], o["pos"], rule.percent)
    rows = rows.select("k", F.explode(F.filter("tried", fits)).alias("o"))
    return rows.select(F.least("k", "o.k").alias("a"), F.greatest("k", "o.k").alias("b")).distinct()


def _cross_pairs(lists: DataFrame, labels: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """All pairs of one list and different components that pass the filters and the folded bitmaps."""
    rows = _labelled(lists, labels)
    parts = rows.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m"))
    major = parts.groupBy("g").agg(F.max_by("c", F.struct("m", "c")).alias("major"), F.count(F.lit(1)).alias("parts"), F.sum("m").alias("m")).where("parts > 1")
    # A list is dealt to pieces of a bounded size; the members outside its largest component go to each of them.
    pieces = F.ceil(F.col("m") / DEALT).cast("int").alias("of")
    rows = join_split(rows, major.select("g", "major", pieces, F.col("m").alias("n")), ["g"], lists.count()).join(classes.select("k", "folded"), "k")
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("k"), F.col("of")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("piece")
    minor = rows.where("c <> major").select("g", every, *[F.col(x).alias(f"{x}1") for x in ("k", "n", "pos", "c", "folded")])
    other = (F.col("c1") != F.col("c")) & ((F.col("c") == F.col("major")) | (F.col("k1") < F.col("k")))
    close = _passes(F.col("n1"), F.col("pos1"), F.col("n"), F.col("pos"), rule.percent)
    both = F.col("n1") + F.col("n")
    apart = sum((F.bit_count(F.get("folded1", F.lit(i)).bitwiseXOR(F.get("folded", F.lit(i)))) for i in range(FOLDED)), F.lit(0))
    alike = apart <= both - 2 * F.ceil(both * rule.percent / (100 + rule.percent))
    met = minor.join(rows.select(F.col("g").alias("g2"), F.col("piece").alias("piece2"), "k", "n", "pos", "c", "major", "folded"), (F.col("g") == F.col("g2")) & (F.col("piece") == F.col("piece2")) & other & close & alike)
    return met.select(F.least("k1", "k").alias("a"), F.greatest("k1", "k").alias("b")).distinct()


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("c", F.col("k"))
    return lists.join(labels, F.col("k") == F.col("node"), "left").withColumn("c", F.coalesce("root", "k")).drop("node", "root")


def suffix_filter(x: np.ndarray, y: np.ndarray, most: int, depth: int = 2) -> bool:
    """False if the sorted sets surely differ in more than ``most`` members: cut both at y's middle
    member; the sizes left and right of it bound the difference from below."""

    def least(x: np.ndarray, y: np.ndarray, depth: int) -> int:
        if not depth or not len(x) or not len(y):
            return abs(len(x) - len(y))
        middle = y[len(y) // 2]
        cut, cut_y = np.searchsorted(x, middle), len(y) // 2
        return least(x[:cut], y[:cut_y], depth - 1) + least(x[cut:], y[cut_y:], depth - 1)

    return least(x, y, depth) <= most


def _both_ends(pairs: DataFrame, per_class: DataFrame) -> DataFrame:
    """(a, b, x, y): the pairs with their classes' ``members``; only what the pairs need is shuffled."""
    n = pairs.count()
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("end"))
    both = per_class.join(F.broadcast(ends) if n <= BROADCAST_ROWS else ends, per_class["k"] == F.col("end")).select("a", "b", "k", "members")
    x = F.min(F.when(F.col("k") == F.col("a"), F.col("members"))).alias("x")
    return both.groupBy("a", "b").agg(x, F.min(F.when(F.col("k") == F.col("b"), F.col("members"))).alias("y"))


def _filtered(ends: DataFrame, linked) -> DataFrame:
    """The pairs (a, b) whose members are ``linked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return ends.mapInArrow(run, "a binary, b binary")


def _alike(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose parity bitmaps don't rule a link out."""
    percent = rule.percent

    def possible(x: bytes, y: bytes) -> bool:
        n1, n2 = int.from_bytes(x[:8], "big"), int.from_bytes(y[:8], "big")
        need = -(-percent * (n1 + n2) // (100 + percent))
        return (int.from_bytes(x[8:], "big") ^ int.from_bytes(y[8:], "big")).bit_count() <= n1 + n2 - 2 * need

    sized = classes.select("k", F.concat(F.unhex(F.lpad(F.hex("n"), 16, "0")), F.col("bitmap")).alias("members"))
    return _filtered(_both_ends(pairs, sized), possible)


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The links among ``pairs`` (a, b), each verified once by its exact intersection.

    The sets are computed again from one text of each class that is left.
    """
    percent = rule.percent
    pairs = materialize(_alike(pairs, classes, rule), "jaccard-alike")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct().join(classes.select("k", "doc_id"), "k")
    wanted = materialize(wanted.select(F.col("doc_id").alias("wanted_id")), "jaccard-wanted")
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _sets(batch.column(1).to_pylist(), rule.width):
                sets = [part.tobytes() for part in np.split(s.value, s.start[1:])]
                yield pa.RecordBatch.from_arrays([_as_binary(s.key), pa.array(sets, pa.binary())], ["k", "members"])

    def linked(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        need = -(-percent * (len(x) + len(y)) // (100 + percent))
        # Members in one of both sets only: at most so many.
        return suffix_filter(x, y, len(x) + len(y) - 2 * need) and len(np.intersect1d(x, y, assume_unique=True)) >= need

    return _filtered(_both_ends(pairs, texts.mapInArrow(members, "k binary, members binary")), linked)


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer words than
    ``rule.width`` is one shingle, a null text or one without words has none and is
    alone. ``component_id`` is the smallest identifier reachable by links. Rows with
    equal sets are linked whatever their identifiers; a null identifier is never the
    smallest unless it is alone. Shingles are compared by 64-bit hashes, and sets are
    told apart by 128-bit keys.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    sc = docs.sparkSession.sparkContext
    scanned = materialize(_scan(rows, rule), "jaccard-scan")
    known = scanned.where("piece is null").select("doc_id", "n", "k", F.col("counts").alias("bitmap"), "folded")
    classes = known.where("n > 0").groupBy("k").agg(
        F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("bitmap").alias("bitmap"), F.min("folded").alias("folded")
    )
    classes = materialize(classes, "jaccard-classes")
    sketch = sc.broadcast(_sketch(scanned))
    lists = materialize(_lists(_prefixes(rows, rule, sketch)), "jaccard-lists")
    sketch.unpersist()
    labels: DataFrame | None = None
    seen: DataFrame | None = None
    for step in (1, 2, 0):
        pairs = _pivot_pairs(lists, labels, rule, step) if step else _cross_pairs(lists, labels, classes, rule)
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "jaccard-pairs")
        links = _verify(pairs, rows, classes, rule)
        if labels is not None:
            links = links.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
        labels = connected_components(links)
        seen = pairs if seen is None else seen.unionByName(pairs)
    grouped = classes.join(labels, F.col("k") == F.col("node"), "left").select("k", "doc_id", F.coalesce("root", "k").alias("root"))
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = grouped.join(least, "root").select("k", "component_id")
    # Texts without shingles are alone.
    full = known.where("n > 0").join(named, "k").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(known.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, Rule(width=4, percent=85))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, min(reached) AS c FROM r GROUP BY doc_id) c ON c.doc_id = w.doc_id
"""
