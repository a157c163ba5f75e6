"""Compression of vectors to one code byte per part.

Components become integers, and a vector is cut into ``PARTS`` parts. Equal parts of one
position are folded to one row with their number, so Lloyd's rounds run over distinct
parts weighted by that number. A round sends the codebooks (``ENTRIES`` rows a position) to
the tasks and brings back one sum per entry and task, whatever the number of vectors. The
last assignment is joined back to the vectors by the parts themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossiergrid.hot_keys import join_split
from dossiergrid.llm.batches import bound_batches
from dossiergrid.scratch import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Distances are exact while components (as integers) stay below this.
LARGEST = 1 << 26
#: Parts that are compared with a codebook at a time.
CHUNK = 4096


def _packed(values: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes: two a component where the row allows it, else four. Equal rows have equal bytes."""
    small = (np.abs(values) < 1 << 15).all(axis=1)
    narrow, wide = values.astype("<i2"), values.astype("<i4")
    return [(narrow[i] if s else wide[i]).tobytes() for i, s in enumerate(small.tolist())]


def _unpacked(parts: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(parts), width), np.int64)
    sizes = np.array([len(p) for p in parts])
    for size, kind in ((2 * width, "<i2"), (4 * width, "<i4")):
        at = np.flatnonzero(sizes == size)
        if len(at):
            out[at] = np.frombuffer(b"".join(parts[i] for i in at.tolist()), kind).reshape(-1, width)
    return out


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every row and its squared distance; of equally near ones the first."""
    code, error = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    top = max(np.abs(values).max(initial=0), np.abs(book).max(initial=0))
    exact = 4 * float(top) ** 2 * values.shape[1] < 2.0**53  # then doubles hold every sum
    norms = (book * book).sum(axis=1)
    step = CHUNK if exact else max(1, CHUNK // len(book))
    for a in range(0, len(values), step):
        x = values[a : a + step]
        if exact:
            apart = norms - 2.0 * (x.astype(np.float64) @ book.T.astype(np.float64))
            at = apart.argmin(axis=1)
        else:
            at = ((x[:, None, :] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        code[a : a + step] = at
        error[a : a + step] = ((x - book[at]) ** 2).sum(axis=1)
    return code, error


@dataclass(frozen=True)
class VectorCodes:
    """``rows``: vec_id, label, code, error, label_error, one row per kept vector; ``codebooks``: per
    part, the final entries (integers)."""

    rows: DataFrame
    codebooks: list[np.ndarray]

    @property
    def codebooks_sha256(self) -> str:
        """Of all integers by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(v) for book in self.codebooks for v in book.ravel().tolist()).encode()).hexdigest()


def _parts(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, width, p0..p3): the packed integer parts of every kept vector, and the components of one."""
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            length = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)  # null components are NaN here
            some = np.array(column.is_valid())
            length[~some] = 0
            good = np.isfinite(flat)
            end = np.cumsum(length)
            bad = np.concatenate([[0], np.cumsum(~good)])
            keep = some & (bad[end] - bad[end - length] == 0)
            sizes = np.unique(length[keep])
            if not len(sizes):
                continue
            if len(sizes) > 1 or sizes[0] == 0 or sizes[0] % PARTS:
                raise ValueError(f"vectors must have one length, a multiple of {PARTS}")
            values = np.floor(SCALE * flat[np.repeat(keep, length)].reshape(-1, sizes[0]))
            if np.abs(values).max() >= LARGEST:
                raise ValueError(f"components must be below {LARGEST // SCALE}")
            values = values.astype(np.int64)
            at = pa.array(np.flatnonzero(keep))
            cut = [pa.array(_packed(p), pa.binary()) for p in np.split(values, PARTS, axis=1)]
            width = pa.array(np.full(len(at), sizes[0] // PARTS), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), width, *cut], ["vec_id", "label", "width", *(f"p{k}" for k in range(PARTS))])

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, width int, " + ", ".join(f"p{k} binary" for k in range(PARTS)))


def _exploded(parts: DataFrame, *along) -> DataFrame:
    """A row per vector and position."""
    both = F.array(*[F.struct(F.lit(k).alias("position"), F.col(f"p{k}").alias("part")) for k in range(PARTS)])
    return parts.select(*along, F.inline(both))


def _sums(distinct: DataFrame, books: list[np.ndarray]) -> list:
    """Per position and entry: the number of parts it is nearest to and their componentwise sums. At most
    ``PARTS * ENTRIES`` rows reach the driver."""
    width = books[0].shape[1]
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total = np.zeros((PARTS, ENTRIES, width), np.int64)
        count = np.zeros((PARTS, ENTRIES), np.int64)
        for batch in batches:
            position, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            values = _unpacked(batch.column(1).to_pylist(), width)
            for k in range(PARTS):
                own = position == k
                if own.any():
                    code, _ = nearest(values[own], books[k])
                    np.add.at(total[k], code, values[own] * n[own][:, None])
                    np.add.at(count[k], code, n[own])
        at = np.argwhere(count > 0)
        sums = pa.array([total[k, e].tolist() for k, e in at], pa.list_(pa.int64()))
        columns = [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(count[count > 0], pa.int64()), sums]
        yield pa.RecordBatch.from_arrays(columns, ["position", "entry", "n", "sums"])

    found = distinct.select("position", "part", "n").mapInArrow(run, "position int, entry int, n long, sums array<long>")
    added = F.array(*[F.sum(F.element_at("sums", i + 1)) for i in range(width)]).alias("sums")
    return found.groupBy("position", "entry").agg(F.sum("n").alias("n"), added).collect()


def _assigned(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``distinct`` with the code and the squared distance of each part."""
    width = books[0].shape[1]
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            position, values = batch.column(0).to_numpy(), _unpacked(batch.column(1).to_pylist(), width)
            code, error = np.zeros(len(position), np.int32), np.zeros(len(position), np.int64)
            for k in range(PARTS):
                own = position == k
                if own.any():
                    code[own], error[own] = nearest(values[own], books[k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], ["position", "part", "n", "entry", "off"])

    return distinct.select("position", "part", "n").mapInArrow(run, "position int, part binary, n long, entry int, off long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> VectorCodes:
    """Codes of all vectors, and the codebooks they refer to.

    Vectors that are null or hold a null or non-finite component are left out. The first codebooks
    are the parts of the ``ENTRIES`` smallest identifiers (null last, ties by the parts' bytes); with
    fewer vectors they are shorter. Repeated rows count as often as they occur and each gets a row.
    Null labels share their error. Vectors of different lengths, of a length that ``PARTS``
    doesn't divide, or with components from ``LARGEST / SCALE`` on are an error. An empty table
    gives no rows and empty codebooks. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    parts = _parts(vectors, id_col, vector_col, label_col)
    names = [f"p{k}" for k in range(PARTS)]
    first = parts.orderBy(F.col("vec_id").asc_nulls_last(), *names).limit(ENTRIES).collect()
    if not first:
        none = parts.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return VectorCodes(none.where("false"), [np.zeros((0, 0), np.int64)] * PARTS)
    books = [_unpacked([bytes(r[n]) for r in first], first[0]["width"]) for n in names]
    distinct = materialize(_exploded(parts, "width").groupBy("position", "part", "width").agg(F.count(F.lit(1)).alias("n")), "codes-distinct")
    total, least, most = distinct.agg(F.sum("n"), F.min("width"), F.max("width")).first()
    if least != most:
        raise ValueError(f"vectors must have one length, not {PARTS * least} and {PARTS * most}")
    for _ in range(ROUNDS):
        for r in _sums(distinct, books):
            books[r["position"]][r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    codes = materialize(_assigned(distinct, books), "codes-assigned")
    # Rows of one identifier, label and vector are alike: they are counted and told out again.
    whole = F.struct(F.xxhash64(*names).alias("a"), F.xxhash64(F.lit(1), *names).alias("b")).alias("whole")
    met = join_split(_exploded(parts, "vec_id", "label", whole), codes, ["position", "part"], total)
    at = lambda k, name: F.max(F.when(F.col("position") == k, F.col(name)))
    each = met.groupBy("vec_id", "label", "whole").agg(
        *[at(k, "entry").alias(f"e{k}") for k in range(PARTS)], *[at(k, "off").alias(f"o{k}") for k in range(PARTS)], (F.count(F.lit(1)) / PARTS).cast("long").alias("copies")
    )
    code = F.concat(*[F.lpad(F.lower(F.hex(f"e{k}")), 2, "0") for k in range(PARTS)])
    error = sum((F.col(f"o{k}") for k in range(1, PARTS)), F.col("o0"))
    each = each.select("vec_id", "label", code.alias("code"), error.alias("error"), "copies", F.col("label").isNull().alias("unlabelled"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("named"))
    each = materialize(each, "codes-vectors")
    by_label = each.groupBy("unlabelled", "named").agg(F.sum(F.col("error") * F.col("copies")).alias("label_error"), F.count(F.lit(1)).alias("n"))
    rows = join_split(each, by_label, ["unlabelled", "named"], total // PARTS)
    told = rows.select("vec_id", "label", "code", "error", "label_error", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return VectorCodes(told.drop("copy"), books)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return found.rows.select("vec_id", "code", "error", "label_error", F.lit(found.codebooks_sha256).alias("codebooks_sha256"))


def _sql() -> str:
    """One assignment and one table of new entries a round."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT d.p, d.x, d.n, min({{'e': list_inner_product(d.f, d.f) - 2 * list_inner_product(d.f, b.f) + list_inner_product(b.f, b.f), 'i': b.i}}) AS m
  FROM d JOIN b{k} b ON b.p = d.p GROUP BY d.p, d.x, d.n
)""")
        if k < ROUNDS:
            steps.append(f"""u{k} AS (
  SELECT p, i, list(c ORDER BY j) AS c FROM (
    SELECT p, m.i AS i, j, floor(sum(n * v) / sum(n))::BIGINT AS c FROM (SELECT p, m, n, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM a{k}) GROUP BY p, m.i, j
  ) GROUP BY p, i
), b{k + 1} AS MATERIALIZED (
  SELECT p, i, coalesce(u.c, b.c) AS c, coalesce(u.c, b.c)::DOUBLE[] AS f FROM b{k} b LEFT JOIN u{k} u USING (p, i)
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS MATERIALIZED (
  SELECT vec_id, label, p, e[(p * len(e) // {PARTS} + 1)::BIGINT : ((p + 1) * len(e) // {PARTS})::BIGINT] AS x FROM v, range({PARTS}) AS r(p)
), d AS MATERIALIZED (
  SELECT p, x, x::DOUBLE[] AS f, count(*) AS n FROM q GROUP BY ALL
), b0 AS MATERIALIZED (
  SELECT p, i, x AS c, x::DOUBLE[] AS f FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i FROM q) WHERE i < {ENTRIES}
), {", ".join(steps)}, o AS (
  SELECT vec_id, label, string_agg(printf('%02x', m.i), '' ORDER BY q.p) AS code, sum(m.e)::BIGINT AS error
  FROM q JOIN a{ROUNDS} a ON a.p = q.p AND a.x = q.x GROUP BY vec_id, label
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, i)) FROM b{ROUNDS}) AS codebooks_sha256
FROM o
"""


OP13_SQL = _sql()
