"""Merkle manifest of a dataset, with an authentication path for every row.

The leaves of a source are cut into aligned blocks of ``RUN ** LEVELS`` by default. Within a block the
paths come from a fractal traversal: for every level it keeps the existing subtree (the
run that the current leaf is below) and the desired one (the next run), which takes in
one leaf for every leaf that is passed, so it is complete when it is needed and a few hundred
digests are held at a time. The blocks' roots are the leaves of the next tier, and so on up
to one block a source, and the sources' roots are the leaves of the last tower. On the
way back every tier appends the path of its block's root to its own paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossiergrid.llm.expressions import ascii_lower
from dossiergrid.scratch import materialize, shuffle_partitions

#: Nodes of a run, and levels of a block.
RUN, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One of so many rows is tampered with, by the checksum of its identifier.
TAMPERED_OF = 5


def digest(*parts: str) -> str:
    """SHA-256 of the parts, one behind another, as lower-case hex."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels until ``n`` nodes are one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


class _Growing:
    """The nodes of one level, from the leaves below them, given in order."""

    def __init__(self, level: int):
        self.open: list[list[str]] = [[] for _ in range(level + 1)]

    def take(self, leaf: str) -> None:
        node, level = leaf, 0
        self.open[0].append(node)
        while level < len(self.open) - 1 and len(self.open[level]) == RUN:
            node = digest(*self.open[level])
            self.open[level] = []
            level += 1
            self.open[level].append(node)

    def done(self) -> list[str]:
        """The nodes; runs that the leaves did not fill are closed as they are."""
        for level in range(len(self.open) - 1):
            if self.open[level]:
                self.open[level + 1].append(digest(*self.open[level]))
                self.open[level] = []
        return self.open[-1]


class Traversal:
    """Authentication paths of the leaves of one block, in order."""

    def __init__(self, leaves: list[str], levels: int):
        self.leaves, self.levels = leaves, levels
        growing = [_Growing(level) for level in range(levels)]
        for level in range(levels):
            for leaf in leaves[: RUN ** (level + 1)]:
                growing[level].take(leaf)
        self.existing = [g.done() for g in growing]
        self.desired = [_Growing(level) for level in range(levels)]
        self.root = digest(*self.existing[-1]) if levels else leaves[0]

    def __iter__(self) -> Iterator[list[tuple[list[str], list[str]]]]:
        """Per leaf and level, the siblings on its left and on its right."""
        leaves = self.leaves
        for i in range(len(leaves)):
            for level in range(self.levels):
                span = RUN ** (level + 1)
                if i and i % span == 0:
                    self.existing[level] = self.desired[level].done()
                    self.desired[level] = _Growing(level)
                ahead = i + span
                if ahead < len(leaves):
                    self.desired[level].take(leaves[ahead])
            path = []
            for level, run in enumerate(self.existing):
                at = i // RUN**level % RUN
                path.append((run[:at], run[at + 1 :]))
            yield path


def _levels_of(block: int, n: int, levels: int) -> int:
    """A first block that isn't full is its group's only one and may be lower; all others have all ``levels``."""
    return levels if block else height(n)


def _encode(path: list[tuple[str, str]]) -> bytes:
    """Levels of joined siblings: the numbers on the left and right, then the digests."""
    return b"".join(bytes((len(a) // 64, len(b) // 64)) + bytes.fromhex(a + b) for a, b in path)


def _decode(path: bytes) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        middle, end = at + 2 + 32 * left, at + 2 + 32 * (left + right)
        out.append((path[at + 2 : middle].hex(), path[middle:end].hex()))
        at = end
    return out


def field(value: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 bytes' number, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256))


def _numbered(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``position``, their place in the order of their group, from 0.

    The rows are range-partitioned by group and order, and counted where they lie. A group goes on from
    one range to the next, which at most one group a range does: those few lengths are sent to all tasks.
    """
    spark, fields = rows.sparkSession, rows.columns
    # Rows that are equal in every key are dealt by where they were read.
    keys = [*(F.col(g) for g in group), *order, F.col("read_at")]
    ranged = rows.withColumn("read_at", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    ranged = ranged.select(*fields, F.spark_partition_id().alias("part"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, passed = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for g in group:
                codes = pc.dictionary_encode(batch.column(g), null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            own = [batch.column(g)[0].as_py() for g in group]
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            local = np.arange(n, dtype=np.int64) - start
            local[start == 0] += passed if own == last else 0
            last, passed = [batch.column(g)[n - 1].as_py() for g in group], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], [*batch.schema.names, "local"])

    schema = ", ".join(f"{c} {kind}" for c, kind in ranged.dtypes)
    local = materialize(ranged.mapInArrow(count, f"{schema}, local long"), "manifest-numbered")
    sizes = local.groupBy("part", *group).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.sum("n").over(before)).where("offset > 0").select("part", *group, "offset")
    met = local.join(F.broadcast(offsets), ["part", *group], "left")
    return met.select(*fields, (F.col("local") + F.coalesce("offset", F.lit(0))).alias("position"))


_GROUP = ["named", "grp"]
_BLOCK = [*_GROUP, "block"]
_PATH = "named boolean, grp string, position long, path binary, subroot string, root string"


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    size = RUN**levels
    return nodes.withColumn("block", ((F.col("position") - F.pmod("position", F.lit(size))) / size).cast("long"))


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("position")


def _hexes(column: pa.ChunkedArray) -> list[str | None]:
    return [v.hex() if v is not None else None for v in column.to_pylist()]


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """(named, grp, position, digest): the root of every block, at the place of the block."""

    def fold(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        block = table["block"][0].as_py()
        root = Traversal(_hexes(table["digest"]), _levels_of(block, table.num_rows, levels)).root
        return pa.table({"named": table["named"][:1], "grp": table["grp"][:1], "position": table["block"][:1], "digest": pa.array([bytes.fromhex(root)], pa.binary())})

    slim = _blocks(nodes.select(*_GROUP, "position", "digest"), levels)
    return slim.groupBy(*_BLOCK).applyInArrow(fold, "named boolean, grp string, position long, digest binary")


def _tower(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of nodes from ``nodes`` up to one block a group, and the groups' roots."""
    tiers = [nodes]
    while True:
        roots = materialize(_roots(tiers[-1], levels), "manifest-roots")
        if not (roots.agg(F.max("position")).first()[0] or 0):
            return tiers, roots
        tiers.append(roots)


def _paths_below(nodes: DataFrame, upper: DataFrame, levels: int) -> DataFrame:
    """The paths of ``nodes``, each with that of its block's root (in ``upper``) behind it."""

    def emit(table: pa.Table, above: pa.Table) -> pa.Table:
        table = _in_order(table)
        n, block = table.num_rows, table["block"][0].as_py()
        tail = above["path"][0].as_py()
        paths = [_encode([("".join(a), "".join(b)) for a, b in path]) + tail for path in Traversal(_hexes(table["digest"]), _levels_of(block, n, levels))]
        same = {c: pa.array([above[c][0].as_py()] * n, pa.string()) for c in ("subroot", "root")}
        return pa.table({"named": table["named"], "grp": table["grp"], "position": table["position"], "path": pa.array(paths, pa.binary()), **same})

    blocks = _blocks(nodes.select(*_GROUP, "position", "digest"), levels)
    return blocks.groupBy(*_BLOCK).cogroup(upper.withColumnRenamed("position", "block").groupBy(*_BLOCK)).applyInArrow(emit, _PATH)


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, text_col: str = "text", levels: int = LEVELS) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified`` of every row.

    A leaf hashes ``fields``; leaves ascend by identifier within their source (null first, equal
    identifiers by their leaf), sources by their bytes (null first). Null and empty values differ. A
    row whose identifier's CRC-32 ``TAMPERED_OF`` divides is folded as if A-Z in its text had been
    lower-cased; one without identifier never is. Repeated rows are leaves of their own. An empty
    table gives no rows. Columns that aren't among ``fields`` are ignored, whatever their names.
    """
    kind = docs.select(docs[id_col].alias("doc_id")).dtypes[0][1]
    changed = [ascii_lower(docs[c]) if c == text_col else docs[c] for c in fields]
    tampered = F.crc32(docs[id_col].cast("string").cast("binary")) % TAMPERED_OF == 0
    source = docs[source_col].cast("string")
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        source.isNotNull().alias("named"),
        F.coalesce(source, F.lit("")).alias("grp"),
        _leaf([docs[c] for c in fields]).alias("digest"),
        F.when(tampered, _leaf(changed)).alias("forged"),
    )
    # The texts are hashed once; sampling the ranges and sorting read digests only.
    slim = materialize(rows, "manifest-leaves")
    leaves = materialize(_numbered(slim, _GROUP, [F.col("doc_id").asc_nulls_first(), F.col("digest")]), "manifest-positions")
    tiers, subroots = _tower(leaves, levels)
    # The sources' roots are one more group of leaves.
    one = subroots.select(F.lit(True).alias("named"), F.lit("").alias("grp"), F.col("named").alias("of_named"), F.col("grp").alias("of_grp"), "digest")
    tops = materialize(_numbered(one, _GROUP, [F.col("of_named"), F.col("of_grp")]), "manifest-sources")
    upper_tiers, roots = _tower(tops, levels)
    hexed = F.lower(F.hex("digest")).alias("root")
    above = roots.select(*_GROUP, "position", F.lit(b"").alias("path"), F.lit("").alias("subroot"), hexed)
    for tier in reversed(upper_tiers):
        above = _paths_below(tier, above, levels)
    of_source = tops.select("position", "of_named", "of_grp", F.lower(F.hex("digest")).alias("of_subroot")).join(above, "position")
    upper = of_source.select(F.col("of_named").alias("named"), F.col("of_grp").alias("grp"), F.lit(0).cast("long").alias("position"), "path", F.col("of_subroot").alias("subroot"), "root")
    upper = materialize(upper, "manifest-paths")
    for tier in reversed(tiers[1:]):
        upper = materialize(_paths_below(tier, upper, levels), "manifest-paths")

    def emit(table: pa.Table, above: pa.Table) -> pa.Table:
        table = _in_order(table)
        n, block = table.num_rows, table["block"][0].as_py()
        tail = _decode(above["path"][0].as_py())
        proof_tail = "".join(a + b for a, b in tail)
        subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
        leaf, forged = _hexes(table["digest"]), _hexes(table["forged"])
        proofs, folded = [], []
        for own, false, path in zip(leaf, forged, Traversal(leaf, _levels_of(block, n, levels)), strict=True):
            joined = [("".join(a), "".join(b)) for a, b in path]
            proofs.append(digest(*(a + b for a, b in joined), proof_tail))
            node = own if false is None else false
            for a, b in joined:
                node = digest(a, node, b)
            for a, b in tail:
                node = digest(a, node, b)
            folded.append(node)
        out = {"doc_id": table["doc_id"], "leaf": leaf, "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded}
        return pa.table(out | {"verified": [f == root for f in folded]})

    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    blocks = _blocks(leaves, levels)
    return blocks.groupBy(*_BLOCK).cogroup(upper.withColumnRenamed("position", "block").groupBy(*_BLOCK)).applyInArrow(emit, schema)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS))


def _tower_sql(name: str, leaves: str, levels: int) -> str:
    """Nodes of ``levels`` levels over ``leaves`` (grp, pos, digest, n), and the runs above each level."""
    steps = [f"{name}0 AS MATERIALIZED (SELECT grp, pos, digest, n FROM {leaves})"]
    for k in range(levels):
        steps.append(f"{name}r{k} AS MATERIALIZED (SELECT grp, pos // {RUN} AS run, list(digest ORDER BY pos) AS digests, any_value(n) AS n FROM {name}{k} GROUP BY grp, pos // {RUN})")
        steps.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT grp, run AS pos, CASE WHEN n = 1 THEN digests[1] ELSE sha256(array_to_string(digests, '')) END AS digest,"
            f" (n + {RUN - 1}) // {RUN} AS n FROM {name}r{k})"
        )
    return ", ".join(steps)


def _fold_sql(name: str, rows: str, out: str, levels: int) -> str:
    """``rows`` (grp, pos, node, proof, ...) folded up to the top of the tower: level by level, siblings join the proof."""
    steps = []
    for k in range(levels):
        own = f"x.pos // {RUN**k} % {RUN}"
        left, right = f"array_to_string(r.digests[:({own})::BIGINT], '')", f"array_to_string(r.digests[({own} + 2)::BIGINT:], '')"
        steps.append(
            f"{out}{k + 1} AS MATERIALIZED (SELECT x.* REPLACE (CASE WHEN r.n = 1 THEN x.node ELSE sha256({left} || x.node || {right}) END AS node,"
            f" x.proof || CASE WHEN r.n = 1 THEN '' ELSE {left} || {right} END AS proof)"
            f" FROM {f'{out}{k}' if k else rows} x JOIN {name}r{k} r ON r.grp IS NOT DISTINCT FROM x.grp AND r.run = x.pos // {RUN ** (k + 1)})"
        )
    return ", ".join(steps)


def _sql(levels: int = 6, source_levels: int = 4) -> str:
    """Good for ``RUN ** levels`` rows a source and ``RUN ** source_levels`` sources."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda t: "sha256(" + " || ".join(part(t if c == "text" else c) for c in FIELDS) + ")"
    # CRC-32 bit by bit: a byte is taken in where the list has one, else the register moves on.
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),"
        " lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295::BIGINT)"
    )
    return f"""
WITH t AS MATERIALIZED (
  SELECT doc_id, source AS grp, {leaf("text")} AS leaf, CASE WHEN {crc} % {TAMPERED_OF} = 0 THEN {leaf(text)} END AS forged FROM documents
), l AS MATERIALIZED (
  SELECT *, leaf AS digest, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM t
), {_tower_sql("a", "l", levels)}, s AS MATERIALIZED (
  SELECT 0 AS grp, grp AS source, digest, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM a{levels}
), {_tower_sql("b", "s", source_levels)}, f AS (
  SELECT doc_id, grp, pos, leaf, coalesce(forged, leaf) AS node, '' AS proof FROM l
), {_fold_sql("a", "f", "g", levels)}, h AS (
  SELECT g.doc_id, 0 AS grp, s.pos, g.leaf, g.node, g.proof, s.digest AS subroot FROM g{levels} g JOIN s ON s.source IS NOT DISTINCT FROM g.grp
), {_fold_sql("b", "h", "i", source_levels)}
SELECT i.doc_id, leaf, subroot, b.digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = b.digest AS verified FROM i{source_levels} i, b{source_levels} b
"""


OP12_SQL = _sql()
