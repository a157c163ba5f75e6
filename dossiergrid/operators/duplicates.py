"""Blocking of duplicate uploads.

An upload is refused if an earlier accepted one has the same file, the same e-mail or
phone, the same name and the same structured history, or the same text. A refused
upload can't refuse others, so the outcome depends on the order; it is neither
connected components nor a distinct. Candidate pairs come from five equality joins,
and each upload waits until all earlier uploads it meets are decided: a round decides
everything whose neighbours are decided, and small open components as a whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossiergrid.components import connected_components
from dossiergrid.functions.text import identity_signature, phone_signature, text_signature
from dossiergrid.hot_keys import join_split
from dossiergrid.scratch import materialize

#: Keys of an open component that one task replays.
SMALL = 50_000


def history_signature(records: Column, fields: list[str], years: str | None = None) -> Column:
    """Ordered normalised records as one text; null without records."""
    parts = lambda r: F.array(*[text_signature(r[f]) for f in fields], *([F.format_string("%.2f", F.bround(F.coalesce(r[years], F.lit(0.0)), 2))] if years else []))
    return F.when(F.size(records) > 0, F.to_json(F.transform(records, parts)))


def duplicate_keys(resumes: DataFrame) -> DataFrame:
    """(id, kind, value): what an upload may share with another one.

    ``resumes``: id, file_hash, email, phone, name, text, experience, education (arrays of structs).
    Long texts are compared by SHA-256 of their signature.
    """
    email, phone, name = identity_signature(F.col("email")), phone_signature(F.col("phone")), identity_signature(F.col("name"))
    work = history_signature(F.col("experience"), ["job_title", "company"], "years")
    school = F.when(work.isNull(), history_signature(F.col("education"), ["degree", "institution"]))
    text = text_signature(F.col("text"))
    history = F.coalesce(F.concat(F.lit("w"), work), F.concat(F.lit("e"), school))
    values = {
        "file": F.col("file_hash"),
        "email": F.nullif(email, F.lit("")),
        "phone": F.nullif(phone, F.lit("")),
        "history": F.when(name != "", F.sha2(F.concat_ws("|", name, history).cast("binary"), 256)),
        "text": F.when(text != "", F.sha2(text.cast("binary"), 256)),
    }
    keys = F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in values.items()])
    rows = resumes.select("id", F.when(history.isNotNull(), F.lit(True)).alias("has"), F.inline(keys))
    return rows.where("value is not null and (kind <> 'history' or has)").select("id", "kind", "value")


def _replay(table: pa.Table) -> pa.Table:
    """The uploads of one open component in their order: (id, key, first_accepted) rows to (id, accepted)."""
    rows: dict = {}
    for i, key, first in sorted(zip(table["id"].to_pylist(), table["key"].to_pylist(), table["first_accepted"].to_pylist(), strict=True), key=lambda r: r[0]):
        rows.setdefault(i, []).append((key, first))
    taken: set = set()
    decided = []
    for i, held in rows.items():
        free = not any(key in taken or (first is not None and first < i) for key, first in held)
        if free:
            taken.update(key for key, _ in held)
        decided.append(free)
    return pa.table({"id": pa.array(rows.keys(), table.schema.field("id").type), "accepted": pa.array(decided, pa.bool_())})


def _decide_small(keys: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` with all open uploads decided whose open component has at most ``SMALL`` keys.

    A component's uploads depend on nothing but each other and the accepted holders of their keys, so one task replays it
    in order. Larger components are left to further rounds.
    """
    tagged = keys.join(state, "id")
    accepted = tagged.where("accepted").groupBy("kind", "value").agg(F.min("id").alias("first_accepted"))
    open_keys = tagged.where("accepted is null").select("id", "kind", "value")
    rows = materialize(open_keys.join(accepted, ["kind", "value"], "left").select("id", F.sha2(F.concat_ws(":", "kind", "value").cast("binary"), 256).alias("key"), "first_accepted"), "duplicate-open")
    total = rows.count()
    if total <= SMALL:
        grouped = rows.withColumn("root", F.lit(0))
    else:
        least = rows.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
        links = join_split(rows, least.where("n > 1"), ["key"], total).where("least <> id").select(F.col("id").alias("a"), F.col("least").alias("b"))
        roots = connected_components(links)
        own = rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        sizes = own.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        # Only components of few rows go on, so no root is a hot key here.
        grouped = own.join(sizes.where(F.col("n") <= SMALL).select("root"), "root", "left_semi")
    kind = dict(state.dtypes)["id"]
    now = grouped.groupBy("root").applyInArrow(_replay, f"id {kind}, accepted boolean").withColumnRenamed("accepted", "now")
    return materialize(state.join(now, "id", "left").select("id", F.coalesce("accepted", "now").alias("accepted")), "duplicate-state")


def block_duplicates(keys: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, accepted, duplicate_of): uploads in the order of ``id``; ``duplicate_of`` is the earliest accepted one it meets.

    A key that many uploads share needs no pairs among them: of one key only the earliest
    accepted upload matters, so a round compares each undecided upload with the least
    undecided and the least accepted one of each of its keys, and decides at least the least undecided
    upload of every key. What is then still open falls into components that share no key;
    the small ones are each replayed in order, so long chains take no more rounds than others. The uploads of a
    key that many share are not shuffled by it. Null identifiers have no place in the order and must not
    occur; uploads without a key are accepted; an empty table gives an empty result.
    """
    keys = materialize(keys.distinct(), "duplicate-keys")
    total = keys.count()
    state = ids.select("id", F.lit(None).cast("boolean").alias("accepted")).distinct()
    while True:
        tagged = keys.join(state, "id")
        best = tagged.groupBy("kind", "value").agg(
            F.min(F.when(F.col("accepted"), F.col("id"))).alias("first_accepted"), F.min(F.when(F.col("accepted").isNull(), F.col("id"))).alias("first_open"),
            F.count(F.lit(1)).alias("n"),
        )
        met = join_split(tagged.where("accepted is null"), best, ["kind", "value"], total).groupBy("id").agg(
            F.min(F.when(F.col("first_accepted") < F.col("id"), F.col("first_accepted"))).alias("hit"), F.min("first_open").alias("least_open")
        )
        decided = F.when(F.col("accepted").isNotNull(), F.col("accepted")).when(F.col("hit").isNotNull(), F.lit(False)).when(
            F.col("least_open").isNull() | (F.col("least_open") == F.col("id")), F.lit(True)
        )
        state = materialize(state.join(met, "id", "left").select("id", decided.alias("accepted")), "duplicate-state")
        if state.where("accepted is null").isEmpty():
            break
        state = _decide_small(keys, state)
        if state.where("accepted is null").isEmpty():
            break
    first = F.min(F.when(F.col("accepted"), F.col("id"))).alias("first")
    tagged = keys.join(state, "id")
    accepted = tagged.groupBy("kind", "value").agg(first, F.count(F.lit(1)).alias("n")).where("first is not null")
    cause = join_split(tagged.where("not accepted"), accepted, ["kind", "value"], total).where("first < id")
    return state.join(cause.groupBy("id").agg(F.min("first").alias("duplicate_of")), "id", "left").select("id", "accepted", "duplicate_of")


def same_file(uploads: DataFrame, key: str = "id", file_hash: str = "file_hash") -> DataFrame:
    """(key, same_as): uploads whose file an earlier one has, with the earliest; a null hash is no file."""
    known = uploads.where(F.col(file_hash).isNotNull()).select(F.col(key).alias("__id"), F.col(file_hash).alias("__hash"))
    first = known.groupBy("__hash").agg(F.min("__id").alias("same_as"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = join_split(known, first, ["__hash"], known.count()).where("__id <> same_as")
    return met.select(F.col("__id").alias(key), "same_as")


def duplicate_message(name: Column, filename: Column) -> Column:
    """What is shown for a refused upload."""
    return F.format_string("Duplicate resume skipped: %s (%s) was already uploaded.", name, filename)
