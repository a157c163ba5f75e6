"""A corpus pipeline over ``documents``: each stage works on all that the one before it kept.

Each row is a document of its own, also where identifiers repeat or are null: near
duplicates and contaminated documents are dropped by identifier and text, which no two
rows share after exact deduplication.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossiergrid.llm.decontamination import decontaminate
from dossiergrid.llm.exact_dedup import exact_dedup
from dossiergrid.llm.jaccard_join import Rule, jaccard_components
from dossiergrid.llm.language_id import NOT_KNOWN, identify, train
from dossiergrid.llm.mixing import mix_sources
from dossiergrid.scratch import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]
#: Keys to drop are sent to all executors up to this number (of a few dozen bytes).
BROADCAST_ROWS = 500_000


def _key(docs: DataFrame) -> Column:
    """A row's identifier and two independent hashes of its text; ordered by identifier, null last."""
    text = docs["text"]
    return F.struct(
        docs["doc_id"].isNull().alias("unnamed"), docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2")
    )


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """``keyed`` without the rows of the ``keys`` (gone); the texts are shuffled only if those are many."""
    keys = materialize(keys.distinct(), "pipeline-dropped")
    few = keys.count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(keys) if few else keys, F.col("key") == F.col("gone"), "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go, and those whose two nearest languages are equally near."""
    known = identify(docs, train(docs), carry=REST)
    return known.where((F.col("lang_pred") != NOT_KNOWN) & ~F.col("ambiguous")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the row with the smallest doc_id stays."""
    return exact_dedup(docs, keep="min", carry=REST).where("kept").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles, the smallest doc_id stays."""
    keyed = docs.withColumn("key", _key(docs))
    groups = jaccard_components(keyed, Rule(width=5, percent=80), id_col="key")
    return _without(keyed, groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    keyed = docs.withColumn("key", _key(docs))
    found = decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    return _without(keyed, found.where("contaminated").select(F.col("doc_id").alias("gone")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of its source takes."""
    return mix_sources(docs).documents.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("jaccard_join", near),
    ("decontamination", benchmark),
    ("mix_sources", mix),
]

#: Language identification can't be expressed in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
