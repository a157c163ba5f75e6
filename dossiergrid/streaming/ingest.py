"""Incremental screening: new files are read, parsed, checked for duplicates and appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from dossiergrid.operators.duplicates import block_duplicates, duplicate_keys
from dossiergrid.operators.facts import resume_facts
from dossiergrid.scratch import materialize
from dossiergrid.sources.documents import EXTENSIONS, MOST_FILES, extension, extract_texts
from dossiergrid.streaming.keyed import KeyTable

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def screen_batch(files: DataFrame, accepted_path: str, rejected_path: str, as_of: str, batch_id: int = 0) -> None:
    """Append what a batch of files (path, content, file_hash) brings to the accepted and the rejected table.

    Earlier accepted resumes can refuse new ones; new ones refuse each other in the order of
    their paths. A batch that runs again writes the same rows under its number, and the
    table of accepted keys is read without that number, so nothing refuses itself. The buckets of that table (beside
    the accepted one) that the batch's own keys fall into are all it looks at: its cost doesn't grow with what is stored.
    """
    spark = files.sparkSession
    texts = materialize(extract_texts(files), "ingest-texts")
    unread = texts.where("text is null or trim(text) = ''").select("path", F.coalesce("error", F.lit("no text")).alias("reason"))
    facts = resume_facts(texts.where("trim(text) <> ''").withColumnRenamed("path", "resume_id"), as_of).withColumnRenamed("resume_id", "path")
    facts = materialize(facts.join(texts.select("path", "file_hash"), "path"), "ingest-facts")
    # New uploads come behind all stored ones: the stamp orders them.
    new = facts.withColumn("id", F.format_string("%012d:%s", F.lit(batch_id), F.col("path")))
    columns = ["id", "file_hash", "email", "phone", "name", "text", "experience", "education"]
    keys = materialize(duplicate_keys(new.select(*columns)), "ingest-keys")
    # Of what is stored, only the keys that a new upload has too, from the folders of their buckets; accepted resumes share
    # none among each other.
    stored_keys = KeyTable(spark, f"{accepted_path.rstrip('/')}-keys")
    ids, pool = new.select("id"), keys
    known = stored_keys.matching(keys, batch_id)
    if known is not None:
        known = materialize(known, "ingest-known")
        ids, pool = ids.unionByName(known.select("id").distinct()), pool.unionByName(known)
    decided = block_duplicates(pool, ids)
    outcome = new.join(decided, "id").withColumn("batch", F.lit(batch_id))
    outcome = materialize(outcome, "ingest-outcome")
    dynamic = lambda rows: rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch")
    refused = outcome.where("not accepted").select("path", F.concat(F.lit("duplicate of "), "duplicate_of").alias("reason"))
    dynamic(outcome.where("accepted").drop("accepted", "duplicate_of")).parquet(accepted_path)
    stored_keys.put(keys.join(outcome.where("accepted").select("id"), "id", "left_semi"), batch_id)
    rejected = refused.unionByName(unread).withColumn("batch", F.lit(batch_id))
    dynamic(rejected).parquet(rejected_path)


def screen_stream(spark: SparkSession, incoming: str, accepted_path: str, rejected_path: str, checkpoint: str, as_of: str) -> DataStreamWriter:
    """A stream over a folder of uploads, at most ten files a batch; start it with the trigger of your choice."""
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", MOST_FILES).option("recursiveFileLookup", "true").load(incoming)
    files = stream.where(extension(F.col("path")).isin(*EXTENSIONS)).withColumn("file_hash", F.sha2("content", 256))
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, k: screen_batch(batch, accepted_path, rejected_path, as_of, k))


def uploads_per_week(uploads: DataFrame, at: str = "uploaded_at", late: str = "1 day") -> DataFrame:
    """Uploads in tumbling weeks; works on tables and on streams, where later rows than ``late`` are left out."""
    rows = uploads.withWatermark(at, late) if uploads.isStreaming else uploads
    return rows.groupBy(F.window(at, "7 days").alias("week")).agg(F.count(F.lit(1)).alias("uploads"))
