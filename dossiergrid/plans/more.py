"""More registered queries: the review surface, lists and signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossiergrid.functions import text
from dossiergrid.operators import duplicates, matching, metrics, review
from dossiergrid.plans.catalog import _RESULTS, query, results, table
from dossiergrid.sources import documents
from dossiergrid.streaming import ingest


@query(
    "preview_skills",
    """
    SELECT p_partkey, array_to_string(w[:2], ', ') || CASE WHEN len(w) > 2 THEN ' +' || (len(w) - 2)::VARCHAR || ' more' ELSE '' END AS shown
    FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
    """,
)
def preview_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", review.preview(F.split("p_name", " "), 2).alias("shown"))


@query(
    "overridden_results",
    f"WITH {_RESULTS} SELECT id, (reviewer_status = 'Rejected' AND fit_score >= 50) AS overridden FROM results",
)
def overridden_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("reviewer_status") == "Rejected", F.lit("Not Qualified")).otherwise(F.lit("Qualified"))
    return results(spark, sf_dir).select("id", review.overridden(label, F.col("fit_score")).alias("overridden"))


@query(
    "skills_share",
    """
    SELECT p_partkey, round_even(len(list_intersect(w, ['almond', 'blue', 'green', 'ivory', 'red', 'steel', 'tin', 'brass'])) / 8 * 100, 2) AS share
    FROM (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part)
    """,
)
def skills_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*[F.lit(x) for x in ("almond", "blue", "green", "ivory", "Red", "steel", "TIN", "brass")])
    return table(spark, sf_dir, "part").select("p_partkey", matching.skills_percentage(F.split("p_name", " "), wanted).alias("share"))


@query(
    "predefined_skills",
    r"""
    SELECT doc_id, array_to_string(list_filter(['the', 'que', 'der', 'of the', 'zzz'], lambda s: regexp_matches(lower(coalesce(text, '')), '(^|[^\p{L}\p{N}_])' || s || '($|[^\p{L}\p{N}_])')), ',') AS skills
    FROM documents
    """,
)
def predefined_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*[F.lit(x) for x in ("the", " que ", "der", "of the", "zzz", " ")])
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(matching.predefined_skills(F.col("text"), wanted), ",").alias("skills"))


@query(
    "list_agreement",
    """
    WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type || ' ' || p_brand || ' ' || p_name), ' ')) AS b FROM part)
    SELECT p_partkey, len(list_intersect(a, b)) AS tp, len(a) - len(list_intersect(a, b)) AS fp, len(b) - len(list_intersect(a, b)) AS fn FROM w
    """,
)
def list_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = metrics.set_counts(F.split("p_name", " "), F.split(F.concat_ws(" ", "p_type", "p_brand", "p_name"), " "))
    rows = table(spark, sf_dir, "part").select("p_partkey", counted.alias("c"))
    return rows.select("p_partkey", *[F.col(f"c.{n}").cast("long").alias(n) for n in ("tp", "fp", "fn")])


@query("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.by_key(table(spark, sf_dir, "orders"), 7, "o_orderkey")


@query(
    "inserts_are_numbered",
    "SELECT count(*) AS n, count(DISTINCT id) AS ids, min(id) AS first, max(id) AS last FROM (SELECT c_custkey AS id FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER () FROM events)",
)
def inserts_are_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    both = review.insert_numbered(rows, table(spark, sf_dir, "events").select(F.col("event_type").alias("name")))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last"))


@query(
    "seeded_names",
    "SELECT n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_name, r_regionkey FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)",
)
def seeded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return review.insert_absent(rows, table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")), "name")


@query(
    "uploads_per_week",
    "SELECT epoch(time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01'))::BIGINT AS week, count(*) AS uploads FROM events GROUP BY 1",
)
def uploads_per_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = ingest.uploads_per_week(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts")
    return weeks.select(F.unix_timestamp("week.start").alias("week"), "uploads")


@query(
    "login_limit",
    """
    SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) <= 5 AS admitted FROM events
    """,
)
def login_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.within_limit(table(spark, sf_dir, "events"), "event_type", "ts", "event_id").select("event_id", "admitted")


@query(
    "roles_and_links",
    """
    SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS may, (starts_with(link, '/') AND NOT starts_with(link, '//')) AS safe
    FROM (SELECT *, CASE WHEN c_acctbal > 5000 THEN '/jobs' WHEN c_acctbal > 0 THEN '//host/jobs' ELSE 'https://host' END AS link FROM customer)
    """,
)
def roles_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.when(F.col("c_acctbal") > 5000, "/jobs").when(F.col("c_acctbal") > 0, "//host/jobs").otherwise("https://host")
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", review.allowed(F.col("c_mktsegment"), ("BUILDING", "MACHINERY")).alias("may"), review.safe_next(link).alias("safe"))


@query(
    "identity_signatures",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '' ELSE lower(trim(c_name)) END AS who FROM customer",
)
def identity_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_acctbal") < 0, F.lit(" Unknown Candidate")).otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.identity_signature(name).alias("who"))


@query(
    "history_signatures",
    """
    SELECT l_orderkey, '[' || string_agg('["' || lower(l_returnflag) || '","' || lower(l_linestatus) || '","' || printf('%.2f', l_quantity) || '"]', ',' ORDER BY l_linenumber, l_returnflag, l_linestatus, l_quantity) || ']' AS history
    FROM lineitem GROUP BY 1
    """,
)
def history_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered records of each order as one signature."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", F.col("l_quantity").alias("years")))).alias("r"))
    return rows.select("l_orderkey", duplicates.history_signature(F.col("r"), ["l_returnflag", "l_linestatus"], "years").alias("history"))


@query(
    "admitted_files",
    "SELECT p_partkey, p_size % 3 < 2 AS admitted FROM part",
)
def admitted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads by their extension, whatever its case."""
    name = F.concat("p_name", F.element_at(F.array(F.lit(".pdf"), F.lit(".DOCX"), F.lit(".exe")), (F.col("p_size") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", documents.extension(name).isin(*documents.EXTENSIONS).alias("admitted"))
