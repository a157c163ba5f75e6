"""Registered queries of the career-document engine, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossiergrid.functions import lexicon, text
from dossiergrid.operators import duplicates, evaluation, facts, intervals, lines, matching, metrics, review, scoring, similarity
from dossiergrid.scratch import spread
from dossiergrid.sources import documents

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; ``documents`` is dealt to all cores where it is one small file, as every query on it works on texts."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as screening results: price as score, date as time, priority as reviewer status."""
    statuses = F.array(*[F.lit(s) for s in review.REVIEW_STATUSES])
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("applicant_id"),
        F.pmod("o_orderkey", F.lit(7)).alias("job_id"),
        (F.col("o_totalprice") / 5000).alias("fit_score"),
        F.col("o_orderdate").alias("screened_at"),
        F.element_at(statuses, F.substring("o_orderpriority", 1, 1).cast("int")).alias("reviewer_status"),
    )


_RESULTS = """
results AS (
  SELECT o_orderkey AS id, o_custkey AS applicant_id, o_orderkey % 7 AS job_id, o_totalprice / 5000 AS fit_score, o_orderdate AS screened_at,
         ['Pending Review', 'Reviewed', 'Move to Interview', 'Rejected', 'Needs Clarification'][o_orderpriority[1]::INT] AS reviewer_status
  FROM orders
)"""


@query(
    "results_ranked_top20",
    f"""
    WITH {_RESULTS}, top AS (SELECT * FROM results ORDER BY fit_score DESC, id DESC LIMIT 20)
    SELECT top.id, fit_score, screened_at, reviewer_status, c_name AS applicant FROM top LEFT JOIN customer ON c_custkey = applicant_id
    """,
)
def results_ranked_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = review.ranked_results(results(spark, sf_dir))
    who = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("applicant"))
    return top.join(who, F.col("applicant_id") == F.col("c_custkey"), "left").select("id", "fit_score", "screened_at", "reviewer_status", "applicant")


def _ordered(name: str, sort: str, order: str, job: int | None = None, status: str | None = None) -> None:
    """A list in one order; with a filter it is whole, without one it is the first page."""
    where = " AND ".join(([f"job_id = {job}"] if job is not None else []) + ([f"reviewer_status = '{status}'"] if status else []))
    tail = f"WHERE {where}" if where else ""
    sql = f"""
    WITH {_RESULTS}, r AS (SELECT id, fit_score, row_number() OVER (ORDER BY {order}) AS place FROM results {tail})
    SELECT id, fit_score, place FROM r {"" if where else "WHERE place <= 20"}
    """

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nav = review.candidate_navigation(results(spark, sf_dir), job, status, sort)
        rows = review.ranked_results(results(spark, sf_dir), job, status, sort)
        return rows.join(nav, "id").select("id", "fit_score", F.col("position").alias("place"))


_ordered("results_fit_asc", "fit_asc", "fit_score ASC NULLS FIRST, id DESC")
_ordered("results_newest", "newest", "screened_at DESC NULLS LAST, id DESC")
_ordered("results_oldest", "oldest", "screened_at ASC NULLS FIRST, id DESC")
_ordered("results_of_job_and_status", "fit_desc", "fit_score DESC NULLS LAST, id DESC", 3, "Rejected")


@query(
    "candidate_navigation",
    f"""
    WITH {_RESULTS}
    SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id, row_number() OVER w AS position, count(*) OVER () AS total
    FROM results WHERE job_id = 2 WINDOW w AS (ORDER BY fit_score DESC NULLS LAST, id DESC)
    """,
)
def candidate_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.candidate_navigation(results(spark, sf_dir), job_id=2)


@query(
    "navigation_of_candidate",
    f"""
    WITH {_RESULTS}, n AS (
      SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id, row_number() OVER w AS position, count(*) OVER () AS total
      FROM results WHERE job_id = 2 WINDOW w AS (ORDER BY screened_at NULLS FIRST, id DESC)
    )
    SELECT * FROM n WHERE id = (SELECT max(id) FROM results WHERE job_id = 2)
    """,
)
def navigation_of_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of a job's newest candidate, oldest first."""
    rows = results(spark, sf_dir)
    newest = rows.where("job_id = 2").agg(F.max("id")).first()[0]
    return review.navigation_of(rows, newest, job_id=2, sort="oldest")


@query(
    "dashboard_counts",
    f"""
    WITH {_RESULTS}, l AS (SELECT CASE WHEN fit_score >= 75 THEN 'Qualified' WHEN fit_score >= 50 THEN 'For Review' ELSE 'Not Qualified' END AS label FROM results)
    SELECT count(*) AS total, count(*) FILTER (WHERE label = 'Qualified') AS qualified, count(*) FILTER (WHERE label = 'For Review') AS for_review,
           count(*) FILTER (WHERE label = 'Not Qualified') AS not_qualified FROM l
    """,
)
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = results(spark, sf_dir).withColumn("recommendation_label", scoring.fit_label(F.col("fit_score")))
    return review.dashboard_counts(labelled)


@query("recent_jobs_top5", "SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def recent_jobs_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return review.recent(jobs)


@query(
    "result_detail_join",
    """
    SELECT o_orderkey AS resume_id, o_custkey AS applicant_id, c_nationkey AS job_id, c_name AS applicant_name, c_mktsegment AS email, NULL::VARCHAR AS phone,
           n_name AS job_title, o_orderstatus AS filename, o_orderpriority AS extraction_status
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
    """,
)
def result_detail_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left").select(
        F.col("o_orderkey").alias("resume_id"), F.col("o_custkey").alias("applicant_id"), F.col("c_nationkey").alias("job_id")
    )
    applicants = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("email"), F.lit(None).cast("string").alias("phone"))
    jobs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    resumes = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("filename"), F.col("o_orderpriority").alias("extraction_status"))
    return review.result_details(rows, applicants, jobs, resumes)


@query(
    "criteria_default_join",
    """
    WITH c AS (SELECT s_nationkey AS job_id, arg_min(s_acctbal, s_suppkey) AS m, arg_min(s_acctbal > 5000, s_suppkey) AS r FROM supplier WHERE s_acctbal > 2000 GROUP BY 1)
    SELECT n_nationkey AS id, n_name AS title, coalesce(m, 50.0) AS min_fit_score, coalesce(r, false) AS requires_all_critical FROM nation LEFT JOIN c ON job_id = n_nationkey
    """,
)
def criteria_default_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    criteria = table(spark, sf_dir, "supplier").where("s_acctbal > 2000").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("job_id"), F.col("s_acctbal").alias("min_fit_score"), (F.col("s_acctbal") > 5000).alias("requires_all_critical")
    )
    return review.with_defaults(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title")), criteria)


@query(
    "children_lists",
    """
    SELECT o_orderkey AS id, list({'l_partkey': l_partkey, 'l_quantity': l_quantity} ORDER BY l_linenumber) FILTER (WHERE l_orderkey IS NOT NULL)::VARCHAR IS NULL AS childless,
           count(l_orderkey) AS n, coalesce(sum(l_quantity), 0) AS total
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
    """,
)
def children_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("id"), "l_partkey", "l_quantity")
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    rows = review.children(parents, child, "order_id", ["l_partkey", "l_quantity"], "lines")
    return rows.select(
        F.col("order_id").alias("id"),
        (F.size("lines") == 0).alias("childless"),
        F.size("lines").cast("long").alias("n"),
        F.aggregate("lines", F.lit(0.0), lambda s, x: s + x["l_quantity"]).alias("total"),
    )


@query(
    "cascade_delete_survivors",
    """
    WITH o AS (SELECT * FROM orders WHERE o_orderstatus <> 'F' OR o_orderstatus IS NULL)
    SELECT o_orderkey, count(l_orderkey) AS n_lines FROM o LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
    """,
)
def cascade_delete_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        "orders": table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey")),
        "lineitem": table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"),
    }
    gone = tables["orders"].where("o_orderstatus = 'F'").select("id")
    left = review.cascade_delete(tables, "orders", gone, {"orders": [("lineitem", "l_orderkey")]})
    joined = left["orders"].join(left["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n_lines"))


@query(
    "audit_union",
    """
    SELECT event_id, user_id, event_type, NULL::DOUBLE AS value FROM events WHERE event_type = 'click'
    UNION ALL SELECT event_id, user_id, NULL, value FROM events WHERE event_type <> 'click'
    """,
)
def audit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    log = events.where("event_type = 'click'").select("event_id", "user_id", "event_type")
    return review.audit_log(log, events.where("event_type <> 'click'").select("event_id", "user_id", "value"))


@query(
    "latest_review_state",
    f"""
    WITH {_RESULTS}, e AS (
      SELECT user_id AS id, ['Pending Review', 'Reviewed', 'Move to Interview', 'Rejected', 'Needs Clarification', 'Unknown'][(event_id % 6 + 1)::INT] AS status,
             event_type AS notes, event_id AS reviewer, ts
      FROM events
    ), l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, reviewer DESC) AS r FROM e WHERE status <> 'Unknown')
    SELECT results.id, coalesce(l.status, reviewer_status) AS reviewer_status, l.notes AS reviewer_notes, l.reviewer AS reviewed_by, l.ts AS reviewed_at
    FROM results LEFT JOIN l ON l.id = results.id AND l.r = 1
    """,
)
def latest_review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = F.array(*[F.lit(s) for s in (*review.REVIEW_STATUSES, "Unknown")])
    reviews = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"),
        F.element_at(statuses, (F.pmod("event_id", F.lit(6)) + 1).cast("int")).alias("reviewer_status"),
        F.col("event_type").alias("reviewer_notes"),
        F.col("event_id").alias("reviewed_by"),
        F.col("ts").alias("reviewed_at"),
    )
    none = [F.lit(None).cast(t).alias(n) for n, t in (("reviewer_notes", "string"), ("reviewed_by", "bigint"), ("reviewed_at", "timestamp_ntz"))]
    rows = results(spark, sf_dir).select("id", "reviewer_status", *none)
    return review.apply_reviews(rows, reviews)


@query(
    "upsert_and_seed",
    """
    SELECT coalesce(p.k, s.k) AS key, coalesce(s.name, p.name) AS name, p.size
    FROM (SELECT p_partkey AS k, p_name AS name, p_size AS size FROM part) p
    FULL JOIN (SELECT s_suppkey * 30 AS k, CASE WHEN s_acctbal > 5000 THEN s_name END AS name FROM supplier) s ON p.k = s.k
    """,
)
def upsert_and_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, changed and added to by all suppliers under keys of their own."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    changes = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 30).alias("key"), F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("name"))
    return review.upsert(rows, changes, "key")


@query(
    "csv_skill_explode",
    """
    SELECT p_partkey, trim(s) AS skill FROM (SELECT p_partkey, unnest(string_split(replace(p_name, ' ', ' ,, '), ',')) AS s FROM part) WHERE trim(s) <> ''
    """,
)
def csv_skill_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(text.csv_list(F.replace("p_name", F.lit(" "), F.lit(" ,, ")))).alias("skill"))


@query("json_skill_roundtrip", "SELECT p_partkey, string_split(p_name, ' ')[1] AS first, len(string_split(p_name, ' ')) AS n FROM part")
def json_skill_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.split("p_name", " ")).alias("skills"))
    back = text.json_list(F.col("skills"))
    return stored.select("p_partkey", F.try_element_at(back, F.lit(1)).alias("first"), F.size(back).cast("long").alias("n"))


@query(
    "doc_text_signature_dups",
    """
    WITH s AS (SELECT doc_id, sha256(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))) AS sig FROM documents)
    SELECT sig, count(*) AS n, min(doc_id) AS first_doc FROM s GROUP BY sig HAVING count(*) > 1
    """,
)
def doc_text_signature_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.text_signature(F.col("text")).cast("binary"), 256).alias("sig"))
    return docs.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(
    "adjacent_line_dedupe",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text <> ''),
    k AS (SELECT *, trim(regexp_replace(lower(line), '[^\p{L}\p{N}_]+', ' ', 'g')) AS key FROM l),
    p AS (SELECT *, lag(key) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM k)
    SELECT d.doc_id, count(p.doc_id) AS n_kept, count(*) FILTER (WHERE key <> '') AS n_words_kept
    FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id AND (key = '' OR before IS NULL OR key <> before) GROUP BY d.doc_id
    """,
)
def adjacent_line_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.when(F.col("text") != "", F.split("text", "\n")).otherwise(F.array().cast("array<string>"))
    kept = table(spark, sf_dir, "documents").select("doc_id", text.drop_adjacent_duplicates(found).alias("kept"))
    filled = F.size(F.filter("kept", lambda x: F.trim(F.regexp_replace(x, r"(?U)[^\w]+", " ")) != ""))
    return kept.select("doc_id", F.size("kept").cast("long").alias("n_kept"), filled.cast("long").alias("n_words_kept"))


@query(
    "doc_contacts",
    r"""
    SELECT doc_id, CASE WHEN e = '' THEN 'Unknown Email' ELSE lower(trim(e, ' .,;:')) END AS email
    FROM (SELECT doc_id, regexp_extract(text, '(?:^|[^\w.-])([\w.+-]+@[\w.-]+\.[A-Za-z]{2,})', 1) AS e FROM documents)
    """,
)
def doc_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.email_of(F.col("text")).alias("email"))


@query("doc_phones")
def doc_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RE2 has no lookaround; tested against Python's expressions."""
    return table(spark, sf_dir, "documents").select("doc_id", text.phone_of(F.col("text")).alias("phone"), text.phone_signature(text.phone_of(F.col("text"))).alias("digits"))


@query(
    "doc_lines_blocks",
    """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text <> ''),
    c AS (SELECT *, sum((trim(line) = '')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM l)
    SELECT d.doc_id, count(*) FILTER (WHERE trim(line) <> '') AS n_lines, count(DISTINCT CASE WHEN trim(line) <> '' THEN block END) AS n_blocks
    FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
    """,
)
def doc_lines_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = lines.evidence_lines(lines.line_table(docs, "doc_id"), "doc_id").select(F.col("doc_id").alias("own"), "block")
    return docs.select("doc_id").join(rows, F.col("doc_id") == F.col("own"), "left").groupBy("doc_id").agg(F.count("own").alias("n_lines"), F.count_distinct("block").alias("n_blocks"))


@query("doc_sections")
def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by heading; the texts hold no real headings, so the tests bring their own."""
    rows = lines.segments(lines.line_table(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")
    return rows.select("doc_id", "segment", "section", "heading", F.size("lines").alias("n_lines"))


@query("doc_entities")
def doc_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.entities(lines.line_table(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")


@query("doc_quality_score")
def doc_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better of the text and its cleaned form; held against a plain version in the tests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", text.judged(F.col("text")).alias("j")).select("doc_id", "j.quality", "j.method")


@query(
    "lexical_variety",
    r"""
    SELECT doc_id, CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.0 END AS variety
    FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z''-]+') AS w FROM documents)
    """,
)
def lexical_variety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.distinct_word_share(F.col("text")).alias("variety"))


@query(
    "tfidf_doc_item",
    r"""
    WITH n AS (SELECT count(*) AS n FROM benchmark), d AS (
      SELECT doc_id, doc_id % n.n AS item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM documents, n
    ), b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM benchmark),
    dt AS (
      SELECT doc_id, item_id, t, 1 + ln(count(*)) AS w
      FROM (SELECT doc_id, item_id, unnest(w || list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) AS t FROM d) GROUP BY ALL
    ), bt AS (
      SELECT item_id, t, 1 + ln(count(*)) AS w
      FROM (SELECT item_id, unnest(w || list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) AS t FROM b) GROUP BY ALL
    ), ds AS (SELECT doc_id, sum(w * w) AS s FROM dt GROUP BY 1), bs AS (SELECT item_id, sum(w * w) AS s FROM bt GROUP BY 1),
    m AS (SELECT doc_id, dt.item_id, sum(dt.w * bt.w) AS dot, sum(dt.w * dt.w) AS b1, sum(bt.w * bt.w) AS b2 FROM dt JOIN bt ON bt.item_id = dt.item_id AND bt.t = dt.t GROUP BY 1, 2),
    c AS (SELECT (ln(1.5::DOUBLE) + 1) ** 2 AS c2)
    SELECT d.doc_id, d.item_id, round(coalesce(dot / (sqrt(c2 * (ds.s - b1) + b1) * sqrt(c2 * (bs.s - b2) + b2)) * 100, 0.0), 6) AS similarity
    FROM d CROSS JOIN c LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN ds ON ds.doc_id = d.doc_id LEFT JOIN bs ON bs.item_id = d.item_id
    """,
)
def tfidf_doc_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against one benchmark item, as a resume against its job."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = docs.select("doc_id", F.pmod("doc_id", F.lit(items.count())).alias("item_id"))
    found = similarity.text_similarity(pairs, docs, items, "doc_id", "item_id", digits=None)
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


#: A small vocabulary of the invented language, with an alias, a phrase and a name with a symbol.
VOCABULARY = ["the", "of the", "thnt", "is.", "que", "und die"]


def _holds(term: str):
    return lambda line: text.term_found(line, F.lit(term))


@query(
    "skill_literal",
    r"""
    WITH l AS (SELECT doc_id, lower(unnest(string_split(text, chr(10)))) AS line FROM documents)
    SELECT doc_id, bool_or(regexp_matches(line, '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])')) AS the, bool_or(regexp_matches(line, '(^|[^\p{L}\p{N}_])of\s+the($|[^\p{L}\p{N}_])')) AS of_the, bool_or(regexp_matches(line, '(^|[^\p{L}\p{N}_])thnt($|[^\p{L}\p{N}_])')) AS thnt,
           bool_or(contains(line, 'is.')) AS is_dot, bool_or(regexp_matches(line, '(^|[^\p{L}\p{N}_])que($|[^\p{L}\p{N}_])')) AS que, bool_or(regexp_matches(line, '(^|[^\p{L}\p{N}_])und\s+die($|[^\p{L}\p{N}_])')) AS und_die
    FROM l GROUP BY doc_id
    """,
)
def skill_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), F.lower).alias("l"))
    names = [v.replace(" ", "_").replace(".", "_dot") for v in VOCABULARY]
    return docs.select("doc_id", *[F.exists("l", _holds(v)).alias(n) for v, n in zip(VOCABULARY, names, strict=True)])


@query("skill_claimed_guarded")
def skill_claimed_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal, fuzzy and stemmed claims of the vocabulary by every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("resume_id"), "text")
    return matching.claimed_skills(docs, VOCABULARY).withColumnRenamed("key", "doc_id")


@query("skill_analysis")
def skill_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched, missing and implied skills of every document for the job of its number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("resume_id"), F.pmod("doc_id", F.lit(3)).cast("int").alias("job_id"), "text")
    skills = [(0, ["the", "rest api"]), (1, ["que", "sql", " "]), (2, ["und die", "agile"])]
    found = matching.analyze_skills(docs, spark.createDataFrame(skills, "job_id int, skills array<string>"))
    return found.select("resume_id", "job_id", *[F.array_join(c, ",").alias(c) for c in ("matched", "missing")], F.to_json("implied").alias("implied"))


@query(
    "interval_union_months",
    """
    WITH m AS (
      SELECT l_suppkey AS key, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS s, year(l_shipdate) * 12 + month(l_shipdate) - 1 + (l_quantity / 10)::INT AS e FROM lineitem
    ), v AS (SELECT key, s, greatest(e, s + 1) AS e FROM m WHERE e >= s), x AS (SELECT DISTINCT key, unnest(range(s, e)) AS month FROM v)
    SELECT key, count(*) AS months FROM x GROUP BY key
    """,
)
def interval_union_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), start.alias("start"), (start + F.rint(F.col("l_quantity") / 10).cast("int")).alias("end"))
    return intervals.months_by_key(spans, "key")


@query(
    "fit_score_label",
    """
    WITH s AS (
      SELECT l_orderkey, l_linenumber, l_quantity * 2 AS skill, 100 - l_discount * 500 AS experience, least(100, l_tax * 2000) AS education, l_extendedprice % 100 AS similarity
      FROM lineitem
    ), f AS (SELECT *, least(100.0, skill * 0.50 + experience * 0.25 + education * 0.15 + similarity * 0.10) AS fit FROM s)
    SELECT l_orderkey, l_linenumber, round(fit, 6) AS fit, CASE WHEN fit >= 75 THEN 'Qualified' WHEN fit >= 50 THEN 'For Review' ELSE 'Not Qualified' END AS label FROM f
    """,
)
def fit_score_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unrounded, so that both engines agree; the half-even rounding has its own tests."""
    c = F.col
    fit = scoring.weighted_score(c("l_quantity") * 2, 100 - c("l_discount") * 500, F.least(F.lit(100.0), c("l_tax") * 2000), c("l_extendedprice") % 100)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fit.alias("fit"))
    return rows.select("l_orderkey", "l_linenumber", F.round("fit", 6).alias("fit"), scoring.fit_label(c("fit")).alias("label"))


@query(
    "prf_metrics",
    """
    SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1
    FROM (SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp, count(*) FILTER (WHERE toxic = 1 AND quality <> 1) AS fp,
                 count(*) FILTER (WHERE toxic <> 1 AND quality = 1) AS fn FROM labels)
    """,
)
def prf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.precision_recall(table(spark, sf_dir, "labels"), F.col("toxic") == 1, F.col("quality") == 1)


@query(
    "week_of_month_partitions",
    """
    SELECT year(ts)::INT AS year, month(ts)::INT AS month, ((day(ts) - 1) // 7 + 1)::INT AS week, count(*) AS n FROM events GROUP BY ALL
    """,
)
def week_of_month_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(*documents.landing_columns(F.col("event_type"), F.col("user_id"), F.col("ts")))
    return rows.groupBy("year", "month", "week").agg(F.count(F.lit(1)).alias("n"))


@query(
    "phrase_pick",
    """
    SELECT doc_id, ['one', 'two', 'three'][((('0x' || substr(md5(source || doc_id::VARCHAR), 1, 8))::BIGINT + 2) % 3 + 1)::INT] AS phrase FROM documents
    """,
)
def phrase_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.concat("source", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", text.pick_phrase(["one", "two", "three"], seed, 2).alias("phrase"))


@query(
    "clipped_excerpts",
    r"""
    WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' -|' || chr(9)) AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) > 220 THEN rtrim(substr(t, 1, 217)) || '...' ELSE t END AS excerpt FROM f
    """,
)
def clipped_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clip_excerpt(F.col("text")).alias("excerpt"))


@query(
    "local_times",
    "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS local FROM events",
)
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.local_time(F.col("ts")).alias("local"))


@query("resume_facts")
def resume_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every document as a resume."""
    found = facts.resume_facts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("resume_id"), "text"), "2026-06-23")
    return found.select("resume_id", "name", "email", "phone", "years", *[F.size(c).alias(f"n_{c}") for c in ("experience", "education", "credentials", "skills")])


@query("screening_results")
def screening_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document screened against a job, end to end."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("resume_id"), "text")
    found = facts.resume_facts(docs, "2026-06-23", mentioned=False).withColumn("job_id", F.pmod("resume_id", F.lit(2)).cast("int"))
    jobs = spark.createDataFrame(
        [
            (0, "Teacher", ["the", "classroom management"], ["the"], ["that"], "Bachelor of Education", 2, 50.0, True),
            (1, "Engineer", ["que", "sql"], [], ["und"], None, 0, 60.0, False),
        ],
        "job_id int, title string, required array<string>, critical array<string>, preferred array<string>, education_req string, experience_req int, "
        "min_fit_score double, requires_all_critical boolean",
    )
    out = evaluation.evaluate(found, jobs)
    return out.select("resume_id", "job_id", "recommendation_label", "fit_score", "text_similarity", "skill_score", F.col("confidence.level").alias("confidence_level"), "summary", "decision_explanation")


@query("duplicate_block_greedy")
def duplicate_block_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads in the order of doc_id; depends on the order, so it is held against a replay in the tests."""
    none = F.array().cast("array<struct<job_title:string,company:string,years:double>>")
    school = F.array().cast("array<struct<degree:string,institution:string>>")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("file_hash"), text.email_of(F.col("text")).alias("email"),
        text.phone_of(F.col("text")).alias("phone"), F.lit(lexicon.UNKNOWN_NAME).alias("name"), "text", none.alias("experience"), school.alias("education"),
    )
    return duplicates.block_duplicates(duplicates.duplicate_keys(docs), docs.select("id"))


def _all() -> None:
    """Registers the queries of the other modules, which need this one's."""
    from dossiergrid.plans import derived, more, screening  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
