"""Registered queries of ranking, work history, toggled sections, blocking and versioned tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossiergrid.functions import text
from dossiergrid.operators import duplicates, history, layout, lines, ranking, review, skill_claims, skill_items, skill_join
from dossiergrid.plans.catalog import _RESULTS, query, results, table
from dossiergrid.scratch import new_path, spread
from dossiergrid.sources.versioned import VersionedTable

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')"
_TERMS = "unnest(w || list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2]))"
_TF = f"""
d AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents), b AS (SELECT item_id AS id, {_WORDS} AS w FROM benchmark),
dt AS MATERIALIZED (SELECT id, t, 1 + ln(count(*)) AS tf FROM (SELECT id, {_TERMS} AS t FROM d) GROUP BY ALL),
bt AS MATERIALIZED (SELECT id, t, 1 + ln(count(*)) AS tf FROM (SELECT id, {_TERMS} AS t FROM b) GROUP BY ALL)"""


@query(
    "rank_all_jobs",
    f"""
    WITH {_TF},
    n AS (SELECT (SELECT count(*) FROM documents WHERE text <> '') + (SELECT count(*) FROM benchmark WHERE text <> '') AS n),
    df AS (SELECT t, ln((1 + any_value(n.n)) / (1 + count(*))) + 1 AS idf FROM (SELECT t FROM dt UNION ALL SELECT t FROM bt), n GROUP BY t),
    dw AS (SELECT id, t, tf * idf AS w FROM dt JOIN df USING (t)), bw AS (SELECT id, t, tf * idf AS w FROM bt JOIN df USING (t)),
    dn AS (SELECT id, sqrt(sum(w * w)) AS s FROM dw GROUP BY id), bn AS (SELECT id, sqrt(sum(w * w)) AS s FROM bw GROUP BY id),
    m AS (SELECT dw.id AS doc_id, bw.id AS item_id, sum(dw.w * bw.w) AS dot FROM dw JOIN bw USING (t) GROUP BY 1, 2),
    s AS (SELECT doc_id, item_id, round(dot / dn.s / bn.s * 100, 6) AS similarity FROM m JOIN dn ON dn.id = doc_id JOIN bn ON bn.id = item_id)
    SELECT doc_id, item_id, similarity, place::INT AS place
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, item_id) AS place FROM s) WHERE place <= 5
    """,
)
def rank_all_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five items that every document is nearest to, of all items."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return ranking.rank_jobs(docs, items, 5, "doc_id", "item_id")


@query(
    "corpus_similarity",
    f"""
    WITH {_TF}, c AS (SELECT count(*) AS items, (SELECT count(*) FROM documents WHERE text <> '') + 1 AS n FROM benchmark),
    p AS (SELECT id AS doc_id, id % c.items AS item_id FROM d, c),
    df AS (SELECT t, sum(l) AS df FROM (SELECT t, 1 AS l FROM dt UNION ALL SELECT t, 0 FROM bt) GROUP BY t),
    g AS (SELECT t, ln((1 + n) / (1 + df)) + 1 AS alone, ln((1 + n) / (2 + df)) + 1 AS shared FROM df, c),
    dw AS (SELECT id, t, tf * alone AS a, tf * shared AS s FROM dt JOIN g USING (t)), bw AS (SELECT id, t, tf * shared AS s FROM bt JOIN g USING (t)),
    ds AS (SELECT id, sum(a * a) AS q FROM dw GROUP BY id), bs AS (SELECT id, sum(s * s) AS q FROM bw GROUP BY id),
    m AS (
      SELECT p.doc_id, p.item_id, sum(dw.s * bw.s) AS dot, sum(dw.s * dw.s - dw.a * dw.a) AS more
      FROM p JOIN dw ON dw.id = p.doc_id JOIN bw ON bw.id = p.item_id AND bw.t = dw.t GROUP BY 1, 2
    )
    SELECT p.doc_id, p.item_id, round(coalesce(dot / sqrt((ds.q + more) * bs.q) * 100, 0.0), 6) AS similarity
    FROM p LEFT JOIN m USING (doc_id, item_id) LEFT JOIN ds ON ds.id = p.doc_id LEFT JOIN bs ON bs.id = p.item_id
    """,
)
def corpus_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its item, with weights fitted over all documents."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    pairs = docs.select("doc_id", F.pmod("doc_id", F.lit(items.count())).alias("item_id"))
    found = ranking.corpus_similarity(pairs, docs, items, "doc_id", "item_id", digits=None)
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(
    "dated_history",
    f"""
    WITH r AS (
      SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS k, p_name || ' teacher' AS role, s_name || ' School' AS employer,
             strftime(l_shipdate, '%b %Y') || ' - ' || strftime(l_shipdate + to_months(l_quantity::INT), '%b %Y') AS dates, l_tax > 0.03 AS dated_first, l_discount > 0.05 AS named
      FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
    ), l AS (
      SELECT l_orderkey, unnest(CASE WHEN dated_first THEN [0, 1, 2] ELSE [2, 0, 1] END) + 3 * k AS line_no,
             unnest([dates, role, CASE WHEN named THEN employer ELSE 'own account' END]) AS line, unnest(['d', 'r', CASE WHEN named THEN 'e' ELSE 'x' END]) AS kind FROM r
    ), f AS (
      SELECT *, last_value(CASE WHEN kind = 'r' THEN line_no END IGNORE NULLS) OVER b AS rb, first_value(CASE WHEN kind = 'r' THEN line_no END IGNORE NULLS) OVER a AS ra,
             last_value(CASE WHEN kind = 'e' THEN line_no END IGNORE NULLS) OVER b AS eb, first_value(CASE WHEN kind = 'e' THEN line_no END IGNORE NULLS) OVER a AS ea
      FROM l WINDOW b AS (PARTITION BY l_orderkey ORDER BY line_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY l_orderkey ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)
    ), g AS (
      SELECT l_orderkey, line_no, line, CASE WHEN rb IS NULL OR ra - line_no < line_no - rb THEN coalesce(ra, rb) ELSE rb END AS r, CASE WHEN eb IS NULL OR ea - line_no < line_no - eb THEN coalesce(ea, eb) ELSE eb END AS e
      FROM f WHERE kind = 'd'
    )
    SELECT g.l_orderkey, g.line_no, g.line AS dates, a.line AS role, b.line AS employer FROM g
    LEFT JOIN l a ON a.l_orderkey = g.l_orderkey AND a.line_no = g.r LEFT JOIN l b ON b.l_orderkey = g.l_orderkey AND b.line_no = g.e
    """,
)
def dated_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a resume: each of its lines a role, an employer (or none) and dates, in either order; roles and employers of all dates."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    month = lambda c: F.date_format(c, "MMM yyyy")
    dates = F.concat(month(F.col("l_shipdate")), F.lit(" - "), month(F.add_months(F.to_date("l_shipdate"), F.col("l_quantity").cast("int"))))
    role, employer = F.concat("p_name", F.lit(" teacher")), F.when(F.col("l_discount") > 0.05, F.concat("s_name", F.lit(" School"))).otherwise(F.lit("own account"))
    entry = F.when(F.col("l_tax") > 0.03, F.concat_ws("\n", dates, role, employer)).otherwise(F.concat_ws("\n", role, employer, dates))
    whole = F.array_sort(F.collect_list(F.struct(*_ORDER.split(", "), entry.alias("entry"))))
    resumes = rows.groupBy("l_orderkey").agg(F.array_join(whole["entry"], "\n").alias("text"))
    flagged = history.line_flags(lines.line_table(resumes, "l_orderkey"), r"(?i)\bteacher\b", r"(?i)\bschool\b")
    return history.dated_roles(flagged, "l_orderkey").select("l_orderkey", F.col("line_no").cast("long").alias("line_no"), "dates", "role", "employer")


@query(
    "line_context",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text <> ''),
    k AS (
      SELECT *, regexp_matches(trim(line), '[0-9]') AS d, length(trim(line)) <= 140 AND NOT ends_with(trim(line), ':') AND trim(line) <> '' AS short FROM l
    ), t AS (SELECT *, short AND regexp_matches(trim(line), '^[A-Z]') AS r, short AND regexp_matches(trim(line), '[.]$') AND NOT regexp_matches(trim(line), '^[A-Z]') AS e FROM k),
    f AS (
      SELECT *, last_value(CASE WHEN r THEN line_no END IGNORE NULLS) OVER b AS rb, first_value(CASE WHEN r THEN line_no END IGNORE NULLS) OVER a AS ra,
             last_value(CASE WHEN e THEN line_no END IGNORE NULLS) OVER b AS eb, first_value(CASE WHEN e THEN line_no END IGNORE NULLS) OVER a AS ea
      FROM t WINDOW b AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)
    )
    SELECT doc_id, line_no, CASE WHEN r THEN line_no WHEN rb IS NULL OR ra - line_no < line_no - rb THEN coalesce(ra, rb) ELSE rb END AS role_line,
           CASE WHEN e THEN line_no WHEN eb IS NULL OR ea - line_no < line_no - eb THEN coalesce(ea, eb) ELSE eb END AS employer_line
    FROM f WHERE d
    """,
)
def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around every line with a digit: the nearest line that begins with a capital, and the nearest other one that ends in a full stop."""
    rows = lines.line_table(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    flagged = history.line_flags(rows, "^[A-Z]", "[.]$", "[0-9]")
    found = history.dated_roles(flagged, "doc_id")
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("line_no", "role_line", "employer_line")])


@query(
    "absorbed_roles",
    """
    WITH r AS (
      SELECT l_orderkey, 'own' AS kind, p_type AS title, (l_quantity / 10)::DECIMAL(20, 6) AS years FROM lineitem JOIN part ON p_partkey = l_partkey
      UNION ALL
      SELECT l_orderkey, 'with employer', s_name || ', ' || p_type, ((l_quantity - l_linenumber % 3) / 10)::DECIMAL(20, 6) FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
    ), n AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t, round(years, 2) AS y FROM r), k AS (SELECT DISTINCT l_orderkey, t, y FROM n WHERE t <> '' AND y > 0),
    g AS (SELECT DISTINCT a.l_orderkey, a.t, a.y FROM k a JOIN k b ON a.l_orderkey = b.l_orderkey AND a.y = b.y AND length(a.t) > length(b.t) AND ends_with(a.t, b.t))
    SELECT n.l_orderkey, kind, count(*) AS kept FROM n LEFT JOIN g USING (l_orderkey, t, y) WHERE g.t IS NULL GROUP BY ALL
    """,
)
def absorbed_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as records, each also with its employer in front of the title and partly another duration; what is left of either kind."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    own = F.struct(F.lit("own").alias("kind"), F.col("p_type").alias("job_title"), (F.col("l_quantity") / 10).alias("years"))
    with_employer = F.struct(F.lit("with employer").alias("kind"), F.concat("s_name", F.lit(", "), "p_type").alias("job_title"), ((F.col("l_quantity") - F.col("l_linenumber") % 3) / 10).alias("years"))
    # An order's lines are put together before they become two records each, so that each line is sent once.
    lines_of = rows.select("l_orderkey", "l_linenumber", "l_quantity", "p_type", "s_name").repartition("l_orderkey")
    records = lines_of.select("l_orderkey", F.inline(F.array(own, with_employer)))
    return history.drop_absorbed(records, "l_orderkey").groupBy("l_orderkey", "kind").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "toggled_lines",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text <> ''),
    s AS (SELECT *, CASE WHEN regexp_matches(line, '[0-9]') THEN false WHEN regexp_matches(line, '^[A-M]') THEN true END AS signal FROM l),
    t AS (SELECT doc_id, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), false) AS inside FROM s)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE inside) AS n_inside FROM t GROUP BY doc_id
    """,
)
def toggled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines inside sections that a line with an early capital opens and one with a digit closes."""
    rows = lines.line_table(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    on, off = F.col("line").rlike("^[A-M]"), F.col("line").rlike("[0-9]")
    return history.toggled(rows, on, off, False, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("inside").alias("n_inside"))


@query(
    "claimed_sections",
    """
    SELECT c_custkey, c_name || '|SKILLS|' || lower(c_mktsegment) || CASE WHEN c_acctbal < 3000 THEN '' ELSE '|' || lower(n_name) END
           || '|EXPERIENCE' || CASE WHEN c_acctbal > 6000 THEN '|clerk at ' || lower(n_name) ELSE '' END || '|EDUCATION|BS ' || c_mktsegment || ', 2015' AS claimed,
           CASE WHEN c_acctbal > 6000 THEN 'clerk at ' || lower(n_name)
                ELSE c_name || '|SKILLS|' || lower(c_mktsegment) || CASE WHEN c_acctbal < 3000 THEN '|Currently learning' ELSE '' END || '|' || lower(n_name) || '|EXPERIENCE|EDUCATION|BS ' || c_mktsegment || ', 2015' END AS work
    FROM customer JOIN nation ON n_nationkey = c_nationkey
    """,
)
def claimed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as resumes with a section of what they are learning and one of work, both of them not always; what they claim and where they worked."""
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    nation, segment = F.lower("n_name"), F.lower("c_mktsegment")
    parts = [
        F.col("c_name"), F.lit("SKILLS"), segment, F.when(F.col("c_acctbal") < 3000, F.lit("Currently learning")), nation, F.lit("EXPERIENCE"),
        F.when(F.col("c_acctbal") > 6000, F.concat(F.lit("clerk at "), nation)), F.lit("EDUCATION"), F.concat(F.lit("BS "), "c_mktsegment", F.lit(", 2015")),
    ]
    table_of = lines.line_table(rows.select("c_custkey", F.concat_ws("\n", *parts).alias("text")), "c_custkey")
    joined = lambda kept, name: kept.groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "|").alias(name))
    return joined(history.claimed_lines(table_of, "c_custkey"), "claimed").join(joined(history.work_lines(table_of, "c_custkey"), "work"), "c_custkey")


_BLOCKED = r"""
WITH RECURSIVE k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id) AS rn, doc_id AS id, list_filter([
    hash('f' || coalesce(text, '')), CASE WHEN e <> '' THEN hash('e' || lower(trim(e, ' .,;:'))) END, CASE WHEN s <> '' THEN hash('t' || s) END, hash('w' || w)], lambda x: x IS NOT NULL) AS keys
  FROM (SELECT *, regexp_extract(text, '(?:^|[^\w.-])([\w.+-]+@[\w.-]+\.[A-Za-z]{2,})', 1) AS e, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS s,
               string_split(coalesce(text, ''), ' ')[1] || length(coalesce(text, ''))::VARCHAR AS w FROM documents)
), r(rn, id, hit, seen) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, MAP {}::MAP(UBIGINT, BIGINT)
  UNION ALL
  SELECT rn, id, hit, CASE WHEN hit IS NULL THEN map_concat(seen, map_from_entries(list_transform(list_distinct(keys), lambda x: struct_pack(k := x, v := id)))) ELSE seen END
  FROM (SELECT k.rn, k.id, k.keys, r.seen, list_min(list_transform(k.keys, lambda x: r.seen[x])) AS hit FROM r JOIN k ON k.rn = r.rn + 1)
)
SELECT id, hit IS NULL AS accepted, hit AS duplicate_of FROM r WHERE rn > 0
"""


@query("duplicate_uploads", _BLOCKED)
def duplicate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads in the order of doc_id: the same file, e-mail, text, or beginning and length refuse one; the SQL replays them one by one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    email, plain = text.identity_signature(text.email_of(F.col("text"))), text.text_signature(F.col("text"))
    values = {
        "file": F.sha2(F.col("text").cast("binary"), 256), "email": F.nullif(email, F.lit("")), "text": F.when(plain != "", F.sha2(plain.cast("binary"), 256)),
        "begins": F.concat(F.element_at(F.split("text", " "), 1), F.length("text").cast("string")),
    }
    keys = docs.select(F.col("doc_id").alias("id"), F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in values.items()]))).where("value is not null")
    return duplicates.block_duplicates(keys, docs.select(F.col("doc_id").alias("id")))


@query(
    "same_files",
    """
    WITH f AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), l AS (SELECT h, min(doc_id) AS first FROM f GROUP BY h)
    SELECT doc_id, first AS same_as FROM f JOIN l USING (h) WHERE doc_id <> first
    """,
)
def same_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads with the file of an earlier one."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("file_hash"))
    return duplicates.same_file(rows, "doc_id")


@query(
    "versioned_parts",
    """
    SELECT coalesce(k, s_suppkey * 3) AS k, coalesce(CASE WHEN s_acctbal > 5000 THEN s_name END, name) AS name, CASE WHEN s_suppkey IS NULL THEN size ELSE coalesce(s_nationkey, size) END AS size
    FROM (SELECT p_partkey AS k, p_name AS name, p_size AS size FROM part) FULL JOIN supplier ON s_suppkey * 3 = k
    WHERE coalesce(k, s_suppkey * 3) NOT IN (SELECT n_nationkey * 7 FROM nation)
    UNION ALL SELECT n_nationkey * 7, NULL, n_regionkey FROM nation WHERE n_regionkey > 2
    """,
)
def versioned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, then versions: changed and added to by all suppliers, some deleted, and some of those back without their former values."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") * 7).alias("k"), F.col("n_regionkey").alias("size"))
    changes = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("k"), F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("name"), F.col("s_nationkey").alias("size"))
    kept = VersionedTable.create(rows, new_path(spark, "versioned-parts"), "k", 16)
    kept.upsert(changes)
    kept.delete(nation.select("k"))
    kept.upsert(nation.where("size > 2"))
    return kept.read()


@query(
    "results_unknown_status",
    f"""
    WITH {_RESULTS}, r AS (SELECT id, fit_score, row_number() OVER (ORDER BY fit_score DESC NULLS LAST, id DESC) AS place FROM results)
    SELECT id, fit_score, place FROM r WHERE place <= 20
    """,
)
def results_unknown_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status that doesn't exist filters nothing: the first page of all results, and their places in it."""
    rows = results(spark, sf_dir)
    places = review.candidate_navigation(rows, status="Archived").select("id", F.col("position").alias("place"))
    return review.ranked_results(rows, status="Archived").join(places, "id").select("id", "fit_score", "place")


_PAGE_WORDS = """
w AS (
  SELECT l_suppkey AS page, p_name AS text, (l_quantity * 14 + l_linenumber % 3)::DOUBLE AS top, side,
         (CASE WHEN side = 2 THEN 270 + l_partkey % 20 WHEN side = 1 THEN 320 + l_partkey % 200 ELSE 40 + l_partkey % 200 END)::DOUBLE AS x0, (20 + l_partkey % 23)::DOUBLE AS w, l_quantity AS row
  FROM (SELECT *, CASE WHEN l_discount > 0.095 AND l_suppkey % 2 = 1 THEN 2 WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS side FROM lineitem) JOIN part ON p_partkey = l_partkey
), p AS (SELECT *, x0 + w + CASE WHEN side = 2 THEN 40 ELSE 0 END AS x1 FROM w)"""


@query(
    "page_layout",
    f"""
    WITH {_PAGE_WORDS}, s AS (SELECT page, count(*) AS words, 600.0::DOUBLE AS width FROM p GROUP BY page),
    b AS (SELECT page, words, k, width * 0.22 + 2 * k AS x, width * 0.68 AS r FROM s, range(138) AS t(k) WHERE words >= 35),
    c AS (SELECT b.*, (SELECT count(*) FROM p WHERE p.page = b.page AND x0 < x + 2 AND x1 > x) <= 1 AS free FROM b),
    i AS (SELECT *, k - row_number() OVER (PARTITION BY page, free ORDER BY k) AS island FROM c),
    g AS (SELECT page, any_value(words) AS words, min(x) AS l, least(max(x) + 2, any_value(r)) AS r FROM i WHERE free GROUP BY page, island HAVING least(max(x) + 2, any_value(r)) - min(x) >= 16),
    h AS (SELECT g.page, l, r, any_value(words) AS words, count(*) FILTER (WHERE x1 <= l) AS n, count(*) FILTER (WHERE x0 >= r) AS m FROM g JOIN p ON p.page = g.page GROUP BY g.page, l, r),
    f AS (SELECT page, arg_min(l, [l - r, l]) AS l, arg_min(r, [l - r, l]) AS r FROM h WHERE n >= 12 AND m >= 20 AND least(n, m) / words >= 0.12 GROUP BY page),
    q AS (SELECT p.*, CASE WHEN (x0 + x1) / 2 >= (l + r) / 2 THEN 1 ELSE 0 END AS col FROM p LEFT JOIN f ON f.page = p.page),
    o AS (SELECT *, lag(x1) OVER (PARTITION BY page, col, row ORDER BY x0, top, text, x1) AS before, row_number() OVER (PARTITION BY page, col, row ORDER BY x0, top, text, x1) AS nth FROM q),
    t AS (
      SELECT page, col, row, string_agg(CASE WHEN nth = 1 THEN '' WHEN x0 - before >= 12 THEN '  ' ELSE ' ' END || text, '' ORDER BY nth) AS line,
             min(min(top)) OVER (PARTITION BY page, col) AS begins FROM o GROUP BY page, col, row
    )
    SELECT page, row_number() OVER (PARTITION BY page ORDER BY begins, col, row) - 1 AS line_no, line FROM t
    """,
)
def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pages whose words are their order lines, in two columns that a word of some pages crosses."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    side = F.when((F.col("l_discount") > 0.095) & (F.col("l_suppkey") % 2 == 1), 2).when(F.col("l_tax") > 0.04, 1).otherwise(0)
    part = F.col("l_partkey")
    x0 = F.when(side == 2, part % 20 + 270).when(side == 1, part % 200 + 320).otherwise(part % 200 + 40).cast("double")
    x1 = x0 + part % 23 + 20 + F.when(side == 2, 40).otherwise(0)
    words = rows.select(F.col("l_suppkey").alias("page"), F.col("p_name").alias("text"), x0.alias("x0"), x1.alias("x1"), (F.col("l_quantity") * 14 + F.col("l_linenumber") % 3).alias("top"))
    pages = words.select("page").distinct().select("page", F.lit(600.0).alias("width"))
    return layout.page_lines(words, pages).withColumn("line_no", F.col("line_no").cast("long"))


@query(
    "skills_in_lines",
    """
    WITH RECURSIVE s AS (SELECT DISTINCT p_name AS skill, string_split(p_name, ' ') AS w FROM part WHERE p_name IS NOT NULL),
    l AS (SELECT l_orderkey, l_linenumber, 'makes ' || left(p_name, l_linenumber) || substr(p_name, l_linenumber + 2) || ' daily' AS line FROM lineitem JOIN part ON p_partkey = l_partkey),
    u AS (SELECT DISTINCT line, regexp_split_to_array(line, ' +') AS w FROM l),
    r AS (
      SELECT DISTINCT line, k, list_sort(list_distinct(w[i:i + k - 1])) AS a
      FROM u, (SELECT unnest([2, 3, 4]) AS k), (SELECT unnest([1, 2, 3, 4, 5]) AS i) WHERE i + k - 1 <= len(w)
    ),
    p AS MATERIALIZED (
      SELECT a, skill, list_sort(list_filter(a, lambda x: list_contains(w, x))) AS c,
             list_sort(list_filter(a, lambda x: NOT list_contains(w, x))) AS x, list_sort(list_filter(list_distinct(w), lambda y: NOT list_contains(a, y))) AS y
      FROM (SELECT DISTINCT a FROM r), s
    ),
    q AS MATERIALIZED (
      SELECT row_number() OVER () AS id, a, skill, len(c) AS n, len(x) AS nx, len(y) AS ny,
             array_to_string(c, ' ') AS t, array_to_string(list_concat(c, x), ' ') AS ta, array_to_string(list_concat(c, y), ' ') AS tb FROM p
    ),
    dp AS (
      SELECT id, 0 AS i, unnest(range(0, length(tb) + 1)) AS j, 0 AS v, ta, tb FROM q WHERE 200.0 * least(length(ta), length(tb)) >= 85 * (length(ta) + length(tb))
      UNION ALL
      SELECT id, i + 1, j, max(m) OVER (PARTITION BY id ORDER BY j), ta, tb
      FROM (
        SELECT id, i, j, ta, tb, CASE WHEN j > 0 AND substr(ta, i + 1, 1) = substr(tb, j, 1) THEN lag(v, 1, 0) OVER (PARTITION BY id ORDER BY j) + 1 ELSE v END AS m
        FROM dp WHERE i < length(ta)
      )
    ),
    e AS (SELECT id, max(v) AS v FROM dp WHERE i = length(ta) GROUP BY id),
    z AS (
      SELECT a, skill, CASE WHEN n > 0 AND (nx = 0 OR ny = 0) THEN 100.0::DOUBLE ELSE greatest(
        coalesce(200.0::DOUBLE * v / (length(ta) + length(tb)), 0), CASE WHEN n > 0 THEN 200.0::DOUBLE * length(t) / (length(t) + least(length(ta), length(tb))) ELSE 0 END) END AS ratio
      FROM q LEFT JOIN e USING (id)
    )
    SELECT l_orderkey, l_linenumber, skill, max(ratio) AS ratio
    FROM l JOIN r USING (line) JOIN z USING (a) JOIN s USING (skill) WHERE ratio >= 85 AND k BETWEEN len(s.w) AND len(s.w) + 2 GROUP BY ALL
    """,
)
def skills_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, as skills, in a line for every item sold that leaves a letter of its part's name out."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    name, at = F.col("p_name"), F.col("l_linenumber")
    line = F.concat(F.lit("makes "), F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.length(name)), F.lit(" daily"))
    rows = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")).join(parts, F.col("p_partkey") == F.col("l_partkey"))
    return skill_join.similar_skills(rows.select("l_orderkey", "l_linenumber", line.alias("line")), parts, skill="p_name")


@query(
    "listed_skills",
    f"""
    WITH r AS (
      SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}, l_discount) AS k,
             CASE WHEN l_discount <= 0.02 THEN [p_name, p_brand, p_type] WHEN l_discount <= 0.05 THEN [p_name || ' (' || p_brand || ', ' || p_type || ')']
                  WHEN l_discount <= 0.08 THEN [p_name || ' and ' || p_type || ' ' || p_brand] ELSE [p_type || ' Skills', p_name] END AS items
      FROM lineitem JOIN part ON p_partkey = l_partkey
    ), i AS (SELECT l_orderkey, unnest(items) AS item, 10 * k + generate_subscripts(items, 1) AS place FROM r),
    d AS (
      SELECT l_orderkey, arg_min(item, place) AS item, min(place) AS place FROM i
      GROUP BY l_orderkey, regexp_replace(trim(regexp_replace(lower(item), '[^a-z0-9+#.]+', ' ', 'g')), ' skills$', '')
    )
    SELECT l_orderkey, count(*) AS n_skills, string_agg(item, ' / ' ORDER BY place) AS skills FROM d GROUP BY l_orderkey
    """,
)
def listed_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a resume whose lines list skills below a category, with brackets, broken over two lines, or beside denied ones; each skill once."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    discount = F.col("l_discount")
    row = (
        F.when(discount <= 0.02, F.format_string("Tools: %s - %s,  %s", "p_name", "p_brand", "p_type"))
        .when(discount <= 0.05, F.format_string("- %s (%s, %s)", "p_name", "p_brand", "p_type"))
        .when(discount <= 0.08, F.format_string("- %s and\n%s %s", "p_name", "p_type", "p_brand"))
        .otherwise(F.format_string("• %s Skills | no %s; for %s | %s", "p_type", "p_brand", "p_name", "p_name"))
    )
    whole = F.array_sort(F.collect_list(F.struct(*_ORDER.split(", "), "l_discount", row.alias("row"))))
    text = F.concat(F.lit("Summary\n- no item\nTechnical Skills\n"), F.array_join(whole["row"], "\n"), F.lit("\nEducation\n- no item"))
    found = skill_items.listed_skills(rows.groupBy("l_orderkey").agg(text.alias("text")), "l_orderkey")
    return found.select("l_orderkey", F.size("skills").cast("long").alias("n_skills"), F.array_join("skills", " / ").alias("skills"))


@query(
    "claimed_skills",
    """
    WITH r AS (SELECT l_orderkey, p_name, l_discount AS d FROM lineitem JOIN part ON p_partkey = l_partkey),
    o AS (SELECT l_orderkey, bool_or(d > 0.02 AND d <= 0.05) AS docker, bool_or(d > 0.05 AND d <= 0.08) AS sharp FROM r GROUP BY l_orderkey)
    SELECT l_orderkey, p_name AS skill, bool_or(d <= 0.02) AS named, NULL::VARCHAR AS implied_by FROM r GROUP BY ALL
    UNION ALL SELECT l_orderkey, 'Containerization', false, CASE WHEN docker THEN 'docker' END FROM o
    UNION ALL SELECT l_orderkey, 'c  sharp', sharp, NULL FROM o
    """,
)
def claimed_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a resume that names parts, denies them or hopes to learn them, asked for all its parts and for two skills that it names otherwise."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    discount = F.col("l_discount")
    line = (
        F.when(discount <= 0.02, F.format_string("Built tools with %s", F.upper("p_name"))).when(discount <= 0.05, F.format_string("no experience  with %s; uses Docker", "p_name"))
        .when(discount <= 0.08, F.format_string("eager to learn %s. Knows C#", "p_name")).otherwise(F.format_string("sells un%ss", "p_name"))
    )
    orders = rows.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"), F.concat(F.collect_set("p_name"), F.array(F.lit("Containerization"), F.lit("c  sharp"), F.lit(" "))).alias("skills"))
    return skill_claims.skill_claims(lines.line_table(orders, "l_orderkey"), orders, "l_orderkey").select("l_orderkey", "skill", "named", "implied_by")
