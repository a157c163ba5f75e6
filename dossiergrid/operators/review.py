"""The review surface: lists, navigation, dashboards, decisions, deletions and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossiergrid.scratch import materialize, shuffle_partitions

#: What a reviewer may set, and the orders of a list.
REVIEW_STATUSES = ("Pending Review", "Reviewed", "Move to Interview", "Rejected", "Needs Clarification")
PAGE = 20
NOTES_LIMIT = 3000

_ORDERS = {"fit_desc": ("fit_score", "desc"), "fit_asc": ("fit_score", "asc"), "newest": ("screened_at", "desc"), "oldest": ("screened_at", "asc")}


def filter_results(results: DataFrame, job_id: int | None = None, status: str | None = None) -> DataFrame:
    """Results of one job and one reviewer status; arguments that are absent or no known status filter nothing."""
    if job_id is not None:
        results = results.where(F.col("job_id") == job_id)
    if status in REVIEW_STATUSES:
        results = results.where(F.col("reviewer_status") == status)
    return results


def result_order(sort: str | None) -> list[Column]:
    """The sort columns of a list; anything unknown is best fit first. Newer ids come first among equals."""
    column, way = _ORDERS.get(sort or "", _ORDERS["fit_desc"])
    return [F.col(column).desc() if way == "desc" else F.col(column).asc(), F.col("id").desc()]


def ranked_results(results: DataFrame, job_id: int | None = None, status: str | None = None, sort: str | None = None) -> DataFrame:
    """The review list: all results that a filter selects, or the first 20 where there is none."""
    ordered = filter_results(results, job_id, status).orderBy(*result_order(sort))
    filtered = job_id is not None or status in REVIEW_STATUSES
    return ordered if filtered else ordered.limit(PAGE)


def candidate_navigation(results: DataFrame, job_id: int | None = None, status: str | None = None, sort: str | None = None) -> DataFrame:
    """``id``, ``previous_id``, ``next_id``, ``position``, ``total`` of every row of the review list.

    The list is cut into ranges of its order; a row's position is its place in its range plus
    the lengths of the ranges before, and the ends of a range meet the ends of the ranges beside it.
    No task gets the whole list. Ids must be unique, as they are the last sort key.
    """
    order = result_order(sort)
    rows = ranked_results(results, job_id, status, sort).select("id", "fit_score", "screened_at")
    ranged = materialize(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).withColumn("part", F.spark_partition_id()), "review-list")
    of = Window.partitionBy("part").orderBy(*order)
    listed = ranged.select("id", "part", F.row_number().over(of).alias("place"), F.lag("id").over(of).alias("previous_id"), F.lead("id").over(of).alias("next_id"))
    # One row per range.
    ends = listed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", "place").alias("first"), F.max_by("id", "place").alias("last"))
    parts = Window.orderBy("part")
    upto = F.sum("n").over(parts)
    every = F.sum("n").over(Window.partitionBy())
    ends = ends.select("part", (upto - F.col("n")).alias("before"), every.alias("total"), F.lag("last").over(parts).alias("left"), F.lead("first").over(parts).alias("right"))
    return listed.join(F.broadcast(ends), "part").select(
        "id",
        F.coalesce("previous_id", "left").alias("previous_id"),
        F.coalesce("next_id", "right").alias("next_id"),
        (F.col("before") + F.col("place")).alias("position"),
        "total",
    )


def navigation_of(results: DataFrame, candidate: int, job_id: int | None = None, status: str | None = None, sort: str | None = None) -> DataFrame:
    """The row that ``candidate_navigation`` has for one candidate, or none if the list hasn't got them.

    Neighbours are the nearest rows on either side of the candidate's sort key, so one aggregate over
    the list does, with no sort of it. Null scores and times count as the least.
    """
    column, way = _ORDERS.get(sort or "", _ORDERS["fit_desc"])
    # A filtered list is all that is selected: its order needs no sort here.
    filtered = job_id is not None or status in REVIEW_STATUSES
    rows = filter_results(results, job_id, status) if filtered else ranked_results(results, sort=sort)
    rows = rows.select("id", F.col(column).alias("value"))
    own = rows.where(F.col("id") == candidate).first()
    # Higher keys come first: newer ids do in every order.
    last = F.col("id") if way == "desc" else -F.col("id")
    key = F.struct(F.col("value"), last.alias("last"))
    kind = rows.schema["value"].dataType
    value, number = (own["value"], own["id"]) if own else (None, None)
    mine = F.struct(F.lit(value).cast(kind).alias("value"), F.lit(number if own is None or way == "desc" else -number).cast(rows.schema["id"].dataType).alias("last"))
    above, below = (key > mine, key < mine) if way == "desc" else (key < mine, key > mine)
    nearest_above, nearest_below = (F.min_by, F.max_by) if way == "desc" else (F.max_by, F.min_by)
    keyed = lambda near: F.when(near, key)
    found = rows.agg(
        nearest_above("id", keyed(above)).alias("previous_id"),
        nearest_below("id", keyed(below)).alias("next_id"),
        (F.count_if(above) + 1).alias("position"),
        F.count(F.lit(1)).alias("total"),
    )
    # Nullable whether the candidate is there or not, so that the schema doesn't tell.
    name = F.when(F.col("total") > 0, F.lit(number)).cast(rows.schema["id"].dataType).alias("id")
    return found.select(name, "*").where(F.lit(own is not None))


def dashboard_counts(results: DataFrame, label: str = "recommendation_label", labels: tuple[str, ...] = ("Qualified", "For Review", "Not Qualified")) -> DataFrame:
    """One row: all results, and those of each label, in one pass."""
    counts = [F.count_if(F.col(label) == value).alias(value.lower().replace(" ", "_")) for value in labels]
    return results.agg(F.count(F.lit(1)).alias("total"), *counts)


def recent(rows: DataFrame, n: int = 5, at: str = "created_at", key: str = "id") -> DataFrame:
    """The ``n`` newest rows; higher keys first among equals."""
    return rows.orderBy(F.col(at).desc(), F.col(key).desc()).limit(n)


def with_defaults(jobs: DataFrame, criteria: DataFrame) -> DataFrame:
    """Jobs with their first criteria row, or the defaults 50.0 and False."""
    first = criteria.groupBy("job_id").agg(F.min_by(F.struct("min_fit_score", "requires_all_critical"), "id").alias("c"))
    return jobs.join(first, jobs["id"] == first["job_id"], "left").select(
        jobs["*"],
        F.coalesce("c.min_fit_score", F.lit(50.0)).alias("min_fit_score"),
        F.coalesce("c.requires_all_critical", F.lit(False)).alias("requires_all_critical"),
    )


def result_details(results: DataFrame, applicants: DataFrame, jobs: DataFrame, resumes: DataFrame) -> DataFrame:
    """Results with their applicant, job and resume, which may be missing."""
    out = results.join(applicants.select(F.col("id").alias("applicant_id"), F.col("name").alias("applicant_name"), "email", "phone"), "applicant_id", "left")
    out = out.join(jobs.select(F.col("id").alias("job_id"), F.col("title").alias("job_title")), "job_id", "left")
    return out.join(resumes.select(F.col("id").alias("resume_id"), "filename", "extraction_status"), "resume_id", "left")


def children(parent: DataFrame, child: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """``parent`` with its children's ``fields`` as a list, in the order of the child's id; empty where there is none."""
    lists = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", *fields))).alias("__c"))
    lists = lists.select(key, F.transform("__c", lambda c: F.struct(*[c[f].alias(f) for f in fields])).alias(name))
    empty = F.array().cast(lists.schema[name].dataType)
    return parent.join(lists, key, "left").withColumn(name, F.coalesce(name, empty))


def without(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows that a deletion by ``keys`` leaves: those with other or null keys."""
    return rows.join(keys.select(F.col(on).alias("__gone")).distinct(), F.col(on) == F.col("__gone"), "left_anti")


def cascade_delete(tables: dict[str, DataFrame], root: str, ids: DataFrame, children_of: dict[str, list[tuple[str, str]]]) -> dict[str, DataFrame]:
    """Delete the rows ``ids`` (id) of ``root`` and all that refer to them.

    ``children_of`` maps a table to (child table, foreign key) pairs; a child's own
    children go with it.
    """
    out, queue = dict(tables), [(root, "id", ids.select("id"))]
    while queue:
        name, key, gone = queue.pop(0)
        gone = gone.select(F.col(gone.columns[0]).alias("__gone")).distinct()
        lost = tables[name].join(gone, F.col(key) == F.col("__gone"), "left_semi")
        out[name] = out[name].join(gone, F.col(key) == F.col("__gone"), "left_anti")
        if "id" in tables[name].columns:
            queue += [(child, foreign, lost.select("id")) for child, foreign in children_of.get(name, [])]
    return out


def apply_reviews(results: DataFrame, reviews: DataFrame) -> DataFrame:
    """Results with the latest review of each: (id, reviewer_status, reviewer_notes, reviewed_by, reviewed_at).

    Reviews with an unknown status or notes over the limit are refused. The system's
    label never changes. Of reviews at the same time the one by the highest reviewer counts.
    """
    fields = ["reviewer_status", "reviewer_notes", "reviewed_by", "reviewed_at"]
    valid = reviews.where(F.col("reviewer_status").isin(*REVIEW_STATUSES) & (F.length(F.coalesce("reviewer_notes", F.lit(""))) <= NOTES_LIMIT))
    last = valid.groupBy(F.col("id").alias("__id")).agg(F.max_by(F.struct(*fields), F.struct("reviewed_at", "reviewed_by")).alias("__r"))
    joined = results.join(last, F.col("id") == F.col("__id"), "left")
    keep = [F.when(F.col("__r").isNotNull(), F.col(f"__r.{f}")).otherwise(F.col(f)).alias(f) if f in fields else F.col(f) for f in results.columns]
    return joined.select(*keep)


def audit_log(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The log with entries appended; a column that one side lacks is null there."""
    return log.unionByName(entries, allowMissingColumns=True)


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the changed columns replaced where a change isn't null, and new keys added."""
    other = [c for c in changes.columns if c != key]
    both = rows.join(changes.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in other]), F.col(key) == F.col("__key"), "full")
    out = [F.coalesce(f"__new_{c}", c).alias(c) if c in other else F.coalesce(key, "__key").alias(key) if c == key else F.col(c) for c in rows.columns]
    return both.select(*out)


def insert_absent(rows: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Rows with those of ``seed`` whose key isn't there yet."""
    new = seed.join(rows.select(F.col(key).alias("__have")), F.col(key) == F.col("__have"), "left_anti")
    return rows.unionByName(new, allowMissingColumns=True)


def preview(items: Column, n: int) -> Column:
    """The first ``n`` items in a line, and how many more there are."""
    more = F.size(items) - n
    shown = F.array_join(F.slice(items, 1, n), ", ")
    return F.when(more > 0, F.concat(shown, F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(shown)


def overridden(label: Column, fit: Column) -> Column:
    """A result that a rule rejected though its score would do."""
    return (label == "Not Qualified") & (fit >= 50)


def by_key(rows: DataFrame, value: object, key: str = "id") -> DataFrame:
    """The row of a key, or none; a null key finds nothing. The test reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


def insert_numbered(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` and ``new``, whose keys go on from the highest one without a gap.

    A new row has its place in the part of the table that it is read with, and a part begins where those before it
    end: nothing is moved or ordered, whatever the values are. Only the parts' sizes meet in one task.
    """
    new = materialize(new.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    # The number of the part from bit 33 on, below it the place in the part.
    new = new.select("*", F.shiftright("__at", 33).alias("__part"), (F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("__place")).drop("__at")
    sizes = new.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    base = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))
    top = rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    ids = (F.col("__top") + F.col("__base") + F.col("__place")).cast(rows.schema[key].dataType).alias(key)
    kept = [c for c in new.columns if c not in (key, "__part", "__place")]
    numbered = new.join(F.broadcast(base), "__part").crossJoin(F.broadcast(top)).select(ids, *kept)
    return rows.unionByName(numbered, allowMissingColumns=True)


def allowed(role: Column, roles: tuple[str, ...]) -> Column:
    """Whether a user's role is one of those that may; nobody without a role may."""
    return F.coalesce(role.isin(*roles), F.lit(False))


def safe_next(target: Column) -> Column:
    """Whether a link stays on this site: a path, and not one that names another host."""
    return F.coalesce(target.startswith("/") & ~target.startswith("//"), F.lit(False))


def within_limit(attempts: DataFrame, who: str, at: str, key: str, most: int = 5, window: str = "MINUTE") -> DataFrame:
    """``attempts`` with ``admitted``: the first ``most`` of each address in each minute, by time and key."""
    order = Window.partitionBy(who, F.date_trunc(window, F.col(at))).orderBy(at, key)
    return attempts.withColumn("admitted", F.row_number().over(order) <= most)
