"""Neighbours in the review list, of all candidates and of one, against a sorted list."""

import datetime as dt
import random

import pytest

from dossiergrid.operators import review

SCHEMA = "id long, job_id long, reviewer_status string, fit_score double, screened_at timestamp"


def results(seed, n):
    """Many equal and null scores and times, and ids beyond 32 bits."""
    rng = random.Random(seed)
    day = dt.datetime(2024, 5, 1)
    return [
        (5_000_000_000 + i, rng.randrange(3), rng.choice(review.REVIEW_STATUSES[:2]), rng.choice([None, 40.0, 60.5, 60.5, 99.0]), rng.choice([None, day, day + dt.timedelta(hours=rng.randrange(5))]))
        for i in rng.sample(range(10 * n), n)
    ]


def plain(rows, sort):
    """The list as sorted by Python: nulls are the least, newer ids come first among equals."""
    at = 3 if sort.startswith("fit") else 4
    least = -1.0 if at == 3 else dt.datetime(1970, 1, 1)
    value = lambda r: least if r[at] is None else r[at]
    ordered = sorted(sorted(rows, key=lambda r: -r[0]), key=value, reverse=sort in ("fit_desc", "newest"))
    if sort in ("fit_desc", "newest"):
        ordered = sorted(rows, key=lambda r: (value(r), r[0]), reverse=True)
    ids = [None, *[r[0] for r in ordered], None]
    return {ids[i]: (ids[i - 1], ids[i + 1], i, len(rows)) for i in range(1, len(ids) - 1)}


@pytest.mark.parametrize("sort", ["fit_desc", "fit_asc", "newest", "oldest"])
def test_against_a_sorted_list(spark, sort):
    rows = results(3, 90)
    table = spark.createDataFrame(rows, SCHEMA)
    want = plain([r for r in rows if r[1] == 1], sort)
    got = {r.id: (r.previous_id, r.next_id, r.position, r.total) for r in review.candidate_navigation(table, 1, sort=sort).collect()}
    assert got == want and len(want) > 15
    ids = list(want)
    for candidate in (ids[0], ids[1], ids[len(ids) // 2], ids[-1]):
        one = review.navigation_of(table, candidate, 1, sort=sort).collect()
        assert [(r.previous_id, r.next_id, r.position, r.total) for r in one] == [want[candidate]] and one[0].id == candidate


def test_no_candidate_and_one(spark):
    rows = results(4, 5)
    table = spark.createDataFrame(rows, SCHEMA)
    assert review.navigation_of(table, 1).count() == 0 and review.navigation_of(table.limit(0), 1).count() == 0
    assert review.candidate_navigation(table.limit(0)).count() == 0
    assert review.navigation_of(table, 1).schema == review.navigation_of(table, rows[0][0]).schema
    only = table.limit(1)
    row = review.navigation_of(only, only.first().id).first()
    assert (row.previous_id, row.next_id, row.position, row.total) == (None, None, 1, 1)
