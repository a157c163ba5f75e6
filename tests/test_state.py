"""Duplicate blocking in few rounds, keyed state of ingestion, and tables changed in place."""

import os
import random

import pytest
from pyspark.sql import functions as F

from dossiergrid.operators import duplicates, review
from dossiergrid.operators.review import cascade_delete, upsert
from dossiergrid.sources.versioned import VersionedTable, delete_cascading
from dossiergrid.streaming.keyed import KeyTable

KEYS = "id long, kind string, value string"


def replay(rows, ids):
    held, accepted, out = {}, {}, {}
    for i, k, v in rows:
        held.setdefault(i, set()).add((k, v))
    for i in sorted(ids):
        hit = [accepted[key] for key in held.get(i, ()) if key in accepted]
        out[i] = min(hit, default=None)
        if not hit:
            accepted |= dict.fromkeys(held.get(i, ()), i)
    return out


def blocked(spark, rows, ids):
    found = duplicates.block_duplicates(spark.createDataFrame(rows, KEYS), spark.createDataFrame([(i,) for i in ids], "id long"))
    got = found.collect()
    assert all(r.accepted == (r.duplicate_of is None) for r in got)
    return {r.id: r.duplicate_of for r in got}


@pytest.mark.parametrize("small", [50_000, 40])
def test_random_uploads(spark, monkeypatch, small):
    """With few keys a task, components are told apart and large ones go on by rounds."""
    monkeypatch.setattr(duplicates, "SMALL", small)
    rng = random.Random(small)
    rows = [(i, kind, str(rng.randrange(60))) for i in range(150) for kind in ("email", "text") if rng.random() < 0.8]
    rows += [(i, "file", "hot") for i in range(0, 150, 3)] + rows[:5]
    assert blocked(spark, rows, range(152)) == replay(rows, range(152))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Every upload shares a key with the next one only."""
    written = []
    real = duplicates.materialize
    monkeypatch.setattr(duplicates, "materialize", lambda df, name: written.append(name) or real(df, name))
    rows = [(i, "email", str(i + d)) for i in range(1000) for d in (0, 1)]
    want = {i: i - 1 if i % 2 else None for i in range(1000)}
    assert blocked(spark, rows, range(1000)) == want and written.count("duplicate-state") < 10
    # The same where the chain is one of several components.
    written.clear()
    monkeypatch.setattr(duplicates, "SMALL", 2500)
    more = rows + [(i + 5000, "text", str(i % 40)) for i in range(800)]
    assert blocked(spark, more, [*range(1000), *range(5000, 5800)]) == replay(more, [*range(1000), *range(5000, 5800)])
    assert written.count("duplicate-state") < 10


def test_no_uploads(spark):
    assert blocked(spark, [], []) == {} and blocked(spark, [], [4]) == {4: None}


def test_same_file(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None), (6, "a")], "id long, file_hash string")
    assert sorted(map(tuple, duplicates.same_file(rows).collect())) == [(3, 1), (6, 1)]
    assert duplicates.same_file(rows.where("false")).count() == 0


def files_below(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path):
    table = KeyTable(spark, str(tmp_path / "keys"), buckets=64)
    make = lambda rows: spark.createDataFrame(rows, KEYS)
    assert table.matching(make([(1, "email", "a")]), 0) is None
    for batch in range(3):
        table.put(make([(batch * 100 + i, "email", f"{batch}-{i}") for i in range(60)]), batch)
    before = files_below(table.path)
    asked = make([(900, "email", "1-7"), (901, "text", "1-7"), (902, "email", "2-3")])
    found = table.matching(asked, 2)
    assert sorted(map(tuple, found.collect())) == [(107, "email", "1-7")]
    read = set(found.inputFiles())
    assert read and len(read) <= 9 < len(before) / 5 and len({f.split("bucket=")[1].split("/")[0] for f in read}) <= 3
    # The same batch again replaces its rows; other files stay as they were.
    table.put(make([(200 + i, "email", f"2-{i}") for i in range(60)]), 2)
    after = files_below(table.path)
    assert {f for f in before if "batch=2" not in f} == {f for f in after if "batch=2" not in f} and all(after[f] == before[f] for f in before if "batch=2" not in f)
    assert table.compact(most=1) > 0
    everything = table.read(list(range(64))).select("id", "kind", "value").collect()
    assert sorted(r.id for r in everything) == sorted(b * 100 + i for b in range(3) for i in range(60))


def test_batches_through_the_key_table_are_the_replay(spark, tmp_path):
    """Accepted keys of earlier batches refuse later uploads as if all had come at once."""
    rng = random.Random(8)
    rows = [(i, kind, str(rng.randrange(40))) for i in range(90) for kind in ("email", "text") if rng.random() < 0.7]
    table, got = KeyTable(spark, str(tmp_path / "keys"), buckets=16), {}
    for batch in range(3):
        own = [r for r in rows if r[0] // 30 == batch]
        new, pool = spark.createDataFrame(own, KEYS), spark.createDataFrame(own, KEYS)
        ids = spark.createDataFrame([(i,) for i in range(batch * 30, batch * 30 + 30)], "id long")
        known = table.matching(new, batch)
        both = ids if known is None else ids.unionByName(known.select("id").distinct())
        pool = pool if known is None else pool.unionByName(known)
        decided = duplicates.block_duplicates(pool, both).where(F.col("id") >= batch * 30).collect()
        got |= {r.id: r.duplicate_of for r in decided}
        table.put(new.join(spark.createDataFrame([(r.id,) for r in decided if r.accepted], "id long"), "id", "left_semi"), batch)
    assert got == replay(rows, range(90))


PARTS = "k long, name string, size int"


def test_changes_touch_their_own_buckets(spark, tmp_path):
    first = [(i, f"n{i}", i) for i in range(200)]
    table = VersionedTable.create(spark.createDataFrame(first, PARTS), str(tmp_path / "t"), "k", buckets=32)
    before = files_below(table.path)
    table.upsert(spark.createDataFrame([(3, "three", None), (500, None, 9)], PARTS))
    table.delete(spark.createDataFrame([(7,), (999,)], "id long"))
    after = files_below(table.path)
    assert all(after[f] == before[f] for f in before) and len(after) <= len(before) + 4
    want = {i: (n, s) for i, n, s in first if i != 7} | {3: ("three", 3), 500: (None, 9)}
    state = lambda: {r.k: (r.name, r.size) for r in table.read().collect()}
    assert state() == want
    # A deleted key comes back without its former values.
    table.upsert(spark.createDataFrame([(7, None, 70)], PARTS).drop("name"))
    want[7] = (None, 70)
    assert state() == want
    found = table.lookup(spark.createDataFrame([(3,), (7,), (8,), (999,)], "id long"))
    assert {r.k: (r.name, r.size) for r in found.collect()} == {k: want[k] for k in (3, 7, 8)}
    assert len({f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}) <= 4
    merged = table.compact(most=1)
    assert merged and state() == want
    assert {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in merged} <= set(files_below(table.path))
    table.upsert(spark.createDataFrame([(7, "seven", None)], PARTS))
    want[7] = ("seven", 70)
    assert state() == want


def test_random_changes_are_upserts(spark, tmp_path):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, "a", 1) for i in range(30)], PARTS)
    table = VersionedTable.create(rows, str(tmp_path / "t"), "k", buckets=4)
    for step in range(4):
        keys = rng.sample(range(40), 12)
        change = spark.createDataFrame([(i, rng.choice([None, f"s{step}"]), rng.choice([None, step])) for i in keys], PARTS)
        table.upsert(change)
        rows = spark.createDataFrame(upsert(rows, change, "k").collect(), PARTS)
        if step == 2:
            table.compact(most=2)
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, rows.collect()))


def test_cascades_and_refusals(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string")
    results = spark.createDataFrame([(10, 1), (11, 2), (12, 1)], "id long, job long")
    notes = spark.createDataFrame([(100, 10), (101, 11)], "id long, result long")
    plain = cascade_delete({"jobs": jobs, "results": results, "notes": notes}, "jobs", jobs.where("id = 1").select("id"), {"jobs": [("results", "job")], "results": [("notes", "result")]})
    made = {n: VersionedTable.create(t, str(tmp_path / n), "id", 4) for n, t in (("jobs", jobs), ("results", results), ("notes", notes))}
    delete_cascading(made, "jobs", jobs.where("id = 1").select("id"), {"jobs": [("results", "job")], "results": [("notes", "result")]})
    for name, table in made.items():
        assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, plain[name].collect()))
    with pytest.raises(ValueError, match="layout"):
        VersionedTable.create(jobs.withColumn("version", F.lit(1)), str(tmp_path / "x"), "id")
    empty = VersionedTable.create(jobs.where("false"), str(tmp_path / "empty"), "id", 4)
    empty.upsert(jobs)
    assert empty.read().count() == 2


def test_new_rows_of_one_value_are_numbered_where_they_are(spark):
    """No task gets all equal rows: the plan has no shuffle or order of the new rows themselves."""
    rows = spark.createDataFrame([(7, "a")], "id long, name string")
    new = spark.range(0, 1000, numPartitions=6).where("id % 7 <> 0").select(F.lit("same").alias("name"))
    both = review.insert_numbered(rows, new)
    assert sorted(r.id for r in both.collect()) == list(range(7, 7 + both.count()))
    assert both.count() == 1 + new.count() and "row_number" not in both._jdf.queryExecution().optimizedPlan().toString()
    assert review.insert_numbered(rows, new.limit(0)).count() == 1
