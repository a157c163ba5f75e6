"""Registered queries against their SQL, and those without SQL against plain versions."""

import os
import re
import subprocess
import sys

import duckdb
import pytest

from dossiergrid.plans import catalog

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    return names, [tuple(r) for r in df.select(*names).collect()]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    names, got = rows_of(spark, name)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == names
    order = [want.columns.index(n) for n in names]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got, want = sorted(got, key=key), sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == pytest.approx(y, rel=1e-9) if isinstance(x, float) and y is not None else x == y for x, y in zip(a, b, strict=True)), (a, b)


def test_places_of_an_unknown_status(spark):
    """The list is the whole first page with its places, though the status selects nothing."""
    names, got = rows_of(spark, "results_unknown_status")
    assert names == ["fit_score", "id", "place"] and sorted(r[2] for r in got) == list(range(1, 21))


def test_phones(spark):
    pattern = re.compile(
        r"(?<!\d)(?:(?:\+?63|0)[- .]?9\d{2}(?:[- .]?\d){7}|(?:\+?63|0)[- .]?(?:9\d{2}|2)[- .]?\d{3}[- .]?\d{4}"
        r"|(?:\+?\d{1,3}[- .]?)?\(?\d{2,4}\)?[- .]?\d{3}[- .]?\d{4})(?!\d)",
        re.ASCII,
    )
    texts = {r.doc_id: r.text for r in catalog.table(spark, SF, "documents").collect()}
    for r in catalog.queries()["doc_phones"](spark, SF).collect():
        found = pattern.search(texts[r.doc_id])
        assert r.phone == (found[0] if found else "Unknown Phone") and r.digits == re.sub(r"\D", "", found[0] if found else "")


def test_greedy_blocking_is_the_replay(spark):
    texts = sorted((r.doc_id, r.text) for r in catalog.table(spark, SF, "documents").collect())
    emails = {r.doc_id: r.email for r in catalog.queries()["doc_contacts"](spark, SF).collect()}
    phones = {r.doc_id: r.digits for r in catalog.queries()["doc_phones"](spark, SF).collect()}
    accepted, refused = {}, {}
    for i, t in texts:
        keys = {("f", t), ("t", re.sub("[^a-z0-9]+", " ", t.lower()).strip())} - {("t", "")}
        keys |= {("e", emails[i])} if not emails[i].startswith("Unknown") else set()
        keys |= {("p", phones[i])} if phones[i] else set()
        hit = [a for a, k in accepted.items() if k & keys]
        if hit:
            refused[i] = min(hit)
        else:
            accepted[i] = keys
    got = {r.id: r.duplicate_of if not r.accepted else None for r in catalog.queries()["duplicate_block_greedy"](spark, SF).collect()}
    assert refused and got == {i: refused.get(i) for i, _ in texts}


def test_entry_works_without_the_training_data_package():
    """With that folder and the pipeline out of sight, the entry still imports and has the other queries."""
    code = (
        "import sys, importlib.abc\n"
        "class Hide(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.startswith('dossiergrid.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Hide())\n"
        "import __spark_entry__ as e\n"
        "assert e._llm() is None and len(e.queries()) > 30 and set(e.oracle_sql()) <= set(e.queries())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env=os.environ | {"PYTHONPATH": root})
