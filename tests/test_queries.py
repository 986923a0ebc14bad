"""Every registered query of the search engine against its SQL in DuckDB, and the driver's contract."""

import duckdb
import pytest

from lakefind import queries as q
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, duck, name):
    got = q.queries()[name](spark, DATA)
    sql = q.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    want = duck.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    top = e.entry(spark).collect()
    assert top and [r["_score"] for r in top] == sorted((r["_score"] for r in top), reverse=True)
    assert set(q.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_stands_without_the_subpackage(tmp_path):
    """A copy without the language-model folders still imports and lists its queries."""
    import shutil
    import subprocess
    import sys

    from tests.conftest import ROOT

    shutil.copytree(ROOT / "lakefind", tmp_path / "lakefind", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "lakefind/llm/__pycache__").mkdir(parents=True)  # what a deleted folder may leave behind
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [str(len(q.queries())), str(len(q.oracle_sql()))]
