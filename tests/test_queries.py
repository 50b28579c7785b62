"""Every registered query runs, and gives what its SQL gives."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from corpusmill.plans import core


def value(x):
    if x is None or isinstance(x, float) and x != x:
        return None
    if isinstance(x, float):
        return int(x) if x == int(x) else round(x, 6)
    return str(x) if not isinstance(x, (bool, int, str)) else x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=str)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core.sql))
def test_sql(spark, data, duck, name):
    got = core.queries[name](spark, data)
    want = duck.execute(core.sql[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.queries) - set(core.sql)))
def test_runs(spark, data, name):
    assert core.queries[name](spark, data).count() >= 0


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_without_llm():
    for f in Path(entry.__file__).parent.glob("corpusmill/**/*.py"):
        if "llm" not in f.parts:
            assert "corpusmill.llm" not in f.read_text(), f
    assert importlib.util.find_spec("corpusmill") is not None
