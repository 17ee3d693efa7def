"""Registered queries against their SQL, on the smallest tables."""

import importlib
import os
import sys

import duckdb
import pytest

from emend.plans import catalog, catalog_files  # noqa: F401  both register queries

SF = os.environ.get("EMEND_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        want = oracle.sql(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got)


def test_entry_runs_without_the_operators(spark, monkeypatch):
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("emend.llm")]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("corpus_pipeline", "emend.llm", "emend.llm.queries"):
        monkeypatch.setitem(sys.modules, name, None)  # importing it is an ImportError
    monkeypatch.delattr(sys.modules["emend"], "llm", raising=False)
    entry = importlib.reload(entry)
    assert entry.llm_queries is None and entry.corpus_pipeline is None
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) == set(entry.queries()) and set(entry.oracle_sql()) == set(catalog.ORACLE_SQL)
    monkeypatch.undo()
    importlib.reload(entry)
