"""Every registered query against its SQL on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from assocgraph.plans import batch, core, files, joins, more  # noqa: E402,F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return f"{x:.4f}" if isinstance(x, float) else str(x)


def same(spark_df, relation):
    columns = sorted(spark_df.columns)
    assert columns == sorted(relation.columns)
    got = sorted(tuple(str(plain(r[c])) for c in columns) for r in spark_df.collect())
    at = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(str(plain(r[i])) for i in at) for r in relation.fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, db, name):
    same(core.QUERIES[name](spark, SF), db.sql(core.ORACLES[name]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).columns == ["pick_rank", "item", "score", "cost"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
