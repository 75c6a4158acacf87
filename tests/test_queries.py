"""Every registered query with an oracle against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from keyloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}")
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=str)
    assert name not in registry.ORACLES or sorted((rel := con.sql(registry.ORACLES[name])).columns) == cols
    if name in registry.ORACLES:
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted(([plain(r[k]) for k in at] for r in rel.fetchall()), key=str)
