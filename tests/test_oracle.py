"""Queries of the reference's own operators against SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import lodestone.plans  # noqa: F401
from lodestone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
    return str([norm(x) for x in v]) if isinstance(v, list | tuple) else str(v)


def test_multi_objective_weights_to_the_last_digit(spark):
    at = "/root/testdata/sf0.01"
    if not os.path.isdir(at):
        pytest.skip("no tables here")
    with duckdb.connect() as c:
        c.execute(f"create view orders as select * from '{at}/orders.parquet'")
        want = sorted(c.sql(registry.ORACLE["gra15_multi_objective"]).fetchall())
    assert sorted(tuple(r) for r in registry.QUERIES["gra15_multi_objective"](spark, at).collect()) == want


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, con, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    df = registry.QUERIES[name](spark, SF)
    rel = con.sql(registry.ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    assert sorted(tuple(norm(r[c]) for c in names) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
