import os

import duckdb
import pytest

from keelson.plans import every as catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 4) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got, rel = catalogue.queries()[name](spark, FOLDER), db.sql(catalogue.oracle_sql()[name])
    order = sorted(got.columns)
    assert sorted(rel.columns) == order
    at = [rel.columns.index(c) for c in order]
    assert sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() >= 0
