"""What the plans must look like: narrow scans, filters at the scan, no joins of everything with everything."""

import os
import re

import pytest
from pyspark.sql import functions as F

from keelson.plans.projections import Tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_projections_read_only_what_they_need(spark):
    t = Tables(spark, FOLDER)
    text = plan(t.handover)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert sorted(schemas) == ["l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_discount:double", "o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz"] or all("l_extendedprice" not in s and "o_totalprice" not in s for s in schemas)
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_filters_reach_the_scan(spark):
    t = Tables(spark, FOLDER)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_linestatus,O\)", plan(t["lineitem"].filter(F.col("l_linestatus") == "O").select("l_partkey")))


@pytest.mark.parametrize("name", ["org_nodes", "org_edges", "customers", "relocated", "affinities"])
def test_no_cross_joins(spark, name):
    text = plan(getattr(Tables(spark, FOLDER), name))
    assert "Cartesian" not in text and "NestedLoop" not in text and "Python" not in text and "Arrow" not in text
