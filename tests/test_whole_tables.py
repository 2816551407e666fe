"""Queries over whole tables: their operators' own results, for every row."""

import os

import pytest

from graphlake.operators import graph
from graphlake.plans import more_queries  # noqa: F401
from graphlake.plans.queries import QUERIES

FOLDER = os.environ.get("GRAPHLAKE_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.mark.parametrize("name", ["mounted_paths", "mounted_paths_whole"])
def test_mounts_decide_the_paths(spark, monkeypatch, name):
    """A chain cut short in the operator shows in the result."""
    whole = graph.prefix_chain
    monkeypatch.setattr(graph, "prefix_chain", lambda mounts, starts: whole(mounts.where("node >= 0"), starts))
    paths = [r.path for r in QUERIES[name](spark, FOLDER).collect()]
    assert paths and all(p.startswith("/m3/p") for p in paths)


def test_all_parts_are_mounted(spark):
    parts = {r[0] for r in spark.read.parquet(f"{FOLDER}/part.parquet").select("p_partkey").collect()}
    assert {r.node for r in QUERIES["mounted_paths_whole"](spark, FOLDER).collect()} == parts


@pytest.mark.parametrize("name, column, key", [("name_closure_whole", "deployable", "c_custkey"), ("identity_match_whole", "deployable", "c_custkey")])
def test_all_customers_are_deployables(spark, name, column, key):
    want = {r[0] for r in spark.read.parquet(f"{FOLDER}/customer.parquet").select(key).collect()}
    assert {r[column] for r in QUERIES[name](spark, FOLDER).collect()} == want


def test_orphans_of_all_flows(spark):
    used = spark.read.parquet(f"{FOLDER}/lineitem.parquet").where("l_returnflag = 'N'")
    orphans = QUERIES["orphans_whole"](spark, FOLDER)
    assert orphans.join(used, orphans["id"] == used["l_partkey"], "left_semi").count() == 0
