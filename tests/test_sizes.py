"""Sizes of tables as the planner takes them."""

from graphlake.plans import model
from graphlake.scratch import Scratch


def test_rows_that_compress_well_are_not_broadcast(spark):
    rows = spark.range(300_000).selectExpr("id as key", "concat('http://shop-', lpad(id % 400, 5, '0'), '-api.ns.svc.cluster.local:8080/orders') as text")
    model.Tables(spark, "")
    small = Scratch(spark, "sizes").keep(rows, "rows")
    plan = spark.range(10).selectExpr("id as key").join(small, "key", "left")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan


def test_small_tables_still_are(spark):
    model.Tables(spark, "")
    small = Scratch(spark, "sizes").keep(spark.range(10).selectExpr("id as key"), "rows")
    plan = spark.range(10_000_000).selectExpr("id as key").join(small, "key")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def test_a_factor_that_the_session_sets_stays(spark):
    factor = "spark.sql.sources.fileCompressionFactor"
    before = spark.conf.get(factor)
    spark.conf.set(factor, "3.0")
    try:
        model.Tables(spark, "")
        assert spark.conf.get(factor) == "3.0"
    finally:
        spark.conf.set(factor, before)
