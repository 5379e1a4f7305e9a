"""Vectors are dealt by their number, so that a task's share does not grow with the graph."""

from siltstone.operators import graph as G


def test_partitions_follow_the_rows(spark):
    nodes = spark.range(300).selectExpr("id")
    edges = spark.range(300).selectExpr("id as source", "(id + 1) % 300 as target", "'imports' as type")
    vectors = nodes.selectExpr("id", "array(1.0D, 2.0D) as v")
    plan = G.propagate(edges, nodes, vectors, 2, hops=1, rows=10)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 90)" in plan
