"""Components without broadcasts."""

from pyspark.sql import functions as F

from siltstone.operators import graph as G


def test_components_broadcast_nothing(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "source long, target long").withColumn("type", F.lit("imports"))
    out = G.strong_components(edges)
    assert sorted(tuple(r) for r in out.collect()) == [(0, 0, 3), (1, 0, 3), (2, 0, 3)]
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
