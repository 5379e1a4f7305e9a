"""Queries whose job had become smaller."""

from siltstone.plans import catalog


def test_o6_asks_for_every_fiftieth_row(spark):
    asked = {r.query for r in catalog.QUERIES["o6_neighbours"](spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert asked == {r.vec_id for r in rows.where("vec_id % 50 = 0").collect()}


def test_base_classes_do_not_meet_in_pairs(spark):
    from time import monotonic

    from siltstone.operators.graph import base_class_edges

    n = 60_000  # of one name: 1.8 billion pairs
    one = spark.range(n).selectExpr("concat('s', id) as id", "'a.py' as file_path", "id as ord", "'A' as name", "array('A') as bases")
    began = monotonic()
    edges = base_class_edges(one)
    assert edges.count() == n - 1 and edges.where("cast(substr(source, 2) as int) <> cast(substr(target, 2) as int) + 1").count() == 0
    assert monotonic() - began < 40


def test_base_classes_against_all_pairs(spark):
    import random

    from siltstone.operators.graph import base_class_edges

    rng = random.Random(4)
    rows = [(f"s{i}", rng.choice("ab"), rng.randrange(40), rng.choice("XYZ"), rng.sample("XYZ", rng.randrange(3))) for i in range(60)]
    rows = list({(r[1], r[2], r[3]): r for r in rows}.values())
    want = sorted((i, max((o, j) for j, g, o, m, _ in rows if g == f and m == b and o < at)[1]) for i, f, at, _, bases in rows for b in bases if any(g == f and m == b and o < at for _, g, o, m, _ in rows))
    got = base_class_edges(spark.createDataFrame(rows, "id string, file_path string, ord int, name string, bases array<string>"))
    assert sorted(map(tuple, got.collect())) == want


def test_chunks_broadcast_no_files(spark):
    df = catalog.QUERIES["r1_chunks"](spark, "/root/testdata/sf0.001")
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_files_are_dealt_to_all_cores(spark):
    from siltstone.plans.code import PYTHON, _files

    assert _files(spark, "/root/testdata/sf0.001", PYTHON, ".py").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_patches_are_read_without_windows(spark):
    from siltstone.operators.review import hinted_lines
    from siltstone.operators.text import changed_lines

    one = "+x\n a\n@@ -1,2 +5,3 @@ def\n+b\n+++ c\n\n-d\n+e\n@@ odd\n+f\n@@ -9 +5 @@\n+again"
    df = spark.createDataFrame([(1, one), (2, None), (3, ""), (1, "@@ -1 +8 @@\n+z")], "k long, p string")
    assert sorted(map(tuple, changed_lines(df, "k", "p").collect())) == [(1, 0), (1, 5), (1, 7), (1, 8)]
    assert sorted(map(tuple, hinted_lines(df, "k", "p").collect())) == [(1, 1, "x"), (1, 6, "again"), (1, 6, "b"), (1, 6, "f"), (1, 7, "e"), (1, 9, "z")]
    for op in (changed_lines, hinted_lines):
        assert "Window" not in op(df, "k", "p")._jdf.queryExecution().executedPlan().toString()
