"""Point lookups read one row group of many."""

from pyspark.sql import functions as F

from siltstone.sources.keyed import lookup, lookup_all, write_keyed


def rows_read(df):
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_lookup_decodes_little(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.repeat(F.sha2((F.col("id") + 1).cast("string"), 512), 2).alias("v"))
    write_keyed(df, path, "id", files=2, group_bytes=1 << 20, distinct=4096)
    wanted = df.where("v is not null").limit(3).collect()
    for row in wanted:
        found = lookup(spark, path, "id", row.id)
        assert [tuple(r) for r in found.collect()] == [tuple(row)]
        assert 0 < rows_read(found) < 10_000
    absent = lookup(spark, path, "id", "0" * 63 + "x", None)
    assert absent.collect() == [] and rows_read(absent) < 10_000
    assert lookup(spark, path, "id", None).collect() == []
    assert lookup_all(spark, path, "id", spark.createDataFrame([(w.id,) for w in wanted * 2] + [(None,)], "id string")).count() == 3


def test_empty_and_nulls(spark, tmp_path):
    path = str(tmp_path / "e")
    write_keyed(spark.createDataFrame([], "k long, v string"), path, "k")
    assert lookup(spark, path, "k", 1).count() == 0
    write_keyed(spark.createDataFrame([(None, "a"), (1, "b"), (1, "c")], "k long, v string"), path, "k", files=1)
    assert sorted(r.v for r in lookup(spark, path, "k", 1, None).collect()) == ["b", "c"]
