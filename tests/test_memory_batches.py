"""What a task holds of a table of long texts."""

import pyarrow as pa

from siltstone.checkpoints import written


def test_batches_for_python_are_bounded_while_a_table_is_written(spark):
    def rows(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64())], names=["n"])

    texts = spark.range(20_000).selectExpr("repeat('x', 2000) as t").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = [r.n for r in written(texts.mapInArrow(rows, "n long"), "batches").collect()]
    assert sum(got) == 20_000 and max(got) * 2000 <= 9 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
