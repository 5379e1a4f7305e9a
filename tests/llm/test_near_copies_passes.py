"""The steps of near copies whose disk must not grow with the number of blocks that a text is in, or with all shared members at once."""

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F

from siltstone.llm.simhash import candidates, parity, shingle_set, simhash_of_set, tile_linker


def test_blocks_get_no_sets_and_give_a_forest():
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:150]), " ".join([*words[:150], "x"]), " ".join([*words[:150], "x", "y"]), " ".join(reversed(words))]
    sets = [shingle_set(t, 5) for t in texts]
    rows = pa.RecordBatch.from_arrays(
        [pa.array([10, 11, 12, 13]), pa.array([simhash_of_set(s) for s in sets], pa.int64()), pa.array([1] * 4), pa.array([2] * 4, pa.int8()), pa.array([len(s) for s in sets]), pa.array([parity(s).view(np.int64) for s in sets], pa.list_(pa.int64()))],
        names=["node", "fp", "tile", "side", "size", "bits"],
    )
    (found,) = tile_linker(20, 0.8)(iter([rows]))
    assert found.num_rows == 2 and {*found["u"].to_pylist(), *found["v"].to_pylist()} == {10, 11, 12}


def test_passes_change_nothing(spark):
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64)) for _ in range(12)]
    sets = [np.unique(np.r_[b[k:], rng.integers(0, 1 << 62, k, dtype=np.uint64)]) for b in base for k in range(3)]
    reps = spark.createDataFrame([(i, len(s), [int(x) for x in parity(s).view(np.int64)]) for i, s in enumerate(sets)], "node long, size long, bits array<long>")
    shared = spark.createDataFrame([(i, i, int(x)) for i, s in enumerate(sets) for x in s], "node long, comp long, bucket long").withColumn("often", F.lit(False))
    got = [sorted(tuple(r) for r in candidates(shared, reps, 0.8, 2048, n).collect()) for n in (1_000_000, 300)]
    assert got[0] == got[1] and len(got[0]) == 36
