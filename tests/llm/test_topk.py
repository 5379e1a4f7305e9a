"""Top-k by Hamming distance against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm.topk import SegmentIndex, sign_code, top_k


def plain(rows, queries, k):
    rows, out = sorted({r for r in rows if None not in r}), []
    for q, c in sorted({r for r in queries if None not in r}):
        near = sorted((((c ^ d) & (2**64 - 1)).bit_count(), i) for i, d in rows if i != q)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def data(n=600, seed=0):
    rng = random.Random(seed)
    centers = [rng.getrandbits(64) for _ in range(9)]
    rows = [(i, signed(rng.choice(centers) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 12))))) for i in range(n)]
    return rows + [(n + i, signed(centers[0])) for i in range(150)] + [(7, rows[7][1]), (None, 5), (9999, None)]


def test_segment_index_is_exact():
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
    index = SegmentIndex(codes)
    for q in [int(codes[3]), 0, 2**63 - 1]:
        for need in (1, 5, 40, 10_000):
            d = np.bitwise_count(codes ^ np.uint64(q))
            at, dist = index.search(q, np.ones(len(codes), np.int64), need)
            last = np.sort(d)[min(need, len(d)) - 1]
            assert sorted(at.tolist()) == np.flatnonzero(d <= (last if need <= len(d) else 64)).tolist()
            assert (d[at] == dist).all()


def test_against_brute_force(spark):
    rows = data()
    df = spark.createDataFrame(rows, "vec_id long, code long")
    queries = df.where("vec_id % 50 = 0")
    want = plain(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0], 10)
    for block, least in ((1 << 18, 4096), (100, 10)):
        got = sorted((r.query_id, r["rank"], r.neighbor_id, r.distance) for r in top_k(df, queries, 10, block=block, least=least).collect())
        assert got == want


def test_blocks_are_tasks_and_columns_may_clash(spark):
    df = spark.createDataFrame(data(), "vec_id long, code long").selectExpr("*", "1 as b", "'x' as kind", "vec_id as query_id", "2 as ids")
    out = top_k(df, df.where("vec_id % 50 = 0"), 3, block=100)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()  # adaptive execution leaves these apart
    assert out.count() == 3 * len({r[0] for r in data() if r[0] is not None and r[0] % 50 == 0})


def test_few_rows_and_codes(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0]), (1, None), (2, [float("nan"), 2.0]), (3, [1.0] * 64)], "vec_id long, v array<float>").select("vec_id", sign_code(F.col("v")).alias("code"))
    assert {r.vec_id: r.code for r in df.collect()} == {0: 1, 1: 0, 2: 2, 3: -1}
    assert top_k(df, df.where("vec_id = 0"), 10).count() == 3
    assert top_k(df.limit(0), df.limit(0), 10).count() == 0
