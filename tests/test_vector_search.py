"""Exact vector search by cells and bounds on angles."""

import numpy as np
import pytest

from siltstone.operators.vectors import neighbours, searched

SHAPE = "id long, v array<double>"


def plain(rows, asked, k, least, digits=6):
    out = []
    for n, q in asked:
        scored = []
        for i, v in rows:
            if i == n or len(v) != len(q):
                continue
            a, b = (np.array(x) / (np.linalg.norm(x) or 1) for x in (q, v))
            s = round(float(np.clip(a @ b, -1, 1)), digits)
            if s >= least:
                scored.append((-s, i))
        out += [(n, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def clustered(rng, n, dim, groups, spread):
    at = rng.normal(size=(groups, dim))
    return [(i, (at[min(int(rng.exponential(2)), groups - 1)] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("spread", "k", "least", "centres"), [(0.05, 5, 0.25, 16), (0.05, 3, -1.0, 4), (1.0, 7, 0.0, 32), (0.0, 4, 0.1, 8)])
def test_equal_to_all_products(spark, spread, k, least, centres):
    rows = clustered(np.random.default_rng(7), 400, 8, 12, spread)
    rows += [(900, [0.0] * 8), (901, [1.0, 2.0]), (902, [2.0, 4.1]), (903, rows[0][1]), (904, rows[0][1])]
    df = spark.createDataFrame(rows, SHAPE)
    asked = [r for r in rows if r[0] % 10 == 0 or r[0] >= 900]
    got = neighbours(df, spark.createDataFrame(asked, SHAPE), k, least, centres=centres, block=64, batch=16)
    assert sorted((r.query, r.id, r.score, r["rank"]) for r in got.collect()) == plain(rows, asked, k, least)


def test_most_products_are_skipped(spark):
    rows = clustered(np.random.default_rng(3), 2000, 16, 40, 0.02)
    df = spark.createDataFrame(rows, SHAPE)
    _, work = searched(df, df.where("id % 100 = 0"), 5, 0.25, centres=128)
    w = work.first()
    assert w["of"] == 2000 * 20 and w["products"] < 0.6 * w["of"]


def test_nulls_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, []), (6, [1.0, 0.1]), (7, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, SHAPE)
    assert [(r.query, r.id) for r in neighbours(df, df, 3, 0.0).orderBy("query").collect()] == [(1, 6), (6, 1)]
    none = df.limit(0)
    assert neighbours(df, none, 3, 0.0).count() == 0 and neighbours(none, df, 3, 0.0).count() == 0
    assert searched(none, none, 3, 0.0)[1].first()["of"] == 0
    assert [(r.query, r.id) for r in neighbours(df, df, 3, 0.0, exclude=spark.createDataFrame([(6,)], "id long")).collect()] == [(6, 1)]
