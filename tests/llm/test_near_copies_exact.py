"""No link at 0.8 or more is lost, measured on thousands of pairs around that similarity."""

import random

import numpy as np

from siltstone.llm.simhash import near_copies, parity, prefix_of, shingle_set, similar
from tests.llm.test_near_copies import plain


def test_pairs_at_the_threshold(spark):
    rng = random.Random(5)
    rows, want, close = [], {}, 0
    for i in range(3000):
        n = rng.randrange(60, 400)
        words = [f"w{rng.randrange(1_000_000)}" for _ in range(n)]
        other = list(words)
        for _ in range(max(1, round(n / 45)) + rng.choice([-1, 0, 0, 1])):
            other[rng.randrange(n)] = f"v{rng.randrange(1_000_000)}"
        x, y = shingle_set(" ".join(words), 5), shingle_set(" ".join(other), 5)
        linked = similar(x.tobytes(), y.tobytes(), 0.8)
        close += linked and not similar(x.tobytes(), y.tobytes(), 0.85)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i + (not linked)}
    assert close > 1000
    got = {r.doc_id: r.component for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_rest_alone_finds_all_links_with_hot_shingles(spark):
    """Blocks that find nothing (no bands) and shingles that many texts share: exact prefixes find every link."""
    rng = random.Random(8)
    passage = [f"common{i}" for i in range(40)]
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(50_000)}" for _ in range(rng.randrange(30, 90))] + passage
        for _ in range(rng.randrange(1, 4)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 3])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50_000)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(500, " ".join(passage)), (501, " ".join(passage[:-1])), (502, None), (503, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, comp int")
    want = plain(rows)
    for hot, tile in ((1024, 2048), (5, 2048), (5, 7)):
        got = sorted((r.doc_id, r.component) for r in near_copies(df, radius=0, bands=1, rows=40, hot=hot, tile=tile).collect())
        assert got == want


def test_filters_lose_nothing():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.7, 1)], rng.integers(0, 1 << 63, rng.integers(0, 40), dtype=np.uint64)]))
        hot = np.sort(rng.permutation(a)[: len(a) // 3])
        assert np.bitwise_count(parity(a) ^ parity(b)).sum() <= len(np.setxor1d(a, b))
        if len(b) and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            for last in (None, hot):
                x, y = prefix_of(a, 0.8, last), prefix_of(b, 0.8, last)
                same = np.ceil(0.8 / 1.8 * (len(a) + len(b)) - 1e-9)
                assert len(np.intersect1d(x, y)) >= max(1, min(len(x) - len(a), len(y) - len(b)) + same)
