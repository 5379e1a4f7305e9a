"""The prefix-tree join against all pairs, and against DuckDB."""

import os
import random

import duckdb
import numpy as np
import pytest

from siltstone.llm.ngram_join import COUNTERS, gram_set, may_link, ngram_groups, rare_part, tile_links
from siltstone.llm.queries import ORACLES, QUERIES


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain(rows, size=4, percent=85):
    sets = [(d, shingles(t, size)) for d, t in rows]
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(d), root(e)))
                up[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets)


def rows(seed=2):
    rng = random.Random(seed)
    passage = [f"common{i}" for i in range(30)]
    out = []
    for g in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((3, 8, 40, 120, 300)))] + passage * rng.choice((0, 0, 1, 3))
        for _ in range(rng.choice((1, 2, 3, 12))):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(90_000)}"
            out.append((len(out) + 10, rng.choice((" ", "\n")).join(w)))
    out += [(1, " ".join(passage)), (2, " ".join(passage[:-1])), (3, " ".join(passage[:-3]).upper()), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "One\ntwo"), (9, "one two three four")]
    return out + [(2000, "w1 w2 w3 w4 " * 5000), (2001, "w1 w2 w3 w4 " * 5001), (2002, " ".join(f"l{i}" for i in range(20_000))), (2003, " ".join(f"l{i}" for i in range(18_000)))]


def test_against_all_pairs(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in data], "doc_id long, text string, node string, n int, component int, id int")
    want = plain(data)
    assert len({c for _, _, c in want}) < len(data) - 60
    for tile in (1 << 20, 900):
        assert sorted(tuple(r) for r in ngram_groups(df, tile_members=tile).collect()) == want
    assert sorted(tuple(r) for r in ngram_groups(df, shingle=2, percent=60).collect()) == plain(data, 2, 60)


def test_threshold_is_exact(spark):
    """Texts of n different words: one replaced in the middle leaves n - 7 of n - 3 shingles, so n = 52 is 45 of 53 (under 85 %), n = 56 is 49 of 57 (over)."""
    data = []
    for k, n in enumerate(range(44, 70)):
        words = [f"t{k}_{i}" for i in range(n)]
        data += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: n // 2] + ["z"] + words[n // 2 + 1 :]))]
    got = sorted(tuple(r) for r in ngram_groups(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == plain(data) and len({c for _, _, c in got}) not in (26, 52)


def test_trees_find_every_link():
    rng = np.random.default_rng(7)
    for trial in range(60):
        base = [np.unique(rng.integers(0, 400, rng.integers(1, 120), dtype=np.uint64)) for _ in range(4)]
        sets = [np.unique(np.r_[b[rng.random(len(b)) < rng.uniform(0.85, 1)], rng.integers(0, 900, rng.integers(0, 6), dtype=np.uint64)]) for b in base for _ in range(rng.integers(1, 15))]
        side = rng.integers(0, 2, len(sets)).astype(np.int8) if trial % 2 else np.full(len(sets), 2, np.int8)
        group = rng.integers(0, len(sets) * 2, len(sets))
        percent = int(rng.choice((50, 85, 100)))

        def parts(edges):
            up = list(range(len(sets)))

            def root(x):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in edges:
                up[root(a)] = root(b)
            return [min(j for j in range(len(sets)) if root(j) == root(i)) for i in range(len(sets))]

        same = [(i, j) for i in range(len(sets)) for j in range(i) if group[i] == group[j]]
        links = [(i, j) for i in range(len(sets)) for j in range(i) if (side[i] == 2 or side[i] != side[j]) and len(sets[i]) and len(sets[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]
        i, j = tile_links(sets, group, side, percent)
        got = list(zip(i.tolist(), j.tolist()))
        assert all((max(e), min(e)) in links for e in got) and parts(got + same) == parts(links + same)


def test_rare_parts_meet():
    rng = np.random.default_rng(1)
    counters = rng.integers(0, 50, COUNTERS)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 200), dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 63, rng.integers(0, 9), dtype=np.uint64)])
        if len(b) and 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
            assert len(np.intersect1d(rare_part(a, counters, 85), rare_part(b, counters, 85)))
    assert len(gram_set(b"a b c d", 4)) == 1 and len(gram_set(b"a b c", 4)) == 1 and gram_set(b"a b c", 4) != gram_set(b"a b c d", 4)


def test_null_repeated_and_empty(spark):
    words = " ".join(f"w{i}" for i in range(80))
    data = [(None, words), (5, words), (5, words + " more"), (5, "an other text of five"), (9, "an other text of five"), (None, "alone at last and well"), (3, "nothing of the others here")]
    got = sorted((tuple(r) for r in ngram_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 77, 5), (5, 77, 5), (5, 78, 5), (5, 2, 5), (9, 2, 5), (None, 2, None), (3, 2, 3)], key=str)
    assert ngram_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    other = " ".join(f"v{i}" for i in range(200))
    twice = [(1, words), (1, other), (7, words + " more"), (8, other + " more"), (9, "more")]
    got = sorted(tuple(r) for r in ngram_groups(spark.createDataFrame(twice, "doc_id long, text string")).collect())
    assert got == [(1, 77, 1), (1, 197, 1), (7, 78, 1), (8, 198, 1), (9, 1, 9)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no data")
def test_against_duckdb(spark):
    c = duckdb.connect()
    c.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(c.execute(f"select doc_id, n_shingles, component_id from ({ORACLES['op13_ngram_join']})").fetchall())
    assert sorted(tuple(r) for r in QUERIES["op13_ngram_join"](spark, "/root/testdata/sf0.001").collect()) == want


def test_sets_that_link_are_promising():
    rng = np.random.default_rng(3)
    for _ in range(150):
        base = np.unique(rng.integers(0, 1 << 40, rng.integers(1, 150), dtype=np.uint64))
        sets = [np.unique(np.r_[base[rng.random(len(base)) < rng.uniform(0.85, 1)], rng.integers(0, 1 << 40, rng.integers(0, 12), dtype=np.uint64)]) for _ in range(6)]
        sets = [x for x in sets if len(x)]
        counters = rng.integers(0, 9, COUNTERS)
        rare = [rare_part(x, counters, 85) for x in sets]
        s = np.array([sum(any(m in r for j, r in enumerate(rare) if j != i) for m in own) for i, own in enumerate(rare)])
        ok = may_link(np.array([len(x) for x in sets]), s, np.arange(len(sets)), np.full(len(sets), 2), 85)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if i != j and 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)):
                    assert ok[i] and ok[j]
