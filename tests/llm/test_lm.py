"""Pitman-Yor model: seating draws, normalisation, agreement with a plain sampler, groups, held-out quality."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm.lm import Settings, numbers_of, pack, score_documents, seat, stirling, unpack


def corpus(n=160, seed=5):
    rng = random.Random(seed)
    tongues = [[f"{p}{i}" for i in range(120)] for p in ("ka", "lo", "mi")]

    def text():
        words = rng.choice(tongues)
        return " ".join(words[min(int(rng.expovariate(0.05)), 119)] for _ in range(rng.randrange(5, 120)))

    return [(i, text()) for i in range(n)]


def test_stirling_and_seating():
    d, c = 0.4, 6

    def ways(customers, sizes):  # sum over seatings by direct enumeration
        if not customers:
            return Counter({len(sizes): 1.0})
        out = Counter()
        for k in range(len(sizes)):
            for t, w in ways(customers - 1, [*sizes[:k], sizes[k] + 1, *sizes[k + 1 :]]).items():
                out[t] += w * (sizes[k] - d)
        for t, w in ways(customers - 1, [*sizes, 1]).items():
            out[t] += w
        return out

    want = ways(c, [])
    got = np.exp(stirling(d, 64)[c])
    assert all(math.isclose(got[t], want[t], rel_tol=1e-9) for t in range(1, c + 1))
    p = np.array([want[t] * 0.3**t * np.prod([2.0 + d * i for i in range(t)]) for t in range(1, c + 1)])
    keys = np.random.default_rng(1).integers(0, 1 << 64, 40_000, np.uint64)
    draws = seat(np.full(40_000, c), np.full(40_000, 2.0), np.full(40_000, 0.3), d, keys)
    above = seat(np.full(40_000, c), np.full(40_000, 2.0), np.zeros(40_000), d, keys, (0.5, np.full(40_000, 4.0), 0.65))
    q = np.array([want[t] * np.prod([(2.0 + d * i) * (0.5 if i == 0 else i - 0.65 + 0.5) / (4.0 + i) for i in range(t)]) for t in range(1, c + 1)])
    assert np.abs(np.bincount(above, minlength=c + 1)[1:] / 40_000 - q / q.sum()).max() < 0.01
    assert np.abs(np.bincount(draws, minlength=c + 1)[1:] / 40_000 - p / p.sum()).max() < 0.01
    many = seat(np.array([1, 5000, 700]), np.full(3, 1.0), np.full(3, 0.5), d, keys[:3])
    assert many[0] == 1 and 1 <= many[1] <= 5000 and 1 <= many[2] <= 700
    whole = seat(np.full(200, 2048), np.full(200, 5.0), np.full(200, 0.1), d, keys[:200])
    more = seat(np.full(200, 2049), np.full(200, 5.0), np.full(200, 0.1), d, keys[:200])
    assert abs(whole.mean() - more.mean()) < 1  # no jump where the predictive rule takes over


def test_arrays_round_trip():
    rng = np.random.default_rng(3)
    x = {"a": rng.integers(0, 300, 9), "b": numbers_of([b"x", b"", b" "]), "c": np.zeros(0, np.int64), "d": rng.random(4).astype(np.float32), "e": np.array([2**40])}
    back = unpack(pack(**x))
    assert all((back[k] == v).all() and len(back[k]) == len(v) for k, v in x.items())


class Plain:
    """One customer at a time leaves and sits down again; tables are lists of sizes."""

    def __init__(self, texts, s, seed):
        self.s, self.rng = s, random.Random(seed)
        self.tables, self.root = defaultdict(lambda: defaultdict(list)), defaultdict(list)
        self.tokens = [(u, w) for t in texts for u, w in zip([" ", *t], [*t, ""])]
        self.vocabulary = len({w for _, w in self.tokens})
        for u, w in self.tokens:
            self.add(u, w)

    def root_p(self, w):
        s, n, t = self.s, sum(map(sum, self.root.values())), sum(map(len, self.root.values()))
        mine = self.root.get(w, [])
        return (sum(mine) - s.root_discount * len(mine) + (s.root_strength + s.root_discount * t) / (self.vocabulary + 1)) / (s.root_strength + n)

    def p(self, u, w):
        s, of = self.s, self.tables.get(u, {})
        n, t = sum(map(sum, of.values())), sum(map(len, of.values()))
        mine = of.get(w, [])
        return (sum(mine) - s.discount * len(mine) + (s.strength + s.discount * t) * self.root_p(w)) / (s.strength + n)

    def sit(self, tables, d, new):
        at = self.rng.choices(range(len(tables) + 1), [*(k - d for k in tables), new])[0]
        if at == len(tables):
            tables.append(1)
            return True
        tables[at] += 1
        return False

    def add(self, u, w):
        s, of = self.s, self.tables[u]
        t = sum(map(len, of.values()))
        if self.sit(of[w], s.discount, (s.strength + s.discount * t) * self.root_p(w)):
            roots = sum(map(len, self.root.values()))
            self.sit(self.root[w], s.root_discount, (s.root_strength + s.root_discount * roots) / (self.vocabulary + 1))

    def leave(self, tables):
        at = self.rng.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        if not tables[at]:
            tables.pop(at)
            return True
        return False

    def sweep(self):
        for u, w in self.tokens:
            if self.leave(self.tables[u][w]):
                self.leave(self.root[w])
            self.add(u, w)


def test_agrees_with_a_plain_sampler(spark):
    rng = random.Random(2)
    texts = [[rng.choice("abcdefgh")[0] * (1 + (rng.random() < 0.3)) for _ in range(rng.randrange(3, 25))] for _ in range(45)]
    learn, ask = texts[:35], [*texts[35:], ["never"], ["a", "b", "a", "b"], []]
    s = Settings(burn_in=6, samples=24)
    plain = Plain(learn, s, 1)
    total = defaultdict(float)
    for k in range(150):
        plain.sweep()
        if k >= 30:
            for u, w in {x for t in ask for x in zip([" ", *t], [*t, ""])}:
                total[u, w] += plain.p(u, w) / 120
    want = [sum(math.log10(total[u, w]) for u, w in zip([" ", *t], [*t, ""])) for t in ask]
    rows = [(i, " ".join(t)) for i, t in enumerate([*learn, *ask])]
    got = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 35, settings=s).collect()}
    for i, x in enumerate(want):
        assert math.isclose(got[35 + i], x, rel_tol=0.02), (i, got[35 + i], x)


def test_predictions_sum_to_one(spark):
    rows = [(i, t) for i, t in corpus(40)]
    words = sorted({w for _, t in rows for w in t.split()})
    df = spark.createDataFrame(rows + [(1000 + i, w) for i, w in enumerate(words)] + [(2000, "ka1"), (2001, "unseen"), (2002, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_documents(df, F.col("doc_id") < 1000).collect()}
    ask = spark.createDataFrame(rows + [(1000 + i, f"{w} unseen") for i, w in enumerate(words)] + [(2001, "unseen unseen")], "doc_id long, text string")
    more = {r.doc_id: r.score for r in score_documents(ask, F.col("doc_id") < 1000).collect()}
    after = more[2001] - got[2001]  # an unknown word after an unknown word
    # p(w at the start) p(end | w), p(w at the start) p(unseen | w) p(end | unseen): both known for every w
    first = {}
    for i, w in enumerate(words):
        stop, go = 10 ** got[1000 + i], 10 ** more[1000 + i]
        first[w] = (stop, go)
    assert after < 0 and sum(x for x, _ in first.values()) < 1
    end_after_unseen = 10 ** got[2001]
    assert 0 < end_after_unseen < 1 and all(0 < g < 1 for _, g in first.values())


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(8)
    rows = [(i, " ".join(f"{'kalomi'[2 * (k % 3):][:2]}{k}" for k in (min(int(rng.expovariate(0.02)), 400) for _ in range(rng.randrange(5, 90)))) + " the" * (i % 9)) for i in range(150)]
    return [*rows, (900, "so be it " * 3000), (901, "the " * 4000)]


def test_nothing_depends_on_groups_or_partitions(spark, skewed):
    df = spark.createDataFrame(skewed, "doc_id long, text string")
    train = F.col("doc_id") % 7 != 0
    got = []
    for parts, size in ((1, 1 << 24), (7, 3000), (3, 900), (5, 200)):
        got.append({r.doc_id: (r.score, r.n_known) for r in score_documents(df.repartition(parts), train, group_bytes=size).collect()})
    for other in got[1:]:
        assert other.keys() == got[0].keys() and all(math.isclose(other[d][0], x, rel_tol=1e-6) and other[d][1] == k for d, (x, k) in got[0].items())


def test_rows_base_and_held_out(spark):
    rows = corpus() + [(900, None), (901, ""), (902, "never seen"), (None, "ka1 ka2"), (3, "ka1 ka1"), (3, "ka1 ka1"), (903, "KA1 ka1\x0bka1"), (904, "ka2 " * 30_000)]
    df = spark.createDataFrame([(d, t, 1.0, 2) for d, t in rows], "doc_id long, text string, score double, chunk int")
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    train = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    counts = Counter(w for d, t in rows if d is not None and not held(d) for w in [*(t or "").lower().split(), 0])
    n, v = counts.total(), len(counts)
    got = score_documents(df, train).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got if r.doc_id is not None) == sorted((d, len((t or "").split()) + 1) for d, t in rows if d is not None)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    for d, t in rows:
        words = [*(t or "").lower().split(), 0]
        if d is not None and d != 3:
            assert by[d].n_known == sum(counts[w] > 0 for w in words) and by[d].train_tokens == n
            assert math.isclose(by[d].base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel_tol=1e-9)
    out = [r for r in got if held(r.doc_id)]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) * 0.95
    assert score_documents(df.limit(0), train).count() == 0
    none = score_documents(df, F.lit(False)).collect()
    assert len(none) == len(rows) and all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in none)
