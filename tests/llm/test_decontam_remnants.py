"""Decontamination of documents with fewer words than an item, against brute force."""

import random
from collections import Counter

from siltstone.llm.decontam import Matcher, contaminated, decontaminate
from siltstone.llm.simhash import shingles_of
from tests.llm.test_decontam import setup


def plain(docs, items, k=5, least=0.8):
    out = []
    for d, t in docs:
        words = (t or "").lower().split()
        for i, x in items:
            item = (x or "").lower().split()
            if not item or not words:
                continue
            n, bag, found, taken = min(len(item), len(words)), Counter(shingles_of(x, k)), [], []
            for s in range(len(words) - n + 1):
                own = Counter(shingles_of(" ".join(words[s : s + n]), k))
                score = (own & bag).total() / (own | bag).total()
                if score >= least - 1e-12:
                    found.append((-score, s))
            for score, s in sorted(found):
                if all(abs(s - q) >= len(item) for q in taken):
                    taken.append(s)
                    out.append((d, i, s, n, round(-score, 9)))
    return sorted(out)


def test_items_less_some_words(spark):
    docs, items = setup(seed=6)
    cut = []
    for i, t in items[:22]:
        w = t.split()
        cut += [w[1:], w[:-1], w[2:-1], w[: -len(w) // 4], w[: len(w) // 2]]
    docs += [(1000 + n, " ".join(w)) for n, w in enumerate(cut)]
    want = plain(docs, items)
    assert sum(d >= 1000 for d, *_ in want) >= 30
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.first_word, r.n_words, round(r.similarity, 9)) for r in contaminated(df, bench).collect())
    assert got == want
    assert {r.doc_id for r in decontaminate(df, bench).collect()} == {d for d, _ in docs} - {w[0] for w in want}


def test_remnants_of_long_items():
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(30, 90)))) for i in range(50)]
    matcher = Matcher(items, 5, 0.8)
    for i, t in items:
        for words in (t.split()[1:], t.split()[:-1]):
            assert [m[:3] for m in matcher.find(" ".join(words))] == [(i, 0, len(words))]
