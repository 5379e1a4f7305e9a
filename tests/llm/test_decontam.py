"""Decontamination against brute force over all windows."""

import random
from collections import Counter

from siltstone.llm.decontam import Matcher, RollingHash, contaminated, decontaminate, words_of
from siltstone.llm.simhash import shingles_of


def setup(seed=2):
    rng = random.Random(seed)
    word = lambda: rng.choice("ka lo mi nu pe ra so ti".split()) + str(rng.randrange(60))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 50)))) for i in range(20)] + [(20, "rep rep rep rep rep rep rep rep"), (21, "two words"), (22, ""), (23, None)]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            item = (items[rng.randrange(21)][1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                item[rng.randrange(len(item))] = word().upper()
            if rng.random() < 0.3:
                item.pop(rng.randrange(len(item)))
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() if rng.random() < 0.2 else x for x in item]
        docs.append((d, "\n ".join(w)))
    return docs, items


def plain(docs, items, k=5, least=0.8):
    out = []
    for d, t in docs:
        words = (t or "").lower().split()
        for i, x in items:
            item = (x or "").lower().split()
            if not item:
                continue
            n, bag = len(item), Counter(shingles_of(x, k))
            found = []
            for s in range(len(words) - n + 1):
                own = Counter(shingles_of(" ".join(words[s : s + n]), k))
                score = (own & bag).total() / (own | bag).total()
                if score >= least - 1e-12:
                    found.append((-score, s))
            taken = []
            for score, s in sorted(found):
                if all(abs(s - q) >= n for q in taken):
                    taken.append(s)
                    out.append((d, i, s, n, round(-score, 9)))
    return sorted(out)


def test_all_windows(spark):
    docs, items = setup()
    docs += [(100, None), (101, ""), (102, "some two words here"), (5, docs[5][1])]
    want = plain(docs, items)
    assert len(want) >= 15
    df = spark.createDataFrame([(d, t, 0.0) for d, t in docs], "doc_id long, text string, similarity double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 300):
        got = sorted((r.doc_id, r.item_id, r.first_word, r.n_words, round(r.similarity, 9)) for r in contaminated(df, bench, block_bytes=size).collect())
        assert got == want
    bad = {w[0] for w in want}
    kept = decontaminate(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - bad
    assert contaminated(df, bench.limit(0)).count() == 0 and contaminated(df.limit(0), bench).count() == 0


def test_hashes():
    raw, a, b = words_of("One two one two ONE\ttwo")
    h = RollingHash()(raw, a, b)
    assert h[0] == h[2] == h[4] != h[1] == h[3]
    assert Matcher([], 5, 0.8).find("any text") == []


def test_long_texts_and_common_passages():
    rng = random.Random(3)
    items = [(i, "the very same words open every item of this set " + " ".join(f"w{rng.randrange(500)}" for _ in range(30))) for i in range(300)]
    matcher = Matcher(items, 5, 0.8)
    filler = [f"x{rng.randrange(5000)}" for _ in range(400_000)]
    text = " ".join(filler[:200_000] + items[7][1].split() + filler[200_000:] + "the very same words open every item of this set".split() * 50)
    assert [m[:3] for m in matcher.find(text)] == [(7, 200_000, 40)]
