"""Near copies by verified similarity, against brute force over all pairs."""

import random

from siltstone.llm.simhash import drop_near_copies, near_copies, shingles_of


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("ka lo mi nu pe ra so ti".split()) + rng.choice("ba de fi go hu".split()) + str(rng.randrange(30))
    out = []
    for g in range(25):
        base = [word() for _ in range(rng.randrange(60, 300))]
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 30])):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    rng.shuffle(out)
    return [(i * 2, t) for i, t in enumerate(out)]


def plain(rows, size=5, least=0.8):
    sets = [set(shingles_of(t, size)) for _, t in rows]
    comp = [d for d, _ in rows]
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if comp[i] > comp[j] and (a == b or len(a & b) >= least * len(a | b)):
                    comp[i], changed = comp[j], True
    return sorted({(d, c) for (d, _), c in zip(rows, comp)})


def test_against_all_pairs(spark):
    rows = corpus() + [(1001, None), (1003, ""), (1005, "two words"), (1007, "Two  WORDS"), (1009, "other two")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    want = plain(rows)
    assert any(d != c for d, c in want)
    for tile in (2048, 2):
        assert sorted((r.doc_id, r.component) for r in near_copies(df, tile=tile).collect()) == want
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, c in want if d == c]


def test_null_ids_stay_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or -1 for r in drop_near_copies(df).collect())) == [-1, 3]
    assert drop_near_copies(df.limit(0)).count() == 0
