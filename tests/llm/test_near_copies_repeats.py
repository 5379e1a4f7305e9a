"""Near copies whose shingle sets are alike although one of them repeats a passage many times."""

import random

from siltstone.llm.simhash import near_copies, shingles_of


def test_repeated_passages(spark):
    rng = random.Random(12)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(100_000)}" for _ in range(300)]
        a = rng.randrange(280)
        passage = words[a : a + 15]
        other = words[: a + 15] + passage * 50 + words[a + 15 :]
        x, y = set(shingles_of(" ".join(words), 5)), set(shingles_of(" ".join(other), 5))
        assert len(x & y) / len(x | y) > 0.95
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: r.component for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}
