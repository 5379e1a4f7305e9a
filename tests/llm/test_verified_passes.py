"""Pairs that are not similar take no whole sets, and passes bound what meets at once."""

import random

from pyspark.sql import functions as F

from siltstone.llm import simhash as S


def test_verification_takes_sets_of_likely_pairs_only_and_in_passes(spark, monkeypatch):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(1_000_000)}" for _ in range(rng.choice([8, 300, 3000]))] for _ in range(30)]
    texts = base + [[*b[:-1], "x"] for b in base[:6]] + [[*b[: -len(b) // 8], *(f"y{i}" for i in range(len(b) // 8))] for b in base[:6]]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(100, None), (101, "")]
    sets = {i: S.shingle_set(t, 5) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    want = sorted((a, b) for a, b in pairs if S.similar(sets[a].tobytes(), sets[b].tobytes(), 0.8))
    assert (100, 101) in want and 4 < len(want) < 30
    made, plain = [], S.written

    def counted(df, name):
        out = plain(df, name)
        if name == "sets":
            made.append(out.count())
        return out

    monkeypatch.setattr(S, "written", counted)
    pairs, texts = spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame(rows, "id long, text string")
    assert sorted(map(tuple, S.verified(pairs, texts, 5, 0.8).collect())) == want
    assert made == [len({x for p in want for x in p})]  # before: those of all 44 texts
    made.clear()
    assert sorted(map(tuple, S.verified(pairs, texts, 5, 0.8, pass_bytes=20_000).collect())) == want
    assert len(made) > 3 and max(made) < 12
    assert S.verified(pairs.where(F.col("u") == 100).where("v = 0"), texts, 5, 0.8).count() == 0
