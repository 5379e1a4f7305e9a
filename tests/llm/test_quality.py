"""Quality scores: held-out accuracy and edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm.quality import FEATURES, features, fit_pairs, fit_quality, score_quality


def corpus(n=400, seed=8):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and to in that with".split()) if rng.random() < 0.4 else "".join(rng.choice("aeinorst") for _ in range(rng.randrange(3, 11)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 200))]
        kind = i % 8
        if kind == 0:
            text = " | ".join(words)
        elif kind == 1:
            text = " ".join(w + rng.choice(["%%%", "###", "***"]) for w in words)
        elif kind == 2:
            text = " ".join([words[0]] * len(words))
        else:
            text = ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, len(words), 9)) + "."
        out.append((i, text, int(kind > 2)))
    return out


def test_held_out(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 0.5, "en") for d, t, _ in rows] + [(900, None, 0.5, None), (901, "", 0.5, "x"), (None, "Some text here.", 0.1, "en")], "doc_id long, text string, score double, lang string")
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in rows if d % 4] + [(1, 0, 0), (1, 1, 0), (3, None, 0), (None, 1, 0), (5000, 1, 1), (2, 7, 0)], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, labels)
    got = {r.doc_id: r for r in score_quality(docs, model).collect()}
    assert len(got) == len(rows) + 3 and set(got[0].asDict()) == {"doc_id", "text", "lang", "score"}
    assert all(0 <= r.score <= 1 for r in got.values())
    right = [(got[d].score >= 0.7) == bool(q) for d, _, q in rows if d % 4 == 0]
    assert sum(right) / len(right) > 0.97
    assert model.threshold(0.0) <= model.threshold(0.5) <= 1
    assert fit_quality(docs, labels, max_labelled=50).score(np.zeros((1, len(FEATURES)))).shape == (1,)


def test_degenerate_samples(spark):
    assert features(None).tolist() == features(" \n").tolist() == [0.0] * len(FEATURES)
    for x, y in ((np.zeros((0, len(FEATURES))), np.zeros(0)), (np.ones((3, len(FEATURES))), np.ones(3)), (np.ones((4, len(FEATURES))), np.array([0, 1, 0, 1]))):
        s = fit_pairs(x, y).score(np.zeros((2, len(FEATURES))))
        assert ((s >= 0) & (s <= 1)).all()
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert score_quality(docs, fit_quality(docs, labels)).count() == 0
