"""Phrase mining against counting every n-gram, and against DuckDB."""

import os
import random
import re
from collections import Counter

import duckdb
import pytest

from siltstone.llm.phrases import collocations, scored
from siltstone.llm.queries import ORACLES, QUERIES

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, least, longest, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + m])) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    f = {k: v for k, v in counts.items() if v >= least}
    out = {}
    for (lang, w), a in f.items():
        if len(w) == 1:
            continue
        longer = (x for (other, x), b in f.items() if other == lang and len(x) > len(w) and b >= a)
        if any(w == x[i : i + len(w)] for x in longer for i in range(len(x) - len(w) + 1)):
            continue
        score, k = min((1000 * a * totals[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, totals[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def rows(seed=1):
    rng = random.Random(seed)
    passage = "A common Passage of seven words only. and more,"
    texts = []
    for i in range(300):
        words = [rng.choice(("la", "LE", "de", "é", "x\x00y", f"w{rng.randrange(30)}")) + rng.choice(("", "", "", ".", ",", "\n", "\t", "\r")) for _ in range(rng.randrange(0, 40))]
        texts.append(" ".join([passage] * (i % 3 == 0) + words))
    data = [(t, rng.choice(("en", "en", "fr", None, "und"))) for t in texts]
    return data + [(None, "en"), ("", None), ("\n\n..", "fr"), ("la " * 20_000, "en"), ("a a a a a a a", "xx"), ("la le de é", "fr"), ("la le de é", "fr")]


def test_against_counting(spark):
    data = rows()
    df = spark.createDataFrame([(t, l, "x", 1, 2) for t, l in data], "text string, lang string, phrase string, n int, k int")
    for least, longest, top, chunk in ((3, 5, 2000, 8 << 20), (3, 5, 7, 2000), (2, 3, 50, 1)):
        got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations(df, least, longest, top, chunk_bytes=chunk).collect())
        assert got == plain(data, least, longest, top)


def test_exact_beyond_64_bits(spark):
    a, l, r, n = 10**13 - 1, 10**13 + 1, 10**13 + 7, 10**14 + 3
    phrases = spark.createDataFrame([("en", "a b", 2, a), ("en", "a", 1, l), ("en", "b", 1, r)], "lang string, phrase string, words int, a long")
    got = scored(phrases, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert (got.score, got.l, got.r) == (1000 * a * n // (l * r), l, r)


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations(df).count() == 0 and collocations(spark.createDataFrame([(None, None)], df.schema)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no data")
def test_against_duckdb(spark):
    c = duckdb.connect()
    c.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    r = c.execute(ORACLES["op12_phrases"])
    names = [x[0] for x in r.description]
    want = sorted(tuple(x[names.index(c)] for c in COLUMNS) for x in r.fetchall())
    got = sorted(tuple(x[c] for c in COLUMNS) for x in QUERIES["op12_phrases"](spark, "/root/testdata/sf0.01").collect())
    assert len(want) > 50 and got == want
