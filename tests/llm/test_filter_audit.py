"""The filter audit against a plain replay and against DuckDB."""

import os
import random
import re
from itertools import permutations

import duckdb
import pytest

from siltstone.llm.filter_audit import audit_filters
from siltstone.llm.queries import ORACLES, QUERIES

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    docs = []
    for d, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        again = d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in rows)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": again}
        docs.append((part or "", {k for k, v in fails.items() if v}, d in good and d is not None, d in toxic and d is not None))
    out = {}
    for part in {p for p, *_ in docs}:
        own, total = [x for x in docs if x[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [y for y in left if x in y[1]]
                kept = [y for y in left if x not in y[1]]
                failing = sum(x in y[1] for y in own)
                total[x] += len(gone)
                out[part, "".join(order), step] = [len(kept), len(gone), failing - len(gone) - sum(x in y[1] for y in kept), sum(y[1] == {x} for y in own), sum(y[2] for y in gone), sum(y[3] for y in gone)]
                left = kept
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def rows():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("the", "Of", "AND", "x%", f"w{rng.randrange(400)}", f"v{i}")) for i in range(rng.choice((0, 1, 150, 199, 200, 201, 320)))) for _ in range(40)]
    out = [(i, rng.choice(texts), rng.choice(("a", "b", "b", "b", None, ""))) for i in range(160)]
    return out + [(500, None, "a"), (501, "", "a"), (None, texts[0], "b"), (3, texts[1], "b"), (3, texts[1], "b"), (502, "w " * 30_000, "c"), (503, "É" * 300, "c")]


def got(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in df.collect()}


def test_against_plain_replay(spark):
    data = rows()
    rng = random.Random(4)
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 0, 1))) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 7) for r in data], "doc_id long, text string, source string, part string, flags int")
    out = audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = plain(data, labels)
    assert got(out) == want and out.count() == len(want) == 600 * len({r[2] or "" for r in data})


def test_own_filters_and_empty_table(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a", "s"), (2, None, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = got(audit_filters(docs, labels, {"X": F.col("text") == "a", "Y": F.col("doc_id") > 0}, repeats=None))
    assert out["s", "XY", 1] == [1, 1, 0, 0, 0, 0, 1] and out["s", "YX", 1] == [0, 2, 0, 1, 0, 0, 3] and out["s", "YX", 2] == [0, 0, 1, 0, 0, 0, 1]
    assert audit_filters(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no data")
def test_against_duckdb(spark):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    r = c.execute(ORACLES["op11_filter_audit"])
    names = [x[0] for x in r.description]
    want = {(d["part"], d["filter_order"], d["step"]): [d[k] for k in COLUMNS] for d in (dict(zip(names, x)) for x in r.fetchall())}
    out = QUERIES["op11_filter_audit"](spark, "/root/testdata/sf0.001")
    assert sorted(out.columns) == sorted(names) and got(out) == want
