"""Line deduplication against brute force."""

import random

from siltstone.llm.line_dedup import dedup_lines

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def plain(rows, min_chars=10, min_docs=2):
    docs = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= min_chars:
                docs.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if d is None or len(key(x)) < min_chars or len(docs[key(x)]) < min_docs or d == min(docs[key(x)])]
        out.append((d, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


def rows(seed=0, n=80):
    rng = random.Random(seed)
    pool = [f"Line number {i} of the pool" for i in range(40)] + ["", "short", "  Spaced line one \t", "SPACED LINE ONE", "ÉTÉ été line", "été été line", "trailing\r"]
    out = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 30)))) for i in range(n)]
    return out + [(900, None), (901, ""), (902, "\n\n"), (None, "Line number 1 of the pool\nx"), (5, "Line number 2 of the pool\nown line of a repeat"), (903, "\n".join(["a very common line"] * 3000)), (904, "a very common line")]


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(d, t, "en", -1) for d, t in data], "doc_id long, text string, lang string, n_lines int")
    for min_docs in (1, 2, 4):
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in dedup_lines(df, min_docs=min_docs).collect()), key=str)
        assert got == plain(data, min_docs=min_docs)


def test_empty_table_and_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    out = dedup_lines(df)
    assert out.count() == 0 and set(out.columns) == {"doc_id", "text", "lang", "n_lines", "n_dropped"}


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
