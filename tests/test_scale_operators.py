"""Interval bins, the leader sweep and strongly connected components against plain versions."""

import random
import time

from pyspark.sql import functions as F

from siltstone.operators import findings as P, graph as G
from tests.test_findings import KINDS, row


def pairs(rows, slack):
    rows = [r for r in rows if None not in r]
    return sorted((k, min(i, j), max(i, j)) for n, (k, i, s, e) in enumerate(rows) for l, j, t, f in rows[:n] if k == l and i != j and s - slack <= f and t - slack <= e)


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abbb"), i, s, s + rng.choice((0, 1, 3, 7, 8, 9, 60, 500, -3))) for i, s in enumerate(rng.randrange(-300, 3000) for _ in range(500))]
    rows += [("a", 3, 5, 6), ("a", 900, -10_000, 10_000), ("b", 901, 0, 0), ("b", 901, 0, 0), (None, 1, 1, 1), ("a", None, 1, 1), ("a", 902, None, 1), ("a", 903, 1, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "k string, id long, s int, e int, level int, bin string")
    for slack in (0, 4):
        got = sorted(tuple(r) for r in P.overlap_pairs(df, "k", "id", "s", "e", slack).collect())
        assert got == pairs(rows, slack)
    assert P.overlap_pairs(df.limit(0), "k", "id", "s", "e").count() == 0


def test_a_hundred_thousand_intervals_of_one_key(spark):
    df = spark.range(100_000).select(F.lit("k").alias("k"), "id", (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 7).alias("e"))
    out = P.overlap_pairs(df, "k", "id", "s", "e")
    assert out.count() == 99_999
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def plain_clusters(rows):
    out = []
    for r in rows:
        for c in out:
            a, b = c[0], r
            over = a["start_line"] - 4 <= b["end_line"] and b["start_line"] - 4 <= a["end_line"]
            x, y = a["__tokens"], b["__tokens"]
            title = not (x or y) or bool(x and y) and len(x & y) / len(x | y) >= 0.55
            if a["fingerprint"] == b["fingerprint"] or over and (a["__rule"] and a["__rule"] == b["__rule"] or a["cwe"] and a["cwe"] == b["cwe"] or title):
                c.append(r)
                break
        else:
            out.append([r])
    return [[r["n"] for r in c] for c in out]


def findings(rng, n, lines):
    words = [f"w{i}" for i in range(12)]
    out = []
    for i in range(n):
        start = rng.randrange(lines)
        out.append({"n": i, "start_line": start, "end_line": start + rng.choice((0, 0, 2, 5, 40)), "__rule": rng.choice(("", "", "r1", "r2", f"r{i}")), "cwe": rng.choice((None, "", "c1", f"c{i}")), "__tokens": frozenset(rng.sample(words, rng.randrange(0, 6))), "fingerprint": rng.choice((f"f{start // 10}", f"g{i}"))})
    return sorted(out, key=lambda r: (r["start_line"], r["n"]))


def test_sweep_equals_the_plain_loop():
    rng = random.Random(12)
    for _ in range(150):
        rows = findings(rng, rng.randrange(1, 60), rng.choice((10, 60, 400)))
        leaders, clusters = P.Leaders({f"w{i}": rng.randrange(5) for i in range(12)}), []
        for r in rows:
            home = leaders.home(r)
            if home is None:
                leaders.add(r)
                clusters.append([r["n"]])
            else:
                clusters[home].append(r["n"])
        assert clusters == plain_clusters(rows)


def test_fifty_thousand_findings_of_one_file(spark):
    n = 50_000
    df = spark.range(n).select(
        F.col("id").alias("ord"), F.lit("a.py").alias("file_path"), F.lit("bug").alias("category"), F.lit("high").alias("severity"), F.lit("ruff").alias("source"), F.concat(F.lit("rule_"), F.col("id") % 500).alias("rule_id"), F.lit(None).cast("string").alias("cwe"),
        F.concat(F.lit("alpha"), F.col("id") % 977, F.lit(" beta"), F.col("id") % 331, F.lit(" common")).alias("title"), F.lit("d").alias("description"), (F.col("id") / 5).cast("int").alias("start_line"), (F.col("id") / 5 + 3).cast("int").alias("end_line"), F.lit(0.5).alias("confidence"), F.array(F.lit("x")).alias("related_files"),
    )
    began = time.time()
    got = P.merge_findings(df).agg(F.sum("members"), F.count("*")).first()
    assert got[0] == n and time.time() - began < 60


def test_islands_change_nothing(spark):
    rng = random.Random(5)
    rows = [row(i, file_path=rng.choice(("a.py", "b.py")), rule_id=rng.choice(("", "B608", f"r{i}")), title=rng.choice(("SQL injection", "Open redirect", f"Odd {i}")), start_line=(s := rng.randrange(1, 900)), end_line=s + rng.choice((0, 3, 30))) for i in range(250)]
    df = spark.createDataFrame(rows, KINDS)
    got = sorted((r.ord, r.start_line, r.end_line, r.members) for r in P.merge_findings(df).collect())
    whole, P.islands = P.islands, lambda x: x.withColumn("__island", F.lit(0))
    try:
        assert got == sorted((r.ord, r.start_line, r.end_line, r.members) for r in P.merge_findings(df).collect())
    finally:
        P.islands = whole
    assert len(got) < 250


def tarjan(edges):
    """Linear time, without recursion."""
    out, index, low, on, stack, comps = {}, {}, {}, set(), [], []
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root), on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w), on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    comp = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        comp.append(w)
                        if w == v:
                            break
                    comps.append(comp)
    return sorted((v, min(c), len(c)) for c in comps if len(c) > 1 for v in c)


def test_components_against_a_linear_algorithm(spark):
    rng = random.Random(1)
    small = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5), (5, 6), (0, 1), (7, 0)]
    large = [(rng.randrange(9000), rng.randrange(9000)) for _ in range(10_000)]
    ring = [(i, (i + 1) % 12) for i in range(12)]
    for edges in (small, large, ring, []):
        df = spark.createDataFrame([(a, b, "imports", "x") for a, b in edges] + [(1, 0, "calls", "x"), (None, 1, "imports", "x")], "source long, target long, type string, id string")
        log = []
        got = sorted(tuple(r) for r in G.strong_components(df, log=log).collect())
        assert got == tarjan([e for e in edges if e[0] != e[1]])
        assert len(log) < 120
