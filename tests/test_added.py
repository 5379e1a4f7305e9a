"""Patch application, appends, publish and replay, candidates, summaries, registries, pages, severities."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import code as C, mutations as M, review as V, text as T
from siltstone.operators.registry import Analyzers, VectorStore
from siltstone.sources import files as S
from siltstone.streaming import events as E


def test_edits(spark):
    files = spark.createDataFrame([("a.py", "x = 1\ny = 2\nx = 1\n"), ("b.ts", "f(1)\ng(2)\n")], "path string, content string")
    edits = spark.createDataFrame([("a.py", "y = 2", "y = 3", 1, 1), ("a.py", "x = 1", "x = (", 3, 3), ("a.py", "gone", "z", 9, 9), ("b.ts", "g(2)", "g((2)", 0, 0), ("c.py", "a", "b", 1, 1)], "path string, original string, replacement string, start_line int, end_line int")
    got = sorted(((r.path, r.place, r.after, r.ok) for r in C.apply_edits(files, edits).collect()), key=str)
    assert got == sorted([("a.py", "text", "x = 1\ny = 3\nx = 1\n", True), ("a.py", "lines", "x = 1\ny = 2\nx = (\n", False), ("a.py", None, None, False), ("b.ts", "text", "f(1)\ng((2)\n", False)], key=str)


def test_append_publish_replay(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    M.append(rows, f"{tmp_path}/t", at=F.lit(5))
    M.append(rows, f"{tmp_path}/t", at=F.lit(6))
    assert spark.read.parquet(f"{tmp_path}/t").groupBy("at").count().count() == 2
    E.publish(rows, f"{tmp_path}/log", "k")
    stream = E.replay_then_live(spark, f"{tmp_path}/log", "id int, k string, ts timestamp", "k", "a", files=1)
    q = stream.writeStream.format("memory").queryName("replayed").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        assert spark.table("replayed").count() == 1
        E.publish(spark.createDataFrame([(3, "a")], "id int, k string"), f"{tmp_path}/log", "k")
        q.processAllAvailable()
        assert sorted(r.id for r in spark.table("replayed").collect()) == [1, 3]
    finally:
        q.stop()


def test_candidates_and_summaries(spark):
    f = spark.createDataFrame([(i, 1, "low" if i % 5 else "informational", f"t{i}", f"f{i % 3}.py", i, float(i)) for i in range(40)], "id int, a int, severity string, title string, file_path string, start_line int, score double")
    files = spark.createDataFrame([("f0.py",), ("f1.py",)], "path string")
    want = [i for i in range(39, -1, -1) if i % 5 and i % 3 < 2]
    assert [r.id for r in V.patch_candidates(f, files).collect()] == want[:12]
    assert [r.id for r in V.patch_candidates(f, files, None).collect()] == want
    text = V.finding_summary(f, "a").first().summary.split("\n")
    assert len(text) == 26 and text[0] == "- [low] t39 (f0.py:39)" and text[-1] == "…and 15 more"
    assert V.restored(spark.createDataFrame([(1, None)], "id int, s string"), s="x", n=0).first().asDict() == {"id": 1, "s": "x", "n": 0}
    r = spark.createDataFrame([("b", None), ("a", None), ("c", 1)], "full_name string, last_analyzed_at int")
    assert [x.full_name for x in V.repository_order(r).collect()] == ["c", "a", "b"]
    ctx = spark.createDataFrame([(1, "x.py", "c")], "k int, file_path string, content string")
    changes = spark.createDataFrame([(1, "p", "d", "modified"), (2, "q", "e", None), (2, "r", "", None), (2, "s", "f", "removed")], "k int, path string, patch string, status string")
    assert sorted(tuple(x) for x in V.context_or_diff(ctx, changes, "k").collect()) == [(1, "x.py", "c"), (2, "q", "e")]


def test_registry_and_store(spark):
    a = Analyzers()
    a.register("lines", "python", "ruby")(lambda d: d.select("path", F.lit(1).alias("n")))
    a.register("lines", "go")(lambda d: d.select("path", F.lit(2).alias("n")))
    files = spark.createDataFrame([("a.py", "python"), ("b.go", "go"), ("c.c", "c")], "path string, language string")
    assert sorted(tuple(r) for r in a.run(files, "lines").collect()) == [("a.py", 1), ("b.go", 2)] and a.languages() == ["go", "python", "ruby"]
    s = VectorStore().add(spark.createDataFrame([(1, "f", [1.0, 0.0]), (2, "g", [0.0, 1.0])], "id long, file_path string, v array<double>"))
    s = s.add(spark.createDataFrame([(2, "h", [1.0, 0.1])], "id long, file_path string, v array<double>"))
    assert s.rows.count() == 2 and s.chunks_for(F.col("file_path") == "h").count() == 1
    assert s.search(s.rows.where("id = 1"), 1).count() >= 1


def test_pages_to_the_last(spark):
    fetch = lambda page: ([(page, i) for i in range(3)], page < 4)
    source = V.PagedSource(fetch, "page int, i int")
    assert source.load(spark).count() == 12 and source.load(spark, most=7).count() == 7 and source.load(spark, 2).count() == 6


def test_severities_and_folders(spark, tmp_path):
    ruff = '[{"code": "S105", "message": "m", "filename": "a.py", "location": {"row": 1}, "end_location": {"row": 1}}, {"code": "B1", "message": "m", "filename": "a.py", "location": {"row": 1}, "end_location": {"row": 1}}, {"code": "E5", "message": "m", "filename": "a.py", "location": {"row": 1}, "end_location": {"row": 1}}]'
    got = S.report_findings(spark.createDataFrame([(ruff,)], "report string"), "ruff")
    assert {r.rule_id: r.severity for r in got.collect()} == {"S105": "high", "B1": "medium", "E5": "low"}
    osv = '{"results": [{"source": {"path": "p"}, "packages": [{"package": {"name": "n", "version": "1"}, "vulnerabilities": [{"id": "1", "severity": [{"score": "CVSS:3.1/AV:N/AC:L"}]}, {"id": "2", "severity": [{"score": "CVSS:3.1/AV:L/AC:L"}], "database_specific": {"severity": "LOW"}}, {"id": "3"}]}]}]}'
    got = S.report_findings(spark.createDataFrame([(osv,)], "report string"), "osv")
    assert {r.rule_id: r.severity for r in got.collect()} == {"1": "high", "2": "low", "3": "medium"}
    for name in ("vendor/a.py", "target/b.py", ".idea/c.py", "src/d.py", "src/e.wasm"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [r.path for r in S.source_files(spark, str(tmp_path)).collect()] == ["src/d.py"]


def test_whole_texts(spark):
    rng = random.Random(3)
    texts = ["", "a", "".join(rng.choice("abcé ☃") for _ in range(70_000)) + " lastWordHere"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    entropy = lambda t: -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0.0
    for r in df.select("i", T.entropy(F.col("t")).alias("e"), X.code_tokens(F.col("t")).alias("k")).collect():
        assert math.isclose(r.e, entropy(texts[r.i]), abs_tol=1e-9)
    assert r.k[-4:] == ["lastwordhere", "last", "word", "here"]
