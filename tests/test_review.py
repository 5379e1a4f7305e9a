"""Smaller review operators."""

import hashlib
import hmac
import json

from pyspark.sql import functions as F

from siltstone.operators import code as C
from siltstone.operators import review as V


def test_webhooks(spark):
    body = json.dumps({"action": "opened", "repository": {"full_name": "a/b"}, "pull_request": {"number": 3, "state": "open", "draft": True}})
    sign = lambda b, s="k": "sha256=" + hmac.new(s.encode(), b.encode(), hashlib.sha256).hexdigest()
    rows = [("pull_request", body, sign(body)), ("pull_request", body, sign(body, "x")), ("pull_request", body, None), ("push", body, sign(body)), ("pull_request", "{}", sign("{}"))]
    got = V.webhooks(spark.createDataFrame(rows, "event string, body string, signature string"), "k").collect()
    assert [(r.repository, r.number, r.status, r.draft) for r in got] == [("a/b", 3, "draft", True)]
    assert V.webhooks(spark.createDataFrame(rows, "event string, body string, signature string"), "").count() == 0


def test_paged_source(spark):
    source = V.PagedSource(lambda page: ([(page, "x" * page)] if page < 4 else [], page < 4), "n int, t string")
    assert sorted((r.n, r.t) for r in source.load(spark, 5).collect()) == [(1, "x"), (2, "xx"), (3, "xxx")]


def test_diffs_and_blocks(spark):
    df = spark.createDataFrame([("a\nb\n", "a\nc\n", "f.py"), ("a\n", "a\n", "g.py")], "x string, y string, p string")
    got = [r.d for r in df.select(V.unified_diff("x", "y", "p").alias("d")).collect()]
    assert got[0].splitlines()[:2] == ["--- a/f.py", "+++ b/f.py"] and "-b" in got[0] and "+c" in got[0] and got[1] == ""
    assert df.select(V.reindented(F.col("x"), F.lit(2)).alias("r")).first().r == "  a\n  b\n"


def test_complex_functions(spark):
    text = "def f(a):\n" + "".join(f"    if a == {i}:\n        pass\n" for i in range(12)) + "def g():\n    return 1\n"
    files = spark.createDataFrame([("a.py", text)], "path string, content string")
    assert [(r.name, r.complexity, r.severity) for r in V.complex_functions(C.python_facts(files, "symbols")).collect()] == [("f", 13, "low")]


def test_changed_lines_filter(spark):
    found = spark.createDataFrame([("a", 1, 3), ("a", 9, 9), ("b", 5, 5)], "file_path string, start_line int, end_line int")
    changed = spark.createDataFrame([("a", [3, 4])], "file_path string, lines array<int>")
    assert sorted((r.file_path, r.start_line) for r in C.in_changed_lines(found, changed).collect()) == [("a", 1), ("b", 5)]
    added = spark.createDataFrame([("a", i) for i in range(121)] + [("b", 1)], "file_path string, line int")
    assert [(r.file_path, r.added) for r in C.large_changes(added).collect()] == [("a", 121)]
