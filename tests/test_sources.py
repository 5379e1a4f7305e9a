"""Sources and streams."""

import json

from pyspark.sql import functions as F

from siltstone.operators import mutations as M
from siltstone.operators import relational as R
from siltstone.sources import files as S
from siltstone.streaming import events as E


def test_source_tree(spark, tmp_path):
    for name, data in {"src/a.py": b"x = 1\n", "node_modules/b.js": b"y", "img/c.png": b"z", "d.md": "é".encode(), "bad.ts": b"\xff\xfe\x00", "dist2/e.ts": b"ok", "big.py": b"x" * 600_000}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: (r.language, r.content) for r in S.source_files(spark, str(tmp_path), excluded=["dist2/**"], max_bytes=512_000).collect()}
    assert got == {"src/a.py": ("python", "x = 1\n"), "d.md": ("markdown", "é")}


def test_reports(spark):
    reports = {
        "ruff": [{"code": "S608", "message": "m", "filename": "/r/a.py", "location": {"row": 3}, "end_location": {"row": 4}}],
        "bandit": {"results": [{"test_id": "B105", "issue_text": "m", "filename": "./a.py", "line_number": 0, "issue_severity": "HIGH"}]},
        "eslint": [{"filePath": "/r/a.js", "messages": [{"ruleId": None, "message": "m", "severity": 2, "line": 1, "endLine": None}]}],
        "npm_audit": {"vulnerabilities": {"lodash": {"severity": "moderate"}}},
        "semgrep": {"results": [{"check_id": "p.q", "path": "a.py", "start": {"line": 1}, "end": {"line": 2}, "extra": {"message": "m", "severity": "ERROR"}}]},
        "gitleaks": [{"RuleID": "k", "Description": "d", "File": "a", "StartLine": 1, "EndLine": 1}],
        "osv": {"results": [{"source": {"path": "/r/requirements.txt"}, "packages": [{"package": {"name": "x", "version": "1"}, "vulnerabilities": [{"id": "V1"}, {"id": "V2", "summary": "s"}]}]}]},
        "trivy": {"Results": [{"Target": "t", "Vulnerabilities": [{"VulnerabilityID": "C1", "Severity": "LOW"}], "Misconfigurations": [{"ID": "M1", "Severity": "CRITICAL"}]}, {"Target": "u"}]},
    }
    for tool, report in reports.items():
        rows = S.report_findings(spark.createDataFrame([(json.dumps(report),), ("broken{",)], "report string"), tool, "/r/").collect()
        assert len(rows) == (2 if tool in ("osv", "trivy") else 1) and all(r.start_line >= 1 <= r.end_line and r.severity and not r.file_path.startswith("/") for r in rows), tool
    lines = spark.createDataFrame([("a.py:3: error: bad thing  [arg-type]",), ("a.py:4: note: hint",), ("src/a.ts(5,2): error TS2304: no name",)], "value string")
    assert [(r.rule_id, r.start_line) for r in S.text_report_findings(lines, "mypy").collect()] == [("arg-type", 3)]
    assert [(r.rule_id, r.file_path, r.severity) for r in S.text_report_findings(lines, "tsc").collect()] == [("TS2304", "src/a.ts", "high")]


def test_dependencies(spark):
    files = spark.createDataFrame([("package.json", '{"dependencies": {"react": "18"}, "devDependencies": {"react": "19", "jest": "1"}}'), ("requirements.txt", "# c\nFastAPI>=0.1  # web\nuvicorn[standard]==2\n-r other\n"), ("pyproject.toml", 'dependencies = ["fastapi>=9", "pydantic>=2"]')], "path string, content string")
    got = {r.name: r.version for r in S.dependencies(files).collect()}
    assert got == {"react": "19", "jest": "1", "fastapi": ">=0.1", "uvicorn": "==2", "pydantic": ">=2"}
    names, paths = F.array(*map(F.lit, got)), F.array(F.lit("manage.py"))
    assert spark.range(1).select(S.frameworks(names, paths).alias("f")).first().f == ["FastAPI", "Django", "Pydantic", "React", "Jest"]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{(i * 7) % 60:02d}:00", i % 3, ["queued", "running", "completed"][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, ts string, key int, status string").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = E.file_stream(spark, str(tmp_path / "in"), df.schema, per_trigger=2)
    got = E.run_available(E.tumbling_counts(stream, "key", "ts", "10 minutes"), "tumbling", str(tmp_path / "c1"), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.tumbling_counts(df, "key", "ts", "10 minutes").collect()))
    twice = stream.unionByName(stream)
    assert E.run_available(E.once(twice, "id", "ts", "1 day"), "once", str(tmp_path / "c2")).count() == 60
    last = E.run_available(E.last_status(stream, "key", "ts", "status"), "last", str(tmp_path / "c3"), "complete")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, E.last_status(df, "key", "ts", "status").collect()))
    assert E.frames(df.limit(1), "status", "id").first().frame.startswith("event: ")


def test_state_changes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", None, 1), (2, "late", None, 2), (3, "d", 3, 1)], "k int, v string, n int, at int")
    assert sorted(map(tuple, M.upsert(old, new, ["k"], order="at").collect())) == [(1, "a", 1), (2, "late", 2), (3, "d", 3)]
    jobs = spark.createDataFrame([("queued",), ("running",), ("completed",)], "status string")
    assert [r.status for r in E.recovered(jobs).collect()] == ["failed", "failed", "completed"]
    assert [r.status for r in E.cancelled(jobs, F.lit(True)).collect()] == ["cancelled", "cancelled", "completed"]
    assert [r.may_start for r in E.may_start(jobs).collect()] == [False, False, True]
    move = M.move(F.lit("proposed"), F.col("a"), M.PATCH_MOVES)
    assert [r.s for r in spark.createDataFrame([("approve",), ("apply",), ("odd",)], "a string").select(move.alias("s")).collect()] == ["approved", "proposed", "proposed"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "severity string, k int, v double")
    assert [r.n for r in R.severity_counts(none).orderBy("rank").collect()] == [0] * 5
    assert R.posture(none).first().posture == 100.0
    assert R.acceptance(none.withColumn("s", F.lit("x")), "s", ["a"], ["b"]).first().acceptance_rate == 0.0
    assert R.where_all(none, None, R.minimum("v", 0), R.one_of("k", [])).count() == 0
