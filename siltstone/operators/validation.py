"""Patch validation as row-wise and relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions.dims import at_least

# The weight of each signal in a patch's confidence.
FIX_WEIGHTS = {"syntax_validation": 0.25, "lint_success": 0.15, "typecheck_success": 0.15, "test_success": 0.25, "security_scan_success": 0.10}
SIMILARITY_WEIGHT = 0.10
AUTO_APPLY_CONFIDENCE, AUTO_APPLY_LINES = 85.0, 30


def similarity_step(similarity: Column) -> Column:
    return F.when(similarity <= 0, 0.0).when(similarity >= 0.85, 1.0).when(similarity >= 0.6, 0.75).when(similarity >= 0.4, 0.5).otherwise(0.2)


def signal(value: Column, weight: float) -> Column:
    """All of the weight if passed, none if failed, half if the check did not run."""
    return F.when(value.isNull(), weight * 0.5).when(value, weight).otherwise(0.0)


def fix_confidence(similarity: str = "semantic_similarity", **signals: str) -> Column:
    """0 to 100 from five three-valued signals and the similarity; signals give the column of each, by default its name."""
    total = F.lit(SIMILARITY_WEIGHT) * similarity_step(F.col(similarity))
    for name, weight in FIX_WEIGHTS.items():
        total = total + signal(F.col(signals.get(name, name)), weight)
    syntax, tests = F.col(signals.get("syntax_validation", "syntax_validation")), F.col(signals.get("test_success", "test_success"))
    total = F.when(syntax.eqNullSafe(False), 0.0).when(tests.eqNullSafe(False), F.least(total, F.lit(0.35))).otherwise(total)
    return F.round(F.least(F.lit(100.0), F.round(total * 100, 6)), 1)


def risk_level(category: Column, lines: Column, confidence: Column) -> Column:
    return (
        F.when((category == "architecture") | (lines > 40), "high")
        .when((confidence >= AUTO_APPLY_CONFIDENCE) & (lines <= 10), "low")
        .when((confidence >= 65) & (lines <= AUTO_APPLY_LINES), "medium")
        .otherwise("high")
    )


def auto_apply(confidence: Column, risk: Column, severity: Column, syntax: Column, lint: Column, types: Column, tests: Column, security: Column) -> Column:
    """A check that did not run is no pass for syntax and tests, and no failure for the others."""
    ok = lambda c: c.eqNullSafe(True)
    bad = lambda c: c.eqNullSafe(False)
    return (confidence >= AUTO_APPLY_CONFIDENCE) & (risk == "low") & ok(syntax) & ok(tests) & ~bad(lint) & ~bad(types) & ~bad(security) & (severity != "critical")


def status(syntax: Column, tests: Column) -> Column:
    return F.when(syntax.eqNullSafe(True) & ~tests.eqNullSafe(False), "passed").otherwise("failed")


def steps(**checks: Column) -> Column:
    """ARRAY<STRUCT<name, status>> in the given order; after a failed first check the others are skipped."""
    first, *rest = checks.items()
    state = lambda c: F.when(c.isNull(), "skipped").when(c, "passed").otherwise("failed")
    made = [F.struct(F.lit(first[0]).alias("name"), state(first[1]).alias("status"))]
    made += [F.struct(F.lit(n).alias("name"), F.when(first[1].eqNullSafe(False), "skipped").otherwise(state(c)).alias("status")) for n, c in rest]
    return F.array(*made)


def gate(patches: DataFrame, findings: DataFrame, key: str, threshold: str = "medium") -> DataFrame:
    """patches with passed BOOLEAN: no finding of the patch reaches the threshold."""
    bad = findings.where(at_least(F.col("severity"), threshold)).select(F.col(key).alias("__k")).distinct()
    return patches.join(bad, patches[key] == bad["__k"], "left").withColumn("passed", F.col("__k").isNull()).drop("__k")


def introduced(after: DataFrame, before: DataFrame, *keys: str) -> DataFrame:
    """Findings after the patch without an equal one before it."""
    return after.join(before.select(*keys).distinct(), list(keys), "left_anti")


def compare_tests(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per test: fixed, passing, regressed, failing, added or removed, from passed before and after."""
    b, a = before.select(key, F.col("passed").alias("b")), after.select(key, F.col("passed").alias("a"))
    out = b.join(a, key, "full_outer")
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("b") & F.col("a"), "fixed").when(F.col("b") & ~F.col("a"), "regressed").when(F.col("a"), "passing").otherwise("failing")
    return out.select(key, kind.alias("outcome"))


def test_counters(output: Column) -> Column:
    """STRUCT<passed, failed, errors> from a test runner's summary text."""
    n = lambda word: F.coalesce(F.regexp_extract(output, rf"(\d+) {word}", 1).try_cast("int"), F.lit(0))
    return F.struct(n("passed").alias("passed"), n("failed").alias("failed"), n("errors?").alias("errors"))
