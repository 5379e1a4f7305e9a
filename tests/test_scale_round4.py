"""Merging of many small runs of findings."""

import random

from siltstone.operators import findings as P
from tests.test_findings import KINDS, row


def test_bundles_change_nothing(spark):
    rng = random.Random(9)
    rows = [row(i, file_path=f"f{rng.randrange(60)}.py", rule_id=rng.choice(("", "B608", f"r{i}")), title=rng.choice(("SQL injection", "Open redirect", f"Odd {i}")), start_line=(s := rng.randrange(1, 200)), end_line=s + 3) for i in range(200)]
    df = spark.createDataFrame(rows, KINDS)
    got = [sorted(map(str, P.merge_findings(df, bundle=n).collect())) for n in (20_000, 7)]
    assert got[0] == got[1] and len(got[0]) < 200


def test_a_finding_alone_does_not_reach_python(spark):
    df = spark.createDataFrame([row(i, file_path=f"f{i}.py") for i in range(40)], KINDS)
    plan = P.merge_findings(df)
    assert plan.count() == 40 and plan.where("members = 1 and size(corroborating_sources) = 0").count() == 40
    assert "Union" in plan._jdf.queryExecution().optimizedPlan().toString()
