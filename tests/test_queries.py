"""Every registered query of the library against its DuckDB SQL, and the entry without the training-data subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

from siltstone.plans import catalog
from siltstone.sources.tables import TABLES, register

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
there = pytest.mark.skipif(not os.path.isdir(SF), reason="no data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@there
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())


@there
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).schema


@there
def test_views(spark):
    register(spark, SF, "nation", "region")
    assert spark.sql("select count(*) as n from nation join region on n_regionkey = r_regionkey").first().n == 25


def test_entry_without_subpackage(tmp_path):
    code = "import sys; sys.modules['siltstone.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q); print('ok')"
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert run.stdout.strip().endswith("ok"), run.stderr
