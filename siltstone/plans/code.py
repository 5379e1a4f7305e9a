"""Code analysis over source text made from the tables (P, rule families)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.operators import code as C
from siltstone.plans import query
from siltstone.sources.tables import load, spread

PYTHON = '''import os, requests
from .db import session
LIMIT = 5
@app.post("/x")
async def save_%d(path, url: str):
    requests.get(url, verify=False)
    for row in rows:
        session.execute(f"select * from t where id = {row}")
    try:
        open(path)
    except:
        pass
    return 1
    print(2)
class Thing_%d(BaseModel):
    def go(self, a):
        return a if a and self.b else [x for x in a if x]
'''
SCRIPT = """import x from './x';
const y = require("y");
export function run_%d(a) { if (a) { return eval(a); } }
for (const r of rows) {
  await db.find(r);
}
el.innerHTML = a;
try { f(); } catch (e) {}
"""


def _files(spark: SparkSession, sf: str, text: str, suffix: str) -> DataFrame:
    """A file for each part, named after its key, with as many blank lines at its top as its size leaves when divided by 7."""
    n = F.col("p_partkey").cast("string")
    top = F.repeat(F.lit("\n"), F.col("p_size") % 7)
    p = spread(load(spark, sf, "part").select("p_partkey", "p_size"))
    return p.select(F.concat(F.lit("src/m"), n, F.lit(suffix)).alias("path"), F.concat(top, F.replace(F.lit(text), F.lit("%d"), n)).alias("content"))


@query("""select 'src/m' || p_partkey || '.py' as file_path, s.name || case when s.numbered then p_partkey::varchar else '' end as name, s.kind, (s.a + p_size % 7)::int as start_line, (s.b + p_size % 7)::int as end_line, s.cx::int as complexity
from part cross join (values ('LIMIT', false, 'constant', 3, 3, 1), ('save_', true, 'route', 5, 14, 3), ('Thing_', true, 'model', 15, 17, 1), ('go', false, 'method', 16, 17, 5)) s(name, numbered, kind, a, b, cx)""")
def p1_python_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols and complexity of Python files."""
    return C.python_facts(_files(spark, sf, PYTHON, ".py"), "symbols").select("file_path", "name", "kind", "start_line", "end_line", "complexity")


@query("""select 'src/m' || p_partkey || '.py' as file_path, s.kind, s.what, (s.line + p_size % 7)::int as line from part cross join (values ('import', 'os', 1), ('import', 'requests', 1), ('import', '.db', 2), ('call', 'app.post', 4), ('call', 'requests.get', 6), ('call', 'session.execute', 8), ('call', 'open', 10), ('call', 'print', 14)) s(kind, what, line)""")
def p2_imports_and_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Imports and calls of Python files."""
    f = _files(spark, sf, PYTHON, ".py")
    return C.python_facts(f, "uses")


@query("""select 'src/m' || p_partkey || '.py' as file_path, s.rule_id, s.severity, (s.line + p_size % 7)::int as start_line from part cross join (values ('python.sql-injection', 'critical', 8), ('python.blocking-call-in-async', 'high', 6), ('python.ssrf', 'high', 6), ('python.missing-timeout', 'medium', 6),
('python.tls-verification-disabled', 'high', 6), ('python.path-traversal', 'high', 10), ('python.n-plus-one-query', 'medium', 8), ('python.route-missing-auth', 'high', 5), ('python.missing-input-validation', 'medium', 5), ('python.swallowed-exception', 'medium', 11), ('python.dead-code', 'low', 14)) s(rule_id, severity, line)""")
def p_python_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Python rules over a file that breaks most of them (python.* rules, F11)."""
    found = C.python_facts(_files(spark, sf, PYTHON, ".py"), "findings")
    none = spark.createDataFrame([], "file_path string, lines array<int>")
    return C.in_changed_lines(found, none).select("file_path", "rule_id", "severity", "start_line")


@query("""select 'src/m' || p_partkey || '.ts' as file_path, s.rule_id, (s.line + p_size % 7)::int as start_line from part cross join (values ('js.dynamic-code-execution', 3), ('js.await-in-loop', 5), ('js.xss-inner-html', 7), ('js.empty-catch', 8)) s(rule_id, line)""")
def p6_javascript_rules(spark: SparkSession, sf: str) -> DataFrame:
    """JavaScript line rules (P6, js.* rules, W7-W9)."""
    return C.javascript_findings(_files(spark, sf, SCRIPT, ".ts")).select("file_path", "rule_id", "start_line")


@query("""select 'src/m' || p_partkey || '.ts' as file_path, 'run_' || p_partkey as name, 'function' as kind, true as ok, 2::bigint as imports from part""")
def p7_javascript_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """JavaScript symbols, imports and balanced delimiters."""
    f = _files(spark, sf, SCRIPT, ".ts")
    s = C.javascript_symbols(f)
    i = C.javascript_imports(f).groupBy("file_path").agg(F.count("*").alias("imports"))
    ok = f.select(F.col("path").alias("file_path"), C.balanced(F.col("content")).alias("ok"))
    return s.join(i, "file_path").join(ok, "file_path").select("file_path", "name", "kind", "ok", "imports")


@query("""select p_partkey, case p_partkey % 3 when 0 then 'requests.get(u, verify=True)' when 1 then 'api_key = os.environ["API_KEY"]' end as after from part""")
def vp7_fixes(spark: SparkSession, sf: str) -> DataFrame:
    """Mechanical fixes by rule (VP7, V6)."""
    k = F.col("p_partkey") % 3
    rule = F.when(k == 0, "python.tls-verification-disabled").when(k == 1, "hardcoded-secret").otherwise("none")
    code = F.when(k == 0, "requests.get(u, verify=False)").otherwise('api_key = "abc"')
    return load(spark, sf, "part").select("p_partkey", C.fixed(rule, code).alias("after"))


@query("""select case p_partkey % 2 when 0 then 'app/domain/m' else 'app/api/m' end || p_partkey || '.py' as file_path, 'app/services/s.py' as resolved, 3 as line from part where p_partkey % 2 = 0""")
def j28_layering(spark: SparkSession, sf: str) -> DataFrame:
    """Imports against the order of layers, the first of each file."""
    d = F.when(F.col("p_partkey") % 2 == 0, "app/domain/m").otherwise("app/api/m")
    i = load(spark, sf, "part").select(F.concat(d, F.col("p_partkey").cast("string"), F.lit(".py")).alias("file_path"), F.explode(F.array(F.struct(F.lit("app/services/s.py").alias("resolved"), F.lit(3).alias("line")), F.struct(F.lit("app/services/t.py").alias("resolved"), F.lit(9).alias("line")))).alias("x"))
    return C.layering_violations(i.select("file_path", "x.resolved", "x.line"))
