"""Smaller review operators over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.functions import text as X
from siltstone.operators import code as C
from siltstone.operators import graph as G
from siltstone.operators import review as V
from siltstone.operators import text as T
from siltstone.operators.validation import test_counters
from siltstone.plans import query
from siltstone.sources.tables import load


@query("""select event_id, case event_type when 'click' then 'Fix approved for t' || (user_id % 5) when 'view' then 'Analysis completed with ' || event_id || ' findings' when 'error' then 'Analysis failed: unknown error' when 'signup' then 'Signed in via GitHub' else 'Order paid now' end as line from events""")
def f26_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Activity lines from templates and metadata."""
    t = F.col("event_type")
    action = F.when(t == "click", "patch.approved").when(t == "view", "analysis.completed").when(t == "error", "analysis.failed").when(t == "signup", "auth.login").otherwise("order.paid_now")
    fields = F.when(t == "click", F.create_map(F.lit("target"), F.concat(F.lit("t"), F.col("user_id") % 5))).when(t == "view", F.create_map(F.lit("findings"), F.col("event_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return load(spark, sf, "events").select("event_id", V.activity_line(action, fields, F.lit("")).alias("line"))


@query("""select p_partkey, case p_partkey % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'medium' else 'low' end as linter, case when p_partkey % 5 = 0 then 'security' when p_partkey % 4 = 1 then 'performance' when p_partkey % 4 = 2 then 'bug' else 'code_quality' end as category,
 p_partkey % 2 = 0 and (p_size > 10 or p_partkey % 3 = 0) as ready, case p_type when 'PROMO' then 'perf' when 'SMALL' then 'refactor' else 'fix' end || '(' || p_partkey || '.py): ' || substr(p_name, 1, 60) as subject, 'a.py::' || case when p_size > 25 then p_brand || '.' else '' end || 'f' as qualified from part""")
def f25_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Rule severities, categories, readiness, commit subjects, qualified names."""
    k = F.col("p_partkey")
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (k % 4).cast("int"))
    category = F.when(F.col("p_type") == "PROMO", "performance").when(F.col("p_type") == "SMALL", "code_quality").otherwise("security")
    return load(spark, sf, "part").select(
        "p_partkey", V.linter_severity(pick("S608", "S101", "F401", "E501")).alias("linter"), V.pattern_category(pick("other", "Performance", "correctness", ""), k % 5 == 0).alias("category"),
        V.ready_for_review(k % 2 == 0, F.when(F.col("p_size") > 10, "open").otherwise("draft"), F.when(k % 3 == 0, "ready_for_review").otherwise("opened")).alias("ready"),
        V.commit_subject(F.concat(F.lit("src/"), k.cast("string"), F.lit(".py")), category, F.col("p_name")).alias("subject"), V.qualified_name(F.lit("a.py"), F.when(F.col("p_size") > 25, F.col("p_brand")), F.lit("f")).alias("qualified"),
    )


@query("""select n_nationkey, len(list_distinct(list_filter(['ruff', 'eslint', 'builtin_secrets', 'mypy'], lambda x: (x in ('ruff', 'builtin_secrets') or (x = 'eslint' and n_nationkey % 3 = 0)) and (x <> 'eslint' or n_nationkey % 2 = 0)))) as n from nation""")
def f17_scanners(spark: SparkSession, sf: str) -> DataFrame:
    """Scanners enabled or always on, of a family at hand."""
    four = F.array(*(F.struct(F.lit(n).alias("name"), F.array(F.lit(f)).alias("families")) for n, f in (("ruff", "python"), ("eslint", "javascript"), ("builtin_secrets", "any"), ("mypy", "python"))))
    pairs = load(spark, sf, "nation").select("n_nationkey", F.inline(four))
    enabled = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("ruff"), F.lit("eslint"))).otherwise(F.array(F.lit("ruff")))
    families = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("python"), F.lit("javascript"))).otherwise(F.array(F.lit("python")))
    return V.selected_scanners(pairs, enabled, families).groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query("""select conv_id, turn, 2 as added, 1 as removed, (conv_id % 90)::int as passed, case when turn % 2 = 0 then 3 else 0 end as failed from conversations""")
def x31_diff_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Added and removed lines, and test counters from output."""
    added, removed = X.diff_counts(F.concat(F.lit("--- a\n+++ b\n@@ -1 +1 @@\n+x\n-y\n+"), F.replace("text", F.lit("\n"), F.lit(" "))))
    out = F.concat(F.lit("== "), (F.col("conv_id") % 90).cast("string"), F.lit(" passed"), F.when(F.col("turn") % 2 == 0, ", 3 failed").otherwise(""), F.lit(" =="))
    n = test_counters(out)
    return load(spark, sf, "conversations").select("conv_id", "turn", added.alias("added"), removed.alias("removed"), n["passed"].alias("passed"), n["failed"].alias("failed"))


@query("""select o_orderkey, unnest([3 + o_orderkey % 9, 4 + o_orderkey % 9])::int as line, unnest(['b', 'd']) as text from orders""")
def w6_hinted_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Added lines with the hasty numbering, one too high."""
    patch = F.concat(F.lit("@@ -1,3 +"), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(",9 @@\n a\n+b\n-c\n+d"))
    return V.hinted_lines(load(spark, sf, "orders").select("o_orderkey", patch.alias("patch")), "o_orderkey", "patch")


@query("""select p_partkey, case p_partkey % 3 when 0 then 'src/m' || (p_partkey % 50) || '.py' when 1 then 'src/m' || (p_partkey % 50) || '.py' end as real from part""")
def j18_repaired_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths found again by themselves or by their endings."""
    p = load(spark, sf, "part")
    known = p.select(F.concat(F.lit("src/m"), F.col("p_partkey") % 50, F.lit(".py")).alias("path"))
    named = p.select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "src/m").when(F.col("p_partkey") % 3 == 1, "repo/src/m").otherwise("lost/q"), F.col("p_partkey") % 50, F.lit(".py")).alias("path"))
    return V.repaired_paths(named, known).select("p_partkey", "real")


@query("""select p_partkey as ord, case p_partkey % 4 when 0 then 'pkg/m' || (p_partkey % 20) || '.py' when 1 then 'pkg/m' || (p_partkey % 20) || '.py' when 2 then 'web/u' || (p_partkey % 20) || '.ts' end as resolved from part""")
def j17_resolved_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Imports resolved to the likeliest known path."""
    k = F.col("p_partkey")
    n = (k % 20).cast("string")
    module = F.when(k % 4 == 0, F.concat(F.lit("pkg.m"), n)).when(k % 4 == 1, F.concat(F.lit(".m"), n)).when(k % 4 == 2, F.concat(F.lit("../web/u"), n)).otherwise("react")
    p = load(spark, sf, "part")
    imports = p.select(k.alias("ord"), module.alias("module"), F.when(k % 4 == 2, "app/x.ts").otherwise("pkg/x.py").alias("file_path"))
    paths = p.select(F.explode(F.array(F.concat(F.lit("pkg/m"), n, F.lit(".py")), F.concat(F.lit("web/u"), n, F.lit(".ts")), F.concat(F.lit("web/u"), n, F.lit("/index.ts")))).alias("path"))
    return G.resolve_imports(imports, paths).select("ord", "resolved")


@query("""with s as (select p_partkey as ord, p_name as name, 's' || p_partkey as id, p_type as file_path from part) select o.o_orderkey as ord, (select min_by(id, s.ord) from s where name = case when o.o_orderkey % 2 = 0 then 'red widget' else 'none' end) as target from orders o""")
def j16_resolved_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls resolved to the first symbol of their last part."""
    calls = load(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("a.b."), F.when(F.col("o_orderkey") % 2 == 0, "red widget").otherwise("none")).alias("callee"))
    symbols = load(spark, sf, "part").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return G.resolve_calls(calls, symbols).select("ord", "target")


@query("""with s as (select p_partkey as ord, 's' || p_partkey as id, p_type as file_path, p_name as name, p_name as base from part) select a.id as source, max_by(b.id, b.ord) as target from s a join s b on a.file_path = b.file_path and a.base = b.name and b.ord < a.ord group by a.id""")
def j24_base_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Edges to bases declared earlier in the same file."""
    p = load(spark, sf, "part")
    return G.base_class_edges(p.select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("file_path"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.array("p_name").alias("bases")))


@query("""select 'src/m' || p_partkey || '.py' as file_path, s.kind, (s.a + case when s.kind in ('imports', 'module') then 0 else p_size % 7 end)::int as start_line, (s.b + p_size % 7)::int as end_line from part cross join (values ('imports', 1, 3), ('module', 1, 4), ('route', 5, 14), ('model', 15, 17)) s(kind, a, b)""")
def r1_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Files cut into imports, top-level symbols and runs of other lines."""
    from siltstone.plans.code import PYTHON, _files

    f = _files(spark, sf, PYTHON, ".py")
    return T.chunks(f, C.python_facts(f, "symbols"), C.python_facts(f, "imports")).select("file_path", "kind", "start_line", "end_line")


@query("""select o_orderkey, 'Order ' || o_orderkey || chr(10) || 'p' || o_custkey || chr(10) || 'add one' || chr(10) || 'go (x)' as query from orders""")
def r4_query_text(spark: SparkSession, sf: str) -> DataFrame:
    """Query text of a change."""
    o = load(spark, sf, "orders")
    title = o.select("o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"))
    changes = o.select("o_orderkey", F.lit(1).alias("ord"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("path"), F.lit("+++ b\n@@ -1 +1 @@\n+ add one \n-gone\n same").alias("patch"))
    return V.query_text(title, changes, o.select("o_orderkey", F.lit("go").alias("name"), F.lit("(x)").alias("signature")), "o_orderkey")


@query("""select doc_id, case when doc_id % 2 = 0 then 2 else 4 end as width, case when doc_id % 3 = 0 then 'single' else 'double' end as quotes, doc_id % 5 = 0 as semicolons from documents""")
def x38_style(spark: SparkSession, sf: str) -> DataFrame:
    """Indentation, quotes and line ends of a file."""
    k = F.col("doc_id")
    text = F.concat(F.lit("def f(a: int) -> int:\n"), F.when(k % 2 == 0, "  ").otherwise("    "), F.lit("return "), F.when(k % 3 == 0, "'x'").otherwise('"x"'), F.when(k % 5 == 0, ";").otherwise(""))
    s = V.style(text, F.lit("python"))
    return load(spark, sf, "documents").select("doc_id", s["width"].alias("width"), s["quotes"].alias("quotes"), s["semicolons"].alias("semicolons"))


@query("""select doc_id, case when doc_id % 3 = 2 then null else 2 end::int as first_line, case when doc_id % 3 = 2 then null else 4 end::int as last_line from documents""")
def x39_located_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The only place of a block, or none (X39, VP8)."""
    text = F.when(F.col("doc_id") % 3 == 2, "a\n b\nc\na\nb\nc").otherwise("x\n  b\n\n c\ny")
    out = load(spark, sf, "documents").select("doc_id", V.locate_block(text, F.lit("b\nc\n")).alias("at"))
    return out.select("doc_id", F.get("at", F.lit(0)).alias("first_line"), F.get("at", F.lit(1)).alias("last_line"))
