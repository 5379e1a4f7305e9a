"""Finding pipeline, windows, validation and state changes (X, W, VP, K, ST batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siltstone.checkpoints import fresh_path
from siltstone.functions import dims as D
from siltstone.functions import text as X
from siltstone.operators import code as C
from siltstone.operators import findings as P
from siltstone.operators import mutations as M
from siltstone.operators import validation as V
from siltstone.plans import query
from siltstone.plans.base import FINDINGS, findings
from siltstone.sources.tables import load
from siltstone.streaming import events as E, log as L, state as K


@query(FINDINGS + """ select distinct substr(sha256(file_path || '|' || category || '|' || rule_id || '|' || (start_line // 10)), 1, 32) as fingerprint,
 substr(sha256(file_path || '|' || category || '|' || trim(regexp_replace(lower(title), '[^a-z0-9_]+', '-', 'g'), '-') || '|' || (start_line // 10)), 1, 32) as by_title from findings where part_id % 3 = 0 or part_id % 3 > 0""")
def x3_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Identity of findings by rule or title and line tens."""
    f = findings(spark, sf)
    c = F.col
    return f.select(X.fingerprint(c("file_path"), c("category"), c("rule_id"), c("title"), c("start_line")).alias("fingerprint"), X.fingerprint(c("file_path"), c("category"), F.lit(None).cast("string"), c("title"), c("start_line")).alias("by_title")).distinct()


SCORED = FINDINGS + """, s as (select *, case source when 'bandit' then 0.75 when 'semgrep' then 0.8 when 'ruff' then 0.85 when 'mypy' then 0.85 when 'graph' then 0.7 else 0.6 end::double as prior,
  case when status = 'approved' then case when part_id % 2 = 0 then 1.0 else 0.7 end when status = 'rejected' then 0.5 else 0.4 end::double as rel0,
  case when source = 'ai_security' then 0.7 when source = 'mypy' then 1.0 else 0.9 end + 0.05 * least(part_id % 5, 3) as rep0 from findings),
t as (select *, case when confidence <> 0 then confidence else prior end as given, round(case when start_line > 28 then least(1.0, rel0 + 0.1) else rel0 end, 3)::double as contextual_relevance,
  round(least(1.0, case when category in ('secret', 'dependency') then greatest(rep0, 0.95) when category = 'architecture' then least(rep0, 0.75) else rep0 end), 3)::double as reproducibility_factor from s),
scored as (select *, round(round(least(100.0, sev_weight * given * contextual_relevance * reproducibility_factor * 100), 6), 1)::double as score from t)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    f = findings(spark, sf)
    c = F.col
    rel = P.relevance(c("status") == "approved", F.lit(True), c("part_id") % 2 == 0, c("status") == "rejected", c("start_line") > 28)
    return P.scored(f, rel, (c("part_id") % 5).cast("int"))


@query(SCORED + " select severity, source, category, count(*) as n, round(sum(score::decimal(12,1)), 1)::double as total, max(score) as top, min(contextual_relevance) as low_relevance, max(reproducibility_factor) as high_repro from scored group by all")
def x28_issue_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score from severity, confidence, relevance and reproducibility."""
    return _scored(spark, sf).groupBy("severity", "source", "category").agg(F.count("*").alias("n"), F.sum(F.col("score").cast("decimal(12,1)")).cast("double").alias("total"), F.max("score").alias("top"), F.min("contextual_relevance").alias("low_relevance"), F.max("reproducibility_factor").alias("high_repro"))


@query(SCORED + """ select * from (select analysis_id, part_id, start_line, severity, score, row_number() over (partition by analysis_id order by sev_rank desc, score desc, round(least(1.0, given), 3) desc, part_id, start_line, end_line, rule_id, created)::int as rank from scored) where rank <= 5""")
def o3_ranked_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Severity, score and confidence falling within each analysis (O3)."""
    return P.ranked(_scored(spark, sf), "part_id", "start_line", "end_line", "rule_id", "created").where("rank <= 5").select("analysis_id", "part_id", "start_line", "severity", "score", "rank")


@query(SCORED + """, r as (select *, substr(sha256(file_path || '|' || category || '|' || rule_id || '|' || (start_line // 10)), 1, 32) as fingerprint, row_number() over (partition by analysis_id order by sev_rank desc, score desc, round(least(1.0, given), 3) desc, part_id, start_line, end_line, rule_id, created) as rank from scored)
select analysis_id, fingerprint, min(rank)::int as rank from r group by all""")
def k4_persisted_findings(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each fingerprint of an analysis, the best ranked."""
    r = P.with_fingerprint(P.ranked(_scored(spark, sf), "part_id", "start_line", "end_line", "rule_id", "created"))
    return P.persistable(r).select("analysis_id", "fingerprint", "rank")


@query()
def w16_merged_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Leader clustering of findings of one file and category (W16, A21, J27); order-dependent, so rows only."""
    f = findings(spark, sf)
    f = f.select(F.xxhash64("analysis_id", "part_id", "start_line", "end_line", "amount", "created").alias("ord"), F.concat("file_path", F.lit("@"), (F.col("analysis_id") % 997).cast("string")).alias("file_path"), "category", "severity", "source", "rule_id", "cwe", "title", F.col("title").alias("description"), F.col("start_line").cast("int"), F.col("end_line").cast("int"), "confidence", F.array("rule_id").alias("related_files"))
    return P.merge_findings(f)


@query("""select l_orderkey, l_linenumber, l_partkey, case when syntax = false then 0.0 when tests = false then least(35.0, round(total, 1)) else round(total, 1) end::double as confidence from (
 select *, round(100 * (case when syntax is null then 0.125 when syntax then 0.25 else 0 end + case when lint is null then 0.075 when lint then 0.15 else 0 end + case when typed is null then 0.075 when typed then 0.15 else 0 end
   + case when tests is null then 0.125 when tests then 0.25 else 0 end + case when secure is null then 0.05 when secure then 0.10 else 0 end + 0.10 * case when sim <= 0 then 0.0 when sim >= 0.85 then 1.0 when sim >= 0.6 then 0.75 when sim >= 0.4 then 0.5 else 0.2 end), 6) as total
 from (select l_orderkey, l_linenumber, l_partkey, l_discount * 10 as sim, l_suppkey % 7 <> 0 as syntax, case l_partkey % 3 when 0 then true when 1 then false end as lint, case l_partkey % 4 when 0 then true when 1 then false end as typed,
   case l_suppkey % 5 when 0 then null when 1 then false else true end as tests, l_partkey % 11 <> 0 as secure from lineitem))""")
def a30_fix_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Three-valued signals weighed into one confidence (A30, X29, VP5, VP6)."""
    m = lambda c, n, t, f: F.when(F.col(c) % n == t, True).when(F.col(c) % n == f, False)
    s = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") * 10).alias("semantic_similarity"), (F.col("l_suppkey") % 7 != 0).alias("syntax_validation"), m("l_partkey", 3, 0, 1).alias("lint_success"), m("l_partkey", 4, 0, 1).alias("typecheck_success"), F.when(F.col("l_suppkey") % 5 == 0, F.lit(None)).otherwise(F.col("l_suppkey") % 5 != 1).alias("test_success"), (F.col("l_partkey") % 11 != 0).alias("security_scan_success"))
    return s.select("l_orderkey", "l_linenumber", "l_partkey", V.fix_confidence().alias("confidence"))


@query("""select l_returnflag, risk, auto, count(*) as n from (select *, conf >= 85 and risk = 'low' and l_partkey % 3 <> 0 and l_partkey % 5 <> 0 and l_linenumber <> 7 as auto from
 (select *, case when l_linenumber = 1 or lines > 40 then 'high' when conf >= 85 and lines <= 10 then 'low' when conf >= 65 and lines <= 30 then 'medium' else 'high' end as risk from
 (select *, l_quantity as lines, 100 - l_discount * 400 as conf from lineitem))) group by all""")
def x30_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Risk of applying a patch and whether it may be offered."""
    c = F.col
    category, conf = F.when(c("l_linenumber") == 1, "architecture").otherwise("bug"), 100 - c("l_discount") * 400
    risk = V.risk_level(category, c("l_quantity"), conf)
    auto = V.auto_apply(conf, risk, F.when(c("l_linenumber") == 7, "critical").otherwise("low"), c("l_partkey") % 3 != 0, F.lit(None).cast("boolean"), F.lit(True), c("l_partkey") % 5 != 0, F.lit(None).cast("boolean"))
    return load(spark, sf, "lineitem").select("l_returnflag", risk.alias("risk"), auto.alias("auto")).groupBy("l_returnflag", "risk", "auto").agg(F.count("*").alias("n"))


@query("""select o_orderkey, case when b then 'passed' else 'failed' end as parse, case when not b then 'skipped' when l is null then 'skipped' when l then 'passed' else 'failed' end as lint, case when b and l is distinct from false then 'passed' else 'failed' end as status,
 bad is null as gate from (select o_orderkey, o_orderkey % 9 <> 0 as b, case o_orderkey % 3 when 0 then null when 1 then true else false end as l from orders) left join (select distinct l_orderkey as bad from lineitem where l_quantity > 45) on bad = o_orderkey""")
def vp1_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Validation steps, status and the lint gate (VP1-VP3, VP5)."""
    c = F.col
    o = load(spark, sf, "orders").select("o_orderkey", (c("o_orderkey") % 9 != 0).alias("b"), F.when(c("o_orderkey") % 3 != 0, c("o_orderkey") % 3 == 1).alias("l"))
    bad = load(spark, sf, "lineitem").select(c("l_orderkey").alias("o_orderkey"), F.when(c("l_quantity") > 45, "high").otherwise("low").alias("severity"))
    out = V.gate(o, bad, "o_orderkey")
    s = V.steps(parse=c("b"), lint=c("l"))
    return out.select("o_orderkey", s[0]["status"].alias("parse"), s[1]["status"].alias("lint"), V.status(c("b"), c("l")).alias("status"), c("passed").alias("gate"))


@query("""with b as (select l_partkey as test, bool_and(l_discount > 0.01) as passed from lineitem where l_linenumber <= 3 group by 1), a as (select l_partkey as test, bool_and(l_tax > 0.005) as passed from lineitem where l_linenumber > 3 group by 1)
select outcome, count(*) as n from (select case when b.passed is null then 'added' when a.passed is null then 'removed' when not b.passed and a.passed then 'fixed' when b.passed and not a.passed then 'regressed' when a.passed then 'passing' else 'failing' end as outcome from b full join a using (test)) group by 1""")
def vp4_compare_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Tests before and after (VP4)."""
    l = load(spark, sf, "lineitem")
    b = l.where("l_linenumber <= 3").groupBy(F.col("l_partkey").alias("test")).agg(F.bool_and(F.col("l_discount") > 0.01).alias("passed"))
    a = l.where("l_linenumber > 3").groupBy(F.col("l_partkey").alias("test")).agg(F.bool_and(F.col("l_tax") > 0.005).alias("passed"))
    return V.compare_tests(b, a, "test").groupBy("outcome").agg(F.count("*").alias("n"))


@query("""with n as (select c_custkey, c_name || '*' as c_name, case when c_custkey % 4 = 0 then null else c_acctbal + 1 end as c_acctbal from customer where c_custkey % 3 = 0 union all select c_custkey + 1000000, 'new', 1.0 from customer where c_custkey % 100 = 0)
select coalesce(o.c_custkey, n.c_custkey) as c_custkey, coalesce(n.c_name, o.c_name) as c_name, coalesce(n.c_acctbal, o.c_acctbal) as c_acctbal, o.c_mktsegment from customer o full join n on o.c_custkey = n.c_custkey""")
def k1_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Merge by key, nulls leaving old values, last write first."""
    c = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(2).alias("at"))
    stale = new.withColumn("c_name", F.lit("stale")).withColumn("at", F.lit(1))
    more = c.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(1.0).alias("c_acctbal"), F.lit(2).alias("at"))
    return M.upsert(c, new.unionByName(more).unionByName(stale), ["c_custkey"], order="at")


@query("""select o_orderkey, case when o_orderstatus in ('O', 'P') and o_totalprice < 100000 then 'F' else o_orderstatus end as status,
  case when o_orderpriority = '1-URGENT' and o_orderstatus in ('O') then 'approved' when o_orderpriority = '5-LOW' and o_orderstatus in ('O', 'P') then 'rejected' else o_orderstatus end as moved from orders""")
def k7_conditional_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional updates and guarded transitions (K7-K9, VP9)."""
    o = load(spark, sf, "orders")
    out = M.update_where(o.withColumn("status", F.col("o_orderstatus")), F.col("o_orderstatus").isin("O", "P") & (F.col("o_totalprice") < 100000), status=F.lit("F"))
    moves = {"1-URGENT": (("O",), "approved"), "5-LOW": (("O", "P"), "rejected")}
    return out.select("o_orderkey", "status", M.move(F.col("o_orderstatus"), F.col("o_orderpriority"), moves).alias("moved"))


@query("""with gone as (select c_custkey from customer where c_mktsegment = 'MACHINERY'), o as (select * from orders where o_custkey not in (select c_custkey from gone))
select 'customer' as name, count(*) as n from customer where c_custkey not in (select c_custkey from gone) union all select 'orders', count(*) from o union all select 'lineitem', count(*) from lineitem where l_orderkey in (select o_orderkey from o)""")
def k10_cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """What a cascading delete leaves."""
    c = load(spark, sf, "customer")
    left = M.cascade_delete(c, c.where("c_mktsegment = 'MACHINERY'"), "c_custkey", ("orders", load(spark, sf, "orders"), "o_custkey", "o_orderkey"), ("lineitem", load(spark, sf, "lineitem"), "l_orderkey", "l_orderkey"))
    from siltstone.operators.relational import table_totals

    return table_totals(customer=left["root"], orders=left["orders"], lineitem=left["lineitem"])


@query("""select c_custkey, coalesce(n, 0) as n from (select c_custkey from customer union select distinct o_custkey from orders) left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey""")
def k11_get_or_create(spark: SparkSession, sf: str) -> DataFrame:
    """Rows created where missing, with defaults."""
    have, need = load(spark, sf, "customer").select("c_custkey"), load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    counts = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    out = M.add_missing_columns(M.insert_missing(have, need, ["c_custkey"]), n="bigint")
    return out.join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", "k", F.lit(0)).alias("n"))


@query("""select count(*) as n, min(event_id) as first from events where ts < (select max(ts) from events) - interval 14400 minutes""")
def k20_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Rows older than their time to live (K20, ST10)."""
    e = load(spark, sf, "events")
    return M.older_than(e, "ts", e.agg(F.max("ts")).scalar(), 14400).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query(FINDINGS + """, d as (select * from (values ('critical', 5), ('high', 4), ('medium', 3), ('low', 2), ('informational', 1)) t(s, r)), a as (select analysis_id from findings group by 1),
c as (select a.analysis_id, s, r, count(f.severity) as n from a cross join d left join findings f on f.analysis_id = a.analysis_id and f.severity = s group by all)
select analysis_id, string_agg(s || ' ' || n, chr(10) order by r desc) as report, coalesce(string_agg(s || ' ' || n, ', ' order by r desc) filter (where n > 0), '') as short from c group by 1""")
def k17_report(spark: SparkSession, sf: str) -> DataFrame:
    """Text report over all severities, and one over those found."""
    f = findings(spark, sf)
    counts = f.groupBy("analysis_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in D.SEVERITIES])
    every = [F.concat(F.lit(s + " "), F.col(s).cast("string")) for s in D.SEVERITIES]
    some = F.filter(F.array(*[F.when(F.col(s) > 0, e) for s, e in zip(D.SEVERITIES, every)]), lambda x: x.isNotNull())
    return counts.select("analysis_id", F.array_join(F.array(*every), "\n").alias("report"), F.array_join(some, ", ").alias("short"))


@query("""select user_id, event_id, ts, elapsed from (select user_id, event_id, ts, round((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts))) / 1000000.0, 2)::double as elapsed from events)""")
def w18_elapsed(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds since the row before."""
    return E.elapsed(load(spark, sf, "events"), "user_id", "ts").select("user_id", "event_id", "ts", "elapsed")


@query("""with t as (select user_id, event_type, (epoch_us(lead(ts) over (partition by user_id order by ts)) - epoch_us(ts)) / 1000000.0 as s from events) select user_id, event_type, round(round(sum(s), 2), 0)::bigint as seconds from t where s is not null group by all""")
def a23_stage_timings(spark: SparkSession, sf: str) -> DataFrame:
    """Time spent in each stage, as a map and exploded again."""
    return E.stage_timings(load(spark, sf, "events"), "user_id", "ts", "event_type").select("user_id", F.explode("timings").alias("event_type", "s")).select("user_id", "event_type", F.round("s", 0).cast("long").alias("seconds"))


@query("""select user_id, n, (lo)::bigint as start, (hi)::bigint as "end" from (select user_id, min(d) as lo, max(d) as hi, count(*) as n from (select user_id, d, d - row_number() over (partition by user_id order by d) as g from (select distinct user_id, date_diff('day', date '2024-01-01', ts::date) as d from events where event_type = 'error')) group by user_id, g) where n >= 2""")
def w11_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of consecutive days."""
    from siltstone.operators.text import islands

    e = load(spark, sf, "events").where("event_type = 'error'").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("d"))
    return islands(e, "d", "user_id", least=2).select("user_id", (F.col("end") - F.col("start") + 1).alias("n"), "start", "end")


@query("""select event_id, max(event_type = 'error') over (partition by user_id order by ts, event_id rows between 5 preceding and current row) as after_error, max(event_type = 'purchase') over (partition by user_id order by ts, event_id rows between current row and 3 following) as before_purchase from events""")
def w7_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Row frames before and after."""
    back = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, 0)
    ahead = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, 3)
    return load(spark, sf, "events").select("event_id", F.max(F.col("event_type") == "error").over(back).alias("after_error"), F.max(F.col("event_type") == "purchase").over(ahead).alias("before_purchase"))


@query("""select conv_id, turn, tokens, sum(tokens) over (partition by conv_id order by turn rows unbounded preceding)::bigint as running_cost from (select conv_id, turn, greatest(1, length(text) // 4)::int as tokens from conversations) qualify sum(tokens) over (partition by conv_id order by turn rows unbounded preceding) <= 400""")
def w13_until_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in order until a budget is full."""
    from siltstone.operators.vectors import until_budget

    c = load(spark, sf, "conversations").select("conv_id", "turn", X.token_estimate(F.col("text")).alias("tokens"))
    return until_budget(c, "conv_id", [F.asc("turn")], "tokens", 400)


@query("""with recursive c as (select conv_id, turn, role, greatest(1, length(text) // 4)::bigint as tokens, row_number() over (partition by conv_id order by length(text) desc, turn) as rn from conversations),
g as (select conv_id, turn, role, tokens, rn, tokens <= 300 as take, case when tokens <= 300 then tokens else 0 end as used from c where rn = 1
 union all select c.conv_id, c.turn, c.role, c.tokens, c.rn, g.used + c.tokens <= 300, case when g.used + c.tokens <= 300 then g.used + c.tokens else g.used end from c join g on c.conv_id = g.conv_id and c.rn = g.rn + 1)
select conv_id, turn, tokens from g where take""")
def w12_greedy_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in order, skipping those that break the budget."""
    from siltstone.operators.vectors import select_within_budget

    c = load(spark, sf, "conversations").select("conv_id", (-F.length("text")).alias("o"), "turn", "role", X.token_estimate(F.col("text")).alias("tokens"))
    return select_within_budget(c, "conv_id", ["o", "turn"], "role", "tokens", 3, 300).select("conv_id", "turn", F.col("tokens").cast("long").alias("tokens"))


@query(FINDINGS + """, f as (select analysis_id, start_line, confidence as given, replace(file_path, '.py', ['.py', '.ts', '.TSX', '.txt'][part_id % 4 + 1]) as file_path, part_id % 4 in (1, 2) as degraded from findings)
select analysis_id, start_line, file_path, degraded, case when degraded then greatest(0.0, round(given - 0.2, 6)) else given end::double as confidence from f""")
def p8_degraded_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Less confidence in findings of files whose language has no parser here."""
    suffix = F.get(F.array(*map(F.lit, (".py", ".ts", ".TSX", ".txt"))), (F.col("part_id") % 4).cast("int"))
    f = findings(spark, sf).withColumn("file_path", F.replace(F.col("file_path"), F.lit(".py"), suffix))
    return C.degraded(f, ("typescript", "tsx")).select("analysis_id", "start_line", "file_path", "degraded", F.col("confidence").cast("double").alias("confidence"))


@query("""with p as (select conv_id, turn, case turn % 3 when 0 then 'gemini-2.5-flash-lite' when 1 then 'llama-3.1-8b-instant-x' else 'unknown' end as model, length(text)::bigint * 100 as p, greatest(1, length(text) // 4)::bigint as c from conversations),
q as (select *, case turn % 3 when 0 then 0.30 when 1 then 0.05 else 1.25 end as pp, case turn % 3 when 0 then 2.50 when 1 then 0.08 else 10.0 end as cp from p)
select conv_id, turn, model, round(round(p / 1000000.0::double * pp::double + c / 1000000.0::double * cp::double, 9), 6) as cost from q""")
def x7_call_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Price by the first known name that begins the model's."""
    model = F.when(F.col("turn") % 3 == 0, "gemini-2.5-flash-lite").when(F.col("turn") % 3 == 1, "llama-3.1-8b-instant-x").otherwise("unknown")
    c = load(spark, sf, "conversations").select("conv_id", "turn", model.alias("model"), (F.length("text").cast("long") * 100).alias("p"), X.token_estimate(F.col("text")).alias("c"))
    return c.select("conv_id", "turn", "model", D.call_cost(F.col("model"), F.col("p"), F.col("c")).alias("cost"))


@query("""select user_id, time_bucket(interval 1 hour, ts) as start, count(*) as n from events group by all having count(*) > 1""")
def st8_fixed_window_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed windows over a limit (ST8)."""
    return E.fixed_window_limit(load(spark, sf, "events"), "user_id", "ts", "1 hour", 1)


@query("""select event_id, hits, hits > 2 as rejected from (select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 7199999999 preceding and current row) as hits from events)""")
def st9_sliding_log(spark: SparkSession, sf: str) -> DataFrame:
    """Hits in a trailing span, rejected ones counted too (ST9)."""
    return E.sliding_log(load(spark, sf, "events"), "user_id", "ts", 7200, 2).select("event_id", "hits", "rejected")


@query("""select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn <= 20""")
def st2_history(spark: SparkSession, sf: str) -> DataFrame:
    """Last rows of each key (ST2, S15)."""
    return E.history(load(spark, sf, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


@query("""select user_id, after, ((gap - 1) // 86400000000)::bigint as beats from (select user_id, ts as after, epoch_us(lead(ts) over (partition by user_id order by ts)) - epoch_us(ts) as gap from events) where gap > 86400000000""")
def st4_heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    """Silences and the beats in them (ST4)."""
    return E.heartbeats(load(spark, sf, "events"), "user_id", "ts", 86400)


@query("""select user_id, event_id from events e where ts <= coalesce((select min(ts) from events t where t.user_id = e.user_id and t.event_type = 'purchase'), ts)""")
def st5_until_terminal(spark: SparkSession, sf: str) -> DataFrame:
    """Rows up to the first terminal one (ST5)."""
    return E.until_terminal(load(spark, sf, "events"), "user_id", "ts", "event_type", ("purchase",)).select("user_id", "event_id")


@query("""with r as (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn, count(*) over (partition by user_id) as seen from events) select user_id, event_id, seen from r where rn <= 20""")
def st2_history_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events played as a stream that is stopped and restarted: the history that its state holds at the end (ST2, ST10)."""
    sent = K.to_the_end(load(spark, sf, "events"), "ts", lambda s: K.stream_history(s, "user_id", "ts", "event_id", 20))
    return sent.groupBy("user_id").agg(F.max_by("ids", "seen").alias("ids"), F.max("seen").alias("seen")).select("user_id", F.explode("ids").alias("event_id"), "seen")


@query("""with g as (select user_id, ts as after, epoch_us(coalesce(lead(ts) over (partition by user_id order by ts), timestamp '2024-02-10 00:00:00')) - epoch_us(ts) as gap from events),
n as (select user_id, after, (gap - 1) // 86400000000 as n from g where gap > 86400000000) select user_id, after, unnest(range(1, n + 1)) as beat from n""")
def st4_beats_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Beats that timers send on a stream, up to a time after its end (ST4)."""
    sent = K.to_the_end(load(spark, sf, "events"), "ts", lambda s: K.stream_beats(s, "user_id", "ts", 86400), until="2024-02-10")
    return sent.where(F.col("after") + F.make_interval(days=F.col("beat").cast("int")) < F.lit("2024-02-10").cast("timestamp")).select("user_id", F.col("after").cast("timestamp_ntz").alias("after"), "beat")


@query("""select user_id, event_id, event_type from events e where ts <= coalesce((select min(ts) from events t where t.user_id = e.user_id and t.event_type = 'purchase'), ts)""")
def st5_until_terminal_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Rows up to the first terminal one, on a stream (ST5)."""
    return K.to_the_end(load(spark, sf, "events"), "ts", lambda s: K.stream_until_terminal(s, "user_id", "ts", "event_type", "event_id", ("purchase",)))


@query("""select user_id, event_id, hits, hits > 2 as rejected from (select user_id, event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 7199999999 preceding and current row) as hits from events)""")
def st9_sliding_log_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Hits in a trailing span, on a stream that keeps no more than the span (ST9)."""
    return K.to_the_end(load(spark, sf, "events"), "ts", lambda s: K.stream_sliding_log(s, "user_id", "ts", "event_id", 7200, 2))


@query("""with t as (select *, case when event_id % 2 = 0 then 'even' else 'odd' end as writer from events)
select 'all' as topic, writer, event_id, user_id, ts, event_type from t union all select 'ends' as topic, writer, event_id, user_id, ts, event_type from t where event_type in ('purchase', 'error')""")
def st7_topics_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams publish to two topics of a log; one reader a topic follows both, stopped and restarted between them (K14, ST1, ST3, ST7)."""
    events = load(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    log, out, at = (fresh_path(spark, n) for n in ("log", "log-read", "log-state"))
    topics = {"all": L.Topic(), "ends": L.Topic("event_type in ('purchase', 'error')")}

    def play(writer) -> None:
        writer.trigger(availableNow=True).start().awaitTermination()

    for odd, name in enumerate(("even", "odd")):
        rows = f"{log}-{name}"
        events.where(F.col("event_id") % 2 == odd).write.parquet(rows)
        play(L.publish_to(spark.readStream.schema(events.schema).parquet(rows), log, name, topics, f"{at}/{name}"))
        for topic in topics:
            play(L.follow(spark, log, topic, schema, "query").writeStream.format("parquet").option("path", f"{out}/topic={topic}").option("checkpointLocation", f"{at}/{topic}"))
    read = [spark.read.parquet(f"{out}/topic={topic}").withColumn("topic", F.lit(topic)) for topic in topics]
    return read[0].unionByName(read[1]).select("topic", "writer", *events.columns)


@query("""with s as (select user_id, event_type as status, ts as "at", row_number() over (partition by user_id order by ts desc, event_type desc) as rn from events)
select user_id, "at", case when status in ('click', 'view') then 'failed' else status end as status, status not in ('signup') as may_start from s where rn = 1""")
def st11_states(spark: SparkSession, sf: str) -> DataFrame:
    """Current state of each key, recovery and the duplicate-run guard (ST11, ST13, K8)."""
    s = E.last_status(load(spark, sf, "events"), "user_id", "ts", "event_type")
    s = s.withColumn("was", F.col("status")).withColumn("status", F.when(F.col("status").isin("click", "view"), "running").when(F.col("status") == "signup", "signup").otherwise(F.col("status")))
    out = E.recovered(s)
    return out.select("user_id", "at", "status", (F.col("was") != "signup").alias("may_start"))


@query("""select user_id, min(ts) as start, max(ts) + interval 6 hours as "end", count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts) as g from (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) < 21600000000 then 0 else 1 end as fresh from events)) group by user_id, g""")
def ext_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: sessions with a six-hour gap."""
    return E.sessions(load(spark, sf, "events"), "user_id", "ts", "6 hours")


@query("""select user_id, start, count(*) as n from (select user_id, unnest([time_bucket(interval 1 day, ts), time_bucket(interval 1 day, ts, timestamp '2024-01-01 12:00:00')]) as start from events) group by all""")
def ext_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: overlapping windows."""
    return E.sliding_counts(load(spark, sf, "events"), "user_id", "ts", "1 day", "12 hours")


@query("""select count(*) as n, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as total, count(*) filter (where json_extract_string(props, '$.none') is null) as missing from events""")
def x40_json_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of semi-structured columns with defaults."""
    v = X.extract_json(F.col("props"))
    e = load(spark, sf, "events").select(F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.none", "bigint").alias("none"))
    return e.agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.count_if(F.col("none").isNull()).alias("missing"))


@query("""select strftime(ts, '%Y-%m-%d') as day, hour(ts)::int as hour, count(*) as n, case when sum(value) < 60 then 'small' else 'large' end as size from events group by all""")
def x34_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Day and hour buckets and formatted dates."""
    return load(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.when(F.sum("value") < 60, "small").otherwise("large").alias("size"))
