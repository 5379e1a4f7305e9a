"""Filters, joins, aggregates, sorts and set operations (F, J, A, O, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siltstone.functions.dims import severity_rank
from siltstone.operators import relational as R
from siltstone.plans import query
from siltstone.plans.base import FINDINGS, findings
from siltstone.sources.tables import load


@query(FINDINGS + """
select analysis_id, file_path, category, severity, sev_rank as rank, start_line, confidence, amount from findings
where severity in ('critical', 'high') and category in ('security', 'secret', 'dependency') and source <> 'graph' and status = 'proposed' and confidence >= 0.5
order by amount desc""")
def f5_findings_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Dynamic conjunctive filter with IN, equality, inequality and range, score falling."""
    df = R.where_all(findings(spark, sf), R.one_of("severity", ["critical", "high"]), R.one_of("category", ["security", "secret", "dependency"]), F.col("source") != "graph", R.equals("status", "proposed"), R.minimum("confidence", 0.5))
    return df.select("analysis_id", "file_path", "category", "severity", severity_rank(F.col("severity")).alias("rank"), "start_line", "confidence", "amount").orderBy(F.desc("amount"))


@query(FINDINGS + " select severity, count(*) as n from findings where sev_rank >= 3 group by severity")
def f6_over_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinal severity threshold."""
    from siltstone.operators.findings import over_threshold

    return over_threshold(findings(spark, sf), "medium").groupBy("severity").agg(F.count("*").alias("n"))


@query("select c_custkey, c_name from customer where lower(trim(c_mktsegment)) in ('building', 'machinery') and (contains(lower(c_name), '00012') or contains(lower(c_mktsegment), 'chin'))")
def f7_text_search(spark: SparkSession, sf: str) -> DataFrame:
    """Case-insensitive equality, allow-list and substring search over several columns."""
    c = load(spark, sf, "customer")
    return R.search(c.where(R.on_allow_list(F.col("c_mktsegment"), " Building, MACHINERY ,")), "00012", "c_name").select("c_custkey", "c_name").unionByName(
        R.search(c.where(R.same_text(F.col("c_mktsegment"), "machinery")), "chin", "c_mktsegment").select("c_custkey", "c_name")
    ).distinct()


@query("select p_type, count(*) as n, count(*) filter (where regexp_matches(p_name, '(ring|bolt)$')) as by_suffix, count(*) filter (where p_size not between 5 and 45) as outside from part where p_brand <> 'Brand#1' group by p_type")
def f14_suffix_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Suffix selection and negated ranges."""
    p = load(spark, sf, "part").where(F.col("p_brand") != "Brand#1")
    return p.groupBy("p_type").agg(F.count("*").alias("n"), F.count_if(F.col("p_name").rlike("(ring|bolt)$")).alias("by_suffix"), F.count_if(~F.col("p_size").between(5, 45)).alias("outside"))


@query("""select l_returnflag, count(*) as n, coalesce(round(avg(case when l_tax <> 0 then l_tax end), 4), 0) as mean_tax, count(*) filter (where l_discount is not null and l_discount <> 0) as truthy from lineitem group by 1""")
def f9_truthy_means(spark: SparkSession, sf: str) -> DataFrame:
    """Truthiness filter and mean over non-zero values."""
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), R.mean_truthy(F.col("l_tax"), 4).alias("mean_tax"), F.count_if(R.truthy(F.col("l_discount"))).alias("truthy"))


@query("""select count(*) as n, count(distinct o_orderkey) as orders from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = (select min(r_name) from region)""")
def f15_visible_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Ownership up the snowflake by semi-joins."""
    o, c, n, r = (load(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    mine = r.orderBy("r_name").limit(1)
    return R.visible_to(o, (c, "o_custkey", "c_custkey"), (n, "c_nationkey", "n_nationkey"), (mine, "n_regionkey", "r_regionkey")).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("orders"))


@query("""select case when c_acctbal < 0 then 'overdrawn' when c_mktsegment in ('BUILDING', 'FURNITURE') then 'trade' else 'other' end as label, count(*) as n from customer group by 1""")
def f21_derived_labels(spark: SparkSession, sf: str) -> DataFrame:
    """CASE labels."""
    label = F.when(F.col("c_acctbal") < 0, "overdrawn").when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), "trade").otherwise("other")
    return load(spark, sf, "customer").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query(FINDINGS + """, c as (select repository_id, count(*) filter (where severity = 'critical') as critical, count(*) filter (where severity = 'high') as high from findings group by 1)
select repository_id, critical, high, case when critical > 0 then 'block' when high > 0 then 'changes_requested' else 'approve' end as verdict from c""")
def f22_merge_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional counts and the verdict from them."""
    c = findings(spark, sf).groupBy("repository_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    return c.withColumn("verdict", R.merge_verdict(F.col("critical"), F.col("high")))


@query("""select event_type, case event_type when 'error' then 'high' else 'medium' end as severity, case event_type when 'signup' then 'security' else 'code_quality' end as category, count(*) as n from events group by event_type""")
def f23_word_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Severity words and ordered rule prefixes."""
    from siltstone.functions.dims import map_category, map_severity

    e = load(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", map_severity(F.col("event_type")).alias("severity"), map_category(F.upper("event_type")).alias("category"), "n")


@query("""select c_custkey, count(*) as n from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey group by 1""")
def j3_three_way_join(spark: SparkSession, sf: str) -> DataFrame:
    """Inner joins over three tables with counts; the fact is summed by order before it meets the others."""
    per = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    o = load(spark, sf, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("k").alias("n")).join(load(spark, sf, "customer").select("c_custkey"), "c_custkey", "left_semi")


@query("""select s_suppkey, n_name, case when n_nationkey < 10 then r_name end as r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey and n_nationkey < 10""")
def j4_left_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """Lookups that may miss."""
    s, n, r = (load(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, (n["n_regionkey"] == r["r_regionkey"]) & (n["n_nationkey"] < 10), "left").select("s_suppkey", "n_name", "r_name")


@query("""select p_partkey, coalesce(n, 0) as finding_count, coalesce(own, 0) as own_count from part
left join (select p_name as nm, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1) on nm = p_name
left join (select 'part:' || l_partkey as id, count(*) as own from lineitem where l_returnflag = 'R' group by 1) on id = 'part:' || p_partkey""")
def j6_node_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes with the findings of their file, or of their own computed key."""
    l, p = load(spark, sf, "lineitem"), load(spark, sf, "part")
    by_name = l.groupBy("l_partkey").agg(F.count("*").alias("k")).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_name").alias("nm")).agg(F.sum("k").alias("n"))
    own = l.where("l_returnflag = 'R'").groupBy(F.concat(F.lit("part:"), "l_partkey").alias("id")).agg(F.count("*").alias("own"))
    out = p.join(by_name, p["p_name"] == by_name["nm"], "left").join(own, F.concat(F.lit("part:"), "p_partkey") == own["id"], "left")
    return out.select("p_partkey", F.coalesce("n", F.lit(0)).alias("finding_count"), F.coalesce("own", F.lit(0)).alias("own_count"))


@query("""select c_custkey from customer where c_custkey in (select o_custkey from orders group by 1 having count(*) >= 12) and c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')""")
def j20_hubs_without(spark: SparkSession, sf: str) -> DataFrame:
    """Many dependents and none of a kind: having and anti-join."""
    o = load(spark, sf, "orders")
    busy = o.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 12").select(F.col("o_custkey").alias("c_custkey"))
    urgent = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return busy.join(urgent, "c_custkey", "left_anti").join(load(spark, sf, "customer").select("c_custkey"), "c_custkey", "left_semi")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem l where l_returnflag = 'R' and not exists (select 1 from lineitem b where b.l_returnflag = 'A' and b.l_linenumber = l.l_linenumber and b.l_partkey = l.l_partkey)""")
def j22_introduced(spark: SparkSession, sf: str) -> DataFrame:
    """Rows after without an equal one before, by a composite key (J22, VP3)."""
    from siltstone.operators.validation import introduced

    l = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return introduced(l.where("l_returnflag = 'R'"), l.where("l_returnflag = 'A'"), "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""select o_custkey, o_orderkey, o_orderdate, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1""")
def j25_latest_child(spark: SparkSession, sf: str) -> DataFrame:
    """Latest row of each parent (J25, W2, G18, ST13)."""
    return R.latest_per(load(spark, sf, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")


@query("""select o_custkey, coalesce(min(case when o_orderstatus = 'F' then o_orderkey end), min(o_orderkey)) as o_orderkey from orders group by 1""")
def f28_default_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The first finished row of each parent, or its first where none is finished."""
    return R.preferred(load(spark, sf, "orders"), "o_custkey", F.col("o_orderstatus") == "F", F.asc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("""select o_orderkey, o_totalprice, coalesce(kids, '') as children, coalesce(n, 0) as n from orders left join
(select l_orderkey, string_agg(l_partkey || ':' || l_linenumber, ',' order by l_partkey, l_linenumber) as kids, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey where o_orderkey % 10 < 10""")
def j26_nested_children(spark: SparkSession, sf: str) -> DataFrame:
    """Parents with nested children, none included."""
    out = R.nested(load(spark, sf, "orders"), load(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", "kids", ["l_partkey", "l_linenumber"])
    text = F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["l_partkey"].cast("string"), k["l_linenumber"].cast("string"))), ",")
    return out.select("o_orderkey", "o_totalprice", text.alias("children"), F.size("kids").cast("long").alias("n"))


@query("""select distinct a.l_orderkey, least(a.l_partkey, b.l_partkey) as part_a, greatest(a.l_partkey, b.l_partkey) as part_b from lineitem a join lineitem b
on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey and a.l_linenumber * 7 - 4 <= b.l_linenumber * 7 + b.l_quantity and b.l_linenumber * 7 - 4 <= a.l_linenumber * 7 + a.l_quantity""")
def j10_interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Interval overlap with slack inside an equality key, by bins."""
    from siltstone.operators.findings import overlap_pairs

    l = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linenumber") * 7).alias("start_line"), (F.col("l_linenumber") * 7 + F.col("l_quantity")).alias("end_line"))
    return overlap_pairs(l, "l_orderkey", "l_partkey", "start_line", "end_line").select("l_orderkey", F.col("a").alias("part_a"), F.col("b").alias("part_b")).distinct()


@query("""with r as (select user_id, event_id, epoch_us(ts) // 60000000 as m, cast(value as bigint) as len from events)
select a.user_id, a.event_id as a, b.event_id as b from r a join r b on a.user_id = b.user_id and a.event_id < b.event_id and a.m - 4 <= b.m + b.len and b.m - 4 <= a.m + a.len""")
def j10_event_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping spans of a user's events, some users with many."""
    from siltstone.operators.findings import overlap_pairs

    e = load(spark, sf, "events").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).alias("m"), F.rint("value").cast("long").alias("len"))
    return overlap_pairs(e.withColumn("until", F.col("m") + F.col("len")), "user_id", "event_id", "m", "until")


@query("""with e as (select event_id, user_id, ts from events where event_type = 'error'), v as (select event_id as view_id, user_id as vu, ts as vts, value from events where event_type = 'view')
select event_id, view_id, value from (select event_id, view_id, value, row_number() over (partition by event_id order by vts desc, view_id desc) as rn from e left join v on vu = user_id and vts <= ts and vts >= ts - interval 12 hours) where rn = 1""")
def j12_enclosing_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """The latest-starting scope that still holds, by union and a window instead of a range join."""
    e = load(spark, sf, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.lit(0).alias("kind"), F.col("event_id").alias("view_id"), "value", F.lit(None).cast("long").alias("event_id"))
    errors = e.where("event_type = 'error'").select("user_id", "ts", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("view_id"), F.lit(None).cast("double").alias("value"), "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "kind", "view_id", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.struct("ts", "view_id", "value")), ignorenulls=True).over(w)
    out = views.unionByName(errors).withColumn("v", last).where("kind = 1")
    fresh = F.col("v.ts") >= F.col("ts") - F.expr("interval 12 hours")
    return out.select("event_id", F.when(fresh, F.col("v.view_id")).alias("view_id"), F.when(fresh, F.col("v.value")).alias("value"))


@query(FINDINGS + """, dim as (select * from (values ('critical', 5), ('high', 4), ('medium', 3), ('low', 2), ('informational', 1)) t(severity, rank))
select dim.severity, rank, count(f.severity) as n from dim left join findings f on f.severity = dim.severity and f.category = 'secret' group by all""")
def a1_severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts for every severity, zeros included (A1)."""
    return R.severity_counts(findings(spark, sf).where("category = 'secret'"))


@query(FINDINGS + " select category, count(*) as n from findings group by 1 order by n desc, category")
def a2_most_common(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by value, most common first."""
    return R.most_common(findings(spark, sf), "category")


@query(FINDINGS + """ select category, count(*) filter (where status = 'approved') as accepted, count(*) filter (where status <> 'proposed') as decided,
 case when count(*) filter (where status <> 'proposed') = 0 then 0.0 else round(100.0 * count(*) filter (where status = 'approved') / count(*) filter (where status <> 'proposed'), 1) end::double as acceptance_rate from findings group by 1""")
def a3_acceptance_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted share of what was decided (A3)."""
    return R.acceptance(findings(spark, sf), "status", ["approved", "applied"], ["rejected"], "category")


@query("""with days as (select (select max(ts)::date from events) - d::int as day from range(14) t(d))
select day, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'error') as error, count(*) filter (where event_type = 'purchase') as purchase, count(*) filter (where event_type = 'signup') as signup, count(*) filter (where event_type = 'view') as view, count(event_id) as total
from days left join events on ts::date = day group by 1""")
def a6_daily_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Daily pivot over a full calendar."""
    return R.daily_pivot(load(spark, sf, "events"), "ts", "event_type", ["click", "error", "purchase", "signup", "view"], 14)


@query(FINDINGS + """, g as (select file_path, count(*) as n, max(sev_rank) as r, round(sum(amount::decimal(30,6)), 1)::double as score from findings group by 1)
select file_path, n, ['informational', 'low', 'medium', 'high', 'critical'][r] as max_severity, score from g order by score desc, file_path limit 10""")
def a7_riskiest_files(spark: SparkSession, sf: str) -> DataFrame:
    """Top ten files by summed score with their worst severity."""
    return R.riskiest(findings(spark, sf), "file_path", "severity", F.col("amount"))


@query(FINDINGS + " select greatest(0.0, round(100 - 12.0 * coalesce(sum(sev_weight::decimal(10,2)), 0)::double, 1)) as posture from findings where category in ('security', 'secret', 'dependency')")
def a8_posture(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted posture, never below zero."""
    return R.posture(findings(spark, sf).where("category in ('security', 'secret', 'dependency')"))


@query("select o_orderstatus, sum(o_totalprice::decimal(18,2))::decimal(28,4)::double as cost, count(distinct o_custkey) as repositories from orders group by 1")
def a9_cost_and_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Summed cost and distinct counts."""
    return load(spark, sf, "orders").groupBy("o_orderstatus").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("cost"), F.countDistinct("o_custkey").alias("repositories"))


@query(FINDINGS + """, k as (select repository_id, 'severity:' || severity as k, count(*) as n from findings group by all union all select repository_id, 'category:' || category, count(*) from findings group by all union all select repository_id, 'status:' || status, count(*) from findings group by all)
select repository_id, string_agg(k || '=' || n, ',' order by k) as counters from k group by 1""")
def a11_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Several counters of a group in one pass (A11, A32): grouping sets, then one string."""
    sets = findings(spark, sf).groupingSets([["repository_id", "severity"], ["repository_id", "category"], ["repository_id", "status"]], "repository_id", "severity", "category", "status").agg(F.count("*").alias("n"))
    kind = F.when(F.col("severity").isNotNull(), F.concat(F.lit("severity:"), "severity")).when(F.col("category").isNotNull(), F.concat(F.lit("category:"), "category")).otherwise(F.concat(F.lit("status:"), "status"))
    return sets.groupBy("repository_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(kind.alias("k"), "n"))), lambda x: F.concat_ws("=", x["k"], x["n"].cast("string"))), ",").alias("counters"))


@query("select 'customer' as name, count(*) as n from customer union all select 'lineitem', count(*) from lineitem union all select 'orders', count(*) from orders union all select 'part', count(*) from part union all select 'supplier', count(*) from supplier union all select 'events', count(*) from events")
def a12_table_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts of six tables."""
    return R.table_totals(**{t: load(spark, sf, t) for t in ("customer", "lineitem", "orders", "part", "supplier", "events")})


@query("""select lang, sum(len(string_split(text, chr(10))))::bigint as lines, count(*) as files from documents group by 1""")
def a16_language_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line counts per language."""
    from siltstone.sources.files import language_lines

    d = load(spark, sf, "documents")
    lines = language_lines(d, "lang", "text")
    return lines.join(d.groupBy("lang").agg(F.count("*").alias("files")), "lang")


@query("""select event_type, count(*) as n, round(100.0 * count(*) / (select count(*) from events), 2) as percent from events group by 1""")
def a25_percent_of_total(spark: SparkSession, sf: str) -> DataFrame:
    """Share of all rows."""
    return R.share_of_total(load(spark, sf, "events"), "event_type", 2)


@query("""with c as (select user_id, event_type, count(*) as n from events group by all) select user_id, event_type as mode from (select *, row_number() over (partition by user_id order by n desc, event_type) as rn from c) where rn = 1""")
def a27_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Most frequent value of each key, ties settled."""
    return R.mode_by(load(spark, sf, "events"), "user_id", "event_type", "none")


@query("""select count(distinct source) as files, string_agg(distinct lang, ',' order by lang) as languages, sum(greatest(1, length(text) // 4))::bigint as tokens, count(*) filter (where n_chars > 5000) as large from documents""")
def a28_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """One-row manifest."""
    from siltstone.functions.text import token_estimate

    d = load(spark, sf, "documents")
    return d.agg(F.countDistinct("source").alias("files"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"), F.sum(token_estimate(F.col("text"))).alias("tokens"), F.count_if(F.col("n_chars") > 5000).alias("large"))


@query("""select user_id, coalesce(max(value) filter (where event_type = 'purchase'), 0) as top, string_agg(distinct event_type, ',' order by event_type) as reasons from events group by 1""")
def a33_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Largest value with a default, and sorted distinct reasons."""
    return load(spark, sf, "events").groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)).alias("top"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("reasons"))


@query(FINDINGS + """, g as (select part_id as id, count(*) as n, max(case when status = 'rejected' then 1 else 0 end) as changed from findings group by 1)
select id, n, changed, (select count(*) from g) > 40 as truncated from (select * from g order by n desc, changed desc, id limit 40)""")
def o5_top_with_flag(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows with a flag for what was cut."""
    g = findings(spark, sf).groupBy(F.col("part_id").alias("id")).agg(F.count("*").alias("n"), F.max(F.when(F.col("status") == "rejected", 1).otherwise(0)).alias("changed"))
    return R.top_with_flag(g, 40, F.desc("n"), F.desc("changed"), F.asc("id"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 50")
def o13_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page by offset."""
    return R.page(load(spark, sf, "orders"), 3, 25, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "o_totalprice")


@query("""with r as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey, l_suppkey, l_linenumber) as rn from lineitem) select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice from r where rn <= 3""")
def w1_top_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """Top k of each key."""
    return R.latest_per(load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"), "l_orderkey", F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_linenumber"), top=3)


@query("""select c_custkey as k, 'customer' as kind, c_acctbal as v, null::varchar as extra from customer union all select s_suppkey, 'supplier', s_acctbal, s_name from supplier""")
def u1_concatenate(spark: SparkSession, sf: str) -> DataFrame:
    """Streams of rows with different fields."""
    from siltstone.operators.findings import concatenate

    return concatenate(load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("v")), load(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("v"), F.col("s_name").alias("extra")))


@query("""select 'both' as part, count(*) as n from (select l_partkey from lineitem where l_returnflag = 'A' intersect select l_partkey from lineitem where l_returnflag = 'R')
union all select 'only_a', count(*) from (select l_partkey from lineitem where l_returnflag = 'A' except select l_partkey from lineitem where l_returnflag = 'R')
union all select 'any', count(*) from (select l_partkey from lineitem where l_returnflag = 'A' union select l_partkey from lineitem where l_returnflag = 'R')""")
def u5_set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Intersect, except and distinct union of keys in one aggregation."""
    by = load(spark, sf, "lineitem").where("l_returnflag in ('A', 'R')").groupBy("l_partkey").agg(F.max(F.col("l_returnflag") == "A").alias("a"), F.max(F.col("l_returnflag") == "R").alias("r"))
    n = by.agg(F.count_if(F.col("a") & F.col("r")).alias("both"), F.count_if(F.col("a") & ~F.col("r")).alias("only_a"), F.count("*").alias("any"))
    return n.unpivot([], ["both", "only_a", "any"], "part", "n")


@query("""select case grouping(p_brand) when 1 then null else p_brand end as brand, p_type as type, count(*) as n, grouping(p_brand) as all_brands, grouping(p_type) as all_types from part group by rollup (p_brand, p_type)""")
def ext_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: subtotals."""
    return load(spark, sf, "part").rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.grouping("p_brand").cast("long").alias("all_brands"), F.grouping("p_type").cast("long").alias("all_types")).select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), "n", "all_brands", "all_types")
