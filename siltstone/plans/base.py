"""The review schema laid over the driver's tables: lineitems as findings, orders as analyses, customers as repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.functions.dims import lookup
from siltstone.sources.tables import load

SEVERITY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "low", "5-LOW": "informational"}
CATEGORY = {"ECONOMY": "security", "MEDIUM": "bug", "PROMO": "performance", "LARGE": "dependency", "STANDARD": "secret", "SMALL": "architecture"}
SOURCES = ("bandit", "semgrep", "ruff", "ai_security", "mypy", "graph")
STATUS = {"A": "approved", "R": "rejected", "N": "proposed"}


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """analysis_id, repository_id, part_id, file_path, category, severity, source, rule_id, cwe, title, start_line, end_line, confidence, amount, status, created."""
    l, o, p = load(spark, sf, "lineitem"), load(spark, sf, "orders"), load(spark, sf, "part")
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(p, l["l_partkey"] == p["p_partkey"])
    brand = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int")
    return j.select(
        F.col("l_orderkey").alias("analysis_id"), F.col("o_custkey").alias("repository_id"), F.col("l_partkey").alias("part_id"),
        F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".py")).alias("file_path"),
        lookup(F.col("p_type"), CATEGORY).alias("category"), lookup(F.col("o_orderpriority"), SEVERITY).alias("severity"),
        F.get(F.array(*map(F.lit, SOURCES)), brand % len(SOURCES)).alias("source"), F.concat(F.lit("python.rule_"), (F.col("l_partkey") % 20).cast("string")).alias("rule_id"),
        F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("CWE-"), (F.col("l_suppkey") % 7).cast("string"))).alias("cwe"), F.concat(F.lit("Problem in "), "p_name").alias("title"),
        (F.col("l_linenumber") * 7).alias("start_line"), (F.col("l_linenumber") * 7 + F.col("l_quantity").cast("int")).alias("end_line"), F.round(F.col("l_discount") * 10, 2).alias("confidence"),
        F.round(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)")), 2).cast("double").alias("amount"), lookup(F.col("l_returnflag"), STATUS).alias("status"), F.col("l_shipdate").alias("created"),
    )


FINDINGS = """
with findings as (
  select l_orderkey as analysis_id, o_custkey as repository_id, l_partkey as part_id, 'src/' || replace(p_name, ' ', '_') || '.py' as file_path,
    case p_type when 'ECONOMY' then 'security' when 'MEDIUM' then 'bug' when 'PROMO' then 'performance' when 'LARGE' then 'dependency' when 'STANDARD' then 'secret' when 'SMALL' then 'architecture' end as category,
    case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'high' when '3-MEDIUM' then 'medium' when '4-NOT SPECIFIED' then 'low' when '5-LOW' then 'informational' end as severity,
    case o_orderpriority when '1-URGENT' then 5 when '2-HIGH' then 4 when '3-MEDIUM' then 3 when '4-NOT SPECIFIED' then 2 when '5-LOW' then 1 end as sev_rank,
    case o_orderpriority when '1-URGENT' then 1.0 when '2-HIGH' then 0.8 when '3-MEDIUM' then 0.55 when '4-NOT SPECIFIED' then 0.3 when '5-LOW' then 0.15 end::double as sev_weight,
    ['bandit', 'semgrep', 'ruff', 'ai_security', 'mypy', 'graph'][cast(regexp_extract(p_brand, '#(\\d+)', 1) as int) % 6 + 1] as source,
    'python.rule_' || (l_partkey % 20) as rule_id, case when l_suppkey % 3 = 0 then 'CWE-' || (l_suppkey % 7) end as cwe, 'Problem in ' || p_name as title,
    l_linenumber * 7 as start_line, l_linenumber * 7 + cast(l_quantity as int) as end_line, round(l_discount * 10, 2) as confidence,
    round(l_extendedprice::decimal(12,2) * (1 - l_discount::decimal(4,2)), 2)::double as amount, case l_returnflag when 'A' then 'approved' when 'R' then 'rejected' when 'N' then 'proposed' end as status, l_shipdate as created
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
)"""
