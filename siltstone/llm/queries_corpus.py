"""Registered queries that audit, mine and join the texts of ``documents``, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.filter_audit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


OP11_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(source, '') as part from documents),
w as (select *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from d),
f as (
  select d.doc_id, part, len(words) < 200 as fa, 100 * len(list_distinct(words)) < 50 * len(words) as fb,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as fc, regexp_matches(text, '[#$%&*|]') as fd,
    d.doc_id > min(d.doc_id) over (partition by text) as fe
  from w as d
), l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
g as (select part, [fa, fb, fc, fd, coalesce(fe, false)] as fails, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from f left join l using (doc_id)),
x as (select unnest([1, 2, 3, 4, 5]) as i),
orders as (
  select [a.i, b.i, c.i, d.i, e.i] as seq from x a, x b, x c, x d, x e
  where a.i not in (b.i, c.i, d.i, e.i) and b.i not in (c.i, d.i, e.i) and c.i not in (d.i, e.i) and d.i <> e.i
), played as (
  select part, good, toxic, seq, fails, coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda k: fails[seq[k]])), 6) as first,
    len(list_filter(fails, lambda b: b)) as n from g, orders
), steps as (select *, unnest([1, 2, 3, 4, 5]) as step from played),
sums as (
  select part, seq, step, seq[step] as own, count(*) filter (where first > step) as kept, count(*) filter (where first = step) as removed,
    count(*) filter (where first < step and fails[seq[step]]) as redundant, count(*) filter (where n = 1 and fails[seq[step]]) as unique_fails,
    count(*) filter (where first = step and good = 1) as good_lost, count(*) filter (where first = step and toxic = 1) as toxic_lost
  from steps group by all
)
select part, array_to_string(list_transform(seq, lambda k: substr('ABCDE', k, 1)), '') as filter_order, cast(step as int) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  cast(sum(removed) over (partition by part, own) as bigint) as shapley
from sums
"""

def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with pieces as (
  select doc_id, lang, unnest(range(len(p))) as piece, unnest(p) as s
  from (select doc_id, coalesce(lang, 'und') as lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as p from documents)
), listed as (select lang, list_filter(string_split_regex(s, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
sized as (select unnest([1, 2, 3, 4, 5]) as m),
grams as (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) as phrase from listed join sized on len(w) >= m),
f as (select lang, m, phrase, count(*) as a from grams group by all having count(*) >= 100),
n as (select lang, sum(len(w)) as n from listed group by lang),
cand as (select lang, m, phrase, a, string_split(phrase, ' ') as w from f where m > 1),
cuts as (select c.*, k from cand c join (select unnest([1, 2, 3, 4]) as k) on k < m),
parts as (select cuts.lang, m, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') as lp, array_to_string(list_slice(w, k + 1, m), ' ') as rp from cuts),
joined as (
  select p.lang, p.m, p.phrase, p.a, p.k, x.a as l, y.a as r, n.n, (1000::hugeint * p.a * n.n) // (x.a::hugeint * y.a) as score
  from parts p join f x on x.lang = p.lang and x.phrase = p.lp join f y on y.lang = p.lang and y.phrase = p.rp join n on n.lang = p.lang
), best as (select *, row_number() over (partition by lang, phrase order by score, k) as rn from joined),
kept as (
  select * from best b where rn = 1 and not exists (
    select 1 from f g where g.lang = b.lang and g.m > b.m and 100 * g.a >= 100 * b.a and contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' '))
), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked where rank <= 2000
"""

def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.ngram_join import ngram_groups

    return ngram_groups(table(spark, sf_dir, "documents")).withColumnRenamed("component", "component_id")


OP13_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-]+'), lambda x: x <> '') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) end as s from w
), n as (select doc_id, len(s) as n from sets),
rows as materialized (select doc_id, unnest(s) as g from sets),
links as materialized (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as i from rows x join rows y on x.g = y.g and x.doc_id <> y.doc_id group by all) p
    join n on n.doc_id = a join n as m on m.doc_id = b where 100 * i >= 85 * (n.n + m.n - i)
), reach(a, b) as (select doc_id, doc_id from n union select reach.a, links.b from reach join links on links.a = reach.b),
least as (select a, min(b) as component_id from reach group by a)
select n.doc_id, n.n as n_shingles, component_id from n join least on a = n.doc_id
"""

QUERIES = {"op13_ngram_join": op13_ngram_join, "op12_phrases": op12_phrases, "op11_filter_audit": op11_filter_audit}
ORACLES = {"op13_ngram_join": OP13_SQL, "op12_phrases": OP12_SQL, "op11_filter_audit": OP11_SQL}
