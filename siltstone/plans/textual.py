"""Text, vectors and graphs (T, X text, R, G, W text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.functions import dims as D
from siltstone.functions import text as X
from siltstone.operators import graph as G
from siltstone.operators import text as T
from siltstone.operators import vectors as V
from siltstone.plans import query
from siltstone.sources.tables import load

#: Neutral words in place of instruction phrases, which the tables do not hold.
WORD_RULES = (("licence", r"(?i)\blicensed\s+under\b", 0.95), ("contact", r"(?i)[a-z0-9.]+@[a-z0-9.]+", 0.7), ("the-of", r"(?i)\bthe of\b", 0.8))


@query("""with l as (select doc_id, unnest(range(1, len(s) + 1)) as line, unnest(s) as t from (select doc_id, string_split(text, chr(10)) as s from documents)),
m as (select doc_id, line, t, 'licence' as rule_id, 0.95 as confidence from l where regexp_matches(t, '(?i)\\blicensed\\s+under\\b') union all select doc_id, line, t, 'contact', 0.7 from l where regexp_matches(t, '(?i)[a-z0-9.]+@[a-z0-9.]+') union all select doc_id, line, t, 'the-of', 0.8 from l where regexp_matches(t, '(?i)\\bthe of\\b'))
select doc_id, rule_id, 'instruction' as technique, line::int as line, substr(trim(t), 1, 200) as excerpt, confidence::double as confidence from m""")
def t1_line_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Line rules of the injection scan, with neutral rules."""
    return T.injection_matches(load(spark, sf, "documents"), "text", "doc_id", normalise=False, rules=WORD_RULES).where("technique = 'instruction'")


@query("""with c as (select page_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) as inner_text from pages) select page_id, inner_text, contains(inner_text, ' ad ') as hit, length(inner_text)::int as n from c""")
def t2_html_comments(spark: SparkSession, sf: str) -> DataFrame:
    """HTML comments of pages."""
    c = load(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<!--(.*?)-->"), 1)).alias("inner_text"))
    return c.select("page_id", "inner_text", F.contains("inner_text", F.lit(" ad ")).alias("hit"), F.length("inner_text").alias("n"))


@query()
def t3_injection_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The whole injection scan, Unicode normal form included, over conversations."""
    from siltstone.operators.findings import firewall_severity

    m = T.injection_matches(load(spark, sf, "conversations"), "text", "conv_id", "turn")
    return m.withColumn("severity", firewall_severity(F.col("confidence")))


@query("""select doc_id, '<<<UNTRUSTED_REPOSITORY_CONTENT>>>' || chr(10) || replace(replace(regexp_replace(text, '[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]', '', 'g'), '<<<UNTRUSTED_REPOSITORY_CONTENT>>>', '[delimiter-removed]'), '<<<END_UNTRUSTED_REPOSITORY_CONTENT>>>', '[delimiter-removed]') || chr(10) || '<<<END_UNTRUSTED_REPOSITORY_CONTENT>>>' as wrapped from documents""")
def t5_wrapped(spark: SparkSession, sf: str) -> DataFrame:
    """Neutralised text between delimiters."""
    return load(spark, sf, "documents").select("doc_id", X.wrap_untrusted(F.col("text")).alias("wrapped"))


@query("""with l as (select doc_id, lang, unnest(range(1, len(s) + 1)) as line, unnest(s) as t from (select doc_id, lang, string_split(text, chr(10)) as s from documents))
select doc_id, 'custom/pipes' as rule_id, 'low' as severity, line::int as line from l where regexp_matches(t, '\\|.*\\|') and lang in ('en', 'de') union all select doc_id, 'custom/shout', 'medium', line::int from l where regexp_matches(t, '[A-Z]{6,}!!')""")
def t7_custom_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Own rules by language, broken ones passed over."""
    rules = [{"id": "pipes", "pattern": r"\|.*\|", "severity": "low", "languages": ["EN", "de"]}, {"id": "shout", "pattern": "[A-Z]{6,}!!", "severity": "odd"}, {"id": "off", "pattern": "the", "enabled": False}, {"id": "bad", "pattern": "("}]
    return T.custom_rule_matches(load(spark, sf, "documents"), "text", "lang", rules, "doc_id").select("doc_id", "rule_id", "severity", "line")


@query()
def t8_duplicate_logic(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate blocks by structural shingles (T8, J9, X17, W15, U2); tested against brute force.

    The tables hold prose, of which every name would become one placeholder; each word stands for a keyword by hash.
    """
    words = F.transform(F.split("text", r"\s+"), lambda w: F.get(F.array(*map(F.lit, X.KEYWORDS)), F.pmod(F.xxhash64(w), F.lit(len(X.KEYWORDS))).cast("int")))
    blocks = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.lit("f").alias("file_path"), F.lit(True).alias("changed"), F.array_join(words, " ").alias("source"))
    return T.duplicate_logic(blocks, min_lines=1)


@query("""with l as (select doc_id, unnest(range(1, len(s) + 1)) as line, unnest(s) as t from (select doc_id, string_split(text, chr(10)) as s from documents)),
m as (select doc_id, line, regexp_extract(t, '((?i)\\b(?:api[_-]?key|secret|token|password|passwd)\\s*[:=]\\s*["''][^"''\\s]{8,}["''])', 1) as m from l), k as (select * from m where m <> '')
select doc_id, line::int as line, 'generic-assignment' as rule_id, 'high' as severity, 0.7::double as confidence, substr(m, 1, 4) || '…' as preview from k""")
def t12_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets by line with masked previews."""
    return T.find_secrets(load(spark, sf, "documents"), "text", "doc_id").select("doc_id", "line", "rule_id", "severity", "confidence", "preview").where("rule_id = 'generic-assignment'")


@query("""with c as (select doc_id, length(text) as n, unnest(string_split(text, '')) as ch from documents where length(text) > 0), k as (select doc_id, count(*) / n::double as share from c group by doc_id, n, ch)
select doc_id, round(sum(-share * log2(share)), 3) as entropy from k group by doc_id""")
def t12_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Shannon entropy of the characters of texts, as used for secrets."""
    return load(spark, sf, "documents").where(F.length("text") > 0).select("doc_id", F.round(T.entropy(F.col("text")), 3).alias("entropy"))


@query("""select doc_id, regexp_replace(text, '(?i)\\b(?:api[_-]?key|secret|token|password|passwd)\\s*[:=]\\s*["''][^"''\\s]{8,}["'']', '<REDACTED:generic-assignment>', 'g') as clean from documents""")
def t13_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets struck from texts."""
    return load(spark, sf, "documents").select("doc_id", T.redact_secrets(F.col("text"))[0].alias("clean"))


@query("""with r as (select conv_id, turn, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\\sA-Za-z0-9_]') as raw from conversations),
t as (select conv_id, turn, list_transform(flatten(list_transform(raw, lambda x: case when length(x) > 3 and regexp_matches(x, '^[A-Za-z_]') then list_concat([x], list_filter(regexp_split_to_array(replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '\\s+'), lambda p: length(p) > 2)) else [x] end)), lambda x: lower(x)) as toks from r)
select conv_id, turn, len(toks) as n, len(list_distinct(toks)) as distinct_n, coalesce(toks[1], '') as first, coalesce(toks[-1], '') as last from t""")
def x16_code_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Code tokens of whole texts, identifiers with their parts."""
    c = load(spark, sf, "conversations").withColumn("toks", X.code_tokens(F.col("text")))
    return c.select("conv_id", "turn", F.size("toks").cast("long").alias("n"), F.size(F.array_distinct("toks")).cast("long").alias("distinct_n"), F.coalesce(F.get("toks", F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.element_at(F.when(F.size("toks") > 0, F.col("toks")), -1), F.lit("")).alias("last"))


@query("""with w as (select p_partkey, string_split(p_name, ' ') as a, string_split(lower(p_brand || ' ' || p_type || ' ' || p_name), ' ') as b from part)
select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double, 6) as similarity, b[1] || '~' || b[2] as bigram, b[1] || ' ' || b[2] || ' ' || b[3] as trigram from w""")
def u3_set_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Token-set similarity, pairs and shingles."""
    a, b = F.split("p_name", " "), F.split(F.lower(F.concat_ws(" ", "p_brand", "p_type", "p_name")), " ")
    return load(spark, sf, "part").select("p_partkey", F.round(X.set_similarity(a, b), 6).alias("similarity"), X.grams(b, 2, "~")[0].alias("bigram"), X.grams(b, 3)[0].alias("trigram"))


@query("""with f as (select doc_id, case doc_id % 5 when 0 then 'src/Main.py' when 1 then 'web/app.spec.ts' when 2 then './lib/../x/readme.MD' when 3 then 'noext' else 'tests/__tests__/a.JSX' end as path from documents)
select path, case path when 'src/Main.py' then 'python' when 'web/app.spec.ts' then 'typescript' when './lib/../x/readme.MD' then 'markdown' when 'noext' then 'unknown' else 'javascript' end as language,
 case path when 'src/Main.py' then 'python' when 'web/app.spec.ts' then 'javascript' when 'tests/__tests__/a.JSX' then 'javascript' else 'other' end as family, path in ('web/app.spec.ts', 'tests/__tests__/a.JSX') as is_test,
 case path when './lib/../x/readme.MD' then 'x/readme.MD' else path end as normal, case path when './lib/../x/readme.MD' then 'lib/../x/readme.MD' else path end as relative, path = './lib/../x/readme.MD' as unsafe, path like 'web/%' or path = 'src/Main.py' as excluded, count(*) as n from f group by path""")
def x1_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Languages, families, tests, normal, relative, unsafe and excluded paths."""
    p = F.get(F.array(*map(F.lit, ["src/Main.py", "web/app.spec.ts", "./lib/../x/readme.MD", "noext", "tests/__tests__/a.JSX"])), (F.col("doc_id") % 5).cast("int"))
    d = load(spark, sf, "documents").select(p.alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    c = F.col("path")
    return d.select("path", D.language_of(c).alias("language"), D.language_family(D.language_of(c)).alias("family"), X.is_test_path(c).alias("is_test"), X.normal_path(c).alias("normal"), X.relative_path(c, "/root/").alias("relative"), X.is_unsafe_path(c).alias("unsafe"), X.is_excluded(c, ["web/**", "Main.p?"]).alias("excluded"), "n")


@query("""select event_id, greatest(1, coalesce(try_cast(case event_id % 4 when 0 then 'x' when 1 then '-5' else event_id::varchar end as int), 1)) as line, trim(regexp_replace(lower(event_type || ' /Fix: ' || event_id), '[^a-z0-9._/-]+', '-', 'g'), '-/.') as branch from events""")
def x25_clamp_and_slug(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers clamped and branch names cleaned."""
    raw = F.when(F.col("event_id") % 4 == 0, "x").when(F.col("event_id") % 4 == 1, "-5").otherwise(F.col("event_id").cast("string"))
    return load(spark, sf, "events").select("event_id", X.clamp_line(raw).alias("line"), X.sanitise_branch(F.concat("event_type", F.lit(" /Fix: "), F.col("event_id").cast("string"))).alias("branch"))


@query("""with b as (select p_partkey, list_transform(string_split(p_name, ''), lambda x: ascii(x)) as b from part) select p_partkey, list_reduce(list_prepend(2166136261::hugeint, list_transform(b, lambda x: x::hugeint)), lambda h, x: (xor(h::bigint, x::bigint)::hugeint * 16777619) % 4294967296)::bigint as h from b""")
def x9_fnv1a(spark: SparkSession, sf: str) -> DataFrame:
    """FNV-1a over bytes."""
    return load(spark, sf, "part").select("p_partkey", X.fnv1a(F.col("p_name")).alias("h"))


@query("""with p as (select o_orderkey, '@@ -' || (o_orderkey % 7) || ',3 +' || (o_orderkey % 11 + 1) || ',9 @@' || chr(10) || ' a' || chr(10) || '+b' || chr(10) || '-c' || chr(10) || '+d' || chr(10) || '@@ -1 +' || (o_orderkey % 13 + 40) || ' @@' || chr(10) || '+e' as patch from orders)
select o_orderkey, unnest([o_orderkey % 11 + 2, o_orderkey % 11 + 3, o_orderkey % 13 + 40])::int as line from p""")
def w5_changed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """New-file line numbers of unified diffs (W5, X4, VP10)."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    patch = F.concat(F.lit("@@ -"), s(k % 7), F.lit(",3 +"), s(k % 11 + 1), F.lit(",9 @@\n a\n+b\n-c\n+d\n@@ -1 +"), s(k % 13 + 40), F.lit(" @@\n+e"))
    return T.changed_lines(load(spark, sf, "orders").select("o_orderkey", patch.alias("patch")), "o_orderkey", "patch")


@query("""with u as (select vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as v from embeddings),
p as (select q.vec_id as query, r.vec_id as id, round(greatest(-1.0, least(1.0, list_inner_product(q.v, r.v))), 4) as score from u q join u r on q.vec_id % 50 = 0 and q.vec_id <> r.vec_id)
select query, id, score, rank::int as rank from (select *, row_number() over (partition by query order by score desc, id) as rank from p where score >= 0.25) where rank <= 5""")
def o6_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest rows by cosine for stated queries."""
    e = load(spark, sf, "embeddings")
    return V.neighbours(e, e.where("vec_id % 50 = 0"), 5, 0.25, "vec_id", "embedding", digits=4)


@query("""with v as (select vec_id as id, label / 10.0::double as score from embeddings where vec_id % 2 = 0), g as (select vec_id as id, 0.35 + max(case when label = 3 then 0.2 else 0 end) as score, string_agg(distinct 'label ' || label, ',' order by 'label ' || label) as reasons from embeddings where vec_id % 3 = 0 group by 1)
select coalesce(v.id, g.id) as id, round(coalesce(v.score, 0) + coalesce(g.score, 0)::double, 6) as score, coalesce(g.reasons, '') as reasons from v full join g on v.id = g.id""")
def r5_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Vector scores and graph bonuses added up."""
    e = load(spark, sf, "embeddings")
    hits = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), (F.col("label") / 10.0).alias("score"))
    graph = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), F.concat(F.lit("label "), "label").alias("reason"), (F.col("label") == 3).alias("is_test"))
    return V.hybrid(hits, graph).select("id", "score", F.array_join("reasons", ",").alias("reasons"))


@query()
def r2_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed text embeddings."""
    return load(spark, sf, "conversations").select("conv_id", "turn", V.embed(F.col("text")).alias("v"))


@query()
def r2_native_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """The same scheme without Python (R2)."""
    c = load(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("k"), "text")
    return V.native_embedding(c, "k", "text").select("k", "bucket", F.round("weight", 4).alias("weight"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """A sparse graph over all parts: each part leads to another by its key and size, every second one to one more."""
    p = load(spark, sf, "part")
    n = p.count()
    name = lambda k: F.concat(F.when(k % 2 == 0, "c").otherwise("s"), k)
    k = F.col("p_partkey")
    a = p.select(name(k).alias("source"), name((k * 7 + F.col("p_size")) % n).alias("target"), F.when(F.col("p_size") % 3 == 0, "calls").otherwise("imports").alias("type"))
    b = p.where("p_partkey % 2 = 0").select(name(k).alias("source"), name((k * 31 + 11 + F.col("p_size")) % n).alias("target"), F.lit("imports").alias("type"))
    return a.unionByName(b).distinct().withColumn("id", F.concat_ws(">", "source", "target", "type"))


def _nodes(edges: DataFrame) -> DataFrame:
    n = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    return n.withColumn("type", F.when(F.col("id").startswith("c"), "file").otherwise("module")).withColumn("is_test", F.col("id").rlike("[05]$"))


EDGES = """
with recursive total as (select count(*) as n from part),
numbers as (select p_partkey as a, (p_partkey * 7 + p_size) % (select n from total) as b, case when p_size % 3 = 0 then 'calls' else 'imports' end as type from part
  union select p_partkey, (p_partkey * 31 + 11 + p_size) % (select n from total), 'imports' from part where p_partkey % 2 = 0),
edges as (select case when a % 2 = 0 then 'c' else 's' end || a as source, case when b % 2 = 0 then 'c' else 's' end || b as target, type from numbers),
nodes as (select id, case when starts_with(id, 'c') then 'file' else 'module' end as type, regexp_matches(id, '[05]$') as is_test from (select source as id from edges union select target from edges))"""


@query(EDGES + """, r as (select id as start, id, 0 as depth from nodes where id in ('s1', 's7', 'c12', 's33') union select r.start, e.source, r.depth + 1 from r join edges e on e.target = r.id where depth < 3)
select start, id, min(depth) as depth from r group by all having min(depth) > 0""")
def g3_blast_radius(spark: SparkSession, sf: str) -> DataFrame:
    """What depends on a node within three steps."""
    e = _edges(spark, sf)
    return G.blast_radius(e, _nodes(e).where(F.col("id").isin("s1", "s7", "c12", "s33")).select(F.col("id").alias("start")))


@query(EDGES + """, r as (select id as start, id, 0 as depth from nodes where id in ('s1', 'c12', 'c40', 'c7') union select r.start, e.target, r.depth + 1 from r join edges e on e.source = r.id and e.type = 'imports' where depth < 2)
select start, id, min(depth) as depth from r group by all having min(depth) > 0""")
def g4_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """What a node depends on within two steps."""
    e = _edges(spark, sf)
    return G.dependencies(e, _nodes(e).where(F.col("id").isin("s1", "c12", "c40", "c7")).select(F.col("id").alias("start")))


@query(EDGES + """ select target as id, source as test from edges join nodes on nodes.id = source and is_test where edges.type = 'imports' group by all""")
def g5_covering_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Tests that import a node."""
    e = _edges(spark, sf)
    return G.covering_tests(e, _nodes(e))


@query(EDGES + """, pairs as (select case when a % 2 = 0 then 'c' else 's' end || a as a, case when b % 2 = 0 then 'c' else 's' end || b as b from (select p_partkey as a, (p_partkey * 49 + p_size) % (select n from total) as b from part) where a <> b),
w as (select distinct a, a as pos, 0 as depth from pairs union select w.a, e.target, depth + 1 from w join edges e on e.source = w.pos where depth < 5), m as (select a, pos, min(depth) as depth from w group by all)
select pairs.a, pairs.b, depth + 1 as nodes from pairs join m on m.a = pairs.a and m.pos = pairs.b where depth > 0""")
def g7_shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of shortest paths over all edges."""
    e, p = _edges(spark, sf), load(spark, sf, "part")
    name = lambda k: F.concat(F.when(k % 2 == 0, "c").otherwise("s"), k)
    to = (F.col("p_partkey") * 49 + F.col("p_size")) % p.count()
    pairs = p.where(F.col("p_partkey") != to).select(name(F.col("p_partkey")).alias("a"), name(to).alias("b"))
    return G.shortest_paths(e, pairs).select("a", "b", F.size("path").alias("nodes"))


@query(EDGES + """, i as (select distinct source, target from edges where type = 'imports' and source <> target)
select x.source || '>' || x.target as cycle from i x join i y on y.source = x.target and y.target = x.source where x.source < x.target
union all select x.source || '>' || x.target || '>' || y.target from i x join i y on y.source = x.target join i z on z.source = y.target and z.target = x.source where x.source < x.target and x.source < y.target and x.target <> y.target
union all select x.source || '>' || x.target || '>' || y.target || '>' || z.target from i x join i y on y.source = x.target join i z on z.source = y.target join i v on v.source = z.target and v.target = x.source
  where x.source < x.target and x.source < y.target and x.source < z.target and x.target <> y.target and x.target <> z.target and y.target <> z.target""")
def g8_short_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Import cycles of two to four nodes."""
    return G.short_cycles(_edges(spark, sf), 4).select(F.array_join("cycle", ">").alias("cycle"))


@query(EDGES + """, i as materialized (select distinct source as s, target as t from edges where type = 'imports' and source <> target),
reach(s, t) as (select s, t from i union select r.s, i.t from reach r join i on i.s = r.t),
same as (select r.s as id, r.t as other from reach r join reach b on b.s = r.t and b.t = r.s),
named as (select id, min(other) as component from same group by id)
select id, component, count(*) over (partition by component) as size from named where (select count(*) from same x where x.id = named.id) > 1""")
def g8_components(spark: SparkSession, sf: str) -> DataFrame:
    """Import cycles of any length, as strongly connected components."""
    return G.strong_components(_edges(spark, sf))


@query(EDGES + """ select type as kind, count(*) as n from nodes group by 1 union all select 'nodes', count(*) from nodes union all select 'edges', count(*) from edges""")
def g9_graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes by type and totals."""
    e = _edges(spark, sf)
    return G.graph_stats(_nodes(e), e)


@query(EDGES + """ select id, count(e.source) filter (where e.source = id) as out_degree, count(e.source) filter (where e.target = id) as in_degree, count(e.source) filter (where e.source = id and e.type = 'calls') as out_calls from nodes left join edges e on e.source = id or e.target = id group by 1""")
def a20_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees by direction and type."""
    e = _edges(spark, sf)
    o = e.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out_degree"), F.count_if(F.col("type") == "calls").alias("out_calls"))
    i = e.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))
    return _nodes(e).select("id").join(o, "id", "left").join(i, "id", "left").na.fill(0)


@query(EDGES + """, o as (select id as origin from nodes where ends_with(id, '3')), one as (select origin, source, source || '>' || target || '>' || type as eid from o join edges on target = origin),
two as (select origin, e.source, e.source || '>' || e.target || '>' || e.type as eid from (select distinct origin, source from one) m join edges e on e.target = m.source), s as (select * from one union all select * from two)
select origin, (select string_agg(n, ',' order by n) from (select origin as n union select source from s where s.origin = o.origin)) as nodes, (select count(*) from s where s.origin = o.origin) as edges from o""")
def g17_impact(spark: SparkSession, sf: str) -> DataFrame:
    """What a defect reaches in two steps against the edges."""
    e = _edges(spark, sf)
    out = G.impact(e, _nodes(e).where(F.col("id").endswith("3")).select(F.col("id").alias("origin")))
    return out.select("origin", F.array_join("nodes", ",").alias("nodes"), F.size("edges").cast("long").alias("edges"))


@query(EDGES + """, r as (select id as start, id, 0 as depth from nodes where id like 's%' union select r.start, e.source, r.depth + 1 from r join edges e on e.target = r.id where depth < 3), h as (select start, count(distinct id) as dependents from r where id <> start group by 1)
select start as id, dependents, case when dependents >= 8 then 'high' else 'medium' end as severity from h where dependents >= 3 and start not in (select target from edges join nodes on nodes.id = source and is_test where edges.type = 'imports')""")
def g19_untested_hubs(spark: SparkSession, sf: str) -> DataFrame:
    """Changed nodes with many dependents and no test."""
    e = _edges(spark, sf)
    n = _nodes(e)
    return G.untested_hubs(e, n, n.where(F.col("id").startswith("s")).select("id"))


@query(EDGES + """, b as (select source, target from edges union select target, source from edges), r as (select 'c12' as id, 0 as ring union select b.target, ring + 1 from r join b on b.source = r.id where ring < 6), m as (select id, min(ring) as ring from r group by 1)
select nodes.id, coalesce(m.ring, (select max(ring) + 1 from m)) as ring from nodes left join m on m.id = nodes.id""")
def g20_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Distance from a focus over edges either way."""
    e = _edges(spark, sf)
    return G.ring_distance(e, _nodes(e), "c12")


@query()
def g14_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    """PageRank by repeated joins (G14, O8); tested against a plain version."""
    e = _edges(spark, sf)
    return G.pagerank(e, _nodes(e)).select("id", F.round("rank", 6).alias("rank"))


@query()
def g16_graph_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """65-d features, smoothed over two hops (G11, G13, G16, X12, X15); tested against a plain version."""
    e = _edges(spark, sf)
    n = _nodes(e).select("id", "type", F.col("id").alias("label"), F.concat(F.lit("src/"), "id").alias("file_path"), F.lit(1).alias("start_line"), F.lit(10).alias("end_line"), F.lit(False).alias("changed"), "is_test", F.lit(0).alias("finding_count"))
    return G.propagate(e, n, G.node_features(n, e), 65)


@query("""with p as (select page_id, regexp_extract(url, '//([^/]+)', 1) as host, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as href from pages) select page_id, count(*) as links, count(distinct href) as targets, count(*) filter (where length(href) > 5) as long_links from p group by 1""")
def g2_link_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from links in pages."""
    p = load(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("href"))
    return p.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("targets"), F.count_if(F.length("href") > 5).alias("long_links"))
