"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.llm import queries_corpus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", F.col("component").alias("component_id"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
with lines as (
  select doc_id, unnest(range(len(l))) as pos, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
), keyed as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), found as (
  select k, min(doc_id) as first_doc from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2
), marked as (
  select keyed.doc_id, pos, line, coalesce(keyed.doc_id > first_doc, false) as gone from keyed left join found using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siltstone.llm.bpe import bpe_round_trip

    out = bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def fetch_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` has no fetch times: the query takes page_id minutes after 2024-01-01, modulo 30 days."""
    return table(spark, sf_dir, "pages").select("page_id", "url", (F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(43200)) * 60).cast("long").alias("fetched_at"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There is no list table either: the query derives dated entries from the hosts and first path segments in ``pages``.

    By the first hex digits of a pattern's MD5: a third of the hosts and an eighth of their first path segments are
    entered on some day, blocked or allowed; half of those are removed later, and some entered again.
    """
    from siltstone.llm.url_filter import URL

    u = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", URL, 1)).alias("h"), F.regexp_extract("url", URL, 2).alias("rest"))
    u = u.select("h", F.split("rest", "/").alias("s"), F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1).alias("d")).where("h <> ''")
    path = F.when((F.size("s") > 1) & (F.get("s", F.lit(1)) != ""), F.concat("h", F.lit("/"), F.get("s", F.lit(1)))).otherwise("")
    named = lambda pattern, most: F.struct(pattern.alias("pattern"), F.lit(most).alias("most"))
    p = u.select(F.inline(F.array(named(F.col("h"), 6), named(F.col("d"), 16), named(path, 2)))).where("pattern <> ''")
    p = p.groupBy("pattern").agg(F.max("most").alias("most"))
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("pattern"), i, 1)) - 1
    p = p.where(digit(1) < F.col("most")).select("pattern", digit(2).alias("a"), digit(3).alias("b"), digit(4).alias("c"))
    dated = lambda when, days, action: F.struct(when.alias("when"), (F.lit(1704067200) + days * 86400).cast("long").alias("at"), action.alias("action"))
    entered = dated(F.lit(True), F.col("a"), F.when(F.col("b") < 11, "block").otherwise("allow"))
    removed = dated(F.col("c") < 8, F.col("a") + F.col("c") + 1, F.lit("remove"))
    again = dated(F.col("c") < 3, F.col("a") + F.col("c") + 5, F.lit("block"))
    return p.select("pattern", F.inline(F.array(entered, removed, again))).where("when").drop("when")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.url_filter import filter_urls

    return filter_urls(fetch_times(spark, sf_dir), list_entries(spark, sf_dir)).select("page_id", "url", "fetched_at", "verdict", "matched")


OP3_SQL = r"""
with u as (
  select page_id, url, 1704067200 + ((page_id * 7919) % 43200) * 60 as fetched_at,
    lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 1)) as h,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 2) as path
  from pages
), raw_patterns as (
  select h as pattern, 6 as most from u where h <> ''
  union all select regexp_extract(h, '([^.]+\.[^.]+)$', 1), 16 from u where regexp_extract(h, '([^.]+\.[^.]+)$', 1) <> ''
  union all select h || '/' || string_split(path, '/')[2], 2 from u where h <> '' and len(string_split(path, '/')) > 1 and string_split(path, '/')[2] <> ''
), digits as (
  select pattern, max(most) as most, instr('0123456789abcdef', substr(md5(pattern), 1, 1)) - 1 as z, instr('0123456789abcdef', substr(md5(pattern), 2, 1)) - 1 as a,
    instr('0123456789abcdef', substr(md5(pattern), 3, 1)) - 1 as b, instr('0123456789abcdef', substr(md5(pattern), 4, 1)) - 1 as c
  from raw_patterns group by pattern
), p as (select * from digits where z < most), entries as (
  select pattern, 1704067200 + a * 86400 as at_s, case when b < 11 then 'block' else 'allow' end as action from p
  union all select pattern, 1704067200 + (a + c + 1) * 86400, 'remove' from p where c < 8
  union all select pattern, 1704067200 + (a + c + 5) * 86400, 'block' from p where c < 3
), daily as (select pattern, at_s, max(action) as action from entries group by all), spans as (
  select pattern, at_s as valid_from, lead(at_s) over (partition by pattern order by at_s) as valid_to, action from daily
), hits as (
  select u.page_id, s.pattern, s.action, row_number() over (partition by u.page_id order by length(s.pattern) desc, s.pattern desc) as rn
  from u join spans s on s.action <> 'remove' and u.fetched_at >= s.valid_from and (s.valid_to is null or u.fetched_at < s.valid_to)
    and case when instr(s.pattern, '/') = 0 then u.h = s.pattern or ends_with(u.h, '.' || s.pattern)
      else (u.h = string_split(s.pattern, '/')[1] or ends_with(u.h, '.' || string_split(s.pattern, '/')[1]))
        and (u.path = substr(s.pattern, instr(s.pattern, '/')) or starts_with(u.path, substr(s.pattern, instr(s.pattern, '/')) || '/')) end
)
select u.page_id, u.url, u.fetched_at, coalesce(hits.action, 'none') as verdict, hits.pattern as matched
from u left join hits on hits.page_id = u.page_id and hits.rn = 1
"""


K = 10


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all rows by Hamming distance of sign codes, for every row whose id is divisible by 100."""
    from siltstone.llm.topk import sign_code, top_k

    rows = table(spark, sf_dir, "embeddings").select("vec_id", sign_code(F.col("embedding")).alias("code"))
    return top_k(rows, rows.where("vec_id % 100 = 0"), K)


OP1_SQL = """
with codes as (
  select vec_id, list_sum(list_transform(range(64), lambda i: case when embedding[i + 1] > 0 then cast(1 as hugeint) << i else 0 end)) as code from embeddings
), near as (
  select q.vec_id as query_id, r.vec_id as neighbor_id, cast(bit_count(xor(q.code, r.code)) as int) as distance
  from codes q join codes r on q.vec_id % 100 = 0 and q.vec_id <> r.vec_id
), ranked as (select *, cast(row_number() over (partition by query_id order by distance, neighbor_id) as int) as rank from near)
select query_id, rank, neighbor_id, distance from ranked where rank <= 10
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, found again by its url's key."""
    from siltstone.llm.warc import lookup_keys, surt, write_archive

    pages = table(spark, sf_dir, "pages")
    out = lookup_keys(write_archive(pages), pages.select(surt(F.col("url")).alias("key")), payloads=False)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as body, octet_length(encode(coalesce(html, ''))) as n from pages),
d as (select page_id, n, sha1(body) as digest from p), t as (select digest, max(page_id) as target from d where n >= 1000 group by digest)
select d.page_id, d.n as payload_bytes, d.digest as payload_digest, case when t.target <> d.page_id then 'revisit' else 'response' end as record_type,
  case when t.target <> d.page_id then t.target end as refers_to
from d left join t using (digest)
"""


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 10 is not 0; scores every row."""
    from siltstone.llm.lm import score_documents

    train = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    out = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), train)
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 10 == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ``documents`` that nearly equal a ``benchmark`` item."""
    from siltstone.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labelled rows whose crc32(doc_id) mod 4 is not 2; scores every row."""
    from siltstone.llm.quality import fit_quality, score_quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit_quality(docs, labels.where(~held))
    out = score_quality(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_simhash": op2_simhash,
    "op3_url_filter": op3_url_filter,
    "op4_warc": op4_warc,
    "op5_language_model": op5_language_model,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_main_text": op9_main_text,
    "op10_quality": op10_quality,
    "pipeline": pipeline,
} | queries_corpus.QUERIES
ORACLES = {"op1_top_k": OP1_SQL, "op3_url_filter": OP3_SQL, "op4_warc": OP4_SQL, "op6_line_dedup": OP6_SQL} | queries_corpus.ORACLES
