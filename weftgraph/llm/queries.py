"""The thin queries of the driver contract: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.extract import extract_text
from weftgraph.llm.hamming import sign_code, top_k
from weftgraph.llm.langid import identify_languages
from weftgraph.llm.lattice import embedding_components
from weftgraph.llm.ngrams import backoff_scores
from weftgraph.llm.packing import pack_documents
from weftgraph.llm.pieces import encode_pieces
from weftgraph.llm.secrets import scan_secrets
from weftgraph.llm.simhash import simhash_components
from weftgraph.llm.warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes of every embedding whose id is divisible by 50, among all of them."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", sign_code("embedding").alias("code"))
    return top_k(vectors, "code", "vec_id", F.col("vec_id") % 50 == 0, k=10)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n=4)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op10_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_packing, op2_hamming_top_k, op3_warc, op4_lm_scoring, op5_language_id, op6_pieces, op7_html_extraction, op8_simhash, op9_secret_scan, op10_lattice_near_dedup]
    return {f.__name__: f for f in found}


#: Brute force over all pairs of a query and a row; Spark's ranks and distances are int, so are these.
OP2_SQL = """
with v as (select vec_id, embedding from embeddings where vec_id is not null and embedding is not null),
d as (
  select q.vec_id as query_id, c.vec_id as neighbor_id,
         cast(list_sum(list_transform(list_zip(q.embedding[1:64], c.embedding[1:64]),
              lambda z: cast((coalesce(z[1], 0) > 0) <> (coalesce(z[2], 0) > 0) as int))) as int) as distance
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, cast(row_number() over (partition by query_id order by distance, neighbor_id) as int) as rank, neighbor_id, distance
from d qualify row_number() over (partition by query_id order by distance, neighbor_id) <= 10
"""


#: SHA-1 from hex to base32: five hex digits are four base32 digits.
OP3_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
d as (
  select page_id, cast(payload_bytes as bigint) as payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(hex, 5 * (i // 4) + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as int), 1)), '') as payload_digest,
         min(page_id) over (partition by hex) as first_id
  from p
)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id = first_id then null else first_id end as refers_to
from d
"""

#: Positions are sums of the lengths of matches and of what lies between them.
OP9_SQL = r"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t, coalesce(source, '') as o, coalesce(cast(doc_id as varchar), '') as r from documents),
pat(kind) as (values (0), (1), (2)),
hits as (
  select row, kind, case kind
           when 0 then regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
           when 1 then regexp_extract_all(t, 'AKIA[A-Z0-9]+') else regexp_extract_all(t, '[0-9a-f]{32,}') end as m,
         case kind when 0 then regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) end as v,
         case kind
           when 0 then string_split_regex(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
           when 1 then string_split_regex(t, 'AKIA[A-Z0-9]+') else string_split_regex(t, '[0-9a-f]{32,}') end as s, o, r
  from d cross join pat
),
each as (select row, kind, o, r, m, s, v, unnest(range(1, len(m) + 1)) as i from hits),
spans as (
  select row, kind, o, r, coalesce(v[i], m[i]) as value,
         cast(coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) as first, length(m[i]) as n
  from each
),
base as (select row, kind, o, r, value, first, first + n as last from spans where length(value) >= case kind when 0 then 8 when 1 then 16 else 32 end),
owners as (select value, count(distinct o) as owners, count(distinct (o, r)) as repos from base group by value),
looks as (
  select value, list_sum(list_transform(list_distinct(chars), lambda c: -(len(list_filter(chars, lambda x: x = c)) / len(chars)) * log2(len(list_filter(chars, lambda x: x = c)) / len(chars)))) as entropy
  from (select value, string_split(value, '') as chars from owners)
),
judged as (select b.*, owners, repos, owners >= 3 or repos >= 25 as shared, owners < 3 and repos < 25 and entropy >= 2.95 as live from base b join owners using (value) join looks using (value)),
every as (
  select distinct row, first, kind, last from judged
  union select distinct row, last - length(value), 3, last from judged where live
),
listed as (
  select row, string_agg(array['assign', 'access', 'hex', 'live'][kind + 1] || ':' || first || ':' || last, ',' order by first, kind, last) as spans,
         string_agg(case when kind < 3 then array['assign', 'access', 'hex', 'live'][kind + 1] || ':' || first || ':' || last end, ',' order by first, kind, last) as base,
         count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex
  from every group by row
),
found as (select row, count(distinct value) filter (live) as n_live, count(distinct value) filter (shared) as n_shared, max(owners) as max_owners, max(repos) as max_repos from judged group by row)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
       coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_shared, 0) as n_shared, coalesce(max_owners, 0) as max_owners, coalesce(max_repos, 0) as max_repos
from d left join listed using (row) left join found using (row)
"""

#: All pairs of a label, and reachability step by step.
OP10_SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select a, least(a, min(b)) as component_id from reach group by a),
n as (select a, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id, vec_id = coalesce(component_id, vec_id) as kept
from embeddings left join n on n.a = vec_id left join least on least.a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for those operators that it can express; the others are held against brute force in tests."""
    return {"op2_hamming_top_k": OP2_SQL, "op3_warc": OP3_SQL, "op9_secret_scan": OP9_SQL, "op10_lattice_near_dedup": OP10_SQL}
