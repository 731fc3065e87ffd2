"""DuckDB SQL for the queries of this subpackage that SQL expresses on whole tables."""

from __future__ import annotations

OP1 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""

OP2 = """
with recursive sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from documents
), per as (select source, sum(n_tokens)::bigint as n_tokens, count(*) as n_docs from sized group by source),
tot as (select sum(n_tokens)::double as total, count(*) as k from per where n_tokens > 0),
lp as (select source, n_tokens, n_docs, ln(n_tokens / total) as l from per, tot where n_tokens > 0),
b(i, lo, hi) as (
  select 0, 0::double, 1::double
  union all
  select i + 1, case when ok then (lo + hi) / 2 else lo end, case when ok then hi else (lo + hi) / 2 end from (
    select i, lo, hi, (
      select ln(sum(exp((lo + hi) / 2 * l))) - sum((lo + hi) / 2 * l * exp((lo + hi) / 2 * l)) / sum(exp((lo + hi) / 2 * l)) >= 0.98 * ln(count(*)) from lp
    ) as ok from b where i < 50)
), a as (select round(lo, 9) as alpha from b where i = 50),
w as (
  select source, n_tokens, n_docs, floor(round(exp(alpha * l) / (select sum(exp(alpha * l)) from lp, a) * total, 3))::bigint as quota from lp, a, tot
), p as (select source, quota // n_tokens as epochs, quota % n_tokens as rest, greatest(1, n_docs // 4096) as n_blocks from w),
k as (
  select d.*, p.epochs, p.rest, p.n_blocks, ('0x' || substr(md5('1:' || p.epochs || ':' || d.doc_id), 1, 15))::bigint as key
  from sized d join p on d.source is not distinct from p.source
), c as (select *, sum(n_tokens) over (partition by source order by key, doc_id) as upto from k),
n as (select *, epochs + (upto <= rest)::int as copies from c),
e as (select doc_id, source, n_tokens, n_blocks, unnest(range(copies)) as epoch from n),
f as (select *, ('0x' || substr(md5('1:' || epoch || ':' || doc_id), 1, 15))::bigint as key from e)
select doc_id, source, n_tokens, epoch, floor(key / 1152921504606846976.0 * n_blocks)::bigint as block, key from f
"""

OP7 = """
with l as (
  select doc_id, coalesce(text, '') as text, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents
), k as (
  select *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key from l
), c as (select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
j as (select k.*, c.last is not null and k.doc_id < c.last as gone from k left join c using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from j group by doc_id
"""

ORACLES = {"op1_topk_kdtree": OP1, "op2_temperature_mixing": OP2, "op7_line_dedup": OP7}
