"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from papyra.llm.dedup import op2_minhash_dedup
from papyra.llm.fingerprint import op10_merkle_fingerprints
from papyra.llm.html import op6_block_tree_html
from papyra.llm.packing import op4_shortest_pack_first
from papyra.llm.pii import op9_feistel_pseudonyms
from papyra.llm.quality import op7_byte_cnn_quality
from papyra.llm.sentencepiece import op1_sentencepiece
from papyra.llm.sharding import op3_hypergeometric_sharding
from papyra.llm.topk import op8_mtree_topk
from papyra.llm.toxicity import op5_ftrl_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_minhash_dedup,
        op3_hypergeometric_sharding,
        op4_shortest_pack_first,
        op5_ftrl_toxicity,
        op6_block_tree_html,
        op7_byte_cnn_quality,
        op8_mtree_topk,
        op9_feistel_pseudonyms,
        op10_merkle_fingerprints,
    )
}

ORACLE = {
    "op2_minhash_dedup": r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as l from documents),
sh as (
  select doc_id, unnest(case when len(l) >= 2 then list_distinct(list_transform(generate_series(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1])) else l end) as s from w),
n as (select doc_id, count(*) as n from sh group by doc_id),
k as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared, any_value(a.n) as na, any_value(b.n) as nb
  from (select * from sh join n using (doc_id)) a join (select * from sh join n using (doc_id)) b
    on a.s = b.s and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2),
l as (select a, b from k where 100 * shared >= 80 * (na + nb - shared)),
e as (select a, b from l union all select b, a from l),
r(doc_id, node) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on e.a = r.node),
c as (select doc_id, min(node) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, c.component_id = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join c on c.doc_id = d.doc_id
""",
    "op8_mtree_topk": """
with x as (
  select vec_id, list_transform(embedding, lambda e: cast(floor(1024 * cast(e as double)) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from x q join x c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
""",
}
