"""DuckDB SQL for the corpus queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = f"""
with d as (
    select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) as text_sha256
    from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
from d join g using (text_sha256)
"""

OP4 = """
with e as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (
    select q.vec_id as query_id, x.vec_id, list_inner_product(q.v, x.v)::bigint as score
    from e q join e x on q.vec_id <> x.vec_id where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""

OP8 = r"""
with recursive m as (
    select conv_id, turn, role, text,
           row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as position,
           string_split(coalesce(text, ''), chr(10)) as ls
    from conversations),
cut as (
    select conv_id, turn, position, unnest(ls) as line, unnest(range(len(ls))) as i from m),
l as (
    select conv_id, turn, position, i,
           length(regexp_extract(line, '^(?:[ \t]*>)+')) - length(replace(regexp_extract(line, '^(?:[ \t]*>)+'), '>', '')) as level,
           trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+', '')), '[ \t\r]+', ' ', 'g')) as body
    from cut where conv_id is not null and turn is not null),
island as (
    select *, i - row_number() over (partition by conv_id, position, level order by i) as island from l),
p as (
    select conv_id, turn, position, level, island, string_agg(body, ' ' order by i) as passage, count(*) as n
    from island where body <> '' group by all),
whole as (
    select q.conv_id, q.position, q.island, q.turn, q.level, q.n, max(o.turn) as held
    from p q join p o on q.conv_id = o.conv_id and q.passage = o.passage and q.level = o.level + 1 and o.turn < q.turn
    where q.level > 0 group by all),
body as (select distinct conv_id, turn, level, body from l where body <> ''),
holders as (select conv_id, level, body, count(*) as holders from body group by all),
loose as (
    select s.conv_id, s.turn, s.level, s.body, count(*) as n
    from island s left join whole w on w.conv_id = s.conv_id and w.position = s.position and w.level = s.level and w.island = s.island
    where s.level > 0 and s.body <> '' and w.held is null group by all),
single as (
    select q.conv_id, q.turn, q.level, q.body, q.n, max(o.turn) as held
    from loose q join body o on q.conv_id = o.conv_id and q.body = o.body and q.level = o.level + 1 and o.turn < q.turn
    group by all),
f as (
    select conv_id, turn, level, held, 1 as kind, sum(n) as n, sum(n) as vote from whole group by all
    union all
    select s.conv_id, s.turn, s.level, s.held, 0, sum(s.n), sum(s.n * (1000000 // h.holders))
    from single s join holders h on h.conv_id = s.conv_id and h.body = s.body and h.level = s.level - 1 group by all),
up as (
    select conv_id, turn, held as up from f where level = 1
    qualify row_number() over (partition by conv_id, turn order by kind desc, vote desc, held desc) = 1),
chain as (
    select conv_id, turn, up as root, 1 as hops from up
    union all
    select c.conv_id, c.turn, u.up, c.hops + 1 from chain c join up u on u.conv_id = c.conv_id and u.turn = c.root),
root as (
    select conv_id, turn, min(root) as root, max(hops) as hops from chain group by all),
linked as (select conv_id, turn, sum(n) as n from f group by all)
select m.conv_id, m.position, m.turn, m.role,
       coalesce(trim(list_aggregate(list_filter(m.ls, lambda x: not regexp_matches(x, '^(?:[ \t]*>)+')), 'string_agg', chr(10)), chr(32) || chr(10) || chr(13) || chr(9)), '') as clean_text,
       len(list_filter(m.ls, lambda x: regexp_matches(x, '^(?:[ \t]*>)+')))::bigint as quoted_lines,
       list_max(list_transform(m.ls, lambda x: length(regexp_extract(x, '^(?:[ \t]*>)+')) - length(replace(regexp_extract(x, '^(?:[ \t]*>)+'), '>', ''))))::bigint as quote_depth,
       coalesce(linked.n, 0)::bigint as linked_lines, up.up as reply_to,
       coalesce(root.root, m.turn) as thread_root, coalesce(root.hops, 0)::bigint as reply_depth
from m left join linked on linked.conv_id = m.conv_id and linked.turn = m.turn
left join up on up.conv_id = m.conv_id and up.turn = m.turn
left join root on root.conv_id = m.conv_id and root.turn = m.turn
"""

OP12 = """
with e as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
a as (select *, row_number() over (order by vec_id) as a from (select distinct * from e where vec_id % 100 = 0)),
s as (
    select a.a, a.vec_id as anchor_id, a.label = e.label as same, e.vec_id, list_inner_product(a.v, e.v)::bigint as score
    from a join e on a.vec_id <> e.vec_id),
p as (
    select *, row_number() over (partition by a order by score desc, vec_id) as place from s where same
    qualify place <= 5)
select p.anchor_id, p.vec_id as positive_id,
       row_number() over (partition by p.a, p.place order by s.score desc, s.vec_id)::int as rank, s.vec_id as negative_id,
       p.score as positive_score, s.score as negative_score
from p join s on p.a = s.a and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
qualify rank <= 10
"""

ORACLE = {"op4_exact_topk": OP4, "op5_exact_dedup": OP5, "op8_chat_format": OP8, "op12_hard_negatives": OP12}
