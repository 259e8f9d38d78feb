"""DuckDB SQL for the queries that SQL can express."""

OP2 = r"""
with parts as (
    select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
        coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path
    from pages),
rules(rule_host, rule_path, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best as (
    select page_id, host, path, (select max(struct_pack(n := length(rule_host || rule_path), rule := rule_host || rule_path, verdict := verdict)) from rules
        where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) as b
    from parts)
select page_id, host, path, b.rule as rule, coalesce(b.verdict, 'allow') as verdict from best
"""

OP3 = r"""
with w as (
    select 'd' as kind, doc_id as id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
    union all
    select 'i', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') from benchmark where item_id is not null),
items as (select id as item_id, w, least(5, len(w)) as k, len(w) - least(5, len(w)) + 1 as m from w where kind = 'i' and len(w) > 0),
grams as materialized (
    select item_id, k, m, g, count(*) as c
    from (select item_id, k, m, array_to_string(w[i:i + k - 1], ' ') as g from (select *, unnest(range(1, m + 1)) as i from items)) group by all),
places as materialized (
    select id as doc_id, k, len(w) - k + 1 as n, array_to_string(w[i:i + k - 1], ' ') as g, i - 1 as place
    from (select *, unnest(range(1, len(w) - k + 2)) as i from (select w.id, w.w, s.k from w, (select distinct k from items) s where w.kind = 'd' and len(w.w) >= s.k))),
hits as materialized (select p.doc_id, p.n, p.place, g.item_id, g.m, g.g, g.c from places p join grams g on p.k = g.k and p.g = g.g),
starts as (select distinct doc_id, item_id, n, m, unnest(range(place - m + 1, place + 1)) as s from hits),
sums as (
    select s.doc_id, s.item_id, s.n, s.m, s.s, h.g, least(count(*), any_value(h.c)) as common
    from starts s join hits h on s.doc_id = h.doc_id and s.item_id = h.item_id and h.place >= s.s and h.place < s.s + s.m group by all),
windows as (select doc_id, item_id, sum(common)::bigint as common, (m + least(s + m, n) - greatest(s, 0) - sum(common))::bigint as whole from sums group by doc_id, item_id, n, m, s),
found as (select doc_id, item_id, max(common::double / whole::double) as best from windows where 100 * common >= 80 * whole group by doc_id, item_id),
by_doc as (select doc_id, count(*) as n, string_agg(item_id::varchar, ',' order by item_id) as ids, max(best) as best from found group by doc_id)
select d.doc_id, f.n is not null as contaminated, coalesce(f.n, 0)::integer as n_items, coalesce(f.ids, '') as item_ids, coalesce(f.best, 0.0)::double as best
from documents d left join by_doc f on d.doc_id = f.doc_id
"""

OP7 = r"""
with w as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
windows as materialized (select doc_id, i, md5_number(array_to_string(w[i + 1:i + 50], ' ')) as g from (select *, unnest(range(0, len(w) - 49)) as i from w)),
firsts as (select g, min(struct_pack(d := doc_id, i := i)) as f from windows group by g having count(*) > 1),
again as (select doc_id, i from windows join firsts on windows.g = firsts.g where f.d <> doc_id or f.i + 50 <= i),
edges as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as fresh from again),
spans as (select doc_id, n, min(i) as low, max(i) + 50 as high from (select *, sum(fresh) over (partition by doc_id order by i) as n from edges) group by doc_id, n),
by_doc as (select doc_id, sum(high - low)::bigint as words, string_agg(low::varchar || '-' || high::varchar, ',' order by low) as spans from spans group by doc_id)
select d.doc_id, b.words is not null as repeated, coalesce(b.words, 0)::bigint as repeated_words, coalesce(b.spans, '') as spans
from documents d left join by_doc b on d.doc_id = b.doc_id
"""

OP4 = r"""
with recursive toks as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents),
sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
    from toks),
grams as materialized (select doc_id, len(s) as n, md5_number(unnest(s)) as g from sets),
pairs as materialized (
    select a.doc_id as a, b.doc_id as b from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links as materialized (select a, b from pairs union all select b, a from pairs),
reach(x, y) as (select a, b from links union select r.x, l.b from reach r join links l on r.y = l.a)
select s.doc_id, len(s.s)::bigint as n_shingles, least(s.doc_id, coalesce(m.y, s.doc_id)) as component_id, s.doc_id <= coalesce(m.y, s.doc_id) as kept
from sets s left join (select x, min(y) as y from reach group by x) m on m.x = s.doc_id
"""

OP5 = r"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
    from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score from pairs)
select * from ranked where rank <= 5
"""

OP9 = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
near as (
    select *, lag(role) over w is not distinct from role as joined, lead(role) over w is not distinct from role as more from turns
    window w as (partition by conv_id order by turn, role, text)),
pieces as (
    select *, (case when joined then '<|im_sep|>' else '<|im_start|>' || replace(replace(replace(role, '~', '~0'), '<|', '~1'), chr(10), '~2') || chr(10) end)
        || replace(replace(text, '~', '~0'), '<|', '~1') || (case when more then '' else '<|im_end|>' || chr(10) end) as piece
    from near)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    length(string_agg(piece, '' order by turn, role, text)) as formatted_chars
from pieces group by conv_id
"""

OP10 = r"""
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest as d, min(page_id) as first from p where payload_bytes >= 100 group by 1 having count(*) > 1 and min(page_id) is not null)
select page_id, payload_bytes, payload_digest, case when first is distinct from page_id and first is not null then 'revisit' else 'response' end as record_type,
    case when first is distinct from page_id then first end as refers_to
from p left join f on p.payload_digest = f.d
"""

ORACLES = {"op2_url_filter": OP2, "op3_decontaminate": OP3, "op4_minhash": OP4, "op5_topk": OP5, "op7_suffix_array": OP7, "op9_chat": OP9, "op10_warc": OP10}
