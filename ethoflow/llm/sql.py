"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = """
with v as (
  select vec_id, [floor(1024 * x::double) for x in embedding] as e
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x::double)]) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id
)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 10
"""

OP2 = f"""
with i as (
  select item_id, regexp_extract_all(translate(text, {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws
  from benchmark where text is not null
), n as (
  select *, least(10, len(ws)) as l from i where len(ws) > 0
), w as (
  select distinct item_id, l, array_to_string(ws[p:p + l - 1], ' ') as w
  from (select *, unnest(range(1, (len(ws) - l + 2)::bigint)) as p from n)
), d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents
), x as (
  select doc_id, l, p, array_to_string(ws[p:p + l - 1], ' ') as w
  from (select d.*, k.l, unnest(range(1, (len(ws) - k.l + 2)::bigint)) as p from d, (select distinct l from w) k)
), h as (
  select x.doc_id, x.p, x.l, w.item_id from x join w on x.l = w.l and x.w = w.w
), m as (
  select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + l)) as q from h) group by doc_id
), t as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from h group by doc_id
)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join m on d.doc_id = m.doc_id left join t on d.doc_id = t.doc_id
"""

OP8 = """
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i
  from documents where text is not null
), h as (
  select *, ('0x' || substr(md5(line), 1, 8))::bigint & 2147483647 as h from l
), q as (
  select *, (h * 1000003 + coalesce(lag(h) over (partition by doc_id order by i), 0)) % 2147483647 as r, max(i) over (partition by doc_id) as n from h
), e as (
  select *, i = n or (i >= 1 and i <= n - 2 and r < lag(r) over w and r <= lead(r) over w) as ends from q window w as (partition by doc_id order by i)
), c as (
  select *, coalesce(sum(ends::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as c from e
), g as (
  select doc_id, c, count(*) as n, string_agg(line, chr(10) order by i) as chunk from c group by doc_id, c
), f as (
  select chunk, min((doc_id, c)) as first from g where n >= 2 group by chunk having count(*) > 1
), r as (
  select g.doc_id, g.c, g.n from g join f on g.chunk = f.chunk where g.n >= 2 and (g.doc_id, g.c) <> f.first
), k as (
  select c.doc_id, coalesce(string_agg(c.line, chr(10) order by c.i) filter (r.doc_id is null), '') as text
  from c left join r on c.doc_id = r.doc_id and c.c = r.c group by c.doc_id
), s as (
  select doc_id, count(*) as chunks, sum(n) as lines from r group by doc_id
)
select d.doc_id, coalesce(s.chunks, 0)::bigint as removed_chunks, coalesce(s.lines, 0)::bigint as removed_lines, md5(k.text) as text_md5, k.text as text
from documents d left join k on d.doc_id = k.doc_id left join s on d.doc_id = s.doc_id
"""

OP9 = f"""
with p as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), {_AZ}) as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages
), r as (
  select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, q, verdict)
), b as (
  select host, path, max((length(h || q), h || q, verdict)) as best
  from (select distinct host, path from p) join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q)
  group by host, path
)
select p.page_id, p.host, p.path, b.best[2] as rule, coalesce(b.best[3], 'allow') as verdict
from p left join b on p.host = b.host and p.path = b.path
"""


OP11 = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x::double)]) = 0
), s as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_dot_product(a.e, c.e)::bigint as score
  from v a join v c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), n as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

OP13 = """
with recursive i as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_prepend(4294967295::ubigint, [ascii(x)::ubigint for x in string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '')]),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint) % 20 as kind
  from conversations
), d as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(case when kind = 3 then [0, 1] else [0] end) as copy from i where kind <> 0)
), m as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n from d
), o as (
  select *, row_number() over (partition by conv_id, role, text order by n) as seen,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+\\z', '') as solid, left(role, 1) as letter
  from m
), f as (
  select *, case when solid = '' then 'b' when seen > 1 then 'd' when right(solid, 1) not in ('.', '!', '?') then 't' else '' end as fault,
    coalesce(lag(letter) over (partition by conv_id order by n) || letter not in ('su', 'ua', 'au'), false) as illegal
  from o
), g(before, letter, state) as (
  values ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')
), p(before, state, cost, audit) as (
  select state, state, 0, '' from (values ('0'), ('s'), ('u'), ('a')) v(state)
  union all
  select p.before, g.state, p.cost + 3, p.audit || 'I' from p join g on g.before = p.state where g.letter <> 's' and p.cost < 6
), r(conv_id, n, state, best, rows) as (
  select conv_id, 0::bigint, '0', {'cost': 0::bigint, 'audit': ''}, count(*) from f group by conv_id
  union all
  select r.conv_id, any_value(f.n), e.state, min({'cost': r.best.cost + p.cost + e.cost + case when e.edit <> 'D' and f.fault = 't' then 3 else 0 end, 'audit': r.best.audit || p.audit || e.edit}), any_value(r.rows)
  from r join f on r.conv_id is not distinct from f.conv_id and f.n = r.n + 1 join p on p.before = r.state join (
    select before, letter, state, 0 as cost, 'K' as edit from g
    union all select before, null, state, 3, 'R' from g where letter <> 's'
    union all select state, null, state, 4, 'D' from (values ('0'), ('s'), ('u'), ('a')) v(state)
  ) e on e.before = p.state and (e.letter is null or e.letter = f.letter) and (e.edit = 'D' or f.fault not in ('b', 'd'))
  group by r.conv_id, e.state
), z as (
  select r.conv_id, min({'cost': r.best.cost + p.cost, 'audit': r.best.audit || p.audit}) as best
  from r join p on p.before = r.state and p.state in ('0', 'a') where r.n = r.rows group by r.conv_id
), a as (
  select conv_id, audit[k] as edit, k, count(*) filter (audit[k] <> 'I') over w as n, count(*) filter (audit[k] <> 'D') over w as m, (length(audit) - length(replace(audit, 'D', ''))) as gone, length(audit) as size
  from (select conv_id, best.audit as audit, unnest(range(1, length(best.audit) + 1)) as k from z) window w as (partition by conv_id order by k)
), t as (
  select a.conv_id, string_agg(case when edit = 'K' then f.role when (size - gone) % 2 = m % 2 then case when m = 1 and (size - gone) % 2 = 1 then 'system' else 'assistant' end else 'user' end
    || ':' || case when edit = 'I' then '' else f.text end, chr(10) order by k) as text
  from a left join f on a.conv_id is not distinct from f.conv_id and f.n = a.n and edit <> 'I' where edit <> 'D' group by a.conv_id
), c as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
    count(*) filter (fault = 't') as truncated, count(*) filter (illegal) as illegal
  from f group by conv_id
)
select k.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(z.best.cost, 0)::bigint as cost, coalesce(z.best.audit, '') as audit, sha256(coalesce(t.text, '')) as repaired_sha256
from (select distinct conv_id from conversations) k left join c on k.conv_id is not distinct from c.conv_id left join z on k.conv_id is not distinct from z.conv_id left join t on k.conv_id is not distinct from t.conv_id
"""


def _op12() -> str:
    from ethoflow.llm.license_scan import PHRASES, TEMPLATES

    rows = ",\n    ".join(f"""({i}, '{t.label}', '{t.text.replace("'", "''")}', {t.gram}, {t.step}, {t.least})""" for i, t in enumerate(TEMPLATES))
    words = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    return f"""
with t as (
  select *, regexp_extract_all(translate(text, {_AZ}), {words}) as ws from (values
    {rows}
  ) t(t, label, text, k, step, least)
), tg as (
  select t, k, q, array_to_string(ws[q + 1:q + k], ' ') as g from (select *, unnest(range(0, (len(ws) - k + 1)::bigint)) as q from t)
), d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {words}) as ws from documents
), dg as (
  select doc_id, k, p, array_to_string(ws[p + 1:p + k], ' ') as g
  from (select d.*, k.k, unnest(range(0, (len(ws) - k.k + 1)::bigint)) as p from d, (select distinct k from t) k)
), h as (
  select doc_id, t, p, q, p - q as diagonal, dg.k from dg join tg on dg.k = tg.k and dg.g = tg.g
), r as (
  select *, sum(apart) over (partition by doc_id, t order by diagonal) as run from (
    select doc_id, h.t, diagonal, coalesce((diagonal - lag(diagonal) over (partition by doc_id, h.t order by diagonal) > step)::int, 0) as apart
    from (select distinct doc_id, t, diagonal from h) h join t on h.t = t.t
  )
), c as (
  select h.doc_id, h.t, r.run, h.p, h.k, unnest(range(h.q, h.q + h.k)) as w from h join r on h.doc_id = r.doc_id and h.t = r.t and h.diagonal = r.diagonal
), s as (
  select doc_id, c.t, min(p) as first, count(distinct w) / len(any_value(t.ws))::double as similarity, any_value(label) as label
  from c join t on c.t = t.t group by doc_id, c.t, run having count(distinct w) / len(any_value(t.ws))::double >= any_value(least)
), b as (
  select doc_id, count(*) filter (t < {len(PHRASES)}) as n_base, min(first) filter (t < {len(PHRASES)}) as first_word, max(first) filter (t < {len(PHRASES)}) as last_word,
    coalesce(string_agg(distinct label, ',' order by label) filter (t < {len(PHRASES)}), '') as base_labels, string_agg(distinct label, ',' order by label) as labels, max(similarity) as score
  from s group by doc_id
)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from d left join b on d.doc_id is not distinct from b.doc_id
"""


ORACLE = {"op1_topk": OP1, "op2_decontaminate": OP2, "op8_line_dedup": OP8, "op9_url_filter": OP9, "op11_hard_negatives": OP11, "op12_licenses": _op12(), "op13_conversations": OP13}
