"""DuckDB statements of the queries that SQL can express."""

from html.entities import name2codepoint

HOST_SQL = r"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text,
 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select rid, i, array_to_string(w[i:i + 7], ' ') as k from (select rid, w, unnest(generate_series(1, len(w) - 7)) as i from d)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as c from g) where c > 1),
p as (select rid, count(distinct i + j) as n from r, range(8) s(j) group by rid),
m as (select d.rid, doc_id, source, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
 length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines,
 coalesce(p.n, 0) as n_repeat_words from d join l using (rid) left join p using (rid)),
f as (select *, n_words < 20 as f1, 100 * n_repeat_words > 30 * n_words as f2, 100 * n_symbols > 10 * word_chars as f3,
 100 * n_dup_lines > 10 * n_lines as f4, word_chars > 15 * n_words as f5 from m),
h as (select source, u.rule, count(*) as n, count(*) filter (u.bad) as k from f,
 lateral (values (1, f1), (2, f2), (3, f3), (4, f4), (5, f5), (6, f1 or f2 or f3 or f4 or f5)) u(rule, bad) where source is not null group by all),
b as (select rule, count(*) as hosts, sum(n) as n1, sum(n * n) as n2, sum(k) / sum(n) as mean, sum(k * k / n) - sum(k) * sum(k) / sum(n) as spread from h group by rule),
o as (select rule, mean, (spread / nullif(mean * (1 - mean), 0) - (hosts - 1)) / nullif(n1 - n2 / n1 - (hosts - 1), 0) as rho from b),
s as (select rule, mean, least(greatest(case when rho > 0 then 1 / rho - 1 else 1e6 end, 1), 1e6) as z from o),
x as (select source, max((k + mean * z) / (n + z)) > 0.5 as host_failed from h join s using (rule) group by source)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
 cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, (f1 or f2) as base_failed,
 coalesce(host_failed, false) as host_failed, not (f1 or f2) and not coalesce(host_failed, false) as kept
from f left join x using (source)
"""

NEAR_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as k from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.k = b.k and a.doc_id <> b.doc_id group by all),
e as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
c(doc_id, r) as (select doc_id, doc_id from d union select c.doc_id, e.b from c join e on e.a = c.r)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(c.r) as component_id, d.doc_id = min(c.r) as kept
from d join c using (doc_id) left join n using (doc_id) group by d.doc_id
"""

DECONTAM_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
v as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as k from (select item_id, w, least(len(w), 10) as n,
 unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) as i from b where len(w) > 0)),
g as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as k from (select doc_id, w, z.n, unnest(generate_series(1, len(w) - z.n + 1)) as i
 from d, (select distinct n from v) z where len(w) >= z.n)),
o as (select distinct g.doc_id, g.i, g.n, v.item_id from g join v on g.n = v.n and g.k = v.k),
t as (select doc_id, count(distinct i + j) as n_hit from o, range(10) r(j) where j < n group by doc_id),
m as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from o group by doc_id)
select d.doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
 sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join t using (doc_id) left join m using (doc_id)
"""

URL_SQL = r"""
with c as (select page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)', 1)), '\.+$', ''), '') as host,
 cast(date '2024-01-01' + cast(page_id % 366 as int) as date) as day from pages),
w as (select page_id, host, day, i as rank, array_to_string(l[i:], '.') as domain from (select *, case when regexp_matches(host, '^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$') then [host] else string_split(host, '.') end as l from c where host is not null),
 lateral (select unnest(generate_series(1, greatest(len(l) - 1, 1))) as i)),
n as (select domain, cast('0x' || substr(md5(domain), 1, 6) as bigint) as k from (select distinct domain from w)),
e as (select domain, cast(date '2024-01-01' + cast(k % 200 + p.d as int) as date) as list_day, p.action from n join
 (values (0, 0, 'block'), (1, 0, 'block'), (2, 0, 'block'), (2, 30, 'allow'), (2, 60, 'block'), (3, 0, 'block'), (3, 90, 'allow')) p(m, d, action) on k % 7 = m),
a as (select w.page_id, w.rank, e.domain, e.list_day, e.action from w asof join e on w.domain = e.domain and w.day >= e.list_day),
b as (select page_id, arg_min(domain, rank) as list_domain, arg_min(list_day, rank) as list_day, arg_min(action, rank) as action from a group by page_id)
select c.page_id, c.host, c.day, coalesce(b.action = 'block', false) as blocked, b.list_domain, b.list_day from c left join b using (page_id)
"""

_REFERENCES = "map {" + ", ".join(f"'{n}': chr({c})" for n, c in sorted({**name2codepoint, 'apos': 39}.items())) + "}"


def _decoded(text: str) -> str:
    """Character references of a text: numbers, and the names of HTML 4."""
    ref = r"regexp_extract(x, '^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});', 1)"
    number = "case when ref[1:2] in ('#x', '#X') then cast('0x' || ref[3:] as bigint) else try_cast(ref[2:] as bigint) end"
    char = f"case when ref = '' then null when ref[1] = '#' then (case when {number} between 1 and 55295 or {number} between 57344 and 1114111 then chr(cast({number} as int)) else chr(65533) end) else names[ref] end"
    each = f"(select string_agg(case when i = 1 then x when {char} is null then '&' || x else {char} || x[length(ref) + 2:] end, '' order by i) from (select i, x, {ref} as ref, {_REFERENCES} as names from (select unnest(string_split({text}, '&')) as x, unnest(generate_series(1, len(string_split({text}, '&')))) as i)))"
    return f"case when contains({text}, '&') then {each} else {text} end"


WARC_SQL = r"""
with r as (select page_id, coalesce(html, '') as payload, coalesce(url, '') as target_uri, '2024-01-01T00:00:00Z' as refers_to_date,
 md5('response|' || coalesce(cast(page_id as varchar), '') || '|' || coalesce(url, '')) as h from pages),
s as (select *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' as refers_to,
 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload) as hs from r),
t as (select *, 'sha256:' || sha256('HTTP/1.1 200 OK' || chr(13) || chr(10) || hs || chr(13) || chr(10) || chr(13) || chr(10) || payload) as source_block_digest,
 'sha256:' || sha256(payload) as source_payload_digest from s),
x as (select *, regexp_replace(regexp_replace(regexp_replace(payload, '(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)', ' ', 'g'),
 '(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|title|article|footer|nav)\s*>', chr(10), 'g'), '<[^>]*>', '', 'g') as p from t),
y as (select *, """ + _decoded("p") + r""" as q, trim(regexp_replace(""" + _decoded("t0") + r""", '[\s\p{Z}]+', ' ', 'g')) as title from (select *, regexp_extract(payload, '(?is)<title>([^<]*)</title>', 1) as t0 from x)),
b as (select page_id, refers_to, target_uri, refers_to_date, source_block_digest, source_payload_digest, 'metadata' as record_type,
 'application/warc-fields' as content_type, 'source-status: 200' || chr(13) || chr(10) || 'title: ' || title
 || chr(13) || chr(10) || 'source-block-digest: ' || source_block_digest || chr(13) || chr(10) || 'source-payload-digest: ' || source_payload_digest
 || chr(13) || chr(10) || 'source-header: ' || replace(hs, chr(13) || chr(10), chr(13) || chr(10) || 'source-header: ') || chr(13) || chr(10) as block from y
 union all select page_id, refers_to, target_uri, refers_to_date, source_block_digest, source_payload_digest, 'conversion', 'text/plain',
 regexp_replace(regexp_replace(regexp_replace(q, '[ \t\r\x{A0}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') from y),
c as (select *, md5(record_type || '|' || refers_to) as g, 'sha256:' || sha256(block) as block_digest, cast(strlen(block) as bigint) as content_length from b),
d as (select *, '<urn:uuid:' || g[1:8] || '-' || g[9:12] || '-' || g[13:16] || '-' || g[17:20] || '-' || g[21:32] || '>' as record_id, chr(13) || chr(10) as nl from c)
select page_id, refers_to, target_uri, refers_to_date, source_block_digest, source_payload_digest, record_type, content_type, record_id, content_length, block_digest,
 sha256('WARC/1.1' || nl || 'WARC-Type: ' || record_type || nl || 'WARC-Record-ID: ' || record_id || nl || 'WARC-Refers-To: ' || refers_to || nl
 || 'WARC-Refers-To-Target-URI: ' || target_uri || nl || 'WARC-Refers-To-Date: ' || refers_to_date || nl || 'WARC-Target-URI: ' || target_uri || nl
 || 'WARC-Date: ' || refers_to_date || nl || 'WARC-Block-Digest: ' || block_digest || nl || 'Content-Type: ' || content_type || nl
 || 'Content-Length: ' || content_length || nl) as headers_sha256 from d
"""

LEXICAL_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
g as (select count(*) as big_n, cast(sum(len(w)) as bigint) as big_l from d where len(w) > 0),
p as (select rid, doc_id, n, t, count(*) as tf from (select rid, doc_id, len(w) as n, unnest(w) as t from d) group by all),
f as (select t, count(*) as df from p group by t),
i as (select distinct item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
s as (select item_id, text, rid, doc_id, cast(sum(cast(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) as bigint)
 * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) as bigint) as score
 from i join f using (t) join p using (t), g group by all),
r as (select *, row_number() over (partition by item_id, text order by score desc, doc_id) as rank from s where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from r where rank <= 50
"""

TOP_SQL = r"""
with v as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as p from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.rid, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.p, c.p) as bigint) as score from v q join v c on q.rid <> c.rid where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by rid order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 20
"""


def _cluster_sql(count: int, rounds: int) -> str:
    """Plain rounds, one after the other: all distances, then the floor of each component's mean."""
    parts = [
        """v as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as p
 from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"""c0 as materialized (select row_number() over (order by h) - 1 as c, p from (select sha256('3:' || vec_id) as h, p from v order by h limit {count}))""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} as materialized (select rid, min({{'d': d, 'c': c}}) as m from (select rid, c, cast(list_sum(list_transform(list_zip(v.p, k.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from v, c{i} k) group by rid)"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} as materialized (select k.c, coalesce(n.p, k.p) as p from c{i} k left join (select c, list((t - ((t % n) + n) % n) // n order by i) as p
 from (select m.c as c, i, cast(sum(v.p[i]) as bigint) as t, count(*) as n from a{i} join v using (rid), generate_series(1, 64) g(i) group by all) group by c) n on n.c = k.c)"""
            )
    final = f"""select v.vec_id, cast(m.c as int) as cluster, m.d as distance, cast(sum(m.d) over (partition by m.c) as bigint) as cluster_inertia,
 cast(sum(m.d) over () as bigint) as inertia, sha256(array_to_string(k.p, ',')) as centroid_sha256 from a{rounds} a join v using (rid) join c{rounds} k on k.c = a.m.c"""
    return "with " + ",\n".join(parts) + "\n" + final


CLUSTER_SQL = _cluster_sql(8, 10)
