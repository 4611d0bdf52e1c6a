"""DuckDB SQL of the queries that SQL can express."""

WORD = r"'[^\x20\x09-\x0D]+'"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP4 = rf"""
with recursive d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) as w from documents
), s as (
    select distinct doc_id, array_to_string(w[i : i + 2], ' ') as s from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) as i from d where len(w) > 0)
), n as (
    select doc_id, count(*) as n from s group by doc_id
), p as (
    select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), l as (
    select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 90 * (nx.n + ny.n - c)
), e as (
    select x, y from l union all select y, x from l
), r as (
    select doc_id, doc_id as reach from documents union select r.doc_id, e.y from r join e on r.reach = e.x
)
select r.doc_id, max(coalesce(n.n, 0)) as n_shingles, min(reach) as component_id from r left join n on n.doc_id = r.doc_id group by r.doc_id
"""

OP5 = rf"""
with d as (
    select row_number() over () as row_id, doc_id, coalesce(source, '') as host, text, regexp_extract_all(coalesce(text, ''), {WORD}) as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {WORD})) as lines from documents
), g as (
    select row_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) as g from (select row_id, w, unnest(generate_series(1, len(w) - 2)) as i from d)
), hit as (
    select row_id, i from (select row_id, i, count(*) over (partition by row_id, g) as n from g) where n > 1
), rep as (
    select row_id, count(distinct i + k) as n from hit cross join (select unnest([0, 1, 2]) as k) group by row_id
), norm as (
    select distinct row_id, host, text, lower(regexp_replace(trim(x, {BLANK}), '[\x20\x09-\x0D]+', ' ', 'g')) as line from (select row_id, host, text, unnest(lines) as x from d)
), hosts as (
    select host, count(distinct text) as n from d where text is not null group by host
), often as (
    select norm.host, line from norm join hosts on hosts.host = norm.host group by norm.host, line having count(distinct text) > 30 and count(distinct text) > 0.05 * max(hosts.n)
), kept_lines as (
    select row_id, sum(len(string_split(norm.line, ' '))) as all_words, coalesce(sum(len(string_split(norm.line, ' '))) filter (where often.line is not null), 0) as lost
    from norm left join often on often.host = norm.host and often.line = norm.line group by row_id
), c as (
    select doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) as n_symbols,
        len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, cast(coalesce(all_words, 0) as bigint) as line_words, cast(coalesce(lost, 0) as bigint) as lost_words
    from d left join rep on rep.row_id = d.row_id left join kept_lines on kept_lines.row_id = d.row_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (line_words - lost_words < 0.5 * line_words) as kept, line_words, lost_words from c
"""

OP8 = """
with v as (
    select distinct vec_id, list_transform(embedding, lambda x: floor(1024.0::double * x::double)) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id as vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id
), r as (
    select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""

OP12 = r"""
with d as (
    select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), 'null')) as k,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u from documents
), h as (
    select *, cast(len(u) as bigint) as n, cast('0x' || k[1:8] as bigint) as h1, cast('0x' || k[9:16] as bigint) as h2, cast('0x' || k[17:24] as bigint) as h3, cast('0x' || k[25:32] as bigint) as h4 from d
), c as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from h
), p as (
    select *, coalesce(array_to_string(u[1:a], ''), '') as p, coalesce(array_to_string(u[a + 1:b], ''), '') as m, coalesce(array_to_string(u[b + 1:], ''), '') as s from c
)
select doc_id, n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
    sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else text end) as output_sha256,
    sha256(case when form = 'plain' then text else p || m || s end) as restored_sha256 from p
"""
