"""DuckDB SQL for those queries of this sub-package that SQL can express."""

from __future__ import annotations

from keelson.llm import chat, quality

_SYMBOLS = "[#*$%&|<>]"
_GRID = ", ".join(map(str, quality.CUTOFFS))
_PER = "case when {b} > 0 then 1000 * {a} // {b} else 0 end"
_SCORES = {k: _PER.format(a=a, b=b) for k, a, b in zip(quality.RULES, ("n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals"), ("word_chars", "n_lines", "n_words", "word_chars"))}

OP1 = f"""
with d as (select doc_id, coalesce(lang, '') grp, coalesce(text, '') as t from documents),
w as (select doc_id, list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda x: x <> '') ws from d),
l as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \\t-\\r]+', '', 'g') <> '') ls from d),
p as (select doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] k from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w where len(ws) >= 3)),
r as (select doc_id, count(distinct i + s) n from (select doc_id, i, count(*) over (partition by doc_id, k) c from p) q, (values (0), (1), (2)) v(s) where c >= 2 group by 1),
f as (select d.doc_id, grp, len(ws)::bigint n_words, length(regexp_replace(t, '[ \\t-\\r]+', '', 'g'))::bigint word_chars, (length(t) - length(regexp_replace(t, '{_SYMBOLS}', '', 'g')))::bigint n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words, len(ls)::bigint n_lines, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::bigint n_capitals
  from d join w using (doc_id) join l using (doc_id) left join r using (doc_id)),
b as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words base_failed, {', '.join(f'{s} s_{k}' for k, s in _SCORES.items())} from f),
good as (select b.* from b join (select doc_id from labels group by 1 having min(coalesce(quality, 0)) >= 1) using (doc_id) where not base_failed),
m as (select count(distinct grp) groups from good),
g as ({' union all '.join(f"select grp, '{k}' as rule, s_{k} s from good" for k in quality.RULES)}),
x as (select grp, rule, j, c, count(*) n, count(*) filter (where s > c) x from g, (select unnest([{_GRID}]) c, unnest(range(1, {len(quality.CUTOFFS) + 1})) j) group by 1, 2, 3, 4),
y as (select *, x <= n * {quality.LIMIT / len(quality.RULES)!r} and (x >= n or list_sum(list_transform(range(0, x + 1), lambda k: exp(lgamma(n + 1) - case when k = 0 then 0 else lgamma(k + 1) end - case when n = k then 0 else lgamma(n - k + 1) end + k * ln({quality.LIMIT / len(quality.RULES)!r}) + (n - k) * ln(1 - {quality.LIMIT / len(quality.RULES)!r})))) <= {quality.ERROR} / greatest(1, m.groups * {len(quality.RULES)})) as passed from x, m),
z as (select grp, rule, min(c) filter (where passed and run) cutoff from (select *, bool_and(passed) over (partition by grp, rule order by j) run from y) group by 1, 2)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(({' or '.join(f"coalesce(s_{k} > (select cutoff from z where z.grp = b.grp and rule = '{k}'), false)" for k in quality.RULES)}), false) kept from b
"""

_CANON = """regexp_replace(lower(regexp_extract({u}, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1)) || regexp_replace(regexp_replace(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/{{2,}}', '/', 'g'), '/+$', '')
|| case when regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1) <> '' then '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '')), '&') else '' end, '^$', '')"""

OP8 = f"""
with p as (select page_id, {_CANON.format(u='url')} u, make_timestamp((1577836800 + page_id * 3600) * 1000000) ts, make_timestamp((1577836800 + 1800 + page_id * 3600 + (page_id % 7) * 86400) * 1000000) again, md5(html) tag, length(html) n from pages),
a as (select v.page_id, v.u, v.again, v.tag, v.ts, r.page_id rid, r.tag rtag, r.ts rts, r.n rn, row_number() over (partition by v.page_id order by r.ts desc, r.page_id desc) k from p v left join p r on v.u = r.u and r.ts < v.again),
o as (select *, case when rid is null then 'no_response' when page_id % 3 = 0 then case when ts = rts then 'last_modified' else 'mismatch' end when (case when page_id % 5 = 0 then 'x' else '' end) || tag = rtag then 'etag' else 'mismatch' end outcome from a where k = 1)
select page_id * 2 + 1 record_id, u canonical_url, rid * 2 response_id, outcome, case when outcome in ('etag', 'last_modified') then md5('content-length: ' || rn || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || strftime(again, '%Y-%m-%d %H:%M:%S') || chr(10) || 'etag: ' || rtag || chr(10) || 'last-modified: ' || strftime(rts, '%Y-%m-%d %H:%M:%S')) end headers_md5 from o
"""

_ESC = f"regexp_replace({{x}}, '([<\\[])(\\\\*)({chat.TAILS})', '\\1\\\\\\2\\3', 'g')"
_FIXED = len(chat.TURN) + len(chat.SAYS) + len(chat.END)

OP9 = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, {_ESC.format(x='role')} er, {_ESC.format(x='text')} et, role is distinct from lag(role) over (partition by conv_id order by turn, role, text) opens from c)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (where role = '{chat.TRAINED}'), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = '{chat.TRAINED}'), '')) loss_sha256,
  (sum(length(et)) + sum(case when opens then {_FIXED} + length(er) else {len(chat.ALSO)} end))::bigint formatted_chars
from e group by 1
"""
