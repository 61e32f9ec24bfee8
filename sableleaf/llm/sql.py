"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

#: Words of a text, by the rule `[^\x20\x09-\x0D]+`.
_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

_FIT = "(k.host = {r} or ends_with(k.host, '.' || {r})) and starts_with(k.path, '{p}')"


def _fit(column: str) -> str:
    """The longest rule's text or verdict; the rules stand longest first."""
    rules = [("allow", "www.example.com", "/en/"), ("block", "example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("allow", "com", "/")]
    return "case " + " ".join(f"when {_FIT.format(r=repr(h), p=p)} then '{h + p if column == 'rule' else v}'" for v, h, p in rules) + " end"


SQL = {
    "op1_pareto_mix": f"""
with recursive d as (
  select doc_id, source, cast(len({_WORDS.format(text="text")}) as bigint) as size,
         (cast('0x' || substr(md5('mix|' || coalesce(cast(doc_id as varchar), 'null')), 1, 13) as bigint) + 0.5::double) / 4503599627370496::double as u
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w, source_size * 3 as most from s),
o as (select *, row_number() over (order by most / w, source nulls last) as pos, sum(source_size) over () as total, sum(w) over () as all_w,
             coalesce(sum(most) over (order by most / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as most_before,
             coalesce(sum(w) over (order by most / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as w_before from w),
f as (select min(pos) as first_open from o where (total - most_before) * w <= most * (all_w - w_before)),
l as (select cast(total - most_before as double) as words, cast(all_w - w_before as double) as rest, first_open from o, f where pos = first_open),
g as (select o.source, o.source_size, case when l.first_open is null or o.pos < l.first_open then cast(o.most as double) else l.words * o.w / l.rest end as target from o left join l on true),
b as (select d.source, length(bin(d.size)) as share, cast(sum(d.size) as bigint) as words, any_value(g.target) as target
      from d join g on d.source is not distinct from g.source group by 1, 2),
h as (select *, target - 3 * coalesce(sum(words) over (partition by source order by share desc rows between unbounded preceding and 1 preceding), 0) as left_,
             cast(sum(share * words) over (partition by source order by share desc rows between current row and unbounded following) as double) as weight from b),
k as (select *, case when weight > 0 then cast(left_ as double) / weight end as rate from h),
j as (select source, max_by(rate, share) as rate from k where rate * share <= 3 group by source),
e as (select d.*, g.source_size, g.target, coalesce(least(3.0::double, j.rate * length(bin(d.size))), 3.0::double) as e
      from d join g on d.source is not distinct from g.source left join j on d.source is not distinct from j.source),
p as (select *, cast(floor(e) as bigint) as certain, case when floor(e) < 3 then e - floor(e) else 0 end as p from e),
q as (select *, row_number() over (order by doc_id, size) as rid, case when p > 0 and size > 0 then (u / (1 - u)) / (p / (1 - p)) end as q,
             target - sum(certain * size) over (partition by source) as lacks from p),
o2 as (select *, row_number() over (partition by source order by q, doc_id, size, rid) as pos from q where q is not null),
-- one by one: the next that fits is taken
fit as (
  select source, 0::bigint as pos, any_value(lacks) as gap, 0::bigint as rid from q group by source
  union all
  select f.source, n.pos, f.gap - n.size, n.rid from fit f join lateral (
    select x.pos, x.size, x.rid from o2 x where x.source is not distinct from f.source and x.pos > f.pos and x.size <= f.gap order by x.pos limit 1) n on true)
select q.doc_id, q.size, q.source_size, q.target, cast((q.certain + case when f.rid is not null then 1 else 0 end) * q.size as bigint) as taken,
       cast(q.certain + case when f.rid is not null then 1 else 0 end as bigint) as copies, q.source
from q left join (select rid from fit where rid > 0) f on q.rid = f.rid
""",
    "op3_quality_cascade": f"""
with t as (select doc_id, coalesce(text, '') as text, {_WORDS.format(text="text")} as w, row_number() over () as k from documents),
l as (select k, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
      from (select k, unnest(string_split(text, chr(10))) as line from t) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by k),
v as (select k, i, array_to_string(w[i:i + 4], ' ') as win from (select k, w, unnest(range(1, len(w) - 3)) as i from t where len(w) >= 5)),
r as (select k, count(distinct j) as n_repeat_words from (
        select k, unnest(range(i, i + 5)) as j from (select *, count(*) over (partition by k, win) as c from v) where c > 1) group by k),
f as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
             cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, coalesce(n_lines, 0) as n_lines
      from t left join l using (k) left join r using (k))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 15 * n_words or 100 * n_dup_lines > 30 * n_lines) as kept
from f
""",
    "op4_url_filter": rf"""
with recursive a as (select page_id, html, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
k as (select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
own as (select page_id, host, path, html, {_fit("rule")} as rule, {_fit("verdict")} as own from k),
t as (select host, path, unnest([regexp_extract(regexp_extract(html, '(?is)<link\s[^>]*rel\s*=\s*["'']?canonical[^>]*>'), '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1),
                                 regexp_extract(regexp_extract(html, '(?is)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh[^>]*>'), '(?i)url\s*=\s*["'']?([^"''\s>;]+)', 1)]) as target from own),
u as (select host, path, case when regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.\-]*://') then substr(target, strpos(target, '://') + 3) when starts_with(target, '//') then substr(target, 3)
             when starts_with(target, '/') then host || target else host || case when regexp_replace(path, '[^/]*$', '') = '' then '/' else regexp_replace(path, '[^/]*$', '') end || target end as far
      from t where target <> '' and host <> ''),
e as (select host || path as a, translate(regexp_extract(far, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(far, '^[^/?#]*([^?#]*)', 1) as b,
             translate(regexp_extract(far, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host2, regexp_extract(far, '^[^/?#]*([^?#]*)', 1) as path2, host, path from u),
n as (select distinct host, path from e union select host2, path2 from e where host2 <> ''),
says as (select k.host || k.path as node, {_fit("verdict")} as says from n k),
reach as (select node as x, node as y from says union
          select r.x, case when e.a = r.y then e.b else e.a end from reach r join e on (e.a = r.y or e.b = r.y) and e.host2 <> ''),
v as (select r.x as node, bool_or(s.says is not distinct from 'block') as alias_block, bool_or(s.says is not distinct from 'allow') as alias_allow from reach r join says s on s.node = r.y group by r.x)
select page_id, host, path, rule, coalesce(own, case when alias_block and not alias_allow then 'block' else 'allow' end) as verdict,
       coalesce(alias_block, false) as alias_block, coalesce(alias_allow, false) as alias_allow
from own left join v on own.host <> '' and v.node = own.host || own.path
""",
    "op9_ngram_jaccard": f"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as x, len(w) < 5 as short
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from t where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
sets as (select doc_id, md5(string_agg(x || short, '|' order by x, short)) as k from g group by doc_id),
cls as (select doc_id, min(doc_id) over (partition by k) as set_id from sets),
gc as (select g.* from g join cls using (doc_id) where doc_id = set_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from gc a join gc b on a.x = b.x and a.short = b.short and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
both_ as (select a, b from links union all select b, a from links),
reach as (select a as x, a as y from both_ union select r.x, e.b from reach r join both_ e on e.a = r.y),
comp as (select x, least(x, min(y)) as c from reach group by x)
select t.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(comp.c, cls.set_id, t.doc_id) as component_id, coalesce(cls.set_id, t.doc_id) as set_id
from t left join n using (doc_id) left join cls using (doc_id) left join comp on comp.x = cls.set_id
""",
}
