r"""DuckDB SQL for those queries that SQL can express over whole tables.

Not among them: the two models (1, 2), whose training SQL can't tell; substring removal (5), whose
windows are too many for it; and packing (7), for its tokenizer.  Tests hold these against brute force.
"""

from __future__ import annotations

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ALNUM = r"regexp_extract_all(translate(text, " + AZ + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
WORD = r"[^\x20\x09-\x0D]+"

WARC = """with p as (select page_id, strlen(coalesce(html, '')) as b, sha256(coalesce(html, '')) as g, '/' || coalesce(regexp_extract(url, '://[^/]*/(.*)$', 1), '') as r from pages), f as (select *, min(page_id) over (partition by g) as m from p)
select page_id, b as payload_bytes, g as payload_digest, case when b >= 100 and page_id <> m then 'revisit' else 'response' end as record_type, case when b >= 100 and page_id <> m then m end as refers_to, r as requested, 1::bigint as n_requests, 1::bigint as n_metadata from f"""

DECONTAMINATE = f"""with b as (select item_id::varchar as item, {ALNUM} as w from benchmark where text is not null),
pat as (select distinct item, least(len(w), 10) as m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as p from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
d as (select doc_id, coalesce({ALNUM}, []) as w from documents),
win as (select doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') as p from (select doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) as i from d, (select distinct m from pat))),
occ as (select doc_id, i, m, item from win join pat using (m, p)),
hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + m)) as k from occ) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from occ) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join its using (doc_id)"""

URLS = f"""with u as (select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {AZ}), '') as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
rules as (select * from (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) as t (verdict, h, p)),
best as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict from u join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from u left join best using (page_id)"""


def _gram(n: int) -> str:
    return f"case when lead(word, {n - 1}) over o is not null then word || " + " || ".join(f"' ' || lead(word, {k}) over o" for k in range(1, n)) + f" end as g{n}"


_NS = (3, 5, 8, 10)
QUALITY = f"""with d as (select doc_id, coalesce(text, '') as text, coalesce(regexp_extract_all(text, '{WORD}'), []) as w from documents),
t as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
g as (select doc_id, i, word, {", ".join(_gram(n) for n in _NS)} from t window o as (partition by doc_id order by i)),
c as (select *, {", ".join(f"g{n} is not null and count(*) over (partition by doc_id, g{n}) > 1 as c{n}" for n in _NS)} from g),
h as (select doc_id, word, {", ".join(f"bool_or(c{n}) over (partition by doc_id order by i rows between {n - 1} preceding and current row) as h{n}" for n in _NS)} from c),
r as (select doc_id, count(*) as n_words, sum(length(word)) as word_chars, count(*) filter (where h3) as n_repeat_words, {", ".join(f"sum(length(word)) filter (where h{n}) as dup_chars_{n}" for n in _NS[1:])} from h group by doc_id),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
f as (select doc_id, line, count(*) as c from l where regexp_matches(line, '{WORD}') group by doc_id, line),
s as (select doc_id, sum(c)::bigint as n_full_lines, sum(c - 1)::bigint as n_dup_lines, sum((c - 1) * length(line))::bigint as dup_line_chars from f group by doc_id),
a as (select doc_id, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  {", ".join(f"coalesce({c}, 0)::bigint as {c}" for c in ("n_words", "word_chars", "n_repeat_words", "dup_chars_5", "dup_chars_8", "dup_chars_10", "n_full_lines", "n_dup_lines", "dup_line_chars"))}
  from d left join r using (doc_id) left join s using (doc_id)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from a)
select *, not (base_failed or 100 * dup_chars_5 > 35 * word_chars or 100 * dup_chars_8 > 28 * word_chars or 100 * dup_chars_10 > 25 * word_chars
  or 100 * n_dup_lines > 40 * n_full_lines or 100 * dup_line_chars > 40 * greatest(word_chars, 1) or 100 * n_symbols > 25 * n_words) as kept from v"""

LINES = f"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(trim(line, {SPACES}), {AZ}) as key from l),
h as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(h.key) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where h.key is null), '')) as kept_sha256 from k left join h using (key) group by doc_id"""

NEAR = f"""with recursive d as (select doc_id, coalesce(regexp_extract_all(translate(text, {AZ}), '{WORD}'), []) as w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
sets as (select doc_id, count(*) as n, md5(string_agg(s, chr(10) order by s)) as code from sh group by doc_id),
reps as (select min(doc_id) as doc_id, n, code from sets group by n, code),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id where a.doc_id in (select doc_id from reps) and b.doc_id in (select doc_id from reps) group by 1, 2),
near as (select a, b from pairs join reps x on x.doc_id = a join reps y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
links as (select a, b from near union all select b, a from near),
reach as (select doc_id as node, doc_id as label from reps union select links.b, reach.label from reach join links on links.a = reach.node where reach.label < links.b),
comp as (select node, min(label) as label from reach group by node)
select d.doc_id, coalesce(sets.n, 0)::bigint as n_shingles, coalesce(label, d.doc_id) as component_id, coalesce(label, d.doc_id) = d.doc_id as kept
from d left join sets using (doc_id) left join reps on reps.code = sets.code and reps.n = sets.n left join comp on comp.node = reps.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op3_warc": WARC,
    "op4_decontaminate": DECONTAMINATE,
    "op6_url_filter": URLS,
    "op8_quality_rules": QUALITY,
    "op9_line_dedup": LINES,
    "op10_near_dedup": NEAR,
}
