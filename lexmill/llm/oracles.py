"""DuckDB SQL for the queries that SQL can express."""

WARC = """
with p as (select page_id, coalesce(octet_length(encode(html)), 0) as payload_bytes, sha1(coalesce(html, '')) as payload_digest, url from pages),
k as (select payload_digest, max(page_id) as keeper from p where payload_bytes >= 1000 group by payload_digest)
select p.page_id, p.url, p.payload_bytes, p.payload_digest,
  case when p.payload_bytes >= 1000 and p.page_id <> k.keeper then 'revisit' else 'response' end as record_type,
  case when p.payload_bytes >= 1000 and p.page_id <> k.keeper then k.keeper end as refers_to
from p left join k on p.payload_digest = k.payload_digest and p.payload_bytes >= 1000
"""

URLS = r"""
with r as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, url, translate(regexp_extract(coalesce(rest, ''), '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(rest, ''), '\A[^/?#]*([^?#]*)', 1) as path from r),
q as (select *, regexp_replace(regexp_replace(regexp_extract(url, '\A[^?#]*\?([^#]*)', 1), '(?:\A|&)(?:utm_[^=&#]*|ref|fbclid|gclid)=[^&]*', '', 'g'), '\A&+|&+\z', '', 'g') as query from h),
c as (select *, case when host <> '' then host || regexp_replace(path, '(?:/index\.html?)?/?\z', '') || case when query <> '' then '?' || query else '' end end as canonical_url from q),
l as (select distinct canonical_url from c where list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills']) and canonical_url is not null),
v as (select c.*, l.canonical_url is not null as on_list, case
  when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
  when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
  when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
  when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
  when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule
  from c left join l using (canonical_url))
select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' when on_list then 'block' else 'allow' end as verdict,
  canonical_url, rule is null and on_list as listed from v
"""

ORACLES: dict[str, str] = {"op2_warc_chunked_records": WARC, "op3_blocked_bloom_urls": URLS}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, breaks: str) -> str:
    return f"list_filter(regexp_split_to_array({_LOWER.format(text)}, '[{breaks}]+'), lambda x: x <> '')"


_ASCII_BREAKS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
BENCHMARK = f"""
with d as (select doc_id, {_words('text', _ASCII_BREAKS)} as w from documents),
b as (select cast(item_id as varchar) as item, {_words('text', _ASCII_BREAKS)} as w from benchmark),
bw as (select distinct item, l, array_to_string(w[p:p + l - 1], ' ') as win from (select item, w, least(10, len(w)) as l, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from b where len(w) > 0)),
dw as (select doc_id, l, p, array_to_string(w[p:p + l - 1], ' ') as win from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as p from d, (select distinct l from bw))),
h as (select doc_id, item, p, l from dw join bw using (l, win)),
n as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + l)) as q from h) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join i using (doc_id)
"""

_SPACES = r"\x20\x09-\x0D"
NEAR = f"""
with recursive d as (select row_number() over () as r, doc_id, {_words('text', _SPACES)} as w from documents),
s as (select distinct r, array_to_string(w[p:p + 4], ' ') as s from (select r, w, unnest(range(1, greatest(len(w) - 3, 2))) as p from d where len(w) > 0)),
n as (select r, count(*) as n from s group by r),
o as (select a.r as a, b.r as b, count(*) as i from s a join s b on a.s = b.s and a.r < b.r group by all),
l as (select a, b from o join n x on x.r = a join n y on y.r = b where 100 * i >= 75 * (x.n + y.n - i)),
m as (select a.r as a, b.r as b from d a join d b on a.doc_id = b.doc_id and a.r < b.r),
e as (select a, b from l union select b, a from l union select a, b from m union select b, a from m),
c as (select r, doc_id as root from d union select e.b, c.root from c join e on e.a = c.r),
k as (select r, min(root) as root from c group by r),
g as (select r, min(doc_id) over (partition by h) as class_id from (select s.r, doc_id, list_sort(list(s)) as h from s join d on d.r = s.r group by s.r, doc_id))
select d.doc_id, coalesce(n, 0) as n_shingles, k.root as component_id, coalesce(d.doc_id = k.root, true) as kept, coalesce(g.class_id, d.doc_id) as class_id
from d join k on k.r = d.r left join n on n.r = d.r left join g on g.r = d.r
"""

ORACLES |= {"op5_benchmark_decontamination": BENCHMARK, "op7_minhash_near_dedup": NEAR}
