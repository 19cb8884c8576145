"""DuckDB SQL that gives the same rows as the queries, over views of the test tables."""

from __future__ import annotations

from lexmill.plans.made_sources import EXTENSION, symbols_sql
from lexmill.plans.patterns import KINDS, LANGUAGES

FILES = "files as (select source || '/' || lang || '/' || cast(doc_id as varchar) || '.txt' as file_path, text as content, doc_id from documents)"
RUNS = r"regexp_split_to_array({0}, '[^\p{{L}}\p{{M}}\p{{N}}_]+')"


def _runs(text: str) -> str:
    return f"list_filter({RUNS.format(text)}, lambda x: x <> '')"


OCC = f"""occ as (select file_path, lower(t) as token, pos from (
  select file_path, unnest(r) as t, generate_subscripts(r, 1) - 1 as pos from (select file_path, {_runs('content')} as r from files))
  where octet_length(encode(lower(t))) >= 2)"""
BASE = f"with {FILES}, {OCC}"
LINES = """lines as (select file_path, generate_subscripts(a, 1)::int as line_number, rtrim(unnest(a), chr(13)) as line_content
  from (select file_path, string_split(content, chr(10)) as a from files))"""


def tokens(condition: str) -> str:
    return f"{BASE} select distinct file_path from occ where {condition}"


def all_of(conditions: list[str]) -> str:
    having = " and ".join(f"bool_or({c})" for c in conditions)
    return f"{BASE} select file_path from occ group by file_path having {having}"


def n_of(sql: str) -> str:
    return f"select count(*) as n from ({sql})"


def phrase(first: str, second: str, gap: int) -> str:
    return f"{BASE} select a.file_path, count(*) as hits from occ a join occ b on a.file_path = b.file_path and b.pos = a.pos + {gap} where a.token = '{first}' and b.token = '{second}' group by a.file_path"


OF_THE, THE_OF = phrase("of", "the", 1), phrase("the", "of", 2)
EXACT, PREFIX, SUFFIX, SUBSTRING = tokens("token = 'the'"), tokens("starts_with(token, 'ent')"), tokens("suffix(token, 'tion')"), tokens("contains(token, 'ati')")
MULTI, PARTS = all_of(["token = 'the'", "token = 'of'", "token = 'and'"]), all_of(["contains(token, 'tio')", "contains(token, 'ing')"])
BRANCHES = [["token = 'the'", "token = 'of'"], ["token = 'de'", "token = 'la'"]]
ANY = " union ".join(f"select file_path from ({all_of(b)})" for b in BRANCHES)


def bm25(terms: list[str], tail: str, also: str = "true") -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""{BASE}, dl as (select f.file_path, count(o.token) as dl from files f left join occ o using (file_path) group by f.file_path),
 size as (select count(*) as n, avg(dl) as mean from dl),
 tf as (select file_path, token, count(*) as tf from occ where token in ({listed}) group by all),
 df as (select token, count(*) as df from tf group by token),
 s as (select file_path, count(*) as held, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))) as score
  from tf join df using (token) join dl using (file_path), size group by file_path)
 select file_path, round(score, 6) as score from s where held = {len(terms)} and {also} order by score desc, file_path {tail}"""


def files_where(condition: str) -> str:
    return f"with {FILES} select file_path from files where {condition} order by file_path"


def lines_where(condition: str) -> str:
    return f"with {FILES}, {LINES} select file_path, line_number, line_content from lines where {condition}"


def any_line(pattern: str, options: str = "") -> str:
    opts = f", '{options}'" if options else ""
    return f"with {FILES}, {LINES} select distinct file_path from lines where regexp_matches(line_content, '{pattern}'{opts}) order by file_path"


def windows(match: str, before: int, after: int) -> str:
    """CTEs up to w: file_path, grp, line_number, line_content, is_match."""
    return f"""with {FILES}, {LINES}, m as (select *, {match} as is_match from lines),
 k as (select *, max(is_match::int) over (partition by file_path order by line_number rows between {after} preceding and {before} following) as near from m),
 b as (select *, case when line_number - lag(line_number) over (partition by file_path order by line_number) > 1 then 1 when lag(line_number) over (partition by file_path order by line_number) is null then 1 else 0 end as b from k where near = 1),
 w as (select file_path, sum(b) over (partition by file_path order by line_number)::bigint as grp, line_number, line_content, is_match from b)"""


GROUPS = " select file_path, grp, min(line_number) as lo, max(line_number) as hi, sum(is_match::int)::bigint as hits from w group by file_path, grp"
LINE_TOKENS = f"list_transform({_runs('line_content')}, lambda x: lower(x))"

_kind = "case p_size % 14 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end"
_language = "case p_partkey % 10 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(LANGUAGES)) + " end"
SYMBOLS = f"""sym0 as (select {_kind} as kind, split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) as name,
  {_language} as language, 'pkg/' || lower(p_type) || '/f' || cast(p_partkey % 50 as varchar) || '.go' as repo_rel_path,
  case when p_partkey % 3 <> 0 then replace(p_brand, '#', '') end as container_name, cast(p_partkey % 200 + 1 as int) as line_start, p_size from part),
sym as (select kind, name, container_name || '::' || name as qualified_name, language, repo_rel_path, container_name, 'fn ' || name || '(size: ' || cast(p_size as varchar) || ')' as signature, line_start from sym0)"""
FN = "kind in ('function', 'method')"


def symbols(condition: str, tail: str = "") -> str:
    return f"with {SYMBOLS} select * from sym where {condition} {tail}"


def _parts(text: str) -> str:
    once = text
    for a, b in ((r"(\p{Ll})(\p{Lu})", r"\1 \2"), (r"(\p{Lu})(\p{Lu}\p{Ll})", r"\1 \2"), (r"([0-9])([^0-9])", r"\1 \2"), (r"([^0-9])([0-9])", r"\1 \2")):
        once = f"regexp_replace({once}, '{a}', '{b}', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({once}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: lower(x)), lambda x: octet_length(encode(x)) >= 2)"


PATHS = """paths as (select page_id, 'src/' || case when page_id % 5 = 0 then '.git/' else '' end || 'p' || cast(page_id as varchar) ||
  case page_id % 6 when 0 then '.rs' when 1 then '.TXT' when 2 then '.pdf' when 3 then '.log' when 4 then '.py' else '' end as path, octet_length(encode(html)) as size from pages)"""
CHANGES = """changes as (select 'u' || cast(user_id as varchar) as path, case when event_type = 'error' then 'remove' else 'index' end as action, ts, event_id from events)"""
LATEST = f"with {CHANGES}, l as (select path, action, event_id, row_number() over (partition by path order by ts desc, event_id desc) as r from changes)"
EVENTS = """ev as (select case event_id % 6 when 0 then 'create' when 1 then 'modify_data' when 2 then 'metadata' when 3 then 'rename_from' when 4 then 'remove' else 'rename_to' end as kind,
  'u' || cast(user_id as varchar) as path, case when event_id % 10 = 0 then 'u' || cast(user_id as varchar) || '.new' end as new_path, event_id as seq from events)"""
ACTION = "case when kind in ('create', 'modify_data', 'rename_to') then 'index' when kind in ('rename_from', 'remove') then 'remove' end"
DOC_CHANGES = f"{FILES}, ch as (select file_path as path, case when doc_id % 11 = 0 then 'remove' when doc_id % 7 = 0 then 'index' end as action from files)"
PLAIN = """ select file_path, line_number, unnest(case when grp > 1 and lag(grp) over (partition by file_path order by line_number) <> grp then ['--', t] else [t] end) as line from
 (select *, file_path || s || cast(line_number as varchar) || s || line_content as t from (select *, case when is_match then ':' else '-' end as s from w))"""
JSON_TEXT = r"""replace(replace(line_content, '\', '\\'), '"', '\"')"""
BENCH = """bench as (select printf('dir_%02d/file_%02d.rs', id // 20, id % 20) as file_path, id, line, case
  when line = 50 and id % 100 < 10 then 'fn initialize_connection() { let status = ready; }' when line = 51 and id % 100 < 5 then 'fn connect_database() { let pool = active; }'
  when line = 52 and id % 100 < 20 then 'fn handle_request() { let response = ok; }' else 'fn func_' || (id % 20) || '_' || line || '() { let x = ' || line || '; }' end as t
  from range(1000) a(id), range(100) b(line))"""
REFINE = f"""with {SYMBOLS} select * from sym where {FN} and (regexp_matches(signature, 'size(: [12]$|:? 4)') or regexp_matches('size ' || cast(line_start * 7 % 50 as varchar), 'size(: [12]$|:? 4)'))"""

ORACLES: dict[str, str] = {
    "tok_exact": EXACT, "tok_prefix": PREFIX, "tok_suffix": SUFFIX, "tok_substring": SUBSTRING, "tok_multi_and": MULTI, "tok_multi_substring": PARTS,
    "tok_phrase": OF_THE, "tok_phrase_gap": THE_OF, "tok_empty": f"with {FILES} select file_path from files where false",
    "idx_exact": EXACT, "idx_prefix": PREFIX, "idx_suffix": SUFFIX, "idx_substring": SUBSTRING, "idx_multi_and": MULTI, "idx_multi_substring": PARTS, "idx_phrase": OF_THE,
    "cnt_exact": n_of(EXACT), "cnt_prefix": n_of(PREFIX), "cnt_suffix": n_of(SUFFIX), "cnt_substring": n_of(SUBSTRING), "cnt_multi_term": n_of(all_of(BRANCHES[0])),
    "cnt_multi_substring": n_of(PARTS), "cnt_any_branch": n_of(ANY), "cnt_phrase": n_of(OF_THE), "cnt_files": "select count(*) as n from documents",
    "cnt_min_branch": f"select least(({n_of(all_of(BRANCHES[0]))}), ({n_of(all_of(BRANCHES[1]))})) as n",
    "stats_index": f"{BASE} select (select count(*) from files) as n_files, count(distinct token) as n_terms, count(distinct (file_path, token)) as n_postings from occ",
    "stats_terms": f"{BASE} select token, count(distinct file_path) as df, count(*) as cf from occ group by token",
    "idx_terms": f"{BASE} select token, count(distinct file_path) as df, count(*) as cf from occ group by token",
    "rank_bm25_term": bm25(["the"], "limit 20"), "rank_bm25_multi": bm25(["of", "the"], "limit 20"), "rank_bm25_indexed": bm25(["of", "the"], "limit 20"),
    "rank_phrase": bm25(["of", "the"], "limit 20", f"file_path in (select file_path from ({OF_THE}))"),
    "rank_prefix_const": f"select file_path, 1.0::double as score from ({PREFIX}) order by file_path limit 20",
    "rank_multi_substring": f"select file_path, 1.0::double as score from ({PARTS}) order by file_path limit 20",
    "rank_list_all": f"with {FILES} select file_path from files order by file_path limit 20",
    "rank_glob": bm25(["the"], "limit 10", "starts_with(file_path, 'src1/')"),
    "src_stored_text": f"with {FILES} select md5(content) as content_md5 from files where file_path = 'src1/en/1.txt'",
    "set_or_of_ands": ANY, "set_intersect": f"({PREFIX}) intersect ({SUFFIX})", "set_except": f"with {FILES} select file_path from files where file_path not in ({EXACT})",
    "rx_lines": lines_where(r"regexp_matches(line_content, '^The .*tion')"),
    "rx_files": any_line(r"the thor[\p{L}\p{M}\p{N}_]+"), "rx_prefiltered": any_line(r"the thor[\p{L}\p{M}\p{N}_]+"), "rx_count": n_of(any_line("tion[,.] (The|And)")),
    "rx_ignore_case": any_line("THE THOR", "i"), "rx_alternation": any_line("idiot|moron|clown"),
    "rx_multiline_dot": files_where(r"regexp_matches(content, 'tion\.\nThe')"), "rx_multiline_lines": f"""with {FILES}, {LINES}, x as (select *, lead(line_content) over w as nx, lag(line_content) over w as pv from lines window w as (partition by file_path order by line_number))
 select file_path, line_number, line_content from x where (suffix(line_content, 'tion.') and starts_with(nx, 'The')) or (starts_with(line_content, 'The') and suffix(pv, 'tion.'))""",
    "rx_bounded": f"{any_line('the')} limit 20",
    "snip_context": windows(f"len(list_filter({LINE_TOKENS}, lambda x: starts_with(x, 'thor'))) > 0", 1, 2) + GROUPS,
    "snip_regex": windows("contains(line_content, 'the thor')", 2, 0) + " select * from w",
    "snip_asymmetric": windows("contains(line_content, 'the thor')", 0, 3) + GROUPS,
    "sym_kind": symbols("kind = 'struct'"), "sym_kind_fn": symbols(FN), "sym_lang": symbols("language = 'rust'"), "sym_path": symbols("starts_with(repo_rel_path, 'pkg/economy')"),
    "sym_name_exact": symbols(f"{FN} and lower(name) = 'redwidget'"), "sym_name_prefix": symbols(f"{FN} and starts_with(lower(name), 'red')"),
    "sym_name_suffix": symbols("language = 'go' and suffix(lower(name), 'bolt')"), "sym_name_substring": symbols("language = 'python' and contains(lower(name), 'dbo')"),
    "sym_name_parts": symbols(f"starts_with(repo_rel_path, 'pkg/') and list_has_all({_parts('name')}, ['widget', 'red'])"),
    "sym_qname_exact": symbols("lower(qualified_name) = 'brand2::smallring'"), "sym_qname_prefix": symbols("starts_with(lower(qualified_name), 'brand1')"),
    "sym_qname_suffix": symbols("suffix(lower(qualified_name), '::redwidget')"), "sym_qname_substring": symbols("contains(lower(qualified_name), '2::s')"),
    "sym_qname_parts": symbols(f"list_has_all({_parts('qualified_name')}, ['brand', 'gear'])"),
    "sym_combined": symbols(f"{FN} and language = 'go' and starts_with(repo_rel_path, 'pkg/s') and contains(lower(name), 'bol')"),
    "sym_topk": symbols("kind = 'class'", "order by repo_rel_path, line_start, kind, lower(name) limit 15"),
    "sym_glob": symbols(f"{FN} and regexp_matches(repo_rel_path, '^pkg/.*/f1.*\\.go$')"), "sym_regex_refine": REFINE,
    "sym_files": f"with {SYMBOLS} select distinct repo_rel_path from sym where kind = 'enum'",
    "an_body_tokens": f"with {FILES}, {OCC.replace('file_path', 'doc_id')} select doc_id, token, count(*) as n from occ group by all",
    "an_reversed": f"with {FILES}, {OCC.replace('file_path', 'doc_id')} select doc_id, reverse(token) as token, count(*) as n from occ group by all",
    "an_positions": f"with {FILES}, {OCC.replace('file_path', 'doc_id')} select doc_id, token, pos from occ",
    "an_ident_parts": f"with {SYMBOLS} select distinct name, unnest({_parts('name')}) as part from sym",
    "an_qname_parts": f"with {SYMBOLS} select distinct qualified_name, unnest({_parts('qualified_name')}) as part from sym where qualified_name is not null",
    "src_ext_filter": f"with {PATHS} select page_id, path from paths where page_id % 6 in (0, 1, 4)",
    "src_hidden_filter": f"with {PATHS} select page_id, path from paths where page_id % 6 in (0, 1, 4) and page_id % 5 <> 0",
    "src_size_limit": f"with {PATHS} select page_id from paths where size <= 4096",
    "src_skip_report": f"""with {PATHS}, r as (select path, case when page_id % 5 = 0 then 'hidden' when page_id % 6 not in (0, 1, 4) then 'extension' when size > 4096 then 'size' end as reason from paths),
 k as (select *, row_number() over (partition by reason order by path) as i from r where reason is not null) select reason, count(*) as n, string_agg(path, ',' order by path) filter (where i <= 10) as samples from k group by reason""",
    "src_lines": f"with {FILES}, {LINES} select file_path, line_number, md5(line_content) as line_md5 from lines",
    "src_glob": f"with {FILES} select file_path from files where regexp_matches(file_path, '^src[12]/(.*/)?1..[.]txt$')",
    "src_extension": f"with {PATHS} select case page_id % 6 when 0 then 'rs' when 1 then 'txt' when 2 then 'pdf' when 3 then 'log' when 4 then 'py' else '' end as ext, count(*) as n from paths group by all",
    "out_json": f"""with {FILES}, {LINES} select '{{"path":"' || file_path || '","line":' || cast(line_number as varchar) || ',"content":"' || {JSON_TEXT} || '"}}' as line from lines where contains(line_content, 'the thor')""",
    "out_envelope": f"""select '{{"pattern":"the","type":"token","count":' || count(*) || ',"results":[' || string_agg('{{"path":"' || file_path || '"}}', ',' order by file_path) || ']}}' as line from ({bm25(["the"], "limit 20")})""",
    "out_plain": windows("contains(line_content, 'the thor')", 1, 1) + PLAIN,
    "upd_latest_wins": f"{LATEST} select path, action, event_id from l where r = 1",
    "upd_event_actions": f"with {EVENTS} select seq, path, {ACTION} as action from ev",
    "upd_rename_pair": f"""with {EVENTS}, c as (select path, {ACTION} as action, seq from ev where new_path is null union all select path, 'remove', seq from ev where new_path is not null union all select new_path, 'index', seq from ev where new_path is not null)
 select path, action, seq from (select *, row_number() over (partition by path order by seq desc, action desc) as r from c where action is not null) where r = 1""",
    "upd_vanished": f"{LATEST}, p as (select distinct path from changes where event_id % 2 = 0) select path, case when action = 'index' and path not in (select path from p) then 'remove' else action end as action from l where r = 1",
    "upd_delete": f"with {DOC_CHANGES} select path as file_path from ch where action is distinct from 'remove'",
    "upd_upsert": f"with {DOC_CHANGES} select file_path, md5(case when action = 'index' then 'new ' || content else content end) as content_md5 from files join ch on path = file_path where action is distinct from 'remove'",
    "bench_corpus_planted": f"with {BENCH} select regexp_extract(t, 'fn (initialize_connection|connect_database|handle_request)', 1) as planted, count(distinct file_path) as n from bench where planted <> '' group by 1",
    "bench_corpus_query": f"with {BENCH} select distinct file_path from bench where contains(t, 'request')",
}


def _extracted(language: str) -> str:
    own = lambda c: f"replace(replace(s.{c}, '<T>', t), '<w>', w)"
    return f"""with p as (select p_partkey as k, upper(substr(f, 1, 1)) || substr(f, 2) || p_partkey as t, lower(f) || p_partkey as w from (select p_partkey, split_part(p_name, ' ', 1) as f from part)),
 s(by_, rest, kind, name, container_name, visibility) as (values {symbols_sql(language)})
 select 'src/{language}/f' || k || '.{EXTENSION[language]}' as repo_rel_path, kind, {own('name')} as name, {own('container_name')} as container_name, visibility, '{language}' as language from p join s on k % by_ = rest"""


ORACLES["stream_latest_wins"] = ORACLES["upd_latest_wins"]
ORACLES |= {f"extract_symbols_{language}": _extracted(language) for language in EXTENSION}
