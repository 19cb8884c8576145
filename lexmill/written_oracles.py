"""DuckDB SQL for the queries that read what the library wrote."""

from __future__ import annotations

from lexmill import oracles as o
from lexmill.oracles import ANY, BASE, EXACT, FILES, LINES, MULTI, OF_THE, OCC, PARTS, PREFIX, SUBSTRING, SUFFIX, THE_OF, bm25, n_of, phrase
from lexmill.written import COUNTED, FILE, SYMBOL_LANGUAGES, TREE_EXT, TREE_FOLDER

STATE = f"""{FILES}, now as (select file_path, case when doc_id % 11 <> 0 and doc_id % 7 = 0 then 'new ' || content else content end as content from files where doc_id % 11 <> 0 or doc_id is null)"""
NOW_FILES = f"with {STATE} select file_path, md5(content) as content_md5 from now"
_NOW_OCC = OCC.replace("from files", "from now")
TERMS = "select token, count(distinct file_path) as df, count(*) as cf from occ group by token"
COUNTS = dict(zip(COUNTED, (EXACT, PREFIX, SUFFIX, SUBSTRING, o.all_of(["token = 'the'", "token = 'of'"])), strict=True))
UPDATED_TERMS = f"with {STATE}, {_NOW_OCC} {TERMS}"

_TREE = f"""t0 as (select s_suppkey as k, s_name, {TREE_FOLDER} as folder, {TREE_EXT} as ext from supplier),
 t as (select k, folder, ext, {FILE} as p, case when k % 10 = 0 then s_name || repeat(' more', 100) else s_name end as content from t0),
 judged as (select *, octet_length(encode(content)) as size, case when ext = '.skip.txt' and folder <> 'sub/' then 'ignored' when ext = '.md' and folder = 'sub/' then 'ignored' when ext = '.log' then 'extension'
  when octet_length(encode(content)) > 400 then 'size' when ext = '.pdf' then 'unreadable' end as why from t where folder not in ('.hidden/', 'gen/')),
 tree as (select p as repo_rel_path, size, case when why is null then md5(content) end as content_md5, why as reason from judged
  union all select folder, 0, null, case folder when 'gen/' then 'ignored' else 'hidden' end from (select distinct folder from t where folder in ('.hidden/', 'gen/'))
  union all select '.gitignore', 17, null, 'hidden' union all select 'sub/.gitignore', 17, null, 'hidden')"""
_SKIPS = f"""with {_TREE}, r as (select reason, repo_rel_path as path, row_number() over (partition by reason order by repo_rel_path) as k from tree where reason is not null)
 select reason, count(*) as n, string_agg(case when k <= 3 then path end, ',' order by path) as samples from r group by reason"""
_CHANGED = f"""with {_TREE}, c as (select repo_rel_path as path, cast(regexp_extract(repo_rel_path, 'f(\\d+)', 1) as bigint) as k from tree where reason is null)
 select path, 'index' as action from c where k % 3 = 0 or k % 5 = 0 union all select 'gone0', 'remove'"""
_SYMBOL_TEXT = f"""with {o.SYMBOLS}, s as (select *, row_number() over (order by repo_rel_path, line_start, kind, lower(name)) as i from sym where kind = 'class'), f as (select * from s where i <= 15),
 l as (select i, unnest(['', i || '. ' || name || ' (' || kind || ')', '   ' || repo_rel_path || ':' || line_start || '  lang:' || language, '   ' || signature]) as line, unnest([1, 2, 3, 4]) as j from f)
 select cast(1 as int) as line_number, 'Found ' || (select count(*) from f) || ' symbols for: kind:class' as line union all select cast(4 * (i - 1) + j + 1 as int), line from l"""
_SYMBOLS = " union all ".join(f"select * from ({o.ORACLES[f'extract_symbols_{x}']})" for x in SYMBOL_LANGUAGES)
_TIMED = "(select event_type as query, value as ms from events where event_id % 2 = {0})"
_STATS = "select query, avg(ms) as avg, quantile_cont(ms, 0.5) as p50, quantile_cont(ms, 0.95) as p95, quantile_cont(ms, 0.99) as p99 from {0} group by query"

ORACLES: dict[str, str] = {
    "pidx_exact": EXACT, "pidx_prefix": PREFIX, "pidx_suffix": SUFFIX, "pidx_substring": SUBSTRING, "pidx_multi_and": MULTI, "pidx_multi_substring": PARTS, "pidx_phrase": OF_THE, "pidx_phrase_gap": THE_OF, "pidx_any_branch": ANY,
    "pidx_rank": bm25(["of", "the"], "limit 20"), "pidx_rank_phrase": o.ORACLES["rank_phrase"], "pidx_regex": o.ORACLES["rx_files"], "pidx_regex_lines": o.ORACLES["rx_lines"],
    "pidx_terms": f"{BASE} {TERMS}", "pidx_stored_terms": f"{BASE} {TERMS}", "pidx_lengths": f"{BASE} select f.file_path, count(o.token) as dl from files f left join occ o using (file_path) group by f.file_path",
    "pidx_files": f"with {FILES} select file_path, md5(content) as content_md5 from files", "pidx_stats": o.ORACLES["stats_index"],
    "pidx_upd_files": NOW_FILES, "pidx_cmp_files": NOW_FILES, "stream_applied_files": NOW_FILES,
    "pidx_upd_exact": f"with {STATE}, {_NOW_OCC} select distinct file_path from occ where token = 'new'", "pidx_upd_suffix": f"with {STATE}, {_NOW_OCC} select distinct file_path from occ where suffix(token, 'tion')",
    "pidx_upd_terms": UPDATED_TERMS, "pidx_cmp_terms": UPDATED_TERMS,
    "pidx_status": f"with {STATE}, a as (select (select count(*) from files) as n, (select count(*) from now) as m) select unnest(['base', 'updated', 'compacted']) as state, unnest([n, m, m]) as n_files, unnest([1, 2, 1])::bigint as n_segments, false as dirty, false as needs_rebuild, true as has_bytes from a",
    "pidx_life_cycle": "select unnest(['needs a build at first', 'same files reuse the generation', 'a generation aside is not active', 'cleaning removes it', 'a dirty mark asks for a rebuild', 'a rebuild replaces the generation', 'every file is there']) as step, true as holds",
    "pidx_symbols": _SYMBOLS, "pidx_symbol_search": f"select repo_rel_path, name, container_name from ({o.ORACLES['extract_symbols_java']}) where kind = 'method' and name = 'visitors'",
    "stream_events": f"with {o.DOC_CHANGES} select path, true as told from ch where action is not null",
    "src_scan": f"with {_TREE} select * from tree", "src_scan_skips": _SKIPS, "src_tree_changes": _CHANGED,
    "src_fingerprint": "select count(*) as n_files, true as same_in_any_order, true as changes_with_a_file from documents",
    "cnt_dispatch": " union all ".join(f"select '{p}' as pattern, ({n_of(sql)}) as n" for p, sql in COUNTS.items()),
    "top_limits": f"with a as (select ({n_of(EXACT)}) as n, ({n_of(o.any_line('the'))}) as m) select unnest(['default', 'five', 'all']) as \"case\", unnest([least(7, n), least(5, n), n]) as tokens, unnest([least(7, m), least(5, m), m]) as files from a",
    "out_symbol_text": _SYMBOL_TEXT,
    "rx_literal_files": f"with {FILES} select file_path from files where contains(content, 'idiot') or contains(content, 'moron') or contains(content, 'clown')",
    "rx_token_files": f"{BASE} select file_path from occ group by file_path having bool_or(contains(token, 'the')) and bool_or(contains(token, 'thor'))",
    "rx_phrase_files": " union ".join(f"select file_path from ({phrase(w, 'the', 1)})" for w in ("of", "in")),
    "rx_posix": f"with {FILES}, {LINES} select file_path, line_number from lines where regexp_matches(line_content, '[[:upper:]][[:digit:]]|[[:punct:]]{{2}}')",
    "bench_latency": f"select query, round(avg, 6) as avg, round(p50, 6) as p50, round(p95, 6) as p95, round(p99, 6) as p99 from ({_STATS.format(_TIMED.format(0))})",
    "bench_regressions": f"with c as ({_STATS.format(_TIMED.format(0))}), b as ({_STATS.format(_TIMED.format(1))}) select query, round(c.p50, 6) as p50, round(b.p50, 6) as base_p50, round(c.p50 / b.p50, 6) as ratio, case when c.p50 / b.p50 > 1.02 then 'fail' when c.p50 / b.p50 > 1 then 'warn' else 'ok' end as status from c join b using (query)",
    "an_byte_line": "select doc_id, cast(1 + length(h) - length(replace(h, chr(10), '')) as int) as line from (select doc_id, substr(text, 1, instr(text, 'the ') - 1) as h from documents where instr(text, 'the ') > 0)",
    "an_clean_type": "select p_partkey, replace(p_brand, '#', '') as name from part",
}
