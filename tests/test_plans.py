"""Patterns, symbol queries, literals, the dialect and globs."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.functions.dialect import BadPattern, jvm_pattern, py_pattern
from lexmill.functions.globs import glob_regex
from lexmill.plans.benchmark import Profile, grep_pattern, load_profiles, load_tasks, plan_metrics
from lexmill.plans.literals import literal_candidates, phrases, text_holds, token_candidates
from lexmill.plans.patterns import FilePattern, Mode, SymbolQuery, parse_file_pattern, parse_symbol_query


@pytest.mark.parametrize(
    ("text", "mode", "tokens"),
    [("connect", Mode.EXACT, ("connect",)), ("init%", Mode.PREFIX, ("init",)), ("%llo", Mode.SUFFIX, ("llo",)), ("%at%", Mode.SUBSTRING, ("at",)), ("Validate()", Mode.EXACT, ("validate",)),
     ("validate(%", Mode.PREFIX, ("validate",)), ("std::io", Mode.ALL_TERMS, ("std", "io")), ("%", Mode.EMPTY, ()), ("%%", Mode.EMPTY, ()), ("%a%", Mode.EMPTY, ()), ("", Mode.EMPTY, ())],
)
def test_file_patterns(text, mode, tokens):
    found = parse_file_pattern(text)
    assert (found.mode, found.tokens) == (mode, tokens)


def test_pattern_flags():
    assert parse_file_pattern("%::run") == FilePattern(Mode.SUFFIX, ("run",), True, False)


def test_symbol_queries():
    assert parse_symbol_query("kind:fn lang:go path:cmd/ init%") == SymbolQuery(("function", "method"), "go", "cmd/", "init%")
    assert parse_symbol_query("foo:bar handler") == SymbolQuery(name="foo:bar handler")
    assert not parse_symbol_query("foo:bar handler").has_filters
    for bad in ("kind:callable handler", "kind:fn lang:js handler"):
        found = parse_symbol_query(bad)
        assert found.invalid and not found.name and found.has_filters
    assert parse_symbol_query("kind:struct kind:type x").kinds == ("type_alias",)
    assert parse_symbol_query("lang:rs qname:a::b c").qualified_name == "a::b"
    for name in ("javascript", "js", "php", "swift", "kotlin", "kt"):
        assert parse_symbol_query(f"lang:{name}").invalid


@pytest.mark.parametrize(
    ("pattern", "branches"),
    [(r"impl.*for SearchResult", (("impl", "for", "searchresult"),)), ("TODO|FIXME|HACK", (("todo",), ("fixme",), ("hack",))), (r"\.unwrap\(\)", (("unwrap",),)), ("^pub fn ", (("pub", "fn"),)),
     (".*", ()), (r"\d+", ()), ("[invalid", ()), ("foo|b+", ())],
)
def test_token_candidates(pattern, branches):
    assert token_candidates(pattern).branches == branches


def test_phrases():
    assert [p.terms for p in phrases(r"context\.Context")] == [((0, "context"), (1, "context"))]
    assert [p.terms for p in phrases("foo a bar")] == [((0, "foo"), (2, "bar"))]
    assert any("New(" in b[0] for b in literal_candidates(r"errors?\.New\(").branches)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab(|)?*+.[]c", max_size=10), st.text(alphabet="abc.", max_size=12))
def test_literals_never_lose_a_match(pattern, text):
    try:
        compiled = re.compile(pattern)
    except re.error:
        return
    if compiled.search(text):
        assert text_holds(text, literal_candidates(pattern))


def test_dialect():
    assert jvm_pattern("a+") == "(?mdU)a+"
    assert jvm_pattern("a", True, True) == "(?mdUsiu)a"
    assert jvm_pattern("(?P<x>a)[[:alpha:]_]a++") == r"(?mdU)(?<x>a)[\p{Alpha}_]a+"
    assert jvm_pattern("[+*]+") == "(?mdU)[+*]+"
    for bad in ("(?=a)", "(?<!a)b", r"(a)\1", "[invalid", "(?U)a", "(?>a)"):
        with pytest.raises(BadPattern):
            jvm_pattern(bad)
        with pytest.raises(BadPattern):
            py_pattern(bad)


@pytest.mark.parametrize(
    ("glob", "path", "matches"),
    [("src/*.rs", "src/lib.rs", True), ("src/*.rs", "src/a/lib.rs", True), ("src/**/a.rs", "src/a.rs", True), ("src/**/a.rs", "src/x/y/a.rs", True), ("*.rs", "a.py", False), ("a?c", "abc", True),
     ("[!a]b", "ab", False), ("[a-c]b", "bb", True), ("**", "a/b", True)],
)
def test_globs(glob, path, matches):
    assert bool(re.search(glob_regex(glob).replace(r"\z", r"\Z"), path)) is matches


def test_bad_globs():
    for bad in ("a**", "***", "[a"):
        with pytest.raises(ValueError):
            glob_regex(bad)


def test_benchmark_files(tmp_path):
    good = tmp_path / "p.json"
    good.write_text('{"version": 1, "profiles": [{"key": "a", "lexical_queries": ["x"], "max_tracked_files": 10, "symbol_regex_queries": [{"symbol": "kind:fn", "regex": "x"}], "rg_equivalent": {}}]}')
    assert load_profiles(good)[0].fits(10) and not load_profiles(good)[0].fits(11)
    assert Profile("k", min_tracked_files=5).fits(5)
    for bad in ('{"profiles": [{"key": "a"}]}', '{"profiles": [{"key": "a", "lexical_queries": ["x"]}, {"key": "a", "lexical_queries": ["x"]}]}', '{"profiles": [{"key": "a", "lexical_queries": ["x"], "symbol_regex_queries": [{"symbol": "s"}]}]}'):
        good.write_text(bad)
        with pytest.raises(ValueError):
            load_profiles(good)
    good.write_text('{"tasks": [{"id": "t", "repo": "r", "prompt": "p", "expected_paths": ["a"], "x_symbol_queries": ["s"], "x_lexical_queries": ["l"], "rg_regex_queries": ["g"]}]}')
    assert load_tasks(good)[0]["symbol_queries"] == ["s"]


def test_grep_patterns():
    assert re.search(grep_pattern("%request%"), "handle_request")
    assert grep_pattern("handle%").endswith("handle")


def test_plan_metrics():
    assert plan_metrics([["a"], ["b", "c"]], ["c"]) == {"success": True, "first_hit_query": 2, "candidates": 3}
    assert plan_metrics([["a"]], ["z"]) == {"success": False, "first_hit_query": None, "candidates": 1}


@pytest.mark.parametrize("pattern", ["[[:upper:]][[:digit:]]", "[^[:space:]]x]", "[a-z&&[^aeiou]]q]", "[]a[]z"])
def test_classes_within_classes_promise_nothing(pattern):
    assert literal_candidates(pattern).everything and token_candidates(pattern).everything and phrases(pattern) == []


def test_choosing_files_and_lines_by_two_engines_agrees(spark):
    """With matches over several lines files are chosen by one engine and lines by another: no file without a line, no line without a file."""
    from lexmill.operators import regexes as rx
    from lexmill.operators.corpus import Corpus

    texts = ["fox\nden", "a fox\r\nden b", "Fox\n\nden", "foxden", "ÉTÉ\nété", "x1\ny2\nz3", "", "\n", "fox\n den\nfox\nden", "tab\there\nend"]
    corpus = Corpus(spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file_path string, content string"))
    for pattern in (r"fox\s+den", r"x\n\s?den", r"fox.den", r"[[:alpha:]]\d\n", r"\w+\n\w+", r"(?i)FOX\r?\n", r"été", r"\bden\b", r"^\s*$", r"e\nend", r"(a|b)\s"):
        files = {r["file_path"] for r in rx.matching_files(corpus, pattern, multiline=True).collect()}
        assert files == {r["file_path"] for r in rx.matching_lines(corpus, pattern, multiline=True).collect()}, pattern


def test_literals_end_at_an_optional_part():
    """Only a sequence that is exact as a whole is spelled out with and without it."""
    assert literal_candidates(r"(idiot|moron)s? \w+|clown").branches == (("idiot",), ("moron",), ("clown",))
    assert literal_candidates(r"https?://\w+").branches == (("http", "://"),)
    assert literal_candidates("colou?r").branches == (("color",), ("colour",))


def test_named_classes_are_ascii_in_both_engines(spark):
    """One character each: what a named class takes, by both engines and by ASCII's tables; letters are those of Unicode."""
    import string

    points = [chr(c) for c in range(0x250) if chr(c) not in "\n\r"] + list("٠—€ 　«")
    texts = spark.createDataFrame([(i, c) for i, c in enumerate(points)], "i int, c string").cache()
    ascii_sets = {"punct": string.punctuation, "upper": string.ascii_uppercase, "lower": string.ascii_lowercase, "digit": string.digits, "alnum": string.ascii_letters + string.digits, "xdigit": string.hexdigits, "space": " \t\v\f", "blank": " \t", "word": string.ascii_letters + string.digits + "_", "graph": string.ascii_letters + string.digits + string.punctuation, "print": string.ascii_letters + string.digits + string.punctuation + " ", "cntrl": [chr(c) for c in [*range(32), 127] if chr(c) not in "\n\r"], "ascii": [c for c in points if ord(c) < 128], "alpha": [c for c in points if c.isalpha()]}
    for name, expected in ascii_sets.items():
        for pattern, want in ((f"^[[:{name}:]]$", set(expected)), (f"^[[:^{name}:]]$", set(points) - set(expected)), (f"^[^[:{name}:]]$", set(points) - set(expected))):
            assert {r["c"] for r in texts.where(texts["c"].rlike(jvm_pattern(pattern))).select("c").collect()} == want, pattern
            assert {c for c in points if py_pattern(pattern).search(c)} == want, pattern
