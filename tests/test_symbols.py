"""Symbol searches and extraction."""

import pytest

from lexmill.operators.symbols import SYMBOL_SCHEMA, InvalidQuery, search_symbols
from lexmill.plans.patterns import SymbolQuery
from lexmill.plans.made_sources import EXTENSION, SEGMENTS, source_of
from lexmill.sources.extract import extract_symbols, symbols_of


def rows(spark, *made):
    out = []
    for m in made:
        kind, name, lang, path, line, *rest = m
        qname = rest[0] if rest else None
        signature = rest[1] if len(rest) > 1 else None
        out.append((kind, name, qname, lang, path, None, None, signature, line, line, 0, len(name), None))
    return spark.createDataFrame(out, SYMBOL_SCHEMA)


def names(df):
    return [r["name"] for r in df.collect()]


def test_names(spark):
    table = rows(spark, *[("function", n, "go", "a.go", 1) for n in ("mixColour", "mixPaint", "theColourMixer", "washColour", "getBrush")])
    assert sorted(names(search_symbols(table, SymbolQuery(name="mix%")))) == ["mixColour", "mixPaint"]
    assert sorted(names(search_symbols(table, SymbolQuery(name="%colour")))) == ["mixColour", "washColour"]
    assert sorted(names(search_symbols(table, SymbolQuery(name="%colour%")))) == ["mixColour", "theColourMixer", "washColour"]
    assert names(search_symbols(table, SymbolQuery(name="the mixer"))) == ["theColourMixer"]
    assert names(search_symbols(table, SymbolQuery(name="the% mixer"))) == []
    with pytest.raises(InvalidQuery, match="at least 3 chars"):
        search_symbols(table, SymbolQuery(name="%ru%"))
    with pytest.raises(InvalidQuery):
        search_symbols(table, "kind:callable x")


def test_order_is_the_same_in_any_partitioning(spark):
    """Symbols of one path, line, kind and name come by what else they have."""
    made = [("function", "mix", "go", "a.go", 1, q, f"fn mix(size: {i})") for q in ("b::mix", "a::mix") for i in range(20)]
    expected = sorted((m[5], m[6]) for m in made)
    for given, parts in ((made, 1), (made[::-1], 3), (made[7:] + made[:7], 7)):
        found = search_symbols(rows(spark, *given).repartition(parts), "kind:fn", 15).select("qualified_name", "signature")
        assert list(map(tuple, found.collect())) == expected[:15]


def test_filters_and_order(spark):
    table = rows(spark, ("function", "mixColour", "go", "pkg/A.go", 3), ("struct", "MixColour", "rust", "b.rs", 1), ("function", "mixPaint", "go", "pkg/a.go", 1))
    assert names(search_symbols(table, "kind:fn lang:go mixcolour")) == ["mixColour"]
    assert names(search_symbols(table, "path:PKG/")) == ["mixPaint", "mixColour"]
    ties = rows(spark, ("function", "bbb", "go", "b.go", 20), ("function", "aaa", "go", "a.go", 20), ("method", "ccc", "go", "a.go", 10), ("function", "ddd", "go", "a.go", 10))
    assert names(search_symbols(ties, "lang:go")) == ["ddd", "ccc", "aaa", "bbb"]
    assert names(search_symbols(ties, "lang:go", limit=2)) == ["ddd", "ccc"]
    assert names(search_symbols(ties, "lang:go", glob="b.*")) == ["bbb"]


def test_qualified_names(spark):
    table = rows(spark, ("method", "mixColour", "go", "a.go", 1, "Easel::mixColour"))
    for q in ("easel::mixcolour", "%mixcolour", "easel%", "%el::mi%", "easel mix colour"):
        assert len(names(search_symbols(table, SymbolQuery(qualified_name=q)))) == 1, q
    assert names(search_symbols(table, "qname:Easel::")) == []


def test_refinement(spark):
    made = [("function", f"fn{i:03}", "go", "studio/paint/mixers.go", 3 * i + 1) for i in range(60)]
    content = "\n".join(f"func fn{i:03}() {{\n  {'ochre' if i == 59 else 'x'}\n}}" for i in range(60))
    out = [(k, n, None, lang, p, None, None, f"func {n}()", at, at + 2, 0, 1, None) for k, n, lang, p, at in made]
    table = spark.createDataFrame(out, SYMBOL_SCHEMA)
    files = spark.createDataFrame([("studio/paint/mixers.go", content)], "repo_rel_path string, content string")
    assert names(search_symbols(table, "kind:fn", 1, refine="ochre", files=files)) == ["fn059"]
    assert names(search_symbols(table, "kind:fn", refine="fn00[12]", files=files)) == ["fn001", "fn002"]


def found(path, text):
    return {(s["kind"], s["name"], s["container_name"], s["visibility"]) for s in extract_symbols(path, text)}


@pytest.mark.parametrize("language", EXTENSION)
@pytest.mark.parametrize("number", range(6))
def test_extraction(language, number):
    text, expected = source_of(language, number, f"Kiln{number}", f"kiln{number}")
    assert found(f"a.{EXTENSION[language]}", text) == expected
    assert not any("ghost" in str(s).lower() for s in found(f"a.{EXTENSION[language]}", text))


@pytest.mark.parametrize(("path", "text"), [("a.txt", "class Loom {}"), ("a.py", ""), ("noextension", "def f(): pass")])
def test_nothing_to_extract(path, text):
    assert found(path, text) == set()


#: A text that only bodies hold, by language.
BODY = {"go": ("return day", "sort.Ints", "Rows,"), "rust": ("self.mass", "write!", "pub mass"), "python": ("return metres", "return [w"), "typescript": ("repeat", "a.length", "bars:"), "java": ("this.curator", "return null", "EAST"), "c": ("sea->waves", "double salt"), "cpp": ("return Cargo", "return berth", "double length"), "csharp": ("return loaves", "Rye"), "ruby": ("hours.map", "knots *"), "zig": ("self.knots +=", "return rope")}


@pytest.mark.parametrize("language", EXTENSION)
def test_signatures_hold_no_body(language):
    whole = "".join(s[2] for s in SEGMENTS[language])
    assert all(b in whole for b in BODY[language])
    for number in range(6):
        for s in extract_symbols(f"a.{EXTENSION[language]}", source_of(language, number, "Kiln", "kiln")[0]):
            if s["kind"] not in ("field", "variable", "constant"):
                assert not any(b in s["signature"] for b in BODY[language]), s


def test_alias_keeps_braces_and_spans():
    (alias,) = extract_symbols("t.ts", "type Gauge = { read(): number }\n")
    assert alias["kind"] == "type_alias" and "read(): number" in alias["signature"]
    (f,) = extract_symbols("é.py", "# é\ndef f():\n    pass\n")
    assert (f["line_start"], f["line_end"], f["byte_start"], f["byte_end"]) == (2, 3, 5, 22)


@pytest.mark.parametrize("path", ["a.go", "a.rs", "a.py", "a.ts", "a.java", "a.c", "a.cpp", "a.cs", "a.rb", "a.zig"])
def test_broken_files_do_not_fail(path):
    for text in ("}}}} ((( {{{", "class {", "def", "fn (", '"unclosed', "/* open", "func (s *S) {", "type X = {", "\n\n\n", "struct { struct { } } }"):
        extract_symbols(path, text)


def test_symbols_of(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    pass\n"), ("b.txt", "x"), ("c.py", None)], "repo_rel_path string, content string")
    assert names(symbols_of(files)) == ["f"]
