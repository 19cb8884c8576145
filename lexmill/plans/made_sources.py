"""Source files in ten languages, made from the rows of a table, and the symbols that they declare.

A file is put together from segments.  A segment (by, rest, text, symbols) is there if the row's number modulo
by is rest; its symbols are (kind, name, container, visibility).  TYPE and WORD stand for names of the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Symbol = tuple[str, str, str | None, str | None]
Segment = tuple[int, int, str, list[Symbol]]

TYPE, WORD = "<T>", "<w>"

EXTENSION = {"go": "go", "rust": "rs", "python": "py", "typescript": "ts", "java": "java", "c": "c", "cpp": "cpp", "csharp": "cs", "ruby": "rb", "zig": "zig"}

SEGMENTS: dict[str, list[Segment]] = {
    "go": [
        (1, 0, 'package orchard\n\nimport "sort"\n\n// <T> keeps ripe fruit.\ntype <T> struct {\n\tRows, Columns int\n\tlabel string\n}\n\n', [("struct", "<T>", None, "pub"), ("field", "Rows", "<T>", None), ("field", "Columns", "<T>", None), ("field", "label", "<T>", None)]),
        (2, 0, "func (o *<T>) Harvest(day int) (int, error) {\n\treturn day, nil\n}\n\n", [("method", "Harvest", "<T>", "pub")]),
        (2, 1, "func (o <T>) prune() { /* func ghost() {} */ }\n\n", [("method", "prune", "<T>", "private")]),
        (3, 0, "type Picker<T> interface {\n\tPick(n int) bool\n}\n\n", [("interface", "Picker<T>", None, "pub")]),
        (1, 0, "func <w>(xs []int) {\n\tsort.Ints(xs)\n}\n", [("function", "<w>", None, "private")]),
        (3, 1, 'const Season<T> = 4\nvar <w>Basket = "func no() {}"\n', [("constant", "Season<T>", None, "pub"), ("variable", "<w>Basket", None, "private")]),
        (3, 2, "type <T>Crate = map[string]int\n", [("type_alias", "<T>Crate", None, "pub")]),
    ],
    "rust": [
        (1, 0, "use std::fmt;\n\n/// A comet.\npub struct <T> {\n    pub mass: f64,\n    tail: Vec<u8>,\n}\n\n", [("struct", "<T>", None, "pub"), ("field", "mass", "<T>", "pub"), ("field", "tail", "<T>", "private")]),
        (2, 0, "impl <T> {\n    pub fn orbit(&self, years: u32) -> f64 {\n        self.mass * years as f64\n    }\n    fn fade(&mut self) {}\n}\n\n", [("method", "orbit", "<T>", "pub"), ("method", "fade", "<T>", "private")]),
        (2, 1, 'impl fmt::Display for <T> {\n    fn fmt(&self, out: &mut fmt::Formatter) -> fmt::Result {\n        write!(out, "fn ghost() {{}}")\n    }\n}\n\n', [("method", "fmt", "<T>", "private")]),
        (3, 0, "pub(crate) enum Phase<T> { New, Full }\n", [("enum", "Phase<T>", None, "pub")]),
        (3, 1, "trait Glow<T> {\n    fn glow(&self) -> u8;\n}\n", [("trait", "Glow<T>", None, "private")]),
        (3, 2, "const LIMIT: usize = 9;\npub type <T>Map = Vec<u8>;\npub mod <w>_sky {\n    pub fn <w>() {}\n}\n", [("constant", "LIMIT", None, "private"), ("type_alias", "<T>Map", None, "pub"), ("module", "<w>_sky", None, "pub"), ("function", "<w>", None, "pub")]),
    ],
    "python": [
        (1, 0, "import re\nfrom math import sqrt as root, pi\n\nRATIO_<T> = 2\n\n", [("import", "root", None, None), ("import", "pi", None, None), ("variable", "RATIO_<T>", None, None)]),
        (2, 0, 'class <T>(dict):\n    """def ghost(): pass"""\n\n    depth = 0\n\n    def dive(self, metres: int = 3) -> int:\n        return metres\n\n    async def rise(self):\n        pass\n\n', [("class", "<T>", None, None), ("variable", "depth", "<T>", None), ("method", "dive", "<T>", None), ("method", "rise", "<T>", None)]),
        (2, 1, "def <w>(reef):\n    # class Ghost: pass\n    return [w for w in reef]\n\n", [("function", "<w>", None, None)]),
        (3, 0, "@lru_cache\ndef tide_<w>():\n    pass\n", [("function", "tide_<w>", None, None)]),
    ],
    "typescript": [
        (1, 0, 'import { Bell } from "./bell";\n\n', []),
        (2, 0, 'export class <T> {\n  readonly pitch = 440;\n  static ring(times: number): string {\n    return "x".repeat(times);\n  }\n  private async mute(): Promise<void> {}\n}\n\n', [("class", "<T>", None, None), ("method", "ring", "<T>", None), ("method", "mute", "<T>", None)]),
        (2, 1, "export default function <w>(a: Bell[]) {\n  return a.length;\n}\n\n", [("function", "<w>", None, None)]),
        (3, 0, "export interface Tune<T> {\n  bars: number;\n}\nconst enum Key<T> { A, B }\n", [("interface", "Tune<T>", None, None), ("enum", "Key<T>", None, None)]),
        (3, 1, "type <T>Pair = [number, string];\nlet <w>Count = 0;\nconst <w>Play = async (n: number) => {\n  return n;\n};\n", [("type_alias", "<T>Pair", None, None), ("variable", "<w>Count", None, None), ("variable", "<w>Play", None, None)]),
        (3, 2, "// function ghost() {}\nvar <w>Text = `class Ghost {}`;\n", [("variable", "<w>Text", None, None)]),
    ],
    "java": [
        (1, 0, "package museum;\n\nimport java.util.Map;\nimport static java.lang.Math.max;\nimport java.io.*;\n\n", [("import", "Map", None, None), ("import", "max", None, None)]),
        (1, 0, "public final class <T> extends Hall {\n  private static final int ROOMS = 12;\n  protected String curator;\n", [("class", "<T>", None, "pub"), ("field", "ROOMS", "<T>", "private"), ("field", "curator", "<T>", "protected")]),
        (2, 0, "  public <T>(String curator) {\n    this.curator = curator;\n  }\n", [("method", "<T>", "<T>", "pub")]),
        (2, 1, "  @Override\n  public Map<String, Integer> visitors(int day) throws Exception {\n    return null; // class Ghost {}\n  }\n", [("method", "visitors", "<T>", "pub")]),
        (3, 0, "  enum Wing { EAST, WEST }\n", [("enum", "Wing", "<T>", None)]),
        (3, 1, "  interface Guide {\n    int LANGUAGES = 5;\n    void lead(String group);\n  }\n", [("interface", "Guide", "<T>", None), ("constant", "LANGUAGES", "Guide", "pub"), ("method", "lead", "Guide", None)]),
        (1, 0, "}\n", []),
    ],
    "c": [
        (1, 0, "#include <stdio.h>\n#define DEPTH_<T> 40\n#define TWICE(x) ((x) * 2)\n\nstruct <T> {\n  double salt;\n  int waves;\n};\n\n", [("constant", "DEPTH_<T>", None, None), ("struct", "<T>", None, None)]),
        (2, 0, "static int <w>(const struct <T> *sea, int n) {\n  /* int ghost(void) {} */\n  return sea->waves + n;\n}\n\n", [("function", "<w>", None, None)]),
        (2, 1, "enum Tide<T> { LOW, HIGH };\n", [("enum", "Tide<T>", None, None)]),
        (3, 0, "typedef unsigned long <w>_t;\n", [("type_alias", "<w>_t", None, None)]),
        (3, 1, "unsigned int <w>_buoys = 3;\n", [("variable", "<w>_buoys", None, None)]),
    ],
    "cpp": [
        (1, 0, "namespace harbour {\n\n", [("module", "harbour", None, None)]),
        (2, 0, "template <typename Cargo>\nclass <T> : public Ship {\n public:\n  explicit <T>(int tons) : tons_(tons) {}\n  Cargo unload(int crane) const { return Cargo(); }\n private:\n  int tons_ = 0;\n};\n\n", [("class", "<T>", "harbour", None), ("method", "<T>", "<T>", None), ("method", "unload", "<T>", None), ("field", "tons_", "<T>", None)]),
        (2, 1, "struct Rope<T> {\n  double length;\n};\n", [("struct", "Rope<T>", "harbour", None), ("field", "length", "Rope<T>", None)]),
        (3, 0, "enum class Flag<T> : char { Red, Green };\n", [("enum", "Flag<T>", "harbour", None)]),
        (3, 1, "using <T>List = std::vector<int>;\n", [("type_alias", "<T>List", "harbour", None)]),
        (1, 0, "inline int <w>(int berth) {\n  return berth;\n}\n\n}  // namespace harbour\n", [("function", "<w>", "harbour", None)]),
    ],
    "csharp": [
        (1, 0, "using System;\n\nnamespace Bakery.Ovens {\n  public sealed class <T> : IDisposable {\n    private readonly double heat = 180.5;\n", [("module", "Bakery.Ovens", None, None), ("class", "<T>", "Bakery.Ovens", "pub"), ("field", "heat", "<T>", "private")]),
        (2, 0, "    public string Label { get; private set; }\n", [("property", "Label", "<T>", "pub")]),
        (2, 1, "    internal static int Bake(int loaves) {\n      return loaves; // void Ghost() {}\n    }\n", [("method", "Bake", "<T>", "internal")]),
        (3, 0, "    protected int Crumbs => 7;\n", [("property", "Crumbs", "<T>", "protected")]),
        (1, 0, "    public void Dispose() { }\n  }\n", [("method", "Dispose", "<T>", "pub")]),
        (3, 1, "  enum Grain<T> { Rye, Oat }\n", [("enum", "Grain<T>", "Bakery.Ovens", None)]),
        (3, 2, "  interface I<T> {\n    void Knead(int times);\n  }\n", [("interface", "I<T>", "Bakery.Ovens", None), ("method", "Knead", "I<T>", None)]),
        (1, 0, "}\n", []),
    ],
    "ruby": [
        (1, 0, "module Weather\n  class <T> < Station\n    UNITS = %w[mm hpa]\n", [("module", "Weather", None, None), ("class", "<T>", "Weather", None), ("constant", "UNITS", "<T>", None)]),
        (2, 0, "    def rain(hours)\n      hours.map do |h|\n        h + 1\n      end\n    end\n\n", [("method", "rain", "<T>", None)]),
        (2, 1, "    def self.wind(knots)\n      return 0 if knots.zero?\n      knots * 2\n    end\n", [("method", "wind", "<T>", "pub")]),
        (3, 0, "    def dry?\n      unless wet\n        true\n      end\n    end\n", [("method", "dry?", "<T>", None)]),
        (1, 0, "  end\nend\n", []),
        (3, 1, "def <w>\n  # class Ghost\nend\n", [("function", "<w>", None, None)]),
    ],
    "zig": [
        (1, 0, 'const std = @import("std");\n\n', [("constant", "std", None, "private")]),
        (2, 0, "pub const <T> = struct {\n    knots: u32 = 0,\n\n    pub fn tie(self: *<T>) void {\n        self.knots += 1;\n    }\n};\n", [("constant", "<T>", None, "pub"), ("function", "tie", None, "pub")]),
        (2, 1, "fn <w>(rope: []const u8) usize {\n    // fn ghost() void {}\n    return rope.len;\n}\n", [("function", "<w>", None, "private")]),
        (3, 0, "pub var <w>_total: u64 = 0;\n", [("variable", "<w>_total", None, "pub")]),
        (3, 1, 'test "knot <w>" {\n}\n', [("function", "knot <w>", None, None)]),
    ],
}


def _named(text: str, type_name: str, word: str) -> str:
    return text.replace(TYPE, type_name).replace(WORD, word)


def source_of(language: str, number: int, type_name: str, word: str) -> tuple[str, set[Symbol]]:
    """A row's file and its symbols."""
    there = [s for s in SEGMENTS[language] if number % s[0] == s[1]]
    own = lambda x: x and _named(x, type_name, word)
    return own("".join(s[2] for s in there)), {tuple(map(own, x)) for s in there for x in s[3]}


def source_column(language: str, number: Column, type_name: Column, word: Column) -> Column:
    """A row's file."""
    text = F.concat(*[F.lit(s[2]) if s[0] == 1 else F.when(number % s[0] == s[1], F.lit(s[2])).otherwise(F.lit("")) for s in SEGMENTS[language]])
    return F.replace(F.replace(text, F.lit(TYPE), type_name), F.lit(WORD), word)


def symbols_sql(language: str) -> str:
    """The expected symbols as SQL rows (by, rest, kind, name, container_name, visibility)."""
    quoted = lambda x: "cast(null as varchar)" if x is None else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({by}, {rest}, {', '.join(map(quoted, s))})" for by, rest, _, found in SEGMENTS[language] for s in found)
