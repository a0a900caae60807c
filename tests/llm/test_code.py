import random

import numpy as np
import pytest

from loamdex.llm import docpairs, grammars, handwritten, spans, syntax
from loamdex.llm.common import blocks_with_context, text_blocks

# ------------------------------------------------------------------------------------------------------------- blocks


def test_blocks(spark, tables):
    text = "\n".join(f"line {i}" for i in range(1, 26))
    lines, files = tables({1: ("r/a.py", "python", text), 2: ("r/b.py", None, ""), 3: ("r/c.py", "go", None)})
    got = {(r["file_id"], r["block"]): r["text"] for r in text_blocks(lines, None, 10).collect()}
    assert "\n".join(got[1, b] for b in range(3)) == text and got[2, 0] == ""
    near = {r["block"]: r for r in blocks_with_context(lines, 2, 3, 10).where("file_id = 1").collect()}
    assert near[1]["before"] == "line 9\nline 10" and near[1]["after"] == "line 21\nline 22\nline 23" and near[1]["own"].startswith("line 11") and not near[2]["more_after"] and near[1]["first_line"] == 11


# ------------------------------------------------------------------------------------------------------------- spans


def brute(texts, n=spans.SPAN):
    seen = {}
    for i, t in texts.items():
        for k in range(len(t) - n + 1):
            seen.setdefault(t[k:k + n], set()).add(i)
    return {(a, b) for s in seen.values() for a in s for b in s if a < b}, {i: sum(any(len(seen[t[j:j + n]]) > 1 for j in range(max(0, k - n + 1), min(k, len(t) - n) + 1)) for k in range(len(t))) for i, t in texts.items()}


def test_shared_spans_equal_brute_force(spark, tables):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    shared = {n: word(n) for n in (199, 200, 201, 240, 600)}
    wide = "".join(rng.choice("äö漢😀x\n") for _ in range(220))
    texts = {}
    for i in range(1, 15):
        texts[i] = word(rng.randint(0, 300)) + (shared[(199, 200, 201, 240, 600)[i % 5]] if i < 11 else wide) + word(rng.randint(0, 200))
    texts |= {15: "", 16: "short", 17: "a" * 900, 18: "a" * 250 + "b", 19: texts[4], 20: "x" + "\n" * 300, 21: "y" + "\n" * 250}
    crossing = "\n".join(word(3).replace("\n", "z") for _ in range(90))
    texts |= {22: "\n".join(str(rng.random()) for _ in range(215)) + crossing + word(900), 23: word(40) + crossing[5:], 24: "\n" * 470 + crossing[80:300] + "\n" * 300}
    lines, files = tables({i: (f"r/{i}.txt", None, t) for i, t in texts.items()}, dirt=False)
    pairs, share = brute(texts)
    for block in (2000, 260):
        assert {tuple(r) for r in spans.shared_pairs(lines, files, block).collect()} == pairs, block
    got = {r["file_id"]: (r["n_chars"], r["shared_chars"]) for r in spans.shared_share(lines, files, 260).collect()}
    assert got == {i: (len(t), share[i]) for i, t in texts.items()}
    assert sum(r["length"] for r in spans.shared_spans(lines, files, 260).where("file_id = 19").collect()) >= 240


def test_spans_of_odd_tables(spark, tables):
    lines, files = tables({1: ("r/a.py", "python", "def a():\n" * 40), 2: ("r/b.py", None, "def a():\n" * 40), 3: ("r/c.py", "go", None)})
    assert {tuple(r) for r in spans.shared_pairs(lines, files).collect()} == {(1, 2)}
    assert spans.shared_pairs(lines.limit(0), files).count() == 0 and spans.shared_pairs(lines, files.limit(0)).count() == 0


def test_cut_points_move_with_the_text():
    rng = np.random.default_rng(1)
    t = "".join(map(chr, rng.integers(97, 123, 3000)))
    a, b = set(spans.Text(t).cuts()), set(spans.Text("inserted" + t).cuts())
    assert {x + 8 for x in a if x > 60} <= b and max(np.diff(sorted(a))) <= spans.RUN


# --------------------------------------------------------------------------------------------------------- documentation

PY = '''import x

# Reads the whole table and drops rows without a key.
@cached
def read_table(path):
    return 1


# read table
def read_table2(path):
    """Sum up what is left after the last run.

    :param path: table
    """
    return 2

# Detached words about the next one thing.

def third(a,
          b):
    # inside
    return 3


# TODO
# :param a: thing here now
# pylint: disable=all
def fourth(a):
    pass


# fourth(a, 12)
# return value
def fifth(a): return 1


def sixth():
    'One line that says what it does.'
'''


def documented(spark, tables, language, text, functions, path="r/a.x"):
    lines, files = tables({1: (path, language, text)})
    rows = text.split("\n")
    at = [(i, 1, "function", f, next(n for n, t in enumerate(rows, 1) if f + "(" in t and not t.lstrip().startswith(("#", "//", "*"))), "sig") for i, f in enumerate(functions)]
    symbols = spark.createDataFrame(at + at[:1] + [(99, 1, "class", "X", 1, "s"), (98, None, "function", "Y", 1, "s"), (97, 1, "function", "Z", None, "s"), (96, 1, None, None, 1, None)], "id bigint, file_id bigint, kind string, name string, line int, signature string")
    return {r["name"]: r for r in docpairs.pairs(lines, files, symbols).collect()}


def test_python_documentation(spark, tables):
    got = documented(spark, tables, "python", PY, ["read_table", "read_table2", "third", "fourth", "fifth", "sixth"])
    assert set(got) == {"read_table", "read_table2", "sixth"}
    assert got["read_table"]["description"].startswith("Reads the whole table") and got["read_table2"]["description"] == "Sum up what is left after the last run."
    assert got["read_table"]["body"] == "def read_table(path):\n    return 1" and got["sixth"]["description"] == "One line that says what it does."


@pytest.mark.parametrize("above,real", [
    ("/**\n * Restores both halves before they meet again.\n * @param a thing\n */", True), ("/** Internal. */", False), ("// Copies all of the given rows over.\n//go:noinline", True), ("/* NOLINTNEXTLINE */", False), ("// f(a, 3);", False), ("/*\n   Walks every row once more.\n*/", True),
    ("// FIXME walk rows again", False), ("/**\n * @return int\n */", False), ("// was: for (x of y) {", False), ("/** Walks every row once more. */\n\n", False), ("int other; // Walks every row once more", False)])
def test_comments_above(spark, above, real):
    ls = (above + "\nint f(int a) {\n}").split("\n")
    assert bool(docpairs.pair(ls, [(len(ls) - 2, "f", "")], "c")) == real


def test_assignment_is_the_best():
    rng = random.Random(2)
    from itertools import permutations

    for _ in range(60):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        w = {(i, j): rng.randint(1, 20) for i in range(n) for j in range(m) if rng.random() < 0.8}
        got = docpairs.assign(w)
        assert len(set(got.values())) == len(got) and all((i, j) in w for i, j in got.items())
        best = max(sum(w.get((i, p[i]), 0) for i in range(n)) for p in permutations(range(max(m, n) + n), n))
        assert sum(w[i, j] for i, j in got.items()) == best


def test_documentation_of_long_files(spark, tables):
    text = "\n".join(["x = 1"] * 990 + ["# Reads the whole table and drops rows."] + ["def f(a):"] + ["    y = 1"] * 900 + ["z = 1"])
    lines, files = tables({1: ("r/a.py", "python", text)})
    symbols = spark.createDataFrame([(1, 1, "function", "f", 992, "def f(a):")], "id bigint, file_id bigint, kind string, name string, line int, signature string")
    r = docpairs.pairs(lines, files, symbols, block_lines=992).collect()
    assert len(r) == 1 and r[0]["body"].count("\n") == 900
    assert docpairs.pairs(lines, files, symbols.limit(0)).count() == 0 and docpairs.documented(lines.limit(0), files, symbols).count() == 0


# ----------------------------------------------------------------------------------------------------------------- syntax

VALID = {
    "python": ["def f(x):\n    return [i for i in x if i]\n", "s = '''<<<<<<< HEAD\n'''\n"],
    "javascript": ["const f = async (a, {b, ...c} = {}) => { await a?.b(`x${c}y`); };\nexport default class A extends B { static x = 1; get y() { return /[({]/.test(this.z) ? 1 : 2 } }\n", "var a = 1\nvar b = function() { return a / 2 / b }\nfor (const [k, v] of m) if (k) continue; else break\nlabel: while (true) { do { i++ } while (i < 3) }\nswitch (x) { case 'a': y(); default: z() }\ntry { a() } catch { b() } finally { c() }\n/* <<<<<<< HEAD */\nimport x, { y as z } from \"m\"; export * from \"n\"; export { a };\n"],
    "typescript": ["interface A<T> { a?: string; b(x: number): void }\ntype U = 'a' | 'b' | { c: number[] };\nexport const f = <T>(x: T, y?: Map<string, number>): Promise<T> => { return x as any; };\nabstract class C implements A<number> { private readonly x: string = \"\"; constructor(private y: number) { super(); } public get z(): string { return this.x! } }\nenum E { A, B = 2 }\n@dec()\nclass D {}\n"],
    "go": ["package a\n\nimport (\n\t\"os\"\n\tx \"y\"\n)\n\ntype T struct {\n\tA int `json:\"a\"`\n\tB map[string][]int\n}\n\nfunc (t *T) F(a int, b ...string) (int, error) {\n\tif x, ok := m[a]; ok && x > 1 {\n\t\treturn x, nil\n\t} else if a == 2 {\n\t\tgo func() { t.B = nil }()\n\t}\n\tfor i := 0; i < 3; i++ {\n\t\tswitch {\n\t\tcase i > 1:\n\t\t\tcontinue\n\t\tdefault:\n\t\t}\n\t}\n\tv := []T{{A: 1}, {A: 2}}\n\t_ = v\n\tselect {\n\tcase c <- 1:\n\t}\n\treturn 0, nil\n}\n"],
    "java": ["package a.b;\nimport java.util.*;\n@Ann(x = 1)\npublic final class A<T extends B> extends C implements D {\n  private static final int[] X = {1, 2};\n  static { Y.put(\"a\", 1); }\n  enum E { P, Q }\n  @Override\n  public <K> Map<K, List<T>> f(int a, final String... b) throws E1, E2 {\n    for (int i = 0; i < 3; i++) { if (a > b[i].length) continue; else break; }\n    for (String s : b) System.out.println((int) s.length());\n    Runnable r = () -> { g(); };\n    try (X x = new X()) { x.y(A::z); } catch (E1 | E2 e) { throw new R(e); } finally { }\n    return a == 1 ? null : new HashMap<>();\n  }\n}\n"],
    "c": ["#include <a.h>\n#define X(a) \\\n  (a)\ntypedef struct s { int a; char *b; } s_t;\nenum e { A, B = 2 };\nstatic const unsigned char T[] = { 0x1, 0x2, };\nstatic inline int f(const char *a, unsigned long b, ...) {\n  for (int i = 0; i < 3; i++) { if (a[i] == 'x') continue; else break; }\n  s_t v = { .a = 1, .b = \"x\" \"y\" };\n  int *p = (int *) malloc(sizeof(int) * b);\n  switch (b) { case 1: return *p; default: goto end; }\n  do { p++; } while (p->q);\nend:\n  return v.a ? -1 : 0;\n}\n"],
    "ruby": ["require 'a'\nmodule A\n  class B < C\n    attr_reader :a\n    X = %w[a b].freeze\n    def f(a, b = 1, *c, k: 2, &d)\n      return unless a\n      a.each do |x, y|\n        puts \"#{x} #{y[:z]}\" if x\n      end\n      h = { a: 1, 'b' => 2 }\n      case a\n      when 1 then b\n      else c\n      end\n    rescue E => e\n      raise\n    ensure\n      d.call(e)\n    end\n    def g(x) = x + 1\n  end\nend\nwhile x do y end\nz = if a then b else c end\ns = <<~EOS\n  >>>>>>> text\nEOS\n"],
    "shell": ["#!/bin/bash\nset -e\nf() {\n  local a=\"$(g \"$1\" \"${2:-x}\")\"\n  if [ \"$a\" -gt 3 ] && ! h; then\n    echo $((a + 1)) >&2\n  elif true; then :; else\n    for x in \"$@\"/*; do echo \"$x\"; done\n  fi\n  while read -r l; do case \"$l\" in a|b) x;; *) y ;; esac; done < f\n}\narr=(1 \"2 3\")\ncat <<EOF\n$(not closed\nEOF\n((i++)) || true\n(cd x && y) | z\n[[ $a =~ ^(x|y)$ ]] && echo ok # \"\n"],
}
BROKEN = {
    "python": ["def f(:\n  pass", "x = (1,\n", "if x\n    y()\n", "<<<<<<< HEAD\nx = 1\n"], "javascript": ["function f( {", "var x = ;", "if (a > 3 {\n}", "a b", "f('x);\n", "x = 1 }", "<<<<<<< a\nx\n", "{ \"a\": 1 }", "var “x” = 1;", "@@ -1 +1 @@"],
    "typescript": ["const x: = 1;", "class {", "f(a,, b", "=======\n"], "go": ["func f() {}\n", "package a\nfunc f() {\n", "package a\nfunc f() {\n\tif (x > 3 {\n\t}\n}\n", "package a\nx := 1\n", "package a\nfunc f() {\n\tf(a\n\t)\n}\n", "package a\nfunc f() {\n\ta b\n}\n"],
    "java": ["class A { int f( { } }", "class A { void f() { return 1 } }", "def f(): pass", "class A { } }", "class A { String s = \"x; }"], "c": ["int f(void) { return 1 }", "int f( {", "x = 1;", "int a[3] = {1, 2;", "char *s = \"x;\n"],
    "ruby": ["def f\n", "x = (1\n", "end\n", "class A\n  def f\n  end\n", "<<<<<<< HEAD\n", "f(1))\n"], "shell": ["if true; then\n", "f() {\n", "echo \"x\n", "done\n", "for x in a; do\n  y\n", "if then\n  x\nfi\n", "x )\n", "<<<<<<< HEAD\n>>>>>>> b\n"],
}


@pytest.mark.parametrize("language", grammars.LANGUAGES)
def test_grammars(language):
    for t in VALID[language] + ["", "\n\n"]:
        assert grammars.check(t, language) is None, (language, grammars.check(t, language), t)
    for t in BROKEN[language]:
        assert grammars.check(t, language), (language, t)
    for t in VALID[language]:
        for cut in (t.rstrip()[:-1],):
            assert language in ("python", "ruby", "shell", "javascript") or grammars.check(cut, language), (language, cut[-20:])


def test_invalid_files(spark, tables):
    lines, files = tables({1: ("r/a.py", "python", VALID["python"][0]), 2: ("r/b.py", "python", VALID["java"][0]), 3: ("r/c.js", "javascript", "f(\n"), 4: ("s/d.css", "css", "a {"), 5: ("s/e.py", "python", ""), 6: ("s/f.py", "python", None), 7: ("s/g", None, "(")})
    got = {r["file_id"]: r["looks_like"] for r in syntax.invalid_files(lines, files).collect()}
    assert got == {2: "java", 3: None}
    rates = {(r["repository"], r["language"]): (r["files"], r["invalid"], r["foreign"], r["rate"]) for r in syntax.invalid_rates(lines, files).collect()}
    assert rates == {("r", "python"): (2, 1, 1, 0.5), ("r", "javascript"): (1, 1, 0, 1.0), ("s", "python"): (2, 0, 0, 0.0)}
    assert syntax.invalid_files(lines.limit(0), files).count() == 0


@pytest.mark.parametrize("language", ["python", "javascript", "go", "java", "ruby", "c", "shell", "typescript"])
def test_long_files_in_pieces(spark, tables, language):
    unit = {"python": "def f(x):\n    s = '''a\nx\n'''\n    return [\n        1,\n    ]\n", "go": "func f(a int) int {\n\ts := `x\ny`\n\treturn a\n}\n"}.get(language) or VALID[language][-1]
    whole = ("package a\n" if language == "go" else "") + (unit * 6 if language != "java" else unit)
    bad = whole + {"python": "def g(:\n"}.get(language, "((\n")
    lines, files = tables({1: ("r/a", language, whole), 2: ("r/b", language, bad)})
    for block in (3, 7):
        assert [r["file_id"] for r in syntax.invalid_files(lines, files, block).select("file_id").collect()] == [2], block


# ---------------------------------------------------------------------------------------------------------- hand-written


def test_notices():
    look = lambda *t, first=True: tuple(a or b for a, b in zip(*handwritten.notices(list(t), first)[1:]))
    licence = [f"// line {i} of the licence" for i in range(60)]
    assert look(*licence, "// Code generated by x. DO NOT EDIT.", "package a") == (True, False, False)
    assert look(*(f"a = {i}" for i in range(20)), "// Code generated by x. DO NOT EDIT.", *(f"a = {i}" for i in range(20))) == (False, False, False)
    assert look("// Code generated by x. DO NOT EDIT.", *(f"a = {i}" for i in range(20)), first=False) == (False, False, False) and look("/* " + "x" * 900 + " generated by y */ a = 1")[0]
    assert look("// Code generated by tool 1.2. DO NOT EDIT.", "x") == (True, False, False)
    assert look("# Diese Datei wurde von x erzeugt, nicht bearbeiten") == (True, False, False)
    assert look("// Imported unchanged from lib 2.0.7 upstream") == (False, True, False)
    assert look("/*! lib v5.0.1 | (c) 2012 lib authors | MIT */")[2]
    for plain in ("# Originally generated by a script, now kept by hand", "// This module generates the report; edit freely", "// Talks to the code generator of x", "# Copyright 2019 the own authors", 's = "Code generated by x. DO NOT EDIT."'):
        assert look(plain) == (False, False, False), plain


def test_forest_finds_what_no_notice_says(spark, tables):
    rng = random.Random(1)
    name = lambda: "".join(rng.choice(["load", "row", "table", "merge", "key", "sum", "next", "cell"]) for _ in range(2))
    hand = lambda i: "\n".join(x for _ in range(rng.randint(3, 9)) for x in (f"# {name()} the {name()} of each {name()} when asked", f"def {name()}_{rng.randint(1, 99)}({name()}, {name()}):", f"    if {name()} > {rng.randint(1, 9)}:", f"        return {name()}({name()})", f"    return {name()}", ""))
    made = lambda i, head: (["# Code generated by x. DO NOT EDIT."] if head else []) + [f"FIELD_{i}_{k:04d} = field('{name()}', {rng.randint(1, 99999)})" for k in range(rng.randint(30, 80))]
    data = lambda i: ["T = ["] + ["  " + ", ".join(str(rng.randint(-9999, 99999)) for _ in range(9)) + "," for _ in range(40)] + ["]"]
    texts = {i: (f"r/src/h{i}.py", "python", hand(i)) for i in range(1, 161)}
    texts |= {i: (f"r/src/m{i}.py", "python", "\n".join(made(i, i % 2))) for i in range(200, 240)}
    texts |= {i: (f"r/src/d{i}.py", "python", "\n".join(data(i))) for i in range(300, 312)}
    texts |= {i: (f"r/{('vendor/lib', 'third_party/x')[i % 2]}/v{i}.py", "python", f"# Imported unchanged from lib {i}.0.1 upstream\n" + hand(i)) for i in range(500, 530)}
    texts |= {i: (f"r/w{i}.min.js", "javascript", f"/*! w{i} v1.2 | (c) w authors */\n" + "".join(f"var {chr(97 + k % 26)}={rng.randint(1, 9)};" for k in range(200))) for i in range(600, 620)}
    texts |= {406: ("r/w406.min.js", "javascript", "".join(f"var {chr(97 + k % 26)}={rng.randint(1, 9)};" for k in range(200))), 407: ("r/src/t.py", "python", "# Imported unchanged from lib 2.0.7 upstream\n" + hand(1))}
    texts |= {400: ("r/third_party/lib/a.py", "python", hand(0)), 401: ("r/vendors/a.py", "python", hand(0)), 403: ("r/e.py", "python", ""), 404: ("r/n.py", "python", None), 405: ("r/nolang", None, "\n".join(made(1, True)))}
    lines, files = tables(texts)
    rows = handwritten.not_written(lines, files).collect()
    got, by = {r["file_id"]: r["kind"] for r in rows}, {r["file_id"]: r["by"] for r in rows}
    assert set(got) == set(range(200, 240)) | set(range(300, 312)) | set(range(500, 530)) | set(range(600, 620)) | {400, 406, 407}
    assert got[400] == "third party" and got[406] == "minified" and got[300] == "data" and got[200] == "generated"
    # the forest decides on all but the file whose notice is all that tells it from the others
    assert {i for i in by if by[i] != "forest"} == {407}
    assert handwritten.not_written(lines.limit(0), files).count() == 0
    assert handwritten.not_written(*tables({1: ("r/a.py", "python", "x = 1")})).count() == 0


def test_series():
    for *lines, least in (("int a_0 = 4;", "int a_1 = 9;", "", "int a_2 = 1;", 2), ("B_0009=1", "B_0010=4", "B_0011=4", 2), ("x opRegion310 = 7", "x opReading1 = 2", "x opRegion312 = 1", 2), ("t['key.b.8'] = 1", "t['key.cd.9'] = 1", 1), ("v[8] = {}", "v[9] = {}", 1),
                          ("row_3 = load(key_8)", "row_9 = load(key_2)", "end", "row_10 = 1", 0), ("a = 1", "a = 2", 0), ("row_1 = 1", "sum_2 = 1", 0), ("x" + "9" * 5000, "x1", 0)):
        assert handwritten.series(lines) == least, lines


def test_numbered_lines_are_found_whatever_the_sample(spark, tables):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice(["load", "row", "table", "merge", "key", "sum", "next", "cell"]) for _ in range(2))
    hand = lambda: "\n".join(x for _ in range(rng.randint(3, 9)) for x in (f"def {name()}_{rng.randint(1, 99)}({name()}, {name()}):", f"    if {name()} > {rng.randint(1, 9)}:", f"        return {name()}({name()})", ""))
    forms = [lambda i, k: f"def get_{i}_{k}(o): return o[{rng.randint(1, 9999)}]", lambda i, k: f"KEY_{i}_{k:03d} = field('{name()}', {rng.randint(1, 9999)})", lambda i, k: f"CELL_{i}_{name()}_{k} = {rng.randint(1, 9999)}"]
    made = lambda i: "\n".join(forms[i % 3](i, k) for k in range(rng.randint(30, 60)))
    texts = {i: (f"r/src/h{i}.py", "python", hand()) for i in range(1, 121)} | {i: (f"r/src/m{i}.py", "python", made(i)) for i in range(200, 215)}
    texts |= {i: (f"r/src/g{i}.py", "python", "# Code generated by x. DO NOT EDIT.\n" + hand()) for i in range(300, 306)}
    # most of what a program numbered has no notice; one such file says that people keep it
    texts |= {400: ("r/src/k.py", "python", "# Originally generated by a script, now kept by hand\n" + made(1))}
    lines, files = tables(texts)
    for sample in (12_000, 60):
        assert {r["file_id"] for r in handwritten.not_written(lines, files, sample).collect()} == set(range(200, 215)) | set(range(300, 306)), sample
    few = tables({1: ("r/a.py", "python", "A_1 = 1\nA_2 = 2\nA_3 = 3"), 2: ("r/b.py", "python", "\n".join(f"A_{k} = 3" for k in range(12)))})
    share = {r["file_id"]: r["n_series_per_n_shown"] for r in handwritten.features(*few).collect()}
    assert share[1] == 0 and share[2] > 0.9
