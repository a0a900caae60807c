"""Constructs of each language, and texts that none of them is."""

import pytest

from loamdex.llm import automata, grammars

VALID = {
"go": ["package a\nfunc F[T any](x T) T { return x }\n","package a\ntype L[T any] struct { head *T }\n","package a\ntype N interface { ~int | ~float64 }\n","package a\nvar m = map[string][]int{\"a\": {1, 2}}\n","package a\nfunc f() { for i := range 10 { _ = i } }\n","package a\nfunc f() { x := F[int](3); _ = x }\n","package a\nfunc (s *S[T]) Get() (t T, err error) { return }\n","package a\nfunc f() { switch x := y.(type) { case int, string: default: } }\n","package a\nfunc f() { select { case v := <-c: _ = v; case c <- 1: default: } }\n","package a\nfunc f() { go func() { defer wg.Done() }() }\n","package a\nvar f = func(a, b int, c ...string) (int, error) { return 0, nil }\n","package a\nconst ( A = iota; B; C )\n","package a\nimport ( \"fmt\"; x \"os\" )\n","package a\nfunc f() { L: for { break L } }\n","package a\nfunc f() { if x, ok := m[k]; ok { } else if y { } else { } }\n","package a\nvar x = a[1:2:3]\n","package a\nvar c chan<- int\nvar d <-chan int\n","package a\nfunc f() { x.y(z...) }\n","package a\ntype A = map[K]V\n","package a\nfunc Map[K comparable, V any](m map[K]V) []K { r := make([]K, 0, len(m)); return r }\n","package a\nvar x = []struct{ a int; b string }{{1, \"a\"}, {2, `b`}}\n","package a\nvar p = &T{A: 1, B: []int{1}}\n","package a\nfunc f() { for i := 0; i < 3; i++ { continue } }\n","package a\nfunc f() { for ; ; { } }\n","package a\nvar x = 0b101 + 0o17 + 0x1p-2 + 1_000 + 'a' + 2i\n","package a\ntype S struct { A int `json:\"a\"`; *B; c.D }\n","package a\nfunc f() { a, b = b, a; a <<= 2; a &^= b }\n","package a\nfunc f() { goto L; L: return }\n","package a\nvar x = Pair[string, int]{\"a\", 1}\n","package a\nfunc f() { if f := func() bool { return true }; f() { } }\n"],
"typescript": ["const x = y as const;\n","type A<T> = T extends string ? 'a' : never;\n","interface A<T = {}> extends B<T> { readonly a?: string; [k: string]: any; m(): void }\n","enum C { A = 1, B }\n","const enum D { A }\n","abstract class A<T> implements B, C { private readonly x: number = 1; constructor(public a: string, private b?: number) { super() } abstract f(): void; static #p = 1; get v(): string { return '' } }\n","function f<T extends keyof U, U>(a: T, b?: U[T], ...c: string[]): asserts a is T { }\n","let a = <T,>(x: T) => x;\n","type M = { readonly [K in keyof T]?: T[K] };\n","declare module 'x' { export const a: number; }\n","namespace A.B { export type X = 1 }\n","import type { A } from './a';\nexport type { A };\n","export default class extends A {}\n","let x = a!.b!.c;\n","let x: [a: string, b?: number, ...rest: boolean[]] = ['a'];\n","function f(this: Window, a: string): void;\nfunction f(a: any) {}\n","const a = b satisfies C;\n","type F = (a: string) => void;\ntype G = new () => A;\n","let x = y as unknown as string[];\n","@Component({ a: 1 })\nclass A { @Input() x: string; @Output() y = new E<string>(); }\n","type T = `a${string}b`;\n","for (const [k, v] of Object.entries(x)) { }\n","const f = async ({ a, b }: P): Promise<void> => { await g(); };\n","let u: typeof import('./x');\n","type A = typeof x[number];\n","let v = a ?? b?.c?.[0]?.(d);\n","export = foo;\nimport fs = require('fs');\n","declare global { interface Window { a: any } }\n","type X = A | B & C;\n","type Y =\n  | 'a'\n  | 'b';\n","class A { declare x: number; static { f(); } override m(): void {} }\n","let g = new Map<string, Array<number>>();\n","function isS(x: any): x is string { return true }\n","let z = 1n ** 2n;\n","type U<T> = T extends (infer R)[] ? R : never;\n","export abstract class B { protected abstract get x(): number; }\n","const el = <div className=\"a\">{x}</div>;\n"],
"javascript": ["const a = <div className=\"a\" {...p}>text {x} <b/></div>;\n","function A() { return (\n <>\n <Foo a={1} b='c'>don't stop</Foo>\n </>\n) }\n","async function* g() { for await (const x of y) yield* x; }\n","class A extends B { #x = 1; static y; get z() { return this.#x } set z(v) {} static async *m() {} }\n","const { a, b: { c = 1 }, ...rest } = o;\n","x ??= y; x ||= z; x &&= w;\n","const r = /a[/]b/gi.test(s);\n","label: for (;;) { continue label }\n","var f = x => ({ a: x });\n","import a, { b as c } from 'd';\nimport * as e from 'f';\nexport { a as default };\nexport * from 'g';\n","let t = tag`a${b}c${`d${e}`}`;\n","if (a) b(); else c()\n","do { x++ } while (x < 3)\n","switch (a) { case 1: case 2: b(); break; default: }\n","try { a() } catch { b() } finally { c() }\n","const o = { a, 'b': 1, [c]: 2, d() {}, get e() { return 1 }, async f() {}, *g() {}, ...h };\n","var a = b ? c : d ? e : f;\n","new.target; \n","delete a.b, void 0, typeof x\n","a = b\n++c\n","const x = await import('y');\n","for (var k in o) if (o.hasOwnProperty(k)) continue;\n","let x = 0xff + 1e3 + .5 + 0b1 + 0o7 + 1_000 + 10n;\n","var s = 'a\\\nb';\n","#!/usr/bin/env node\nf();\n","export default async () => {};\n","a?.b?.[c]?.(d)\n","var let_ = 1; var of = 2; var get = of;\n","(function(){ 'use strict'; })();\n","!function(){}()\n","x = y / z / w;\n","const {x = 1} = y, [a,,b] = c;\n","throw new Error(`x`);\n","with_ = function* () { const a = yield; };\n","class A { 'a b'() {} 123() {} [x]() {} static = 1; async = 2; get; set }\n","if (x) { } else if (y) ; else { }\n","import x from './x.json' with { type: 'json' };\n","while(1) ;\n"],
"java": ["class A { int f(Object o) { return switch (o) { case String s when s.isEmpty() -> 0; case Integer i -> i; default -> { yield 1; } }; } }\n","record P(int x, int y) implements Q { P { if (x < 0) throw new E(); } static int z = 1; }\n","sealed interface S permits A, B {}\n","non-sealed class A implements S {}\n","class A<T extends Comparable<? super T> & B> { <U> U f(List<? extends T>... a) throws E { return this.<U>g(); } }\n","@interface X { String value() default \"a\"; int[] n() default {1, 2}; }\n","enum E implements F { A(1) { void f() {} }, B; private final int x = 1; E(int... a) {} }\n","class A { void f() { for (final String s : x) { } for (int i = 0, j = 1; i < 2; i++, j--) ; } }\n","class A { Runnable r = () -> {}; F<A, B> g = A::new; H h = (a, b) -> a + b; int[] i = new int[]{1, 2}; int[][] k = new int[3][]; }\n","class A { void f() { try (var a = b(); c) { } catch (E | F e) { } finally { } } }\n","class A { String s = \"\"\"\n  a \"b\"\n  \"\"\"; }\n","package a.b;\nimport static a.B.*;\nimport c.D;\n@SuppressWarnings({\"a\", \"b\"})\npublic final class A {}\n","class A { static { x(); } { y(); } A() { this(1); } synchronized void f() { synchronized (this) { } } }\n","class A { void f() { if (o instanceof String s && !s.isEmpty()) { } } }\n","class A { void f() { int x = (int) y + (A) z; A<B>.C d; label: while (true) { break label; } do { } while (a); } }\n","class A { void f() { assert x > 1 : \"m\"; int y = a > b ? c : d; y >>>= 2; } }\n","class A { void f() { switch (a) { case 1, 2 -> b(); default -> throw new E(); } switch (c) { case 1: d(); break; default: } } }\n","module a.b { requires transitive c; exports d to e, f; }\n","class A { void f() { new B() { @Override public void g() {} }.g(); } }\n","class A { List<Map<String, int[]>> x = new ArrayList<>(); int y[] = {1,}; char c = '\\u0041', d = '\\''; long l = 0x1FL + 1_000L; }\n","class A { void f() { if (o instanceof P(int x, var y)) { } } }\n","interface I { default void f() {} static void g() {} private void h() {} int X = 1; }\n","class A { abstract class B {} strictfp native transient volatile int x; }".replace("strictfp native transient volatile int x;","transient volatile int x; native void g();")+"\n","class A { void f() { var x = (Runnable & S) () -> {}; } }\n","class A { void f(@NonNull final String a, int... b) { int @X [] c; } }\n","public class A { public static void main(String[] args) throws Exception { System.out.println(args[0]); } }\n","class A { int x = switch (y) { case A a -> 1; case null, default -> 2; }; }\n","class A { record B<T>(T a) {} enum C { X } interface D {} }\n","void main() { }\n"],
"shell": ["for ((i=0;i<3;i++)); do echo $i; done\n","for ((i=0;i<3;i++))\ndo\necho\ndone\n","if [[ $a =~ ^[a-z]+$ && -f b ]]; then :; elif ((x > 1)); then :; else :; fi\n","case $x in a|b) y ;; (c) z ;& *) w ;; esac\n","f() { local a=(1 2 \"3\"); echo \"${a[@]}\"; }\n","function g { :; }\n","cat <<EOF\n$a `b` 'c\nEOF\n","cat <<-'X' | sort\n\ta \"\n\tX\n","while read -r l; do echo \"$l\"; done < <(ls)\n","x=$((1 + 2 * (3 - 1)))\n","echo ${x:-\"a b\"} ${x%%.*} ${#x} ${x//a/b} ${!x} ${x^^}\n","a && b || c; d & e\n","{ a; b; } > f 2>&1\n","(cd x && y) | z\n","select x in a b; do break; done\n","until x; do :; done\n","trap 'rm -f \"$x\"' EXIT INT\n","arr+=(x); declare -A m=([a]=1 [b]=2)\n","echo \"$(echo \"$(date)\")\" `date`\n","time ls; ! ls\n","x=$'a\\'b'\n","coproc X { ls; }\n","[ \"$a\" = b ] && exit 1\n","let x=1+2\n","case x in esac\n","if ! x; then y; fi\n","for x; do echo $x; done\n","for x in a b c\ndo echo $x\ndone\n","f() ( ls )\n","export A=1 B=\"2\"\n","echo a \\\n  b\n","grep -E '(a|b)' f | awk '{ print $1 }'\n","while :; do case $1 in -h) x;; esac; done\n","((x++)) || true\n","a=${b:=c}\n","cat <<< \"x\"\n","ls 2>/dev/null >&2 &> x\n","if true; then\n  :\nfi >log\n"],
"c": ["#include <a.h>\nint main(void) { return 0; }\n","typedef struct { int a : 3; union { int b; float c; } d; } S;\n","int (*f)(int, char **);\n","static inline int g(const char *restrict a, ...) { return sizeof(int[3]) + _Alignof(int); }\n","struct S s = { .a = 1, .b = { [0] = 2, [1] = 3 } };\n","void f(void) { for (int i = 0; i < 3; i++) { if (i) continue; else break; } do { } while (0); switch (x) { case 1: case 'a': break; default: ; } goto l; l: return; }\n","enum E { A = 1, B, };\n","#define X(a, b) do { a; b; } while (0)\nint x;\n","int a[] = {1, 2, 3,}, *p = &a[0];\n","extern \"C\" int x;\n".replace('extern "C"','extern'),"char *s = \"a\" \"b\" L\"c\" u8\"d\";\n","int x = (int)(long)p->q.r[3] ? a : b;\n","_Static_assert(sizeof(int) == 4, \"x\");\n","int f(a, b) int a; char *b; { return a; }\n","typedef int (*cb)(void *, size_t);\n","void f(void) { int x = ({ int y = 1; y; }); __asm__ volatile (\"nop\" : \"=r\"(x) : : \"memory\"); }\n","struct __attribute__((packed)) P { int a; };\n","int x = (struct S){1, 2}.a;\n","#if defined(A) && \\\n B\nint a;\n#else\nint b;\n#endif\n","unsigned long long int x = 0xFFULL; double d = 1e-3f, e = .5;\n","void f(int n, int a[static n]) { for (;;) ; }\n","int *f(void), g;\n","const struct file_operations fops = { .open = my_open };\n","static const char *const names[] = { [A] = \"a\" };\n","x = y;\n".replace("x = y;","int x, y;"),"void f() { while (*p++) ; a ? b : c; (void)0; }\n","_Noreturn void die(void);\n","_Bool b = !x && ~y;\n","void (*signal(int s, void (*h)(int)))(int);\n","int main() { int a[2][3] = {{1},{2}}; return a[0][1] << 2; }\n","void f(void) { FOREACH(x, list) { g(x); } }\n","MODULE_LICENSE(\"GPL\");\n"],
"ruby": ["def f(a, b = 1, *c, d:, e: 2, **g, &h) = a + b\n","class A < B::C\n  attr_reader :a\n  def self.x; end\n  private def y; end\nend\n","x = case y\n    in {a: Integer => b} then b\n    in [1, *] then 2\n    else 3\n    end\n","a.each { |x, (y, z)| puts x }\n","a&.b ||= c rescue nil\n","s = <<~EOS\n  a #{b}\nEOS\n","x = %w[a b] + %i(c d)\n","begin\n  a\nrescue A, B => e\n  retry\nensure\n  c\nend\n","puts \"#{a ? \"b\" : 'c'}\"\n","if a then b elsif c then d else e end\n","unless a\n b\nend\n","x = if a\n 1\nelse\n 2\nend\n","while a do b end\n","loop do break if x end\n","def method_missing(name, *args); end\n","->(x) { x * 2 }.call(3)\n","f = lambda do |x| x end\n","{ a: 1, 'b' => 2, \"c\": 3 }\n","module A::B; end\n","puts [1, 2].map(&:to_s)\n","a = b ? c : d\n","/a[\\/]b/i =~ s\n","alias x y\nundef z\n","class << self; def a; end; end\n","def a?; true; end\ndef b!; end\ndef c=(v); end\n","for i in 1..3 do p i end\n","x = y unless z\n","return a, b if c\n","BEGIN { a }\n","f(*a, **b, &c)\n","p(<<A, <<B)\na\nA\nb\nB\n","a = [1,\n 2,\n]\n","def <=>(o) x <=> o.x end\n","x = *1..3\n","puts 'a' \\\n 'b'\n","yield x if block_given?\n","x.then { _1 + 1 }\n","Foo = Struct.new(:a) do\n def b; end\nend\n","a, (b, *c), d = e\n","case x when 1, 2 then y else z end\n","def f(...) = g(...)\n","p %q(a (b) c), %r{x/y}m, ?a\n"],
"python": ["match x:\n    case {'a': 1, **r} if r: pass\n    case [1, *_] | A(b=2): pass\n    case _: pass\n","def f(a, /, b, *, c: int = 1, **k) -> None: ...\n","async def f():\n    async with a as b, c: await d\n    return [x async for x in y]\n","x = f'{a!r:>{w}} {b=}'\n","type A[T] = list[T]\ndef f[T](x: T) -> T: return x\n","with (open(a) as b, open(c) as d): pass\n","if (n := 10) > 5: pass\n","try: pass\nexcept* A as e: pass\n","lambda *a, **k: (yield)\n","print(*a, **b, sep='')\n","class A(B, metaclass=C):\n    x: int = 1\n","@a.b(c)[0]\ndef f(): nonlocal_ = 1\n","global x\n","from . import (a, b as c,)\n","assert x, 'y'\n","del a[0], b.c\n","a = b = c, *d = e\n".replace("a = b = c, *d = e","a = *b, c = d"),"x = 1 if y else 2\n","while True:\n    break\nelse: pass\n","raise A from None\n"],
}
INVALID = {
"go": ["package a\nfunc f() { for i := 0; i < 3 { } }\n","package a\nfunc f( { }\n","package a\nvar x = \n","package a\nfunc f() { if { } }\n","package a\nx := 1\n","package a\nfunc f() { return return }\n","package a\nfunc f() { x = = 1 }\n","func f() {}\n","package a\nfunc f() { a b }\n","package a\ntype X struct { a, }\n","package a\nvar s = \"abc\n","package a\nfunc f() }\n","package a\nimport fmt\n","package a\nfunc f() { else { } }\n","package a\n<<<<<<< HEAD\nvar a = 1\n=======\n","package a\nfunc f() { switch x { foo: } }\n".replace("foo:","case 1 2:"),"package a\nfunc f() { defer }\n","package a\nfunc f() { x := [3]int{1, 2 }\n"],
"typescript": ["let x: = 1;\n","interface A { a: string\n","class { x }\n","type A = ;\n","function f(a: string { }\n","enum { A }\n","let x = (a, b => 1;\n","const x = {a: 1, b 2};\n","import { a from 'b';\n","if (a { }\n","let a = 'x\n","for (let i of) {}\n","class A extends { }\n","return }\n","let x: Array<string = [];\n","a b c;\n","export { a, b\n"],
"javascript": ["function (a) { }\n","var a = ;\n","if (a) { b\n","x = {a: 1,, b: 2};\n","let 1a = 2;\n","var s = 'abc\n","for (;;;) {}\n","a b\n","class A { x y }\n","return }\n","import from 'x';\n","const f = (a, b => a;\n","switch (a) { b: c }\n".replace("b: c","foo()"),"try { }\n","else { }\n","x = [1, 2;\n","a ? b;\n","var r = /abc\n;\n","function f() { return a +; }\n","do { } whale (x)\n","`abc\n","a => { \n","<<<<<<< HEAD\na\n"],
"java": ["class A { int f( { } }\n","class A { int x = ; }\n","class A { void f() { if (a { } } }\n","class A { void f() { int int x; } }\n","class A {\n","class A { String s = \"abc; }\n","class A { void f() { for (int i = 0; i < 3) { } } }\n","class { }\n","class A { void f() { return return; } }\n","class A { void f() { a b c; } }\n","class A { void f() { x = 1 } }\n","import a.b\nclass A {}\n","class A { void f() { else { } } }\n","class A { void f() { try { } } }\n","class A { void f() { case 1: } }\n","package ;\nclass A {}\n","class A { public public_ void f() {} }\n","class A { void f() { x = a +; } }\n","class A { char c = ''; }\n","}\n"],
"shell": ["if true; then echo\n","for x in a b; echo $x; done\n","case x in a) b\n","echo \"abc\n","f() { echo\n","while true; done\n","fi\n","a && && b\n","| a\n","if ; then x; fi\n","echo $(ls\n","done\n","for ((i=0;i<3;i++); do x; done\n","if [[ a == b ; then x; fi\n","then x\n","{ a\n","case x { a) b;; esac\n".replace("{","on"),"for in a; do b; done\n","echo 'a\n","x=`ls\n","esac\n"],
"c": ["int int x;\n","int main( { }\n","int x = ;\n","struct S { int a }\n;\n","void f() { if (x { } }\n","void f() { for (;;;) ; }\n","int f() { return 1 }\n","char *s = \"abc\n;\n","void f() {\n","}\n","void f() { else ; }\n","int a[3;\n","void f() { x = a +; }\n","#if A\nint x;\n","void f() { do { } while }\n","typedef ;;int\n","void f() { a b c; }\n","enum { A B };\n","int x = 'ab\n;\n","void f() { case }\n"],
"ruby": ["def f\n","class A\n  def b\n  end\n","if a\n","x = [1, 2\n","puts 'a\n","end\n","def f(a, b\nend\n","x = {a: 1, b: }}\n","foo do |x\nend\n","begin\nrescue\n","class a; end\n","a = = 1\n","def 1a; end\n","x = <<~E\n abc\n","case x\nwhen 1\n","puts \"#{a\"\n","while x\n","module a; end\n","a.b(\n","else\n","a ? b\n","x = (1 + \n","unless\nend\n"],
"python": ["def f(:\n pass\n","if x\n  pass\n","x = (1\n","class A\n","print 'a'\n","  x = 1\n y = 2\n","for x y:\n  pass\n","return = 1\n","x = 'a\n","try:\n  pass\n","else:\n  pass\n","f(a=1, b)\n","1 = x\n","def f():\n","import\n","lambda: (yield\n","a b\n","<<<<<<< HEAD\n"],
}


@pytest.mark.parametrize("language", grammars.LANGUAGES)
def test_constructs(language):
    assert [t for t in VALID[language] if grammars.check(t, language) is not None] == []
    assert [t for t in INVALID[language] if grammars.check(t, language) is None] == []
    # a bracket too many, or an end too early, makes each of them invalid
    for t in VALID[language]:
        for more in (")\n", "}\n", "((\n"):
            assert grammars.check(t + more, language) is not None, (language, t, more)


@pytest.mark.parametrize("language", grammars.LANGUAGES)
def test_other_languages(language):
    for t in VALID[language]:
        assert grammars.accepts(t * (9 if language not in ("go", "java") else 1), language) in (True, False)


def test_python_in_pieces(monkeypatch):
    monkeypatch.setattr(grammars, "PIECE", 40)
    good = "def f(x):\n    s = \'\'\'a\ndef g(:\nx\n\'\'\'\n    return [\n        1,\n    ]\nclass A:\n    pass\n" * 9
    assert grammars.check(good, "python") is None and grammars.check(good + "def f(:\n", "python") and grammars.check("x = 1\n" * 30 + "y = = 2\n" + good, "python") and grammars.check(good + "s = \'\'\'", "python")


def test_nothing_is_valid_for_being_deep():
    assert grammars.check("(" * 100_000 + ")" * 100_000, "python") is not None
    assert grammars.check("x = " + "(" * 50_000 + "1" + ")" * 50_000, "javascript") is None and grammars.check("x = " + "[" * 50_000, "javascript") is not None


def test_grammars_of_any_shape():
    g = automata.Grammar("s = '(' s ')' | A s? | B*\n", "s")
    for text, ok in (("( )", True), ("( ( A ) )", True), ("( A ( ) ) )", False), ("( A", False), ("A A ( B B )", True), ("B A", False), ("", True)):
        assert (g.run(text.split()) is None) == ok, text
