"""Grammars on texts that are valid and on the same texts damaged."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.llm import syntax_check
from tracewell.llm.syntax.base import Broken

VALID = {
    "go": [
        'package a\nimport "fmt"\nimport (\n\t. "x"\n\t_ "y"\n)\ntype T[K comparable, V any] struct { K; *V; f, g func(int) (a, b error) `json:"x"`; m map[string][]*T2[K] }\ntype I interface { ~int | string; M(x ...int) error }\ntype A = [3]int\nvar x, y = 1, "s"\nconst ( A1 = iota; B1 )\n'
        "func (t *T[K, V]) m(a, b int, c ...string) (n int, err error) {\nouter:\n\tfor i := 0; i < 10; i++ { if v, ok := t.m[a]; ok { continue outer } else if !ok { break } else { goto outer } }\n\tfor range ch {}\n\tfor k, v := range map[string]int{\"a\": 1} { _ = k; v++ }\n\tswitch y := z.(type) { case int, *T2: fallthrough; default: }\n\tselect { case v := <-ch: ; case ch <- 1: ; default: }\n\tdefer func() { recover() }()\n\tgo f(a[1:2:3], b[:], []int{1, 2, 3}...)\n\tvar p = &struct{ x int }{1}\n\tif (T3{}) == p { return }\n\tx.y[0].z = <-c + -1<<2&^3\n\tf2 := Map[int, string](xs)\n\treturn 0, nil\n}\n",
        "package main\n\nfunc main() { for { }; if x := f(); x > 1 { } ; switch { case a: b() } ; var a [2][3]int ; c := [...]string{2: `raw`} ; d := 0x1F + 1e3 + 'x' + '\\n' + 0b1 ; _ = a; _ = c; _ = d }",
    ],
    "rust": [
        "#![allow(x)]\n//! doc\nuse a::{b::{self, c as d}, e::*};\npub(crate) mod m { pub fn f() {} }\nextern crate z;\n#[derive(A)]\npub struct S<'a, T: B + ?Sized = u8, const N: usize = 3> where T: 'a, for<'b> F: Fn(&'b u8) -> T { a: &'a mut T, pub b: [u8; N], c: Box<dyn X + Send + 'a>, }\nstruct U; struct V(pub u8, Vec<Vec<u8>>);\nenum E { A, B(u8), C { x: i32 }, D = 3 }\nunion Un { a: u8, b: u16 }\n"
        "impl<'a, T> Tr<T> for S<'a, T> where T: Copy { type O = u8; const K: u8 = 1; fn m(&'a mut self, (x, y): (u8, u8), [a, .., b]: [u8; 4]) -> impl Iterator<Item = u8> + 'a { let Some(v) = o else { return None }; if let Some(x) = y && z { } while let Some(_) = it.next() {} 'l: loop { break 'l 5; } match x { 0 | 1..=5 => {} ref z @ 7.. if z > 3 => f(), E::C { x, .. } => { 1 } (a, ..) => [1, 2], &Some(mut q) => q?, _ => return } let c = move |a: u8, b| -> u8 { a + b }; let d = || x.0.1 as u64 as f32; let e = S { a: 1, ..Default::default() }; for i in (0..n).rev() { x[i] += 1; } unsafe { *p = 3 } let g = Vec::<u8>::with_capacity(3).iter().map(|x| x * 2).collect::<Vec<_>>(); let r = &mut *x; let h = <T as Tr>::f(a < b, c > d); async move { a.await? }; println!(\"{}\", x); vec![1; 3] } }\n"
        "macro_rules! mac { ($a:expr) => { $a }; }\nstatic mut G: u8 = b'x';\nconst _: () = { };\ntype F2 = unsafe extern \"C\" fn(u8, ...) -> !;\nfn lt<'x>(s: &'x str) -> &'x str { let c = 'c'; let q = '\\''; let r = r#\"a\"b\"#; s }\ntrait Q: A + B { fn d(self: Box<Self>) -> u8 { 0 } }\nasync fn aa() {}\nconst fn bb<T>() -> [T; 0] { [] }\n",
        "fn main() { if x == (S { a: 1 }) {} let x = if a { 1 } else { 2 }; match a { _ if b => 1, _ => 2, }; let y = 1.0e3_f64 + 0xFFu8 as f64; let t = (1,); a..=b; .. ; return; }",
    ],
    "php": [
        "<html><?= $x ?>\n<?php\ndeclare(strict_types=1);\nnamespace A\\B;\nuse C\\{D, E as F};\nuse function G\\h;\nabstract class K extends L implements M, N { use T1, T2 { T1::a insteadof T2; T2::b as protected c; } public const int X = 1, Y = 2; private ?int $a = null; public readonly string|int $s; static $q; public function __construct(private readonly int $z, A&B $i = new D(), &...$rest) { parent::__construct(); } abstract protected function f(): ?static; #[Attr(1)] final public static function g(): void {} }\n"
        "enum S: string { case A = 'a'; const Z = self::A; public function l(): string { return match($this) { self::A, self::B => 'x', default => throw new E('y'), }; } }\ninterface I1 extends I2 { public function m(); }\n$f = fn(int $x): int => $x ** 2 <=> 3;\n$g = static function () use (&$a, $b) { yield $k => $v; yield from x(); };\n$s = \"a $b {$c->d['e']} ${f} $g[0] $h[k] $i->j \\\" \";\n$t = <<<EOT\n  x {$y} 'q'\n  EOT . 'z';\n$u = <<<'N'\nraw $x\nN;\nif ($a): echo 1; elseif ($b): else: endif;\nforeach ($a as $k => [$x, 'y' => $z]) { continue 2; }\nfor ($i = 0, $j = 1; $i < 3; $i++, --$j);\nwhile (1) break;\ndo { } while (0);\nswitch ($x) { case 1: case 2; break; default: }\ntry { f(...); } catch (A | B $e) { } catch (C) { } finally { }\n[$a, , $b] = $c; list('x' => $d) = $e; $o?->p()?->q; $x ??= $y ?: $z; echo (int) $a, -$b, !$c = d(); new class(1) extends X { }; isset($a, $b['c']) && print 'x'; goto end; end: return; ?>\ntail",
        "",
        "only text < ?",
    ],
    "javascript": [
        '#!/usr/bin/env node\n"use strict";\nimport a, { b as c, default as d } from "x"; import * as e from \'y\'; import "z";\nexport default class extends F { #p = 1; static s; static { this.s = 2; } get x() { return this.#p } set x(v) {} async *g() { yield* h; await i } static async m() {} [k]() {} "q"() {} get() {} static() {} has(o) { return #p in o } }\nexport const { f, g: [h = 1, ...i], ...j } = k, l = (m, { n = 2 } = {}, ...o) => ({ m, n }), p = async x => await x;\nexport { l as q, p }; export * from "r"; export * as t from "s";\n'
        'function* u() { const v = yield; }\nlabel: for (const w of x) { if (y) continue label; else break }\nfor (let z = 0, a1 = 1; z < a1; z++, a1--) ;\nfor (const k in o) {} for await (const q of r) {}\ndo x++; while (x < 5)\nswitch (a) { case 1: { } default: b() }\ntry { throw new E } catch { } finally { }\nvar re = /[/\\]](?<n>a)+\\/b/giu, s = `t${`u${v}`}w`, n = 1_000n + 0xFF + .5e-3, d2 = a / b / c;\n[a, b] = [b, a]; ({ c, d: e.f = 1 } = g); a ??= b?.c?.[d]?.(e); x = y ? z : (w, v); x = a ** -b; if (a) b\nelse c\nlet async = 1; new.target; import("m").then(({ default: d }) => d); tag`x`; (function () { })(); !function () { }(); x = async function () { }; y = class { }; delete a.b; void 0, typeof x; a = b\n++c\n',
        "",
        "return_ = 1",
    ],
    "python": ["def f(a, /, b, *, c: int = 1) -> None:\n    match a:\n        case [1, *_]: pass\n    async def g(): await x\n    return f'{a!r:>{b}}'\n", "", "x = 1\r\ny = 2"],
}

INVALID = {
    "go": ["", "package a\nfunc f() {", "package a\nfunc f( { }", "package a\nvar x = \n", "package a\n<<<<<<< HEAD\n", "func f() {}", "package a\nfunc f() { if x := 1 { } }", 'package a\nvar s = "abc\n', "package a\nfunc f() { a b }", "package a\nfunc f(a int, string) {}", "package a\nfunc f() }", "package a\nfunc \u00e9\ufffd() {}", "package a\nfunc f() { defer x }", "package a\nvar a = [1, 2]", "package a\n/* open"],
    "rust": ["fn f() {", "fn f( {}", "struct S { a: u8; b: u8 }", "fn f() { let x = ; }", "<<<<<<< a\nfn f() {}", "fn f() { a b }", "fn f() { a < b < c; }", "use a::;", 'fn f() { "abc }', "/* a /* b */", "fn f() { match x { 1 => 2 3 => 4 } }", "fn f() }", "enum E { A B }", "/// doc only", "fn f() { if x { } else }", "impl S { x }", "fn f() { let x: = 1; }"],
    "php": ["<?php $a = ;", "<?php function f( {}", "<?php class A { foo }", "<?php if ($a) {", "<?php echo 'abc;", "<?php <<<<<<< HEAD\n", "<?php $x = \"a $b['k'] \";", "<?php f($a b);", "<?php $a = <<<X\nabc\n", "<?php }", "<?php 1 = $a;", "<?php return", "<?php use A\\{B;", "<?php foreach ($a $b) {}", "<?php try { }", "<?php /* x"],
    "javascript": ["function f( {", "let x = ;", "class A { x y }", "<<<<<<< a\n", "if (a {", "'abc\n'", "`abc", "a b", "}", "f() = 1", "const x;", "import { a from 'b';", "return 1", "for (let x of) {}", "x = {a: 1, b}}", "/* open", "({a = 1})", "var a = 08x", "a ?? b || c", "<!DOCTYPE html>\n<html>", "x = /(/", "version lfs-pointer v1"],
    "python": ["def f(:", "x = (", "if x:\n", "<<<<<<< a", "x\0", "print 'a'"],
}


@pytest.mark.parametrize("name", list(VALID))
def test_valid(name):
    for text in VALID[name]:
        syntax_check.GRAMMARS[name](text)


@pytest.mark.parametrize("name", list(INVALID))
def test_invalid(name):
    for text in INVALID[name]:
        with pytest.raises(Broken):
            syntax_check.GRAMMARS[name](text)
            print(name, repr(text))


def test_a_lost_bracket_is_seen():
    rng = random.Random(4)
    for name in ("go", "rust", "javascript"):
        text = VALID[name][0]
        places = [i for i, c in enumerate(text) if c in "{}()"]
        missed = 0
        for i in rng.sample(places, 40):
            try:
                syntax_check.GRAMMARS[name](text[:i] + text[i + 1 :])
                missed += 1
            except Broken:
                pass
        assert missed <= 2, name


def test_verdicts(spark):
    go, py = "package a\n", "def f():\n    pass\n"
    data = [(1, "r", "a.go", "go", go), (1, "r", "a.go", "go", go), (2, "r", "b.go", None, py), (3, "r", "c.py", " Python ", "def f(:\n"), (4, "r", "d.xx", None, go), (5, "r", "e.py", "py", None), (6, "r", "f.go", "golang", ""), (7, "r", "g.php", "php", go), (8, "r", "h.py", "go", py), (9, "r", None, "rs", ""), (10, "r", "j.js", "cobol", "x = 1")]
    df = spark.createDataFrame(data, "file_id long, repository_id string, path string, language string, text string").withColumn("status", F.lit("clash"))
    checked = syntax_check.checked_files(df.drop("status"), ["file_id", "repository_id"], "language", "path", "text")
    got = {r.file_id: (r.syntax_language, r.status, r.parsed_as) for r in checked.collect()}
    assert got == {
        1: ("go", "ok", None),
        2: ("go", "wrong_language", "python"),
        3: ("python", "corrupt", None),
        4: (None, "unknown", None),
        5: ("python", "unknown", None),
        6: ("go", "corrupt", None),
        7: ("php", "ok", "go"),
        8: ("go", "wrong_language", "python"),
        9: ("rust", "ok", None),
        10: ("javascript", "ok", got[10][2]),
    }
    rates = {r.syntax_language: (r.n_files, r.n_invalid) for r in syntax_check.syntax_rates(checked, "repository_id").collect()}
    assert rates["go"] == (4, 3)
    assert syntax_check.checked_files(df.drop("status").limit(0), ["file_id"], "language", "path", "text").count() == 0


def test_deep_nesting_is_judged():
    import sys

    sys.setrecursionlimit(40_000)
    assert syntax_check.verdict("javascript", "x = " + "[" * 800 + "]" * 800)[0] == "ok"
    assert syntax_check.verdict("go", "package a\nvar x = " + "(" * 800 + "1" + ")" * 800 + "\n")[0] == "ok"
