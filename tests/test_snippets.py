"""Statements of code as people write it: each language's awkward corners, and code with errors."""

import pytest

from patchloom.functions import code as C
from patchloom.operators.features import statements_of

# language, body of a function (or whole code), its statements
JS = [
    ('const r = /[{]"/g; if (r.test(a)) { x(); } return 1;', ['const r = /[{]"/g;', "if (r.test(a)) { x(); }", "return 1;"]),
    ("if (/\"/.test(s)) y(); z();", ['if (/"/.test(s)) y();', "z();"]),
    ("let q = a / b / c; q /= 2;", ["let q = a / b / c;", "q /= 2;"]),
    ("if (a) /x}/.test(a); b();", ["if (a) /x}/.test(a);", "b();"]),
    ("return a.replace(/\\/(\")/g, '');", ["return a.replace(/\\/(\")/g, '');"]),
    ("x = (a) / 2; y = b[0] / 3; z++ / 4;", ["x = (a) / 2;", "y = b[0] / 3;", "z++ / 4;"]),
    ("const m = cond ? /'/ : /`/;\nm.exec(s)", ["const m = cond ? /'/ : /`/;", "m.exec(s)"]),
    ("f(/[/]{/, 1); g();", ["f(/[/]{/, 1);", "g();"]),
    ("while (x) { y() }\n/re}/.test(z)", ["while (x) { y() }", "/re}/.test(z)"]),
    ("return typeof /{/;", ["return typeof /{/;"]),
    ("for (const x of /a{/g.exec(b)) c(); d()", ["for (const x of /a{/g.exec(b)) c();", "d()"]),
    ("// it's a { comment\nf()", ["f()"]),
    ("const f = async (a) => {\n b();\n};\nc()", ["const f = async (a) => {\n b();\n};", "c()"]),
]
TS = [
    ("function f<K extends keyof T>(k: K): T[K] { return this.get<K>(k); }", ["return this.get<K>(k);"]),
    ("class A { foo<K>(k: K): K { if (!k) { return k; } return k; } }", ["if (!k) { return k; }", "return k;"]),
    ("foo<A, B<C>>(a: A): Map<A, B<C>> { a(); return b; }", ["a();", "return b;"]),
    ("private async load<T>(id: string): Promise<Array<T>> { return await this.h.get<Array<T>>(id); }", ["return await this.h.get<Array<T>>(id);"]),
    ("function f(): { a: string } { type X = { b: number };\n return { a: 'x' }; }", ["return { a: 'x' };"]),
    ("const f = <T,>(x: T): T => { return x; }", ["return x;"]),
    ("function f(x: string | { a: number }): void { g(x as any); h(x!.y); }", ["g(x as any);", "h(x!.y);"]),
]
PHP = [
    ("if ($a): echo $a; endif; b();", ["if ($a): echo $a; endif;", "b();"]),
    ("if ($a): one(); elseif ($b): two(); else: three(); endif; done();", ["if ($a): one(); elseif ($b): two(); else: three(); endif;", "done();"]),
    ("foreach ($x as $y): if ($y): a(); endif; endforeach; b();", ["foreach ($x as $y): if ($y): a(); endif; endforeach;", "b();"]),
    ("while ($a): b(); endwhile; for (;;): c(); endfor; d();", ["while ($a): b(); endwhile;", "for (;;): c(); endfor;", "d();"]),
    ("switch ($a): case 1: b(); break; default: c(); endswitch; d();", ["switch ($a): case 1: b(); break; default: c(); endswitch;", "d();"]),
    ("$x = <<<EOT\nHi $a; if (x) {\nEOT;\necho $x;", ["$x = <<<EOT\nHi $a; if (x) {\nEOT;", "echo $x;"]),
    ("$x = <<<'RAW'\nno \" quote\n  RAW;\nreturn $x;", ["$x = <<<'RAW'\nno \" quote\n  RAW;", "return $x;"]),
    ("f(<<<\"A\"\n{ $b\nA, 2); g();", ["f(<<<\"A\"\n{ $b\nA, 2);", "g();"]),
    ("if ($a) { ?> <b>it's {</b> <?php echo $a; } c();", ["if ($a) { ?> <b>it's {</b> <?php echo $a; }", "c();"]),
    ("// it's ?> text ' <?php\nf();", ["f();"]),
    ("$a = $b ? $c : $d; $e ?: f();", ["$a = $b ? $c : $d;", "$e ?: f();"]),
    ("# it's\n#[Attr]\ng();", ["#[Attr]\ng();"]),
]
GO = [
    ("for _, x := range m[k] {\n run(x)\n}\nreturn", ["for _, x := range m[k] {\n run(x)\n}", "return"]),
    ("for i := range []int{1, 2} {\n run(i)\n}\nreturn", ["for i := range []int{1, 2} {\n run(i)\n}", "return"]),
    ("for k := range map[string]a.B{\"x\": {1}} {\n run(k)\n}", ["for k := range map[string]a.B{\"x\": {1}} {\n run(k)\n}"]),
    ("for _, c := range []struct{ a int }{{1}, {2}} {\n run(c)\n}\nb()", ["for _, c := range []struct{ a int }{{1}, {2}} {\n run(c)\n}", "b()"]),
    ("if x, ok := y.(T); ok {\n a()\n}\nselect {\ncase <-c:\n b()\n}", ["if x, ok := y.(T); ok {\n a()\n}", "select {\ncase <-c:\n b()\n}"]),
]
JAVA = [
    ("try { a(); } finally { b(); } int[] a = {1, 2};", ["try { a(); } finally { b(); }", "int[] a = {1, 2};"]),
    ("try (R r = open()) { a(); } catch (A | B e) { b(); } c();", ["try (R r = open()) { a(); } catch (A | B e) { b(); }", "c();"]),
    ("synchronized (x) { y(); } { z(); } return;", ["synchronized (x) { y(); }", "{ z(); }", "return;"]),
    ("Runnable r = new Runnable() { public void go() { a(); } }; r.run();", ["Runnable r = new Runnable() { public void go() { a(); } };", "r.run();"]),
    ("Map<String, List<Integer>> m = f(); m.g();", ["Map<String, List<Integer>> m = f();", "m.g();"]),
    ('String s = """\n a " { b\n"""; c();', ['String s = """\n a " { b\n""";', "c();"]),
    ("do { a(); } while (b); if (c) d(); else e(); f();", ["do { a(); } while (b);", "if (c) d(); else e();", "f();"]),
    ("switch (a) { case 1: b(); default: c(); } d();", ["switch (a) { case 1: b(); default: c(); }", "d();"]),
    ("class Inner { int x; } new Inner();", ["class Inner { int x; }", "new Inner();"]),
    ("char c = '{'; d();", ["char c = '{';", "d();"]),
]
RUST = [
    ("loop { break; } f();", ["loop { break; }", "f();"]),
    ("if let Some(y) = x { g(y); } else { h(); } i();", ["if let Some(y) = x { g(y); } else { h(); }", "i();"]),
    ("let z = match x { _ => 1 }; z", ["let z = match x { _ => 1 };", "z"]),
    ("match z { 1 => {} _ => {} } k();", ["match z { 1 => {} _ => {} }", "k();"]),
    ("'outer: for i in 0..3 { continue 'outer; } f();", ["'outer: for i in 0..3 { continue 'outer; }", "f();"]),
    ("let c = '{'; let d = '\\''; f(&'a');", ["let c = '{';", "let d = '\\'';", "f(&'a');"]),
    ("unsafe { k() } while let Some(x) = s.pop() { g(x); } m!{a} ;", ["unsafe { k() }", "while let Some(x) = s.pop() { g(x); }", "m!{a} ;"]),
    ('let s = r#"a " {"#; f(s);', ['let s = r#"a " {"#;', "f(s);"]),
    ("let f = |x: &'a str| { x.len() }; f(y)", ["let f = |x: &'a str| { x.len() };", "f(y)"]),
    ("match a { _ => b }.c(); d();", ["match a { _ => b }.c();", "d();"]),
]
CC = [
    ("\n#ifdef X\n  foo(a);\n#else\n  bar();\n#endif\n  b();", ["#ifdef X\n  foo(a);\n#else\n  bar();\n#endif", "b();"]),
    ("\n#if A\n#if B\n x();\n#endif\n y();\n#endif\n z();", ["#if A\n#if B\n x();\n#endif\n y();\n#endif", "z();"]),
    ("\n#define Q 1 \\\n 2\n f();", ["#define Q 1 \\\n 2", "f();"]),
    ("int b[] = {1, 2}; struct s t = { .x = 1 }; g();", ["int b[] = {1, 2};", "struct s t = { .x = 1 };", "g();"]),
    ("{ int k; } do { a--; } while (a); return;", ["{ int k; }", "do { a--; } while (a);", "return;"]),
    ("if (a) b(); else if (c) { d(); } else e(); f();", ["if (a) b(); else if (c) { d(); } else e();", "f();"]),
    ("switch (a) { case 1: g(); } goto out;\nout:\n return;", ["switch (a) { case 1: g(); }", "goto out;", "out:\n return;"]),
    ("char q = '\"'; f('}');", ["char q = '\"';", "f('}');"]),
]
PY = [
    ("    a = 1\n    if x\n        b = 2\n    return a", ["a = 1", "if x\n        b = 2", "return a"]),
    ("    for i in x:\n        print(i\n    return a", ["for i in x:\n        print(i", "return a"]),
    ("    print 'old'\n    b()", ["b()"]),
    ("    try:\n        a()\n    except E, e:\n        b()\n    c()", ["try:\n        a()\n    except E, e:\n        b()", "c()"]),
]
WRAPPED = {"javascript": "function f(a) { %s }", "php": "<?php function f($a) { %s }", "java": "void f() { %s }", "rust": "fn f<'a>(x: &'a str) -> u8 { %s }", "c": "int f(int a) { %s\n}", "go": "func f() {\n%s\n}", "python": "def f(x):\n%s\n", "typescript": "%s"}
CASES = [(lang, WRAPPED[lang] % body, want) for lang, cases in (("javascript", JS), ("typescript", TS), ("php", PHP), ("go", GO), ("java", JAVA), ("rust", RUST), ("c", CC), ("python", PY)) for body, want in cases]


@pytest.mark.parametrize(("language", "code", "want"), CASES)
def test_statements(language, code, want):
    assert C.statements(code, language) == want
    assert len(C.methods(code, language)) == 1 + code.count("public void go")


def tree(nodes):
    return [(n.kind, n.block, tree(n.children)) if n.children else (n.kind, n.block) for n in nodes]


@pytest.mark.parametrize(
    ("language", "code", "want"),
    [
        ("php", "if ($a): echo $a; endif;", [("if", "function_body")]),
        ("php", "if ($a): x(); elseif ($b): y(); else: z(); endif; w();", [("if", "function_body", [("if", "if_false_branch")]), ("call_expr", "function_body")]),
        ("php", "for (;;): a(); endfor;", [("for", "function_body", [("call_expr", "loop_body")])]),
        ("php", "switch ($a): case 1: b(); break; endswitch;", [("switch", "function_body", [("call_expr", "switch_case"), ("break", "switch_case")])]),
        ("php", "<p>it's</p><?php if ($a) { ?> text { <?php echo $a; } ?> tail", [("if", "function_body", [("echo", "if_true_branch")])]),
        ("javascript", "if (/{/.test(a)) { b(); }", [("if", "function_body", [("call_expr", "if_true_branch")])]),
        ("python", "def f():\n    if x\n        b = 2\n    else:\n        c(\n    return 1", [("if", "function_body", [("assign", "if_true_branch")]), ("return", "function_body")]),
    ],
)
def test_trees(language, code, want):
    assert tree(C.nodes(code, language)) == want


def test_calls_by_regex_and_with_types():
    def calls(code, language):
        side = C.Side(code, language)
        return [name for n in side.roots for _, _, name, _ in C.calls(side.own(n), language, lambda a, b: code[a:b])]

    assert calls('function f() { /"/.test(s); }', "javascript") == ['/"/.test']
    assert calls("function f() { this.get<K>(k); bar<Map<A, B>>(a < b, c > d); }", "typescript") == ["this.get", "bar"]


def test_heredoc_names_and_regex_tokens():
    side = C.Side("$x = <<<A\nHi $b and $c\nA;", "php")
    assert C.n_names(side.own(side.roots[0]), "php") == 3
    side = C.Side("x = /a/g;", "javascript")
    assert side.n_tokens(side.roots[0]) == 7  # x, =, /, a, /, g, ;


@pytest.mark.parametrize(("code", "n"), [("function f() { " + "if (a) { " * 1200 + "x();" + " }" * 1200 + " }", 1201), ("function f() { " + "if (a) { b(); } else " * 500 + "{ x(); } }", 1001)])
def test_deep_nesting(code, n):
    rows = statements_of(code, code.replace("x()", "y()"), "javascript")
    assert len(rows) == 2 * n and sum(r[-1] for r in rows) == 1
