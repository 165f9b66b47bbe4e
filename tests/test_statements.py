"""Statements of each language against what the statement table's definition says of them, told by hand."""

import pytest

from patchloom.functions import code as C
from patchloom.operators import features


def rows(code, language):
    return [dict(zip(features.NAMES, r)) for r in features.statements_of(code, code, language)]


KINDS = {
    "go": [
        ("a := 1", "assign"), ("a += 1", "assign"), ("i++", "assign"), ("var a int", "assign"), ("const a = 1", "assign"), ("f()", "call_expr"), ("<-ch", "call_expr"), ("ch <- 1", "send"), ("go f()", "go_routine"),
        ("defer f()", "defer"), ("break", "break"), ("continue", "continue"), ("fallthrough", "fallthrough"), ("goto end", "goto"), ("return 1", "return"), ("for {\n}", "for"), ("switch x {\n}", "switch"), ("select {\n}", "switch"), ("end:\nf()", "label"),
    ],
    "python": [
        ("a = 1", "assign"), ("a += 1", "assign"), ("a: int = 1", "assign"), ("f()", "call_expr"), ("a.b().c", "expr_stmt"), ("await_(x)", "call_expr"), ("'doc'", "expr_stmt"), ("a, b", "expression_statement"), ("import os", "import"),
        ("from a import b", "import"), ("pass", "pass"), ("global a", "global"), ("assert a", "assert"), ("del a", "delete"), ("raise E", "throw_raise"), ("return", "return"), ("with a:\n    b()", "with"), ("while a:\n    b()", "while"),
    ],
    "javascript": [
        ("a = 1;", "assign"), ("a += 1;", "expr_stmt"), ("i++;", "expr_stmt"), ("let a = 1;", "assign"), ("var a;", "assign"), ("f();", "call_expr"), ("a.b(1).c(2);", "call_expr"), ("a.b(1).c;", "expr_stmt"), ("await f();", "expr_stmt"),
        ("new A();", "expr_stmt"), ("f() || g();", "expr_stmt"), ("throw e;", "throw_raise"), ("import a from 'b';", "import"), ("export const a = 1;", "export"), ("do { f(); } while (a);", "do_while"), ("end: f();", "label"),
    ],
    "php": [
        ("$a = 1;", "assign"), ("$a .= 'x';", "expr_stmt"), ("$a++;", "expr_stmt"), ("f();", "call_expr"), ("$a->b();", "call_expr"), ("A::b();", "call_expr"), ("new A();", "expr_stmt"), ("throw new E();", "throw_raise"), ("echo $a;", "echo"),
        ("global $a;", "global"), ("goto end;", "goto"), ("const A = 1;", "assign"), ("foreach ($a as $b) { f(); }", "for"), ("try { f(); } catch (E $e) { g(); }", "try_catch"),
    ],
}


@pytest.mark.parametrize("language", KINDS)
def test_statement_types(language):
    for code, kind in KINDS[language]:
        assert rows(code, language)[0]["kind"] == kind, code


def test_what_has_no_row():
    assert rows("type T struct {\n  a int\n}\nf()", "go")[0]["kind"] == "call_expr"
    assert [r["raw"] for r in rows("class A { m() { return 1; } }", "javascript")] == ["return 1;"]  # the first function's body
    assert rows("class A:\n    x = 1\n", "python") == [] and rows("static $a;\nunset($b);", "php") == []
    assert rows("a.map(x => x + 1); f();", "javascript") == []  # its first function's body is an expression


def test_clauses_stand_side_by_side():
    php = C.nodes("if ($a) { f(); } elseif ($b) { g(); } elseif ($c) { h(); } else { i(); }", "php")
    python = C.nodes("if a:\n    f()\nelif b:\n    g()\nelif c:\n    h()\nelse:\n    i()\n", "python")
    for (node,) in (php, python):
        assert [(c.kind, c.block) for c in node.children] == [("call_expr", "if_true_branch"), ("if", "if_false_branch"), ("if", "if_false_branch"), ("call_expr", "if_false_branch")]
        assert [[g.block for g in c.children] for c in node.children] == [[], ["if_true_branch"], ["if_true_branch"], []]
    (nested,) = C.nodes("if (a) { f(); } else if (b) { g(); } else { h(); }", "javascript")
    assert [(c.kind, len(c.children)) for c in nested.children] == [("call_expr", 0), ("if", 2)]


def test_headers_with_statements():
    go = rows("if err := f(); err != nil {\n  return err\n}", "go")
    assert [(r["kind"], r["block"], r["path"], r["guard"]) for r in go] == [("if", "function_body", [], True), ("assign", "function_body", [1], False), ("return", "if_true_branch", [1], False)]
    js = rows("for (let i = 0; i < 3; i++) f(i);", "javascript")
    assert [(r["kind"], r["raw"]) for r in js] == [("for", "for (let i = 0; i < 3; i++) f(i);"), ("assign", "let i = 0;"), ("call_expr", "f(i);")]
    assert [r["kind"] for r in rows("for (const x of y) f(x);", "javascript")] == ["for", "call_expr"]


@pytest.mark.parametrize("test,guards", [("err != nil", True), ("e.Err != nil", True), ("err2 != nil", True), ("myErr != nil", False), ("err != nil && x", False), ("err == nil", False), ("(err != nil)", False), ("x > 0", False)])
def test_error_checks(test, guards):
    assert rows(f"if {test} {{\n  f()\n}}", "go")[0]["guard"] == guards


@pytest.mark.parametrize("language,code,names,top", [
    ("go", 'sb.Select(fmt.Sprintf("%s", x))', ["sb.Select", "fmt.Sprintf"], "sb.Select"),
    ("go", "a().b(c)", ["a", "a().b"], "a().b"),
    ("go", "go func() { f() }()", ["f", "func() { f() }"], "func() { f() }"),
    ("go", "x := []byte(s)", [], ""),
    ("python", "'a'.format(f(x))", ["'a'.format", "f"], "'a'.format"),
    ("python", "x = f(a)(b)", ["f", "f(a)"], "f(a)"),
    ("python", "def g(a):\n    return not (a)", [], ""),
    ("javascript", "return new Foo(bar())", ["Foo", "bar"], "Foo"),
    ("javascript", "x = a?.b(1)", ["a?.b"], "a?.b"),
    ("javascript", "`${f(x)}`", ["f"], "f"),
    ("php", "$a->b()->c($d);", ["$a->b", "$a->b()->c"], "$a->b()->c"),
    ("php", "$x = new A(f());", ["f"], "f"),
    ("php", "if (isset($a) && empty($b)) { f(); }", ["isset", "empty"], "isset"),
])
def test_calls(language, code, names, top):
    row = rows(code, language)[0]
    assert sorted(row["calls"]) == sorted(names) and row["top"] == top and row["n_calls"] == len(names)


@pytest.mark.parametrize("language,code,defined,used", [
    ("go", "a, b := f(c)", 2, 2), ("go", "a.b = c", 0, 2), ("go", "var a, b int", 1, 1), ("go", "x := T{A: y}", 1, 2), ("go", "i++", 0, 1),
    ("python", "a.b = c", 2, 1), ("python", "a = b = c", 1, 2), ("python", "a, b = c", 2, 1), ("python", "d[k] = v", 2, 1), ("python", "f(x=1)", 0, 2),
    ("javascript", "let a = 1, {b} = c;", 1, 1), ("javascript", "a.b = c;", 0, 2), ("javascript", "x = {k: v, w};", 1, 1), ("javascript", "f(this.a, undefined)", 0, 1),
    ("php", "$a = $b;", 1, 1), ("php", "$a->b = $c;", 1, 1), ("php", "[$a, $b] = f();", 2, 0), ("php", "$a[$i] = 1;", 2, 0), ("php", "$a .= $b;", 0, 2),
])
def test_variables(language, code, defined, used):
    row = rows(code, language)[0]
    assert (row["defined"], row["used"]) == (defined, used)


@pytest.mark.parametrize("language,code,joins", [
    ("go", "q := base + user", True), ("go", "x := +1", False), ("python", "a = b + c", False), ("python", "a = f'{b}'", True), ("python", "a = f'b'", False), ("javascript", "a = b + c", True),
    ("javascript", "a = `b`", True), ("javascript", "a = b - c", False), ("php", "$a = $b . 'c';", True), ("php", '$a = "b";', True), ("php", "$a = 'b';", False), ("php", "$a = 1.5;", False),
])
def test_joined_text(language, code, joins):
    assert rows(code, language)[0]["joins"] == joins


@pytest.mark.parametrize("language,code,tokens", [
    ("go", 'f("a\\n", x)', 9), ("python", 'x = ""', 4), ("python", "x = f'a{b}c'", 9), ("javascript", "a.b(`x${y}`);", 12), ("php", "$a = 'b';", 7), ("go", "a := 1 // why", 3), ("python", "if a:  # why\n    b()", 7),
])
def test_tokens(language, code, tokens):
    assert rows(code, language)[0]["tokens"] == tokens


def test_typescript_reads_a_lone_method_inside_a_class():
    assert [r["first"] for r in rows("private f(): void {\n  g();\n}", "typescript")] == [3] and [r["first"] for r in rows("function f() {\n  g();\n}", "typescript")] == [2]


def test_flags_of_the_table(spark):
    code = [
        (0, "php", 'echo htmlspecialchars("x");'), (1, "js", "el.innerHTML = x;"), (2, "go", "gob.NewDecoder(r)"), (3, "py", "with open(p) as f:\n    pass"), (4, "py", "import os"), (5, "php", "if (filter_var($a)) { b($a); }"),
        (6, "go", "https.Get(u)"), (7, "js", "https.get(u)"), (8, "py", "x = '{}'.format(1)"),
    ]
    df = spark.createDataFrame([(i, lang, text, text) for i, lang, text in code], "row_index long, language string, vulnerable_code string, fixed_code string")
    got = {(int(r["statement_id"].split(":")[3]), r["statement_id"].split("#")[1]): r for r in features.features(df).collect()}
    assert got[0, "1"]["is_output_render"] and got[0, "1"]["uses_only_literals"] and got[0, "1"]["sanitization_call_detected"] and got[0, "1"]["statement_type"] == "echo"
    assert got[1, "1"]["is_output_render"] and got[2, "1"]["is_deserialization"] and got[2, "1"]["call_target_kind"] == "stdlib"
    assert got[3, "1"]["is_compound"] and got[3, "1"]["is_file_io"] and got[3, "1"]["cyclomatic_contribution"] == 0 and not got[4, "1"]["uses_only_literals"]
    assert got[5, "2"]["sanitization_call_detected"] and got[5, "2"]["guard_count"] == 1 and got[6, "1"]["call_target_kind"] == "third_party" and got[7, "1"]["call_target_kind"] == "stdlib"
    assert got[8, "1"]["uses_string_concat_or_format"]
