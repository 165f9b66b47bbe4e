"""Queries of the table functions: statements of awkward code in SQL, their texts told by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom import sql
from patchloom.functions import text as T
from patchloom.operators import pairs as P
from patchloom.plans.base import query, read

#: (language, before, statements, after) by o_orderkey % 24; § is the key, ¶ a line break.
SNIPPETS = [
    ("js", "function f(a) { ", ["const r = /[{]\"/g;", "if (r.test(a§)) { x(); }", "return 1;"], " }"),
    ("js", "function f(s) { ", ["if (/\"/.test(s)) y(§);", "q = a / b / c;", "return s.replace(/\\//g, §);"], " }"),
    ("ts", "class A { foo<K>(k: K): K { ", ["if (!k) { return k; }", "return this.get<K>(k, §);"], " } }"),
    ("ts", "foo<A, B<C>>(a: A): Map<A, B<C>> { ", ["a(§);", "return b;"], " }"),
    ("ts", "private async load<T>(id: string): Promise<T> { ", ["const x = §;", "return await this.http.get<T>(id);"], " }"),
    ("php", "function f($a) { ", ["if ($a): echo §; endif;", "b();"], " }"),
    ("php", "function f($a) { ", ["foreach ($x as $y): if ($y): a(§); endif; endforeach;", "while ($a): b(); endwhile;", "c();"], " }"),
    ("php", "function f($a) { ", ["$x = <<<EOT¶Hi $a; if (x) { §¶EOT;", "echo $x;"], " }"),
    ("php", "<?php function f($a) { ", ["if ($a) { ?> <b>no { here §</b> <?php echo $a; }", "c();"], " }"),
    ("java", "void f() { ", ["try { a(§); } finally { b(); }", "int[] a = {1, 2};", "return;"], " }"),
    ("java", "void f() { ", ["synchronized (x) { y(§); }", "{ z(); }", "for (int i : a) { q(); }"], " }"),
    ("java", "void f() { ", ["Map<String, List<Integer>> m = f(§);", "do { a(); } while (b);", "switch (a) { case 1: b(); default: c(); }"], " }"),
    ("rust", "fn f(x: u8) -> u8 { ", ["loop { break; }", "if let Some(y) = x { g(§); } else { h(); }", "let z = match x { _ => 1 };", "z"], " }"),
    ("rs", "fn f(x: u8) { ", ["unsafe { k(§) }", "match z { 1 => {} _ => {} }", "match a { _ => b }.c();"], " }"),
    ("c", "int f(int a) {¶", ["#ifdef X¶  foo(§);¶#else¶  bar();¶#endif", "int b[] = {1, 2};", "return a;"], "¶}"),
    ("c++", "int f(int a) {¶", ["#define Q § \\¶ 2", "{ int k; }", "if (a) b(); else if (c) { d(); } else e();"], "¶}"),
    ("py", "def f(x):¶    ", ["a = §", "if x¶        b = 2", "return a"], ""),
    ("python", "def f(x):¶    ", ["for i in x:¶        print(i, §", "return a"], ""),
    ("go", "func f(x int) error {¶", ["a, err := load(§)", "if err != nil {¶return err¶}", "for i := range []int{1, 2} {¶run(i)¶}", "return nil"], "¶}"),
    ("golang", "func (s *S) f() {¶", ["defer s.close()", "switch x {¶case §:¶a()¶default:¶b()¶}", "go run()"], "¶}"),
    ("js", "const f = async (a) => {¶", ["let b = `x${a}§`;", "try { c() } catch (e) { d() }", "for (const x of y) z(x);"], "¶};"),
    ("js", "function f() { ", ["label: for (;;) { break label; }", "do a(§); while (b);", "throw new Error(\"}\");"], " }"),
    ("go", "", ["x := §", "run(x)"], ""),
    ("java", "void f() { ", ["char c = \"{\".charAt(§);", "class Inner { int x; }", "new Inner();"], " }"),
]


def _sql(template: str) -> str:
    """A template as an SQL expression over o_orderkey."""
    # a dollar before a brace would be a variable of the other engine's
    return "'" + template.replace("'", "''").replace("${", "$' || '{").replace("¶", "' || chr(10) || '").replace("§", "' || CAST(o_orderkey AS VARCHAR(20)) || '") + "'"


def _separator(language: str, before: str) -> str:
    """Between statements: a line break where these end lines, four blanks more in a function of Python."""
    return "¶    " if before.startswith("def") else "¶" if before.endswith("¶") or language == "go" else " "


CODE = "SELECT o_orderkey AS row_index, CASE o_orderkey % 24 {} END AS language, CASE o_orderkey % 24 {} END AS code FROM orders".format(
    " ".join(f"WHEN {i} THEN '{language}'" for i, (language, *_) in enumerate(SNIPPETS)),
    " ".join(f"WHEN {i} THEN {_sql(before + _separator(language, before).join(own) + after)}" for i, (language, before, own, after) in enumerate(SNIPPETS)),
)
EXPECTED = "SELECT o_orderkey AS row_index, i AS n, t AS text FROM (SELECT o_orderkey, unnest(l) AS t, unnest(range(1, 1 + len(l))) AS i FROM (SELECT o_orderkey, CASE o_orderkey % 24 {} END AS l FROM orders))".format(
    " ".join(f"WHEN {i} THEN [{', '.join(map(_sql, own))}]" for i, (_, _, own, _) in enumerate(SNIPPETS))
)


def snippets(spark, sf_dir):
    """A function of one of 24 kinds for each order; few parts of the file still make work for all cores."""
    read(spark, sf_dir, "orders").repartition(spark.sparkContext.defaultParallelism).createOrReplaceTempView("orders")
    # a backslash is itself in the other engine's strings
    return spark.sql(CODE.replace("\\", "\\\\").replace("chr(", "char("))


@query(EXPECTED.replace(" AS n,", "::INTEGER AS n,").replace("i::INTEGER", "CAST(i AS INTEGER)"))
def lateral_statements(spark, sf_dir):
    """Top-level statements of awkward code, by a table function and a lateral join."""
    sql.register(spark)
    snippets(spark, sf_dir).createOrReplaceTempView("snippets")
    return spark.sql("SELECT c.row_index, s.n, s.text FROM snippets c, LATERAL code_pieces(c.code, c.language) s")


@query(EXPECTED.replace(" AS n,", "::INTEGER AS n,").replace("i::INTEGER", "CAST(i AS INTEGER)"))
def statement_texts(spark, sf_dir):
    """The same by the pairs pipeline's own function."""
    found = P.split_code(F.col("code"), T.resolve_language(F.col("language")), "statement")
    return snippets(spark, sf_dir).select("row_index", F.posexplode(found).alias("n", "text")).withColumn("n", F.col("n") + 1)


@query(f"WITH p AS ({CODE}) SELECT row_index, code AS text FROM p WHERE row_index % 24 IN (0, 1, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, 18, 19, 21, 23)")
def method_texts(spark, sf_dir):
    """Functions that are all of their snippet, as methods."""
    found = P.split_code(F.col("code"), T.resolve_language(F.col("language")), "method")
    whole = "row_index % 24 IN (0, 1, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, 18, 19, 21, 23)"
    return snippets(spark, sf_dir).where(whole).select("row_index", F.explode(found).alias("text"))
