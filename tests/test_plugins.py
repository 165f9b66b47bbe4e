"""A language and a strategy from outside the package, table functions in SQL, counters observed in the same pass."""

import pytest
from pyspark.sql import functions as F

from patchloom import cli, plugins, sql
from patchloom.functions import code as C
from patchloom.operators import features, pairs
from patchloom.sources import tables

# a ninth language: a statement a line, `fun` opens a method, `guard` an if


def lines_of(code):
    return [x.strip() for x in code.split("\n") if x.strip()]


def methods_of(code):
    return [f"fun{x}".strip() for x in code.split("fun")[1:]]


def nodes_of(code):
    out, at = [], 0
    for line in code.split("\n"):
        if line.strip():
            start = at + len(line) - len(line.lstrip())
            out.append(C.Node("if" if line.strip().startswith("guard") else "call_expr", "function_body", start, at + len(line.rstrip())))
        at += len(line) + 1
    return out


def crosswise(v, f):
    return list(zip(v, reversed(f))) if len(v) == len(f) else None


@pytest.fixture
def brief():
    plugins.language("brief", methods_of, lines_of, nodes_of, aliases=("br",), like="go")
    plugins.strategy("crosswise", crosswise)
    yield
    plugins.forget("brief")
    plugins.forget("crosswise")


PAIRS = "row_index int, cve_id string, language string, vulnerable_code string, fixed_code string"
ROWS = [(0, "C", " BR ", "guard a\nrun(b)", "guard a\nrun(c)"), (1, "C", "brief", "only(x)", None), (2, "C", "go", "a := 1", "a := 2"), (3, "C", "cobol", "MOVE A", "MOVE B"), (4, "C", "go", " ", "x")]


def test_a_language_of_a_plugin(spark, brief):
    df = spark.createDataFrame(ROWS, PAIRS)
    found = [(r["row"], r["statement_type"], r["raw_text"], r["label"], r["language"], r["num_calls"]) for r in features.features(df).withColumn("row", F.split("statement_id", ":")[3]).orderBy("statement_id").collect() if r["origin"] == "vulnerable"]
    assert sorted(found) == [("0", "call_expr", "run(b)", 1, "brief", 1), ("0", "if", "guard a", 0, "brief", 0), ("1", "call_expr", "only(x)", 1, "brief", 1), ("2", "assign", "a := 1", 1, "go", 0)]
    made, counted = pairs.pair(df, "statement", "crosswise")
    assert sorted((r["row_index"], r["vulnerable_code"], r["fixed_code"]) for r in made.collect()) == [(0, "guard a", "run(c)"), (0, "run(b)", "guard a"), (2, "a := 1", "a := 2")]
    assert counted.first().asDict() == {"total_in": 4, "total_out": 3, "skipped_no_code": 1, "skipped_mismatch": 1, "skipped_unsupported": 1}
    assert pairs.splitter("method")("fun a() fun b()", "brief") == ["fun a()", "fun b()"]


def test_plugins_are_checked(spark, brief):
    with pytest.raises(ValueError, match="already"):
        plugins.language("own", methods_of, lines_of, aliases=("go",))
    with pytest.raises(ValueError, match="already"):
        plugins.language("python", methods_of, lines_of)
    with pytest.raises(ValueError, match="lower case"):
        plugins.language("Own", methods_of, lines_of)
    with pytest.raises(ValueError, match="like"):
        plugins.language("own", methods_of, lines_of, like="java")
    with pytest.raises(TypeError):
        plugins.language("own", lambda code: None, lines_of)
    with pytest.raises(TypeError):
        plugins.strategy("own", lambda v, f: 1)
    with pytest.raises(ValueError, match="of the package"):
        plugins.strategy("strict", crosswise)
    with pytest.raises(ValueError, match="crosswise"):
        pairs.pair_by(F.col("a"), F.col("b"), "unknown")
    plugins.forget("brief")
    assert features.features(spark.createDataFrame(ROWS, PAIRS)).where("language = 'brief'").count() == 0


def test_plugins_by_the_command_line(spark, tmp_path, monkeypatch):
    (tmp_path / "own_brief.py").write_text("from patchloom import plugins\nplugins.language('briefer', lambda c: [c] if c else [], lambda c: c.split(), aliases=('brf',))\nplugins.strategy('first', lambda v, f: list(zip(v[:1], f[:1])))\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "in.csv").write_text("language,vulnerable_code,fixed_code\nbrf,a b,c d\n")
    try:
        cli.main(["-i", str(tmp_path / "in.csv"), "-o", str(tmp_path / "out.csv"), "-s", "first", "--plugins", "own_brief"], spark)
        assert [(r["vulnerable_code"], r["fixed_code"]) for r in tables.read_csv(spark, str(tmp_path / "out.csv")).collect()] == [("a", "c")]
    finally:
        plugins.forget("briefer")
        plugins.forget("first")


CODE = [
    (0, "go", "a := 1\nif a > 0 {\n  run(a)\n}\nreturn a", "a := 1\nif a > 1 {\n  run(a)\n}\nreturn a"), (1, "py", "def f(x):\n    y = x\n    return y", "def f(x):\n    return y\n"), (2, "cobol", "x", "y"), (3, None, "x", "y"),
    (4, "php", None, "y"), (5, "js", 'const r = /[{]"/g; r.test(a);', 'const r = /[{]"/g; r.test(b);'),
]


def test_lateral_statements_equal_features(spark):
    sql.register(spark)
    df = spark.createDataFrame(CODE, "row_index int, language string, vulnerable_code string, fixed_code string")
    df.createOrReplaceTempView("pairs_of_code")
    table = features.features(df).withColumn("row", F.split("statement_id", ":")[3].cast("int"))
    want = sorted(tuple(r) for r in table.select("row", "origin", "statement_type", "parent_block_type", "nesting_depth", "line_start", "line_end", "raw_text", "label", "num_calls").collect())
    got = spark.sql("SELECT p.row_index, s.origin, s.kind, s.block, size(s.path), s.first, s.last, s.raw, s.label, s.n_calls FROM pairs_of_code p, LATERAL pair_statements(p.vulnerable_code, p.fixed_code, p.language) s")
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 15
    got = spark.sql("SELECT p.row_index, s.statement_type, s.parent_block_type, s.nesting_depth, s.line_start, s.line_end, s.raw_text FROM pairs_of_code p, LATERAL code_statements(p.vulnerable_code, p.language) s")
    assert sorted(tuple(r) for r in got.collect()) == sorted((r[0], *r[2:8]) for r in want if r[1] != "fixed")
    got = spark.sql("SELECT p.row_index, s.n, s.text FROM pairs_of_code p, LATERAL code_pieces(p.vulnerable_code, p.language) s WHERE row_index IN (0, 5) ORDER BY ALL")
    assert [tuple(r) for r in got.collect()] == [(0, 1, "a := 1"), (0, 2, "if a > 0 {\n  run(a)\n}"), (0, 3, "return a"), (5, 1, 'const r = /[{]"/g;'), (5, 2, "r.test(a);")]
    got = spark.sql("SELECT p.row_index, s.text FROM pairs_of_code p, LATERAL code_methods(p.vulnerable_code, p.language) s")
    assert [tuple(r) for r in got.collect()] == [(1, "def f(x):\n    y = x\n    return y")]


def test_table_functions_check_their_arguments_and_partitions(spark):
    sql.register(spark)
    with pytest.raises(Exception, match="strings"):
        spark.sql("SELECT * FROM code_statements(1, 'go')").collect()
    rows = [("m", i, "vulnerable", t) for i, t in enumerate(["a", "b", "c", "d"])] + [("m", 10 + i, "fixed", t) for i, t in enumerate(["b", "x", "d", "a"])] + [("n", 0, "vulnerable", "q"), ("n", 1, "fixed", "q"), ("o", 0, "vulnerable", "z"), ("p", 0, "fixed", "z"), ("m", 99, "other", "w")]
    spark.createDataFrame(rows, "method string, place int, side string, text string").repartition(3).createOrReplaceTempView("sides")
    got = spark.sql("SELECT * FROM label_statements(TABLE(sides)) ORDER BY method, n")
    assert [tuple(r) for r in got.collect()] == [("m", 1, "a", 0), ("m", 2, "b", 0), ("m", 3, "c", 1), ("m", 4, "d", 0), ("n", 1, "q", 0), ("o", 1, "z", 1)]
    with pytest.raises(Exception, match="side and text"):
        spark.sql("SELECT * FROM label_statements(TABLE(SELECT 1 AS a))").collect()


def test_counters_are_observed_while_the_table_is_written(spark, tmp_path):
    df = spark.createDataFrame([*CODE, (6, "js", "function f() { " + "if (a) { " * 20_000 + "x();" + " }" * 20_000 + " }", None)], "row_index int, language string, vulnerable_code string, fixed_code string")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = cli.features_to(df, str(tmp_path / "table.csv")).first().asDict()
    assert got == features.counters(df).first().asDict()
    assert got["total_input_rows"] == 7 and got["skipped_unsupported_language"] == 2 and got["skipped_no_code"] == 1 and got["skipped_extraction_failure"] == 1
    assert got["total_output_rows"] == tables.read_csv(spark, str(tmp_path / "table.csv")).count() > 10
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert [(r["row_index"], r["reason"]) for r in features.rejects(features.parsed(df)).collect()] == [(6, "extraction_failure")]
