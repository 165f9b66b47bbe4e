"""Queries: the pairs and features pipelines over generated code, against rows told by hand from each template."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.operators import classify
from patchloom.operators import features as X
from patchloom.operators import metrics as M
from patchloom.operators import pairs as P
from patchloom.plans.base import query, read

NL = "' || chr(10) || '"
K = "' || CAST(o_orderkey AS VARCHAR(20)) || '"
#: (language, vulnerable, fixed) by o_orderkey % 8; {K} splices the key in.
TEMPLATES = [
    ("go", f"a{K} := load(x){NL}if err != nil {{{NL}  return err{NL}}}{NL}db.Query(\"q\" + a{K})", f"a{K} := load(x){NL}if err != nil {{{NL}  return err{NL}}}{NL}db.Query(\"q\", a{K})"),
    ("py", f"def f(x):{NL}    y = x{K}{NL}    if y:{NL}        os.system(y){NL}    return y", f"def f(x):{NL}    y = x{K}{NL}    if y and x:{NL}        os.system(y){NL}    return y"),
    ("js", f"let a = 1;{NL}eval(a{K});", f"let a = 1;{NL}eval(a{K});"),
    ("php", f"try {{ $a = $x; }} catch (E $e) {{ echo $a{K}; }}", f"try {{ $a = $x; }} catch (E $e) {{ echo htmlspecialchars($a{K}); }}"),
    ("python", f"a = b{K}{NL}c(a)", f"c(a){NL}a = b{K}"),
    ("java", f"int f() {{ return {K}; }}", "int f() { return 0; }"),
    ("golang", f"x := {K}{NL}run(x)", None),
    ("ts", f"while (a) {{ b(a, {K}); break; }}", f"while (a) {{ b(a, {K}); break; }}"),
]
CODE = "SELECT o_orderkey AS row_index, CAST(o_orderkey % 8 AS INTEGER) AS template, " + ", ".join(
    f"CASE o_orderkey % 8 {' '.join(f'WHEN {i} THEN ' + ('NULL' if t[j] is None else repr_) for i, t in enumerate(TEMPLATES) for repr_ in [chr(39) + str(t[j]) + chr(39)])} END AS {name}"
    for j, name in enumerate(("language", "vulnerable_code", "fixed_code"))
) + ", 'r' || CAST(o_custkey AS VARCHAR(20)) AS repo, 'f' AS file, 'm' AS method FROM orders"

# (template, origin, seq, parent, type, block, label, flag that is set)
EXPECTED = [
    (0, "vulnerable", 1, None, "assign", "function_body", 0, None), (0, "vulnerable", 2, None, "if", "function_body", 0, None), (0, "vulnerable", 3, 2, "return", "if_true_branch", 0, "handler"),
    (0, "vulnerable", 4, None, "call_expr", "function_body", 1, "db"), (0, "fixed", 1, None, "assign", "function_body", 0, None), (0, "fixed", 2, None, "if", "function_body", 0, None),
    (0, "fixed", 3, 2, "return", "if_true_branch", 0, "handler"), (0, "fixed", 4, None, "call_expr", "function_body", 0, "db"),
    (1, "vulnerable", 1, None, "assign", "function_body", 0, None), (1, "vulnerable", 2, None, "if", "function_body", 1, None), (1, "vulnerable", 3, 2, "call_expr", "if_true_branch", 0, "exec"),
    (1, "vulnerable", 4, None, "return", "function_body", 0, None), (1, "fixed", 1, None, "assign", "function_body", 0, None), (1, "fixed", 2, None, "if", "function_body", 0, None),
    (1, "fixed", 3, 2, "call_expr", "if_true_branch", 0, "exec"), (1, "fixed", 4, None, "return", "function_body", 0, None),
    (2, "unchanged", 1, None, "assign", "function_body", 0, None), (2, "unchanged", 2, None, "call_expr", "function_body", 0, "eval"),
    (3, "vulnerable", 1, None, "try_catch", "function_body", 0, None), (3, "vulnerable", 2, 1, "assign", "try_body", 0, None), (3, "vulnerable", 3, 1, "echo", "exception_handler", 1, "handler"),
    (3, "fixed", 1, None, "try_catch", "function_body", 0, None), (3, "fixed", 2, 1, "assign", "try_body", 0, None), (3, "fixed", 3, 1, "echo", "exception_handler", 0, "handler"),
    (4, "vulnerable", 1, None, "assign", "function_body", 0, None), (4, "vulnerable", 2, None, "call_expr", "function_body", 0, None),
    (4, "fixed", 1, None, "call_expr", "function_body", 0, None), (4, "fixed", 2, None, "assign", "function_body", 0, None),
    (6, "vulnerable", 1, None, "assign", "function_body", 1, None), (6, "vulnerable", 2, None, "call_expr", "function_body", 1, None),
    (7, "unchanged", 1, None, "while", "function_body", 0, None), (7, "unchanged", 2, 1, "call_expr", "loop_body", 0, None), (7, "unchanged", 3, 1, "break", "loop_body", 0, None),
]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in rows)


def code_pairs(spark, sf_dir):
    # keys, dealt out before code is made of them: parsing wants all cores, however few parts the file has
    read(spark, sf_dir, "orders").repartition(spark.sparkContext.defaultParallelism).createOrReplaceTempView("orders")
    return spark.sql(CODE.replace("chr(", "char("))


def statement_table(spark, sf_dir, *columns):
    rows = X.features(code_pairs(spark, sf_dir), ("statement_id", *columns))
    seq = F.element_at(F.split("statement_id", "#"), -1).cast("int")
    return rows.withColumns({"row_index": F.element_at(F.split("statement_id", ":"), 4).cast("long"), "seq": seq})


E = f"e(template, origin, seq, parent, kind, block, label, flag) AS (VALUES {_values(EXPECTED)}), p AS ({CODE})"
_J = "FROM p JOIN e ON p.template = e.template"


@query(f"WITH {E} SELECT row_index, origin, CAST(seq AS INTEGER) AS seq, kind AS statement_type, block AS parent_block_type, CAST(CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS INTEGER) AS nesting_depth {_J}")
def statement_tree(spark, sf_dir):
    return statement_table(spark, sf_dir, "origin", "statement_type", "parent_block_type", "nesting_depth").select("row_index", "origin", "seq", "statement_type", "parent_block_type", "nesting_depth")


@query(f"WITH {E} SELECT row_index, CAST(seq AS INTEGER) AS seq, CAST(label AS INTEGER) AS label {_J} WHERE origin = 'vulnerable'")
def label_statements(spark, sf_dir):
    return statement_table(spark, sf_dir, "origin", "label").where("origin = 'vulnerable'").select("row_index", "seq", "label")


@query(f"WITH {E} SELECT kind AS statement_type, count(*) AS n {_J} GROUP BY 1")
def statement_type_counts(spark, sf_dir):
    return X.features(code_pairs(spark, sf_dir), ("statement_type",)).groupBy("statement_type").agg(F.count("*").alias("n"))


#: (language, vulnerable, fixed) by o_orderkey % 8; 77777 stands for the key.
TABLE_TEMPLATES = [
    ('go', 'func (s S) f(id string) error {\n\trows, err := s.db.Query("SELECT " + id)\n\tif err != nil {\n\t\treturn fmt.Errorf("x: %w", err)\n\t}\n\tgo s.log(rows, 77777)\n\treturn nil\n}', 'func (s S) f(id string) error {\n\trows, err := s.db.Query("SELECT ?", id)\n\tif err != nil {\n\t\treturn fmt.Errorf("x: %w", err)\n\t}\n\tgo s.log(rows, 77777)\n\treturn nil\n}'),
    ('py', 'def f(x):\n    try:\n        os.system(f"ls {x}")\n    except OSError as e:\n        log(e, 77777)\n    return x', 'def f(x):\n    try:\n        subprocess.run(["ls", shlex.quote(x)])\n    except OSError as e:\n        log(e, 77777)\n    return x'),
    ('js', 'function f(a) {\n  const q = `id=${a}`;\n  el.innerHTML = q + 77777;\n  items.forEach(i => eval(i));\n}', 'function f(a) {\n  const q = `id=${a}`;\n  el.innerHTML = DOMPurify.sanitize(q) + 77777;\n  items.forEach(i => eval(i));\n}'),
    ('php', 'function f($a) {\n  if ($a) {\n    echo $a . 77777;\n  } elseif ($b) {\n    $r = $db->query("q $a");\n  }\n  throw new E();\n}', 'function f($a) {\n  if ($a) {\n    echo htmlspecialchars($a) . 77777;\n  } elseif ($b) {\n    $r = $db->query("q $a");\n  }\n  throw new E();\n}'),
    ('ts', 'private g(n: number): void {\n  for (let i = 0; i < n; i++) {\n    this.h(77777);\n  }\n}', 'private g(n: number): void {\n  for (let i = 0; i < n; i++) {\n    this.h(77777);\n  }\n}'),
    ('python', 'with open(p) as f:\n    if f:\n        pass\n    elif p:\n        del p\n    else:\n        self.x = pickle.loads(f.read(77777))', None),
    ('golang', 'switch x {\ncase 1:\n\tos.Remove(p)\n\tfallthrough\ndefault:\n\ty = 77777\n}', 'y = 77777\nswitch x {\ncase 1:\n\tos.Remove(p)\n}'),
    ('Java', 'int f() { return 77777; }', None),
]
# (template, origin, seq, parent, type, block, first line, last line, text, tokens, calls, top call, its target, text joined, defined, used, guards, in a handler, handles, sanitized, children, label, kind of sink), told by hand
TABLE = [
    (0, 'vulnerable', 1, None, 'assign', 'function_body', 2, 2, 'rows, err := s.db.Query("SELECT " + id)', 16, 1, 's.db.Query', 'third_party', True, 2, 2, 0, False, False, False, 0, 1, 'db'),
    (0, 'vulnerable', 2, None, 'if', 'function_body', 3, 5, 'if err != nil {\n\t\treturn fmt.Errorf("x: %w", err)\n\t}', 17, 0, '', 'none', False, 0, 1, 0, False, False, False, 1, 0, None),
    (0, 'vulnerable', 3, 2, 'return', 'if_true_branch', 4, 4, 'return fmt.Errorf("x: %w", err)', 11, 1, 'fmt.Errorf', 'stdlib', True, 0, 2, 1, True, False, False, 0, 0, None),
    (0, 'vulnerable', 4, None, 'go_routine', 'function_body', 6, 6, 'go s.log(rows, 77777)', 9, 1, 's.log', 'third_party', False, 0, 2, 0, False, False, False, 0, 0, None),
    (0, 'vulnerable', 5, None, 'return', 'function_body', 7, 7, 'return nil', 2, 0, '', 'none', False, 0, 0, 0, False, False, False, 0, 0, None),
    (0, 'fixed', 1, None, 'assign', 'function_body', 2, 2, 'rows, err := s.db.Query("SELECT ?", id)', 16, 1, 's.db.Query', 'third_party', False, 2, 2, 0, False, False, False, 0, 0, 'db'),
    (0, 'fixed', 2, None, 'if', 'function_body', 3, 5, 'if err != nil {\n\t\treturn fmt.Errorf("x: %w", err)\n\t}', 17, 0, '', 'none', False, 0, 1, 0, False, False, False, 1, 0, None),
    (0, 'fixed', 3, 2, 'return', 'if_true_branch', 4, 4, 'return fmt.Errorf("x: %w", err)', 11, 1, 'fmt.Errorf', 'stdlib', True, 0, 2, 1, True, False, False, 0, 0, None),
    (0, 'fixed', 4, None, 'go_routine', 'function_body', 6, 6, 'go s.log(rows, 77777)', 9, 1, 's.log', 'third_party', False, 0, 2, 0, False, False, False, 0, 0, None),
    (0, 'fixed', 5, None, 'return', 'function_body', 7, 7, 'return nil', 2, 0, '', 'none', False, 0, 0, 0, False, False, False, 0, 0, None),
    (1, 'vulnerable', 1, None, 'try_catch', 'function_body', 2, 5, 'try:\n        os.system(f"ls {x}")\n    except OSError as e:\n        log(e, 77777)', 24, 0, '', 'none', False, 0, 2, 0, False, False, False, 2, 0, None),
    (1, 'vulnerable', 2, 1, 'call_expr', 'try_body', 3, 3, 'os.system(f"ls {x}")', 11, 1, 'os.system', 'stdlib', True, 0, 3, 0, False, False, False, 0, 1, 'exec'),
    (1, 'vulnerable', 3, 1, 'call_expr', 'exception_handler', 5, 5, 'log(e, 77777)', 6, 1, 'log', 'user_defined', False, 0, 2, 0, True, True, False, 0, 0, None),
    (1, 'vulnerable', 4, None, 'return', 'function_body', 6, 6, 'return x', 2, 0, '', 'none', False, 0, 1, 0, False, False, False, 0, 0, None),
    (1, 'fixed', 1, None, 'try_catch', 'function_body', 2, 5, 'try:\n        subprocess.run(["ls", shlex.quote(x)])\n    except OSError as e:\n        log(e, 77777)', 30, 0, '', 'none', False, 0, 2, 0, False, False, False, 2, 0, None),
    (1, 'fixed', 2, 1, 'call_expr', 'try_body', 3, 3, 'subprocess.run(["ls", shlex.quote(x)])', 17, 2, 'subprocess.run', 'stdlib', False, 0, 5, 0, False, False, True, 0, 0, 'exec'),
    (1, 'fixed', 3, 1, 'call_expr', 'exception_handler', 5, 5, 'log(e, 77777)', 6, 1, 'log', 'user_defined', False, 0, 2, 0, True, True, False, 0, 0, None),
    (1, 'fixed', 4, None, 'return', 'function_body', 6, 6, 'return x', 2, 0, '', 'none', False, 0, 1, 0, False, False, False, 0, 0, None),
    (2, 'vulnerable', 1, None, 'assign', 'function_body', 2, 2, 'const q = `id=${a}`;', 10, 0, '', 'none', True, 1, 1, 0, False, False, False, 0, 0, None),
    (2, 'vulnerable', 2, None, 'assign', 'function_body', 3, 3, 'el.innerHTML = q + 77777;', 8, 0, '', 'none', True, 0, 2, 0, False, False, False, 0, 1, 'output'),
    (2, 'vulnerable', 3, None, 'call_expr', 'function_body', 4, 4, 'items.forEach(i => eval(i));', 12, 2, 'items.forEach', 'third_party', False, 0, 4, 0, False, False, False, 0, 0, 'eval'),
    (2, 'fixed', 1, None, 'assign', 'function_body', 2, 2, 'const q = `id=${a}`;', 10, 0, '', 'none', True, 1, 1, 0, False, False, False, 0, 0, None),
    (2, 'fixed', 2, None, 'assign', 'function_body', 3, 3, 'el.innerHTML = DOMPurify.sanitize(q) + 77777;', 13, 1, 'DOMPurify.sanitize', 'third_party', True, 0, 3, 0, False, False, True, 0, 0, 'output'),
    (2, 'fixed', 3, None, 'call_expr', 'function_body', 4, 4, 'items.forEach(i => eval(i));', 12, 2, 'items.forEach', 'third_party', False, 0, 4, 0, False, False, False, 0, 0, 'eval'),
    (3, 'vulnerable', 1, None, 'if', 'function_body', 2, 6, 'if ($a) {\n    echo $a . 77777;\n  } elseif ($b) {\n    $r = $db->query("q $a");\n  }', 35, 0, '', 'none', False, 0, 1, 0, False, False, False, 2, 0, None),
    (3, 'vulnerable', 2, 1, 'echo', 'if_true_branch', 3, 3, 'echo $a . 77777;', 6, 0, '', 'none', True, 0, 1, 1, False, False, False, 0, 1, 'output'),
    (3, 'vulnerable', 3, 1, 'if', 'if_false_branch', 4, 6, 'elseif ($b) {\n    $r = $db->query("q $a");\n  }', 22, 0, '', 'none', False, 0, 1, 1, False, False, False, 1, 0, None),
    (3, 'vulnerable', 4, 3, 'assign', 'if_true_branch', 5, 5, '$r = $db->query("q $a");', 15, 1, '$db->query', 'third_party', True, 1, 2, 2, False, False, False, 0, 0, 'db'),
    (3, 'vulnerable', 5, None, 'throw_raise', 'function_body', 7, 7, 'throw new E();', 6, 0, '', 'none', False, 0, 0, 0, False, False, False, 0, 0, None),
    (3, 'fixed', 1, None, 'if', 'function_body', 2, 6, 'if ($a) {\n    echo htmlspecialchars($a) . 77777;\n  } elseif ($b) {\n    $r = $db->query("q $a");\n  }', 38, 0, '', 'none', False, 0, 1, 0, False, False, False, 2, 0, None),
    (3, 'fixed', 2, 1, 'echo', 'if_true_branch', 3, 3, 'echo htmlspecialchars($a) . 77777;', 9, 1, 'htmlspecialchars', 'user_defined', True, 0, 1, 1, False, False, True, 0, 0, 'output'),
    (3, 'fixed', 3, 1, 'if', 'if_false_branch', 4, 6, 'elseif ($b) {\n    $r = $db->query("q $a");\n  }', 22, 0, '', 'none', False, 0, 1, 1, False, False, False, 1, 0, None),
    (3, 'fixed', 4, 3, 'assign', 'if_true_branch', 5, 5, '$r = $db->query("q $a");', 15, 1, '$db->query', 'third_party', True, 1, 2, 2, False, False, False, 0, 0, 'db'),
    (3, 'fixed', 5, None, 'throw_raise', 'function_body', 7, 7, 'throw new E();', 6, 0, '', 'none', False, 0, 0, 0, False, False, False, 0, 0, None),
    (4, 'unchanged', 1, None, 'for', 'function_body', 3, 5, 'for (let i = 0; i < n; i++) {\n    this.h(77777);\n  }', 23, 0, '', 'none', False, 0, 3, 0, False, False, False, 2, 0, None),
    (4, 'unchanged', 2, 1, 'assign', 'function_body', 3, 3, 'let i = 0;', 5, 0, '', 'none', False, 1, 0, 0, False, False, False, 0, 0, None),
    (4, 'unchanged', 3, 1, 'call_expr', 'loop_body', 4, 4, 'this.h(77777);', 7, 1, 'this.h', 'third_party', False, 0, 0, 0, False, False, False, 0, 0, None),
    (5, 'vulnerable', 1, None, 'with', 'function_body', 1, 7, 'with open(p) as f:\n    if f:\n        pass\n    elif p:\n        del p\n    else:\n        self.x = pickle.loads(f.read(77777))', 34, 1, 'open', 'user_defined', False, 0, 3, 0, False, False, False, 1, 1, 'file'),
    (5, 'vulnerable', 2, 1, 'if', 'with_body', 2, 7, 'if f:\n        pass\n    elif p:\n        del p\n    else:\n        self.x = pickle.loads(f.read(77777))', 26, 0, '', 'none', False, 0, 1, 0, False, False, False, 3, 1, None),
    (5, 'vulnerable', 3, 2, 'pass', 'if_true_branch', 3, 3, 'pass', 1, 0, '', 'none', False, 0, 0, 1, False, False, False, 0, 1, None),
    (5, 'vulnerable', 4, 2, 'if', 'if_false_branch', 4, 5, 'elif p:\n        del p', 5, 0, '', 'none', False, 0, 1, 1, False, False, False, 1, 1, None),
    (5, 'vulnerable', 5, 4, 'delete', 'if_true_branch', 5, 5, 'del p', 2, 0, '', 'none', False, 0, 1, 2, False, False, False, 0, 1, None),
    (5, 'vulnerable', 6, 2, 'assign', 'if_false_branch', 7, 7, 'self.x = pickle.loads(f.read(77777))', 15, 2, 'pickle.loads', 'stdlib', False, 2, 4, 1, False, False, False, 0, 1, 'deserialization'),
    (6, 'vulnerable', 1, None, 'switch', 'function_body', 1, 7, 'switch x {\ncase 1:\n\tos.Remove(p)\n\tfallthrough\ndefault:\n\ty = 77777\n}', 19, 0, '', 'none', False, 0, 1, 0, False, False, False, 3, 1, None),
    (6, 'vulnerable', 2, 1, 'call_expr', 'switch_case', 3, 3, 'os.Remove(p)', 6, 1, 'os.Remove', 'stdlib', False, 0, 2, 0, False, False, False, 0, 1, 'file'),
    (6, 'vulnerable', 3, 1, 'fallthrough', 'switch_case', 4, 4, 'fallthrough', 1, 0, '', 'none', False, 0, 0, 0, False, False, False, 0, 1, None),
    (6, 'vulnerable', 4, 1, 'assign', 'switch_case', 6, 6, 'y = 77777', 3, 0, '', 'none', False, 1, 0, 0, False, False, False, 0, 1, None),
    (6, 'fixed', 1, None, 'assign', 'function_body', 1, 1, 'y = 77777', 3, 0, '', 'none', False, 1, 0, 0, False, False, False, 0, 0, None),
    (6, 'fixed', 2, None, 'switch', 'function_body', 2, 5, 'switch x {\ncase 1:\n\tos.Remove(p)\n}', 13, 0, '', 'none', False, 0, 1, 0, False, False, False, 1, 0, None),
    (6, 'fixed', 3, 2, 'call_expr', 'switch_case', 4, 4, 'os.Remove(p)', 6, 1, 'os.Remove', 'stdlib', False, 0, 2, 0, False, False, False, 0, 0, 'file'),
]


def _sql(x) -> str:
    """A value as SQL; line ends, tabs and the key's stand-in are put in by expressions."""
    if x is None or isinstance(x, bool | int):
        return "NULL" if x is None else str(x).upper()
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '").replace("${", "$' || '{").replace("77777", "' || CAST(o_orderkey AS VARCHAR(20)) || '") + "'"


TABLE_CODE = "SELECT o_orderkey AS row_index, CAST(o_orderkey % 8 AS INTEGER) AS template, " + ", ".join(
    f"CASE o_orderkey % 8 {' '.join(f'WHEN {i} THEN {_sql(t[j])}' for i, t in enumerate(TABLE_TEMPLATES))} END AS {name}" for j, name in enumerate(("language", "vulnerable_code", "fixed_code"))
) + ", 'r' || CAST(o_custkey AS VARCHAR(20)) AS repo, 'f' AS file, CAST(NULL AS VARCHAR(20)) AS method, 'CVE-' || CAST(o_orderkey AS VARCHAR(20)) AS cve_id, 'CWE' AS vulnerability_type, 'h' AS commit_hash FROM orders"
_TABLE_ROWS = " UNION ALL ".join(
    "SELECT {0} AS template, {1} AS origin, {2} AS seq, CAST({3} AS INTEGER) AS parent, {4} AS kind, {5} AS block, {6} AS a, {7} AS b, {8} AS raw, {9} AS tokens, {10} AS calls, {11} AS top, {12} AS target, {13} AS joins, {14} AS defined, {15} AS used, "
    "{16} AS guards, {17} AS inside, {18} AS handles, {19} AS sanitized, {20} AS children, {21} AS label, CAST({22} AS VARCHAR) AS flag".format(*[_sql(x).replace("' || CAST(o_orderkey AS VARCHAR(20)) || '", "77777") for x in row])
    for row in TABLE
)


@query(f"""WITH RECURSIVE e AS ({_TABLE_ROWS}), p AS ({TABLE_CODE}), d AS (SELECT template, origin, seq, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.template, e.origin, e.seq, d.depth + 1 FROM e JOIN d ON e.template = d.template AND e.origin = d.origin AND e.parent = d.seq),
  x AS (SELECT e.* REPLACE (replace(e.raw, '77777', CAST(p.row_index AS VARCHAR)) AS raw), p.row_index, p.repo, p.cve_id, u.a AS pa, u.b AS pb, d.depth, p.repo || ':f::' || CAST(p.row_index AS VARCHAR) || ':' || e.origin || ':' AS prefix,
    CASE e.template WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' WHEN 3 THEN 'php' WHEN 4 THEN 'typescript' WHEN 5 THEN 'python' ELSE 'go' END AS language
    FROM p JOIN e ON e.template = p.template JOIN d ON d.template = e.template AND d.origin = e.origin AND d.seq = e.seq LEFT JOIN e u ON u.template = e.template AND u.origin = e.origin AND u.seq = e.parent)
  SELECT cve_id, CASE WHEN origin = 'vulnerable' THEN 'CWE' ELSE 'none' END AS vulnerability_type, 'h' AS commit_hash, repo, origin, prefix || a || '-' || b || '#' || seq AS statement_id,
  CASE WHEN parent IS NOT NULL THEN prefix || pa || '-' || pb || '#' || parent END AS parent_statement_id, CAST(depth AS INTEGER) AS nesting_depth, kind AS statement_type, block AS parent_block_type, repo AS repo_name, 'f' AS file_path, '' AS function_name, language,
  CAST(a AS INTEGER) AS line_start, CAST(b AS INTEGER) AS line_end, CAST(b - a + 1 AS INTEGER) AS num_source_lines, raw AS raw_text, CAST(tokens AS INTEGER) AS token_count, CAST(length(raw) AS INTEGER) AS char_length, CAST(calls AS INTEGER) AS num_calls,
  top AS top_level_call_name, target AS call_target_kind, coalesce(flag = 'exec', false) AS is_process_exec, coalesce(flag = 'db', false) AS is_db_query, coalesce(flag = 'eval', false) AS is_dynamic_eval, coalesce(flag = 'deserialization', false) AS is_deserialization,
  coalesce(flag = 'file', false) AS is_file_io, false AS is_network_call, coalesce(flag = 'output', false) AS is_output_render, joins AS uses_string_concat_or_format, CAST(defined AS INTEGER) AS num_variables_defined, CAST(used AS INTEGER) AS num_variables_used,
  used = 0 AND (calls > 0 OR kind = 'assign') AND kind NOT IN ('pass', 'fallthrough') AS uses_only_literals, CAST(guards AS INTEGER) AS guard_count, inside AS inside_error_handler, handles AS is_error_handling_statement, sanitized AS sanitization_call_detected,
  children > 0 OR kind IN ('if', 'for', 'switch', 'try_catch', 'with') AS is_compound, CAST(children AS INTEGER) AS num_direct_children, CAST(CASE WHEN kind IN ('if', 'for', 'try_catch') THEN 1 ELSE 0 END AS INTEGER) AS cyclomatic_contribution, CAST(label AS INTEGER) AS label FROM x""")
def features_end_to_end(spark, sf_dir):
    """All columns of the statement table over templates of each language."""
    # keys and dates, dealt out before code is made of them: parsing wants all cores, however few parts the file has
    read(spark, sf_dir, "orders").repartition(spark.sparkContext.defaultParallelism).createOrReplaceTempView("orders")
    return X.features(spark.sql(TABLE_CODE.replace("chr(", "char(")))


#: (template, number of the pair, has a vulnerable side, has a fixed side) of aligned statement pairs.
ALIGNED = [
    (0, 3, 1, 1), (1, 3, 1, 1), (2, 2, 1, 1), (3, 1, 1, 1), (4, 3, 1, 1), (5, 1, 1, 1), (6, 2, 1, 0), (7, 1, 1, 1),
]


@query(f"WITH a(template, n, v, f) AS (VALUES {_values(ALIGNED)}), p AS ({CODE}) SELECT row_index, CAST(n AS BIGINT) AS n_pairs FROM p JOIN a ON p.template = a.template")
def pairs_statement(spark, sf_dir):
    made, _ = P.pair(code_pairs(spark, sf_dir), "statement", "aligned")
    return made.groupBy("row_index").agg(F.count("*").alias("n_pairs"))


@query(f"WITH p AS ({CODE}) SELECT row_index, vulnerable_code, fixed_code, 'method' AS granularity FROM p WHERE template IN (1, 5)")
def pairs_method(spark, sf_dir):
    made, _ = P.pair(code_pairs(spark, sf_dir), "method", "strict")
    return made.select("row_index", "vulnerable_code", "fixed_code", "granularity")


@query(f"WITH p AS ({CODE}) SELECT row_index, CAST(CASE WHEN template IN (1, 5) THEN 1 ELSE 0 END AS INTEGER) AS n_methods FROM p")
def extract_methods(spark, sf_dir):
    from patchloom.functions import text as T

    found = P.split_code(F.col("vulnerable_code"), T.resolve_language(F.col("language")), "method")
    return code_pairs(spark, sf_dir).select("row_index", F.size(found).alias("n_methods"))


STATEMENTS = [(0, 3), (1, 3), (2, 2), (3, 1), (4, 2), (5, 1), (6, 2), (7, 1)]


@query(f"WITH a(template, n) AS (VALUES {_values(STATEMENTS)}), p AS ({CODE}) SELECT row_index, CAST(n AS INTEGER) AS n_statements FROM p JOIN a ON p.template = a.template")
def extract_statements(spark, sf_dir):
    from patchloom.functions import text as T

    found = P.split_code(F.col("vulnerable_code"), T.resolve_language(F.col("language")), "statement")
    return code_pairs(spark, sf_dir).select("row_index", F.size(found).alias("n_statements"))


@query("""SELECT o_orderkey AS row_index, 'success' AS status, CASE o_orderkey % 3 WHEN 0 THEN 'a=>a|=>n|b=>b' WHEN 1 THEN 'a=>a|x=>y' ELSE 'a=>a|x~y=>z' END AS pairs FROM orders""")
def pair_aligned(spark, sf_dir):
    v = F.expr("CASE o_orderkey % 3 WHEN 0 THEN array('a', 'b') WHEN 1 THEN array('a', 'x') ELSE array('a', 'x', 'y') END")
    f = F.expr("CASE o_orderkey % 3 WHEN 0 THEN array('a', 'n', 'b') WHEN 1 THEN array('a', 'y') ELSE array('a', 'z') END")
    status, made = P.pair_aligned(F.col("v"), F.col("f"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_index"), v.alias("v"), f.alias("f"))
    shown = F.array_join(F.transform("p", lambda x: F.concat(F.replace(x["vulnerable_code"], F.lit("\n\n"), F.lit("~")), F.lit("=>"), x["fixed_code"])), "|")
    return rows.select("row_index", status.alias("status"), made.alias("p")).select("row_index", "status", shown.alias("pairs"))


@query()
def classify_end_to_end(spark, sf_dir):
    """Both approaches with a small tree over the generated pairs: metrics by fold, approach and model."""
    source = code_pairs(spark, sf_dir).withColumn("cve_id", F.lit(None).cast("string")).withColumn("vulnerability_type", F.lit("CWE")).withColumn("method", F.col("row_index").cast("string"))
    config = classify.Config(models=[{"name": "decision_tree", "params": {"maxDepth": 3}}], importance=False)
    out = classify.compare(source, X.features(source, config.columns()), config)["metrics"]
    return out.select("fold", "approach", "eval_level", "model", "n_test", "n_test_pos", *[F.round(c, 6).alias(c) for c in M.METRICS])
