"""The features pipeline: code pairs to a flat table of labelled statements.

A worker reads each side's tokens once and gives a struct a statement, with the places of its
ancestors. Everything that ancestors or a row's own columns tell (depth, guards, handlers,
sanitizers, sink flags, target kind, ids) is an expression on top.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from patchloom import plugins
from patchloom.functions import code as C
from patchloom.functions import shapes
from patchloom.functions import text as T
from patchloom.functions.dictionaries import FORMATS, SANITIZERS, SINKS

#: Languages with dictionaries; TypeScript is read as JavaScript.
LANGUAGES = ("go", "python", "javascript", "php", "typescript")
FLAGS = tuple(SINKS["python"])
# Fixed value: the columns of the statement table, in order.
COLUMNS = (
    "cve_id", "vulnerability_type", "commit_hash", "repo", "origin", "statement_id", "parent_statement_id", "nesting_depth", "statement_type", "parent_block_type", "repo_name", "file_path",
    "function_name", "language", "line_start", "line_end", "num_source_lines", "raw_text", "token_count", "char_length", "num_calls", "top_level_call_name", "call_target_kind",
    "is_process_exec", "is_db_query", "is_dynamic_eval", "is_deserialization", "is_file_io", "is_network_call", "is_output_render", "uses_string_concat_or_format", "num_variables_defined",
    "num_variables_used", "uses_only_literals", "guard_count", "inside_error_handler", "is_error_handling_statement", "sanitization_call_detected", "is_compound", "num_direct_children",
    "cyclomatic_contribution", "label",
)
#: What a worker tells of a statement; path has the places of its ancestors among the pair's statements, outermost first.
STATEMENT = (
    "origin string, seq int, path array<int>, kind string, block string, first int, last int, raw string, tokens int, calls array<string>, n_calls int, top string, joins boolean, "
    "defined int, used int, guard boolean, children int, label int"
)
NAMES = [x.split(" ")[0] for x in STATEMENT.split(", ")]
#: What ancestors tell of a statement, and what that is told by.
ABOVE = {"depth": "path", "above": "path first last seq", "guards": "path kind", "in_handler": "path block guard", "handles": "path kind block", "sanitized": "path calls"}
# Fixed value: what each column that isn't the pair's own is made of.
MADE_OF = {
    "vulnerability_type": "origin", "origin": "origin", "statement_id": "origin first last seq", "parent_statement_id": "origin above", "nesting_depth": "depth", "statement_type": "kind", "parent_block_type": "block",
    "line_start": "first", "line_end": "last", "num_source_lines": "first last", "raw_text": "raw", "token_count": "tokens", "char_length": "raw", "num_calls": "n_calls", "top_level_call_name": "top", "call_target_kind": "top",
    **dict.fromkeys(FLAGS, "calls"), "is_output_render": "calls raw kind", "uses_string_concat_or_format": "joins calls", "num_variables_defined": "defined", "num_variables_used": "used", "uses_only_literals": "used n_calls kind",
    "guard_count": "guards", "inside_error_handler": "in_handler", "is_error_handling_statement": "handles", "sanitization_call_detected": "sanitized", "is_compound": "children kind", "num_direct_children": "children",
    "cyclomatic_contribution": "kind", "label": "label",
}
# Fixed value: the pair's columns that others are made of.
OF_PAIR = {"repo_name": "repo", "file_path": "file", "function_name": "method", **dict.fromkeys(("statement_id", "parent_statement_id"), "repo file method row_index")}


def statements_type(names: Sequence[str] = NAMES) -> str:
    """The type of a pair's statements with these of NAMES."""
    return f"array<struct<{','.join(x.replace(' ', ':', 1) for x in STATEMENT.split(', ') if x.split(' ')[0] in names)}>>"


#: Pairs that a worker turns into statements at a time.
GROUP = 512
# Fixed value: the left side of Go's error check.
ERROR_CHECK = re.compile(r"(?:[^&|=!<>]*\b)?err\w*\s*!=\s*nil", re.I)


def languages() -> tuple[str, ...]:
    """Languages with a statement table, those of plug-ins among them."""
    return (*LANGUAGES, *(name for name, own in plugins.LANGUAGES.items() if own.nodes))


def _squeeze(x: str) -> str:
    return re.sub(r"\s+", " ", x).strip()


def _mark(nodes: list[C.Node]) -> None:
    for n in nodes:
        n.label = 1
        _mark(n.children)


def label(v: list[C.Node], f: list[C.Node], v_side: C.Side, f_side: C.Side) -> None:
    """Label the vulnerable statements that the fix changed: 1 for changed headers, replaced and deleted statements; 0 for equal and moved ones."""
    if not v:
        return
    vs, fs = ([_squeeze(side.code[n.start : n.end]) for n in nodes] for side, nodes in ((v_side, v), (f_side, f)))
    codes = SequenceMatcher(None, vs, fs).get_opcodes()
    moved: dict[str, int] = {}
    for tag, _, _, c, d in codes:
        if tag == "insert":
            for x in fs[c:d]:
                moved[x] = moved.get(x, 0) + 1
    for tag, a, b, c, d in codes:
        if tag == "replace" and b - a == d - c:
            for x, y in zip(v[a:b], f[c:d]):
                if x.kind != y.kind:
                    _mark([x])
                    continue
                x.label = int(_squeeze(v_side.own_text(x)) != _squeeze(f_side.own_text(y)))
                label(x.children, y.children, v_side, f_side)
        elif tag == "replace":
            _mark(v[a:b])
        elif tag == "delete":
            for x, key in zip(v[a:b], vs[a:b]):
                if moved.get(key):
                    moved[key] -= 1
                else:
                    _mark([x])


def _rows(side: C.Side, origin: str, first: int, labelled: bool) -> Iterator[tuple]:
    """A row a statement, parents first; first is the place of the first among the pair's."""
    code, language, at = side.code, side.language, 0
    shift = 1 if language == "typescript" and T.ISOLATED.match(code) else 0

    def walk(node: C.Node, path: list[int]) -> Iterator[tuple]:
        nonlocal at
        at += 1
        place = first + at
        own = side.own(node)
        calls = C.calls(own, language, lambda a, b: code[a:b]) if any(t.text in ("(", "new") for t in own) else []
        outer = [c for c in calls if not any(x is not c and x[0] <= c[0] and c[1] <= x[1] for x in calls)]
        top = min(outer, default=None)
        defined = C.n_defined(node.kind, own, language) if node.defined is None else node.defined
        guard = language == "go" and node.test is not None and ERROR_CHECK.fullmatch(code[slice(*node.test)]) is not None
        yield (
            origin, at, path, node.kind, node.block, side.line(node.start) + shift, side.line(node.end) + shift, code[node.start : node.end], side.n_tokens(node), [c[2] for c in calls if c[2]], len(calls), top[2] if top else "",
            C.joins(own, language), defined, C.n_names(own, language) - defined, guard, len(node.children), node.label if labelled else 0,
        )
        for child in sorted(node.children, key=lambda n: n.start):
            yield from walk(child, [*path, place])

    for root in side.roots:
        yield from walk(root, [])


def _side(code: str, language: str, own: plugins.Language | None) -> C.Side:
    return C.Side(code, language) if own is None else C.Side(code, own.like, own.nodes)


def statements_of(vulnerable: str, fixed: str | None, language: str, own: plugins.Language | None = None) -> list[tuple]:
    """Rows of both versions of one method; of the vulnerable one alone, as unchanged, if the two are the same. own: the plug-in of its language, if it is one's."""
    own = own or plugins.LANGUAGES.get(language)
    if own is None:
        return _by_shape(language, vulnerable, fixed)
    return _statements(language, vulnerable, fixed, own)


def _statements(language: str, vulnerable: str, fixed: str | None, own: plugins.Language | None = None) -> list[tuple]:
    v = _side(vulnerable, language, own)
    if not (fixed and fixed.strip()):
        _mark(v.roots)
        return list(_rows(v, "vulnerable", 0, True))
    if vulnerable.strip() == fixed.strip():
        return list(_rows(v, "unchanged", 0, False))
    f = _side(fixed, language, own)
    label(v.roots, f.roots, v, f)
    rows = list(_rows(v, "vulnerable", 0, True))
    return rows + list(_rows(f, "fixed", len(rows), False))


def _restored(row: tuple, put: Callable[[str], str]) -> tuple:
    """A row of NAMES with put() applied to raw, calls and top."""
    return (*row[:7], put(row[7]), row[8], [put(c) for c in row[9]], row[10], put(row[11]), *row[12:])


_by_shape = shapes.remembered(_statements, _restored)


@lru_cache(shapes.SHAPES)
def _shape(language: str, vulnerable: str, fixed: str | None) -> list[tuple]:
    return _statements(language, vulnerable, fixed)


def _arrow(rows: list[tuple[str, str, str | None]], names: Sequence[str], kind: pa.DataType, added: dict[str, plugins.Language]) -> pa.Array:
    """The statements of rows (language, vulnerable, fixed) with these of NAMES; null where the code can't be worked on.

    Rows of each shape are made once and copied by Arrow; texts with numbers are put together anew.
    """

    def alone(language: str, *texts: str | None) -> list[tuple]:
        own = added.get(language)
        return _statements(language, *texts, own)

    # what a plug-in says may depend on numbers
    found = shapes.Rows(rows, _shape, alone, added, (IndexError, ValueError, RecursionError))
    places = [NAMES.index(n) for n in names]
    made = pa.array([None if own is None else [tuple(x[i] for i in places) for x in own] for own in found.results], kind).take(pa.array(found.at))
    flat = made.flatten()
    own = [x or [] for x in found.results]
    columns = {n: flat.field(i) for i, n in enumerate(names)}
    for name in ("raw", "top"):
        if name in columns:
            i = NAMES.index(name)
            cells = [[(k, cut) for k, x in enumerate(rows_of) if (cut := shapes.parts(x[i]))] for rows_of in own]
            columns[name] = found.put_back(columns[name], [len(x) for x in own], cells)
    if "calls" in columns:
        calls = [[c for x in rows_of for c in x[NAMES.index("calls")]] for rows_of in own]
        cells = [[(k, cut) for k, c in enumerate(x) if (cut := shapes.parts(c))] for x in calls]
        lists = columns["calls"]
        columns["calls"] = pa.ListArray.from_arrays(_offsets(lists), found.put_back(lists.flatten(), [len(x) for x in calls], cells))
    structs = pa.StructArray.from_arrays(list(columns.values()), fields=list(kind.value_type))
    return pa.ListArray.from_arrays(_offsets(made), structs, type=kind, mask=made.is_null() if made.null_count else None)


def _offsets(lists: pa.ListArray) -> pa.Array:
    """Where each list begins among all of them end to end, and the last one's end."""
    return pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]).astype(np.int32))


def parsed(pairs: DataFrame, names: Sequence[str] = NAMES, code: bool = True) -> DataFrame:
    """pairs with _language and _s, a struct of these of NAMES for each statement; null where the code can't be worked on. code: whether to keep the columns of code."""
    known = pairs.withColumn("_language", T.resolve_language(F.col("language")))
    known = known.where(F.col("_language").isin(*languages()) & T.has_code(F.col("vulnerable_code")))
    added = dict(plugins.LANGUAGES)  # they travel with the plan
    columns = [c for c in known.columns if code or c not in ("vulnerable_code", "fixed_code", "language")]
    schema = known.select(*columns, F.lit(None).cast(statements_type(names)).alias("_s")).schema
    kind = to_arrow_type(schema["_s"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # batches of whole methods are wide: some at a time
            for at in range(0, len(batch), GROUP):
                part = batch.slice(at, GROUP)
                rows = list(zip(*(part[c].to_pylist() for c in ("_language", "vulnerable_code", "fixed_code"))))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), _arrow(rows, names, kind, added)], [*columns, "_s"])

    return known.mapInArrow(run, schema)


def _by_language(language: Column, of) -> Column:
    """of(dictionary) by the row's language."""
    out = of("javascript")
    for name in ("go", "python", "php"):
        out = F.when(language.isin(name, *(x for x in plugins.LANGUAGES if plugins.like(x) == name)), of(name)).otherwise(out)
    return out


def _placed(s: Column, names: Sequence[str], told: Sequence[str]) -> Column:
    """Each statement of s, a pair's, with these of NAMES and what its ancestors tell, of these: depth, above (the lines and number of its parent), guards, in_handler, handles and sanitized.

    path has places in s, so each ancestor is looked up, never searched for. _clean says of each
    statement whether it calls a sanitizer.
    """

    def of(x: Column, i: Column) -> Column:
        path = x["path"]
        nested = F.size(path) > 0

        def at(place: Column) -> Column:
            return F.get(s, place - 1)

        def handles(p: Column, k: Column) -> Column:
            below = at(F.coalesce(F.get(path, k + 1), i + 1))  # the next one on the way to x
            return (below["block"] == "exception_handler") | (below["block"] == "if_true_branch") & at(p)["guard"]

        parent = at(F.element_at(path, -1))
        above = {
            "depth": lambda: F.size(path),
            "above": lambda: F.when(nested, F.struct(parent["first"].alias("first"), parent["last"].alias("last"), parent["seq"].alias("seq"))),
            "guards": lambda: F.size(F.filter(path, lambda p: at(p)["kind"] == "if")), "in_handler": lambda: F.exists(F.transform(path, handles), lambda h: h),
            "handles": lambda: F.when(nested, (parent["kind"] == "try_catch") & (x["block"] == "exception_handler")).otherwise(False),
            "sanitized": lambda: F.get(F.col("_clean"), i) | F.exists(path, lambda p: F.get(F.col("_clean"), p - 1)),
        }
        return F.struct(*[x[name].alias(name) for name in names], *[above[name]().alias(name) for name in told])

    return F.transform(s, of)


def _parts(columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """(those of NAMES, those of ABOVE) that these columns are made of."""
    wanted = {x for c in columns for x in MADE_OF.get(c, "").split()}
    told = [x for x in ABOVE if x in wanted]
    wanted |= {x for name in told for x in ABOVE[name].split()}
    # a statement without columns of its own is still a row
    return [x for x in NAMES if x in wanted] or ["seq"], told


def features(pairs: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The statement table: these of COLUMNS for each statement of each pair of a language with dictionaries.

    pairs needs row_index; other missing columns count as null. Pairs without vulnerable code, and
    those whose code can't be parsed, give no rows. Nothing is worked out for columns left out.
    """
    names, _ = _parts(columns)
    # what goes to Python comes back: no more columns than are asked for
    needed = {x for c in columns for x in OF_PAIR.get(c, c).split()}
    own = pairs.select("language", "vulnerable_code", "fixed_code", *[c for c in pairs.columns if c in needed - {"language"}])
    return table_of(parsed(own, names, code=False), columns)


def table_of(parsed_pairs: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """features() of pairs that parsed() has gone over."""
    rows = parsed_pairs
    for c in ("cve_id", "vulnerability_type", "commit_hash", "repo", "file", "method"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    language = F.col("_language")
    names, told = _parts(columns)

    def cleans(calls: Column, name: str) -> Column:
        return F.exists(calls, lambda n: T.matches(n, SANITIZERS[name], (), ()))

    meta = ["cve_id", "vulnerability_type", "commit_hash", "repo", "file", "method"]
    clean = [F.transform("_s", lambda x: _by_language(language, lambda name: cleans(x["calls"], name))).alias("_clean")] if "sanitized" in told else []
    rows = rows.select("_s", "_language", (F.col("row_index").cast("string") if "row_index" in rows.columns else F.lit(None).cast("string")).alias("_row"), *[T.or_empty(F.col(c)).alias(c) for c in meta], *clean)
    rows = rows.select("_language", "_row", *meta, F.inline(_placed(F.col("_s"), names, told)))
    prefix = F.concat_ws(":", "repo", "file", "method", "_row", "origin")

    flags = {flag: _by_language(language, lambda name, flag=flag: T.sink_flags(F.col("calls"), name)[flag]) for flag in FLAGS}
    flags["is_output_render"] = flags["is_output_render"] | T.output_text(F.col("raw"), F.col("kind"), language)
    formats = _by_language(language, lambda name: F.exists("calls", lambda n: T.matches(n, *FORMATS[name], ())))
    made = {
        "vulnerability_type": F.when(F.col("origin") == "vulnerable", F.col("vulnerability_type")).otherwise("none"),
        "statement_id": T.statement_id(prefix, F.col("first"), F.col("last"), F.col("seq")),
        "parent_statement_id": F.when(F.col("above").isNotNull(), T.statement_id(prefix, F.col("above.first"), F.col("above.last"), F.col("above.seq"))),
        "nesting_depth": F.col("depth"), "statement_type": F.col("kind"), "parent_block_type": F.col("block"),
        "repo_name": F.col("repo"), "file_path": F.col("file"), "function_name": F.col("method"), "language": language,
        "line_start": F.col("first"), "line_end": F.col("last"), "num_source_lines": T.line_span(F.col("first"), F.col("last")),
        "raw_text": F.col("raw"), "token_count": F.col("tokens"), "char_length": F.char_length("raw"), "num_calls": F.col("n_calls"),
        "top_level_call_name": F.col("top"), "call_target_kind": _by_language(language, lambda name: T.call_target_kind(F.col("top"), name)),
        **flags, "uses_string_concat_or_format": F.col("joins") | formats, "num_variables_defined": F.col("defined"), "num_variables_used": F.col("used"),
        "uses_only_literals": T.only_literals(F.col("used"), F.col("n_calls"), F.col("kind")), "guard_count": F.col("guards"), "inside_error_handler": F.col("in_handler"),
        "is_error_handling_statement": F.col("handles"), "sanitization_call_detected": F.col("sanitized"), "is_compound": T.is_compound(F.col("children"), F.col("kind")),
        "num_direct_children": F.col("children"), "cyclomatic_contribution": T.cyclomatic(F.col("kind")), "label": F.col("label"),
    }
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in columns])


#: Counters of the features pipeline, in order.
COUNTERS = (
    "total_input_rows", "total_output_rows", "total_positive_labels", "total_from_vulnerable_side", "total_from_fixed_side", "total_from_unchanged_rows",
    "skipped_unsupported_language", "skipped_no_code", "skipped_extraction_failure",
)


def _seen() -> list[Column]:
    """Counters over the input."""
    known = F.coalesce(T.resolve_language(F.col("language")).isin(*languages()), F.lit(False))
    return [F.count("*").alias(COUNTERS[0]), F.count_if(~known).alias(COUNTERS[6]), F.count_if(known & ~T.has_code(F.col("vulnerable_code"))).alias(COUNTERS[7])]


def _found() -> list[Column]:
    """Counters over parsed pairs."""
    tests = [lambda x: F.lit(True), lambda x: x["label"] == 1, lambda x: x["origin"] == "vulnerable", lambda x: x["origin"] == "fixed", lambda x: x["origin"] == "unchanged"]
    sums = [F.coalesce(F.sum(F.when(F.col("_s").isNotNull(), F.size(F.filter("_s", test)).cast("long"))), F.lit(0).cast("long")) for test in tests]
    return [*(c.alias(name) for c, name in zip(sums, COUNTERS[1:6])), F.count_if(F.col("_s").isNull()).alias(COUNTERS[8])]


class Counted:
    """Parsed pairs whose counters are observed by whatever writes them: parsed, a table to work on, and row(), one row of the counters after that."""

    def __init__(self, pairs: DataFrame):
        self.spark = pairs.sparkSession
        self.seen, self.found = Observation(), Observation()
        self.parsed = parsed(pairs.observe(self.seen, *_seen())).observe(self.found, *_found())

    def row(self) -> DataFrame:
        got = self.seen.get | self.found.get
        return self.spark.createDataFrame([tuple(got[c] for c in COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS))


def counters(pairs: DataFrame) -> DataFrame:
    """One row of the nine counters: rows in and out, positive labels, rows of each origin, and rows skipped for their language, for missing code, or because they couldn't be parsed."""
    return pairs.agg(*_seen()).crossJoin(parsed(pairs).agg(*_found())).select(*COUNTERS)  # one row each


def rejects(parsed_pairs: DataFrame) -> DataFrame:
    """Parsed pairs whose code couldn't be worked on, with the reason."""
    return parsed_pairs.where("_s is null").drop("_s", "_language").withColumn("reason", F.lit("extraction_failure"))
