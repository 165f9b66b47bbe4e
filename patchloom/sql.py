"""Table functions for SQL: statements, methods and pairs of code by name, with lateral joins, and labels of partitioned statements.

    register(spark)
    SELECT p.cve_id, s.* FROM pairs p, LATERAL code_statements(p.vulnerable_code, p.language) s
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from patchloom.functions import code as C
from patchloom.functions.dictionaries import ALIASES
from patchloom.operators import features, pairs


KINDS = {"int": IntegerType(), "string": StringType(), "boolean": BooleanType(), "array<int>": ArrayType(IntegerType()), "array<string>": ArrayType(StringType())}


def _schema(columns: str) -> StructType:
    """The type of rows with these columns; it is worked out where there is no session."""
    out = StructType()
    for column in columns.split(", "):
        name, kind = column.split(" ")
        out.add(name, KINDS[kind])
    return out


def _texts(*arguments: AnalyzeArgument) -> None:
    for a in arguments:
        if a.isTable or not isinstance(a.dataType, StringType) and a.dataType.simpleString() != "void":
            raise ValueError(f"code and languages are strings, not {a.dataType.simpleString()}")


def _language(x: str | None) -> str | None:
    return ALIASES.get((x or "").strip().lower())


class CodeStatements:
    """code_statements(code, language): number, type, block, depth, first and last line and text of each statement of code, parents first; nothing of code without text or in unknown languages."""

    @staticmethod
    def analyze(code: AnalyzeArgument, language: AnalyzeArgument) -> AnalyzeResult:
        _texts(code, language)
        return AnalyzeResult(_schema("n int, statement_type string, parent_block_type string, nesting_depth int, line_start int, line_end int, raw_text string"))

    def eval(self, code: str | None, language: str | None) -> Iterator[tuple]:
        name = _language(language)
        if name is None or not (code or "").strip():
            return
        side, n = C.Side(code, name), 0
        stack = [(node, 0) for node in reversed(sorted(side.roots, key=lambda x: x.start))]
        while stack:
            node, depth = stack.pop()
            n += 1
            yield n, node.kind, node.block, depth, side.line(node.start), side.line(node.end), code[node.start : node.end]
            stack += [(child, depth + 1) for child in reversed(sorted(node.children, key=lambda x: x.start))]


class _Pieces:
    split: Any = None

    @staticmethod
    def analyze(code: AnalyzeArgument, language: AnalyzeArgument) -> AnalyzeResult:
        _texts(code, language)
        return AnalyzeResult(_schema("n int, text string"))

    def eval(self, code: str | None, language: str | None) -> Iterator[tuple]:
        name = _language(language)
        if name is not None and (code or "").strip():
            yield from enumerate(pairs.splitter(type(self).granularity)(code, name), 1)


class CodePieces(_Pieces):
    """code_pieces(code, language): the top-level statements of code, as the pairs pipeline takes them."""

    granularity = "statement"


class CodeMethods(_Pieces):
    """code_methods(code, language): the methods of code."""

    granularity = "method"


class PairStatements:
    """pair_statements(vulnerable, fixed, language): statements of both versions of a method with the label of the vulnerable ones."""

    @staticmethod
    def analyze(vulnerable: AnalyzeArgument, fixed: AnalyzeArgument, language: AnalyzeArgument) -> AnalyzeResult:
        _texts(vulnerable, fixed, language)
        return AnalyzeResult(_schema(features.STATEMENT))

    def eval(self, vulnerable: str | None, fixed: str | None, language: str | None) -> Iterator[tuple]:
        name = _language(language)
        if name in features.languages() and (vulnerable or "").strip():
            yield from features.statements_of(vulnerable, fixed, name)


class LabelStatements:
    """label_statements(TABLE(t) PARTITION BY method ORDER BY place): t has side (vulnerable or fixed) and text. Each vulnerable text with label 1 if the fixed ones lack it, 0 if they have it, moved or not.

    What a partition holds are a method's statements.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        names = rows.dataType.names if rows.isTable else []
        if "side" not in names or "text" not in names:
            raise ValueError("the table needs columns side and text")
        if not {"method", "place"} <= set(names):
            raise ValueError("the table needs columns method, by which it is partitioned, and place, by which it is ordered")
        return AnalyzeResult(_schema("method string, n int, text string, label int"), partitionBy=[PartitioningColumn("method")], orderBy=[OrderingColumn("place")])

    def __init__(self):
        self.method, self.sides = None, {"vulnerable": [], "fixed": []}

    def eval(self, row: Any) -> None:
        self.method = row["method"]
        if row["side"] in self.sides and row["text"] is not None:
            self.sides[row["side"]].append(row["text"])

    def terminate(self) -> Iterator[tuple]:
        v, f = self.sides["vulnerable"], self.sides["fixed"]
        labels, new = [0] * len(v), {}
        codes = SequenceMatcher(None, v, f).get_opcodes()
        for tag, _, _, c, d in codes:
            if tag == "insert":
                for text in f[c:d]:
                    new[text] = new.get(text, 0) + 1
        for tag, a, b, _, _ in codes:
            for i in range(a, b) if tag in ("replace", "delete") else ():
                moved = tag == "delete" and new.get(v[i], 0) > 0
                if moved:
                    new[v[i]] -= 1
                labels[i] = 0 if moved else 1
        for n, (text, label) in enumerate(zip(v, labels), 1):
            yield str(self.method), n, text, label


FUNCTIONS = {"code_statements": CodeStatements, "code_pieces": CodePieces, "code_methods": CodeMethods, "pair_statements": PairStatements, "label_statements": LabelStatements}


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL by their names."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
