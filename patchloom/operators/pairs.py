"""The pairs pipeline: code pairs to aligned pairs of statements or methods."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom import plugins
from patchloom.functions import code as C
from patchloom.functions import shapes
from patchloom.functions import text as T

PAIR = "array<struct<vulnerable_code:string,fixed_code:string>>"


def supported(pairs: DataFrame) -> DataFrame:
    return pairs.where(T.resolve_language(F.col("language")).isNotNull())


def rejects(pairs: DataFrame) -> DataFrame:
    """Rows that give nothing, with the reason."""
    unsupported, no_code = T.resolve_language(F.col("language")).isNull(), ~T.has_code(F.col("vulnerable_code"))
    return pairs.withColumn("reason", F.when(unsupported, "unsupported_language").when(no_code, "no_code")).where("reason is not null")


def safe_type(rows: DataFrame, side: str) -> DataFrame:
    """Fixed and unchanged code has no vulnerability type."""
    return rows.withColumn("vulnerability_type", F.when(F.col(side) == "vulnerable", T.or_empty(F.col("vulnerability_type"))).otherwise("none"))


def stats(rows: DataFrame) -> DataFrame:
    """One row of counters from status and n_pairs."""
    return rows.agg(
        F.count("*").alias("total_in"), F.coalesce(F.sum("n_pairs"), F.lit(0)).cast("long").alias("total_out"),
        F.count_if(F.col("status") == "no_vulnerable_code").alias("skipped_no_code"), F.count_if(F.col("status") == "mismatch").alias("skipped_mismatch"),
    )


def feature_stats(rows: DataFrame, side: str = "origin") -> DataFrame:
    of = lambda name: F.count_if(F.col(side) == name).alias(f"n_{name}")
    return rows.agg(F.count("*").alias("n_rows"), of("vulnerable"), of("fixed"), of("unchanged"), F.count_if(F.col("label") == 1).alias("n_positive"))


def moved_lines(turns: DataFrame) -> DataFrame:
    """Lines of the first turn that a later turn of the same conversation repeats, but for white space: equal text that moved."""
    lines = turns.select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line")).select("conv_id", "turn", T.normalize_ws(F.col("line")).alias("line"))
    later = lines.where("turn > 0").select("conv_id", "line").distinct()
    return lines.where("turn = 0 and line <> ''").select("conv_id", "line").distinct().join(later, ["conv_id", "line"], "left_semi")


def outermost(spans: DataFrame) -> DataFrame:
    """Spans (id, line, a, b) that no other span of the same id strictly contains.

    A running greatest end over spans by start, longest first: one sort for each id.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("id").orderBy("a", F.desc("b"), "line").rowsBetween(Window.unboundedPreceding, -1)
    # the first of equal spans stands for them
    return spans.withColumn("_reach", F.max("b").over(order)).where("_reach is null or b > _reach").drop("_reach")


_methods = shapes.remembered(lambda language, code: C.methods(code, language), lambda text, put: put(text))
_statements = shapes.remembered(lambda language, code: C.statements(code, language), lambda text, put: put(text))


@lru_cache(shapes.SHAPES)
def _method_shape(language: str, code: str) -> list[str]:
    return list(C.methods(code, language))


@lru_cache(shapes.SHAPES)
def _statement_shape(language: str, code: str) -> list[str]:
    return list(C.statements(code, language))


def methods(code: str, language: str) -> list[str]:
    """C.methods(), by shapes."""
    return _methods(language, code)


def statements(code: str, language: str) -> list[str]:
    """C.statements(), by shapes."""
    return _statements(language, code)


def splitter(granularity: str) -> Callable[[str, str], list[str]]:
    """What splits code of a language into statements or methods, those of plug-ins among them."""
    known, added = methods if granularity == "method" else statements, dict(plugins.LANGUAGES)

    def split(code: str, language: str) -> list[str]:
        own = added.get(language)
        if own is None:
            return known(code, language)
        return (own.methods if granularity == "method" else own.statements)(code)

    return split


def split_code(code: F.Column, language: F.Column, granularity: str) -> F.Column:
    """array<string>: the statements or methods of a snippet."""
    split = splitter(granularity)
    added = dict(plugins.LANGUAGES)
    known = _method_shape if granularity == "method" else _statement_shape

    @F.arrow_udf("array<string>")
    def pieces(codes: pa.Array, languages: pa.Array) -> pa.Array:
        rows = [(x, c) if c and c.strip() and x else ("", "") for c, x in zip(codes.to_pylist(), languages.to_pylist())]
        # what a plug-in says may depend on numbers
        found = shapes.Rows(rows, known, lambda x, c: split(c, x) if x else [], {"", *added})
        made = pa.array(found.results, pa.list_(pa.string())).take(pa.array(found.at))
        cells = [[(i, cut) for i, text in enumerate(own) if (cut := shapes.parts(text))] for own in found.results]
        offsets = np.concatenate([[0], np.cumsum(made.value_lengths().to_numpy())]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), found.put_back(made.flatten(), [len(x) for x in found.results], cells))

    return pieces(code, language)


def align(v: list[str], f: list[str]) -> list[tuple[str, str]]:
    """Snippets of two versions side by side: equal and equally long replaced runs one to one, other replaced runs as one pair, the rest alone."""
    out = []
    for tag, a, b, c, d in SequenceMatcher(None, v, f).get_opcodes():
        if tag == "equal" or tag == "replace" and b - a == d - c:
            out += zip(v[a:b], f[c:d])
        elif tag == "replace":
            out.append(("\n\n".join(v[a:b]), "\n\n".join(f[c:d])))
        else:
            out += [(x, "") for x in v[a:b]] + [("", x) for x in f[c:d]]
    return out


def pair_aligned(v: F.Column, f: F.Column) -> tuple[F.Column, F.Column]:
    """(status, pairs) by a diff of the two arrays of snippets."""

    @F.pandas_udf(PAIR)
    def pairs_of(vs: pd.Series, fs: pd.Series) -> pd.Series:
        return pd.Series([[{"vulnerable_code": a, "fixed_code": b} for a, b in align(list(x), list(y))] if x is not None and len(x) else [] for x, y in zip(vs, fs)])

    return F.when(F.size(v) == 0, "no_vulnerable_code").otherwise("success"), pairs_of(v, f)


def pair_by(v: F.Column, f: F.Column, strategy: str) -> tuple[F.Column, F.Column]:
    """(status, pairs) by a strategy's name: strict, aligned or one of a plug-in."""
    if strategy in ("strict", "aligned"):
        return (T.pair_strict if strategy == "strict" else pair_aligned)(v, f)
    if strategy not in plugins.STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(['aligned', 'strict', *sorted(plugins.STRATEGIES)])}")
    own = plugins.STRATEGIES[strategy]

    @F.pandas_udf(PAIR)
    def pairs_of(vs: pd.Series, fs: pd.Series) -> pd.Series:
        made = [own(list(x), list(y)) if x is not None and len(x) else [] for x, y in zip(vs, fs)]
        return pd.Series([None if m is None else [{"vulnerable_code": a, "fixed_code": b} for a, b in m] for m in made], dtype=object)

    made = pairs_of(v, f)
    return F.when(F.size(v) == 0, "no_vulnerable_code").when(made.isNull(), "mismatch").otherwise("success"), F.coalesce(made, F.array().cast(PAIR))


def pair(pairs: DataFrame, granularity: str = "statement", strategy: str = "aligned") -> tuple[DataFrame, DataFrame]:
    """(one row for each aligned pair, counters).

    All input columns stay; vulnerable_code and fixed_code become the pair's, granularity is added
    or replaced. Rows of unsupported languages give nothing.
    """
    known = pairs.withColumn("_language", T.resolve_language(F.col("language")))
    rows = known.where("_language is not null")
    rows = rows.withColumns({f"_{side}": split_code(F.col(f"{side}_code"), F.col("_language"), granularity) for side in ("vulnerable", "fixed")})
    status, made = pair_by(F.col("_vulnerable"), F.col("_fixed"), strategy)
    paired = rows.withColumns({"status": status, "_pairs": made})
    counted = stats(paired.select("status", F.size("_pairs").cast("long").alias("n_pairs")))
    counted = counted.crossJoin(known.agg(F.count_if(F.col("_language").isNull()).alias("skipped_unsupported")))  # one row each
    out = paired.withColumn("_pair", F.explode("_pairs"))
    columns = [c for c in pairs.columns if c not in ("vulnerable_code", "fixed_code", "granularity")]
    return out.select(*columns, "_pair.vulnerable_code", "_pair.fixed_code", F.lit(granularity).alias("granularity")), counted
