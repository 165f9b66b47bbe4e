"""From code pairs to labelled methods and statements, and leakage-safe folds."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.sources.tables import stored

SIDE_LABEL = {"vulnerable": 1, "fixed": 0, "unchanged": 0}
# Columns that tell where a statement comes from or restate its label.
LEAKY = (
    "cve_id", "vulnerability_type", "commit_hash", "repo", "origin", "statement_id", "parent_statement_id", "repo_name", "file_path", "function_name", "line_start", "line_end", "label",
)


def sides(pairs: DataFrame) -> DataFrame:
    """A row for each side of a pair that has code: unchanged once, else vulnerable and fixed, with side and code."""
    v, f = F.col("vulnerable_code"), F.col("fixed_code")
    none = F.array().cast("array<struct<side:string,code:string>>")

    def side(name: str, code) -> F.Column:
        return F.when(T.has_code(code), F.array(F.struct(F.lit(name).alias("side"), code.alias("code")))).otherwise(none)

    both = F.when(T.unchanged(v, f), side("unchanged", v)).when(T.has_code(v), F.concat(side("vulnerable", v), side("fixed", f))).otherwise(none)
    return pairs.withColumn("_side", F.explode(both)).select(*pairs.columns, "_side.side", "_side.code")


def group_key(by: str) -> F.Column:
    """The key that must not stand on both sides of a split: the method, the row or the advisory."""
    if by == "method":
        return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("repo", "file", "method")])
    return {"row": F.col("row_index").cast("string"), "cve": F.coalesce(F.col("cve_id"), F.lit(""))}[by]


def raw_methods(pairs: DataFrame, by: str = "method") -> DataFrame:
    """A labelled method for each side: group_id, side, method_id, code, label."""
    label = F.create_map(*[F.lit(x) for pair in SIDE_LABEL.items() for x in pair])
    return sides(pairs).withColumns({
        "group_id": group_key(by), "method_id": F.concat_ws(":", F.col("row_index").cast("string"), "side"), "label": label[F.col("side")],
    })


def align(methods: DataFrame, statements: DataFrame) -> DataFrame:
    """Methods that have statements."""
    return methods.join(statements.select("method_id").distinct(), "method_id", "left_semi")


def orphans(statements: DataFrame, methods: DataFrame, key: str = "row_index") -> DataFrame:
    """Statements whose pair isn't there."""
    return statements.join(methods.select(key).distinct(), key, "left_anti")


def lineage_mismatches(statements: DataFrame, pairs: DataFrame, key: str = "row_index", value: str = "cve_id") -> int:
    """How many statements have another value than the pair they are said to come from; nulls count as empty."""
    own = pairs.select(key, F.coalesce(F.col(value).cast("string"), F.lit("")).alias("_theirs"))
    return statements.join(own, key).where(F.coalesce(F.col(value).cast("string"), F.lit("")) != F.col("_theirs")).count()


def strata(statements: DataFrame) -> DataFrame:
    """group_id and stratum: 1 if any of its statements is positive."""
    return statements.groupBy("group_id").agg(F.max("label").alias("stratum"))


def places(ids: DataFrame, seed: int | str) -> DataFrame:
    """group_id and its place, from 1, in order of a digest of group_id and seed; inside each stratum, if ids has that column."""
    if "stratum" in ids.columns:
        return _dealt(ids, seed, True).select("group_id", "stratum", "place")
    return _dealt(ids.withColumn("stratum", F.lit(0)), seed, False).select("group_id", "place")


def _dealt(groups: DataFrame, seed: int | str, stratified: bool) -> DataFrame:
    """groups with place and size in their stratum, in order of a digest of group and seed.

    Groups are one row each. The place is exact: rows are ranked inside buckets of the digest's
    first digits, and buckets are counted, so no task gets all groups.
    """
    keys = ["stratum"] if stratified else []
    g = groups.withColumn("_h", F.md5(F.concat(F.col("group_id").cast("string"), F.lit(f"|{seed}")))).withColumn("_b", F.substring("_h", 1, 3))
    counts = g.groupBy(*keys, "_b").count()
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    counts = counts.select(*keys, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"), F.sum("count").over(whole).alias("size"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", "group_id")
    return g.join(counts, [*keys, "_b"]).withColumn("place", F.col("_before") + F.row_number().over(inside)).select("group_id", "stratum", "place", "size")


def min_stratum(groups: DataFrame) -> DataFrame:
    return groups.agg(F.least(F.count_if(F.col("stratum") == 0), F.count_if(F.col("stratum") == 1)).alias("min_stratum"))


def holdout(groups: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """group_id, fold 0 and is_test; stratified if both strata have two groups or more."""
    stratified = (min_stratum(groups).first()[0] or 0) >= 2
    dealt = _dealt(groups, seed, stratified)
    return dealt.select("group_id", F.lit(0).alias("fold"), (F.col("place") <= F.ceil(F.lit(test_size) * F.col("size"))).alias("is_test"))


def kfold(groups: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """group_id and the fold that tests it; stratified if the smaller stratum has k groups or more."""
    stratified = (min_stratum(groups).first()[0] or 0) >= k
    return _dealt(groups, seed, stratified).select("group_id", ((F.col("place") - 1) % k).cast("int").alias("fold"))


def feature_columns(wanted: list[str]) -> list[str]:
    """wanted less the leaky ones, of which a warning tells."""
    if left_out := [c for c in wanted if c in LEAKY]:
        warnings.warn(f"left out, since they tell the label: {left_out}", stacklevel=2)
    return [c for c in wanted if c not in LEAKY]


def check_columns(df: DataFrame, wanted: list[str]) -> None:
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"missing feature columns: {missing}")


def category(c: str) -> F.Column:
    """column=category of a row; null counts as none."""
    return F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("none")))


def one_hot(df: DataFrame, id_column: str, columns: list[str], train: DataFrame | None = None) -> DataFrame:
    """(id, feature, value) with feature column=category for the categories seen in train; others give no row."""
    def long(x: DataFrame) -> DataFrame:
        pairs = F.array(*[category(c) for c in columns])
        return x.select(id_column, F.explode(pairs).alias("feature"))

    rows = long(df)
    if train is not None:
        rows = rows.join(long(train).select("feature").distinct(), "feature", "left_semi")
    return rows.select(id_column, "feature", F.lit(1.0).alias("value"))


def numbered(terms: DataFrame, column: str) -> DataFrame:
    """(column, i) of distinct terms, i from 0 in their order. Terms are sorted by ranges and counted by range, so no task gets all."""
    ranged = stored(terms.select(column).repartitionByRange(column).sortWithinPartitions(column).withColumn("_at", F.monotonically_increasing_id()))
    per = ranged.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row a range
    joined = ranged.join(F.broadcast(starts), F.shiftright("_at", 33) == F.col("_part"))
    return joined.select(column, (F.col("_before") + F.col("_at") - F.col("_first")).cast("int").alias("i"))


def standard_scale(df: DataFrame, columns: list[str], train: DataFrame | None = None) -> DataFrame:
    """df with columns less their mean in train, over their population deviation; constant columns become 0."""
    fitted = (df if train is None else train).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.crossJoin(F.broadcast(fitted))  # one row
    return joined.select(
        *[c for c in df.columns if c not in columns],
        *[F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0))), F.lit(0.0)).alias(c) for c in columns],
    )


def runs(tokens: F.Column, most: int = 2) -> F.Column:
    """array<string>: the tokens and runs of up to most of them, joined by a space."""
    def of(n: int) -> F.Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1)))
        return F.when(F.size(tokens) >= n, F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(1, most + 1)])


def ngrams(df: DataFrame, id_column: str, text: str, most: int = 2) -> DataFrame:
    """(id, term, tf) of the code tokens and runs of up to most of them, joined by a space."""
    tokens = df.select(id_column, T.code_tokens(F.col(text)).alias("t")).where(F.size("t") > 0)
    return tokens.select(id_column, F.explode(runs(F.col("t"), most)).alias("term")).groupBy(id_column, "term").agg(F.count("*").alias("tf"))


def term_counts(df: DataFrame, text: str, most: int = 2) -> DataFrame:
    """(term, tf, df) of ngrams() where each row is a document: added up on the map side, so only a row a term and task is shuffled."""
    # a column each, so that lambdas don't work out tokens anew
    terms = df.select(T.code_tokens(F.col(text)).alias("t")).where(F.size("t") > 0).select(runs(F.col("t"), most).alias("t"))
    every = F.transform("t", lambda x: F.struct(x.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df")))
    distinct = F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")))
    return terms.select(F.inline(F.concat(every, distinct))).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def most_frequent(per: DataFrame, size: int | None = None, min_df: int = 1) -> DataFrame:
    """The size most frequent of (term, tf, df), ties by name."""
    per = per.where(F.col("df") >= min_df)
    return per if size is None else per.orderBy(F.desc("tf"), "term").limit(size)


def vocabulary(counts: DataFrame, id_column: str, size: int | None = None, min_df: int = 1) -> DataFrame:
    """(term, tf, df): the size most frequent terms, ties by name."""
    return most_frequent(counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")), size, min_df)


def tfidf(counts: DataFrame, terms: DataFrame, n_docs: int, id_column: str) -> DataFrame:
    """(id, term, weight): sublinear tf, smooth idf, rows of unit length."""
    idf = F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + 1
    joined = counts.join(terms.select("term", "df"), "term").withColumn("w", (F.lit(1.0) + F.log("tf")) * idf)
    norm = joined.groupBy(id_column).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return joined.join(norm, id_column).select(id_column, "term", (F.col("w") / F.col("norm")).alias("weight"))


def parse_test_size(value: str) -> float:
    """20, 20% and 0.2 all mean a fifth."""
    n = float(str(value).strip().rstrip("%"))
    return n / 100 if n >= 1 else n

