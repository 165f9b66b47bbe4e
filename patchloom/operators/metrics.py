"""Scores to decisions and metrics: rollup of statements to methods, exact ranking metrics, summaries.

Every function takes and returns DataFrames. Metrics are computed for each combination of keys.
Undefined metrics are null, so averages skip them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "mcc", "roc_auc", "pr_auc")
KEY_METRICS = ("f1", "mcc", "pr_auc", "recall", "roc_auc")
#: Scores of one bucket are ranked in one task; buckets are as wide as one over this.
SCORE_BUCKETS = 1024


def predict(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """df with y_pred: 1 where y_score reaches the threshold."""
    return df.withColumn("y_pred", (F.col("y_score") >= F.lit(threshold)).cast("int"))


def squash(margin: Column) -> Column:
    """A margin as a score between 0 and 1."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def rollup(statements: DataFrame, how: str = "max") -> DataFrame:
    """One row a method: y_score as the greatest or mean statement score, with label, group and number of statements.

    Label and group are constant within a method, so max() takes them with map-side combining.
    """
    score = {"max": F.max, "mean": F.avg}[how]("y_score")
    return statements.groupBy("method_id").agg(
        score.alias("y_score"), F.max("method_label").alias("y_true"), F.max("group_id").alias("group_id"), F.count("*").alias("n_statements")
    )


def confusion(df: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn by keys."""
    said, true = F.col("y_score") >= F.lit(threshold), F.col("y_true") == 1
    return df.groupBy(*keys).agg(
        F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & ~true).alias("tn"), F.count_if(~said & true).alias("fn")
    )


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def threshold_metrics(counts: DataFrame) -> DataFrame:
    """accuracy to mcc from tp, fp, tn, fn; a zero denominator gives 0, one class in the truth gives null for balanced_accuracy and mcc."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    both = ((tp + fn) > 0) & ((tn + fp) > 0)
    of_mcc = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    out = counts.withColumns({
        "accuracy": _share(tp + tn, tp + fp + tn + fn),
        "balanced_accuracy": F.when(both, (_share(tp, tp + fn) + _share(tn, tn + fp)) / 2),
        "precision": _share(tp, tp + fp),
        "recall": _share(tp, tp + fn),
        "mcc": F.when(both, _share(tp.cast("double") * tn - fp.cast("double") * fn, of_mcc)),
    })
    return out.withColumn("f1", _share(2 * tp, 2 * tp + fp + fn))


def _by_score(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each distinct score with pos, neg, and above_pos, above_neg: how many stand at greater scores.

    Running sums go in two steps, over buckets of scores and inside each bucket, so no task gets
    all scores of a key.
    """
    per = df.groupBy(*keys, "y_score").agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg"))
    per = per.withColumn("_b", F.floor(F.col("y_score") * SCORE_BUCKETS))
    buckets = per.groupBy(*keys, "_b").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*keys, "_b", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    inside = Window.partitionBy(*keys, "_b").orderBy(F.desc("y_score")).rowsBetween(Window.unboundedPreceding, -1)
    return per.join(buckets, [*keys, "_b"]).select(
        *keys, "y_score", "pos", "neg",
        (F.col("_p") + F.coalesce(F.sum("pos").over(inside), F.lit(0))).alias("above_pos"),
        (F.col("_n") + F.coalesce(F.sum("neg").over(inside), F.lit(0))).alias("above_neg"),
    )


def ranking_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """roc_auc (ties count half) and pr_auc (average precision over distinct scores) by keys; null if the truth has one class."""
    wins = F.sum(F.col("neg") * (F.col("above_pos") + F.col("pos") / 2.0))
    pos, neg = F.sum("pos"), F.sum("neg")
    hits = F.col("above_pos") + F.col("pos")
    steps = F.sum(F.col("pos") * (hits / (hits + F.col("above_neg") + F.col("neg"))))
    both = (pos > 0) & (neg > 0)
    return _by_score(df, keys).groupBy(*keys).agg(
        F.when(both, F.try_divide(wins, pos.cast("double") * neg)).alias("roc_auc"), F.when(both, F.try_divide(steps, pos)).alias("pr_auc")
    )


def metrics(df: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """All metrics and counts by keys."""
    counted = threshold_metrics(confusion(df, keys, threshold))
    out = counted.join(ranking_metrics(df, keys), keys)
    return out.withColumns({"n_test": F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"), "n_test_pos": F.col("tp") + F.col("fn")})


def summary(per_fold: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Mean and sample deviation over folds of each metric, and the number of folds."""
    made = [f(name).alias(title) for name in names for f, title in ((F.avg, name), (F.stddev_samp, f"{name} (std)"))]
    return per_fold.groupBy(*keys).agg(*made, F.countDistinct("fold").alias("n_folds"))


def long_metrics(per_fold: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    return per_fold.unpivot(ids, list(names), "metric", "value")


def comparison(long: DataFrame, titles: list[str], delta: tuple[str, str]) -> DataFrame:
    """A row for each model and metric, a column of fold means for each title (column approach), and the difference of two of them."""
    wide = long.groupBy("model", "metric").pivot("approach", titles).agg(F.avg("value"))
    return wide.withColumn("delta", F.col(delta[1]) - F.col(delta[0]))


def ranked(df: DataFrame, basis: str, keys: list[str], name: str = "feature") -> DataFrame:
    """df with rank by descending basis within keys, nulls last, ties by name."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(basis), name)))


def importance_mean(importance: DataFrame, columns: list[str]) -> DataFrame:
    return importance.groupBy("approach", "model", "feature").agg(*[F.avg(c).alias(c) for c in columns])


#: What importance is ranked by: the first of these that has any value.
BASES = ("shap_mean_abs", "permutation_mean", "native_importance")


def ranked_by_basis(importance: DataFrame, keys: list[str]) -> DataFrame:
    """importance with importance_basis, and rank by it within keys."""
    joined = importance.join(F.broadcast(basis_of(importance, keys, list(BASES))), keys)  # a row a model
    by = F.coalesce(*[F.when(F.col("importance_basis") == b, F.col(b)) for b in BASES])
    return ranked(joined.withColumn("_by", by), "_by", keys).drop("_by")


def basis_of(importance: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """importance_basis by keys: the first of columns that has any value."""
    counts = importance.groupBy(*keys).agg(*[F.count(c).alias(c) for c in columns])
    pick = reduce(lambda rest, c: F.when(F.col(c) > 0, F.lit(c)).otherwise(rest), reversed(columns), F.lit(None).cast("string"))
    return counts.select(*keys, pick.alias("importance_basis"))


def correlation(value: str, other: str) -> Column:
    """Pearson correlation as an aggregate; null where either is constant."""
    return F.try_divide(F.covar_pop(value, other), F.nullif(F.stddev_pop(value) * F.stddev_pop(other), F.lit(0.0)))


def top_samples(df: DataFrame, n: int) -> DataFrame:
    """The n rows of greatest y_score, ties by sample_id: a top-k, no global sort."""
    return df.orderBy(F.desc("y_score"), "sample_id").limit(n)


# Where a contribution moves a score, up and down.
DIRECTIONS = ("-> vulnerable", "-> aman")


def top_contributions(contributions: DataFrame, k: int) -> DataFrame:
    """Each sample's k greatest contributions by size, zeros left out, with their direction.

    Of opposite values of one feature, which samples that repeat may have, the positive one stands first.
    """
    order = Window.partitionBy("sample_id").orderBy(F.desc(F.abs("value")), "feature", F.desc("value"))
    out = contributions.where("value <> 0").withColumn("contribution_rank", F.row_number().over(order)).where(F.col("contribution_rank") <= k)
    return out.withColumn("direction", F.when(F.col("value") > 0, DIRECTIONS[0]).otherwise(DIRECTIONS[1]))


def explain_sample(df: DataFrame, n_top: int, most: int, seed: int = 42) -> DataFrame:
    """sample_id and sample_rank of the n_top rows of greatest y_score, and without a rank of as many others, in order of a digest, as make up most.

    Rows equal in y_score and sample_id stand in the order of their other columns; sample_id is
    unique in what classify explains.
    """
    top = df.orderBy(F.desc("y_score"), "sample_id").limit(n_top)
    top = top.withColumn("sample_rank", F.row_number().over(Window.orderBy(F.desc("y_score"), "sample_id")))  # n_top rows
    rest = df.join(F.broadcast(top.select("sample_id").distinct()), "sample_id", "left_anti")  # n_top rows
    digest = F.md5(F.concat("sample_id", F.lit(f"|{seed}")))
    rest = rest.orderBy(digest, "sample_id", "y_score").limit(max(0, most - n_top)).withColumn("sample_rank", F.lit(None).cast("int"))
    return top.unionByName(rest)
