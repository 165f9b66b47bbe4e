"""Queries: rollup, decisions, metrics, ranks and report tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.operators import datasets as D
from patchloom.operators import metrics as M
from patchloom.operators import models
from patchloom.plans.base import S, query, r6, read, statements

KEYS = ["approach", "model"]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).withColumnRenamed("y_true", "method_label")


def _rollup(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    out = M.rollup(_labelled(spark, sf_dir), how)
    return out.select("method_id", r6(F.col("y_score")).alias("y_score"), "y_true", "group_id", "n_statements")


def _rollup_sql(how: str) -> str:
    return f"WITH {S} SELECT method_id, round({how}(y_score), 6) AS y_score, max(y_true) AS y_true, max(group_id) AS group_id, count(*) AS n_statements FROM s GROUP BY method_id"


@query(_rollup_sql("max"))
def rollup_max(spark, sf_dir):
    return _rollup(spark, sf_dir, "max")


@query(_rollup_sql("avg"))
def rollup_mean(spark, sf_dir):
    return _rollup(spark, sf_dir, "mean")


@query(f"WITH {S} SELECT method_id, line, y_score, CASE WHEN y_score >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM s")
def threshold_predict(spark, sf_dir):
    return M.predict(statements(spark, sf_dir)).select("method_id", "line", "y_score", "y_pred")


C = """c AS (SELECT approach, model, count_if(y_score >= 0.5 AND y_true = 1) AS tp, count_if(y_score >= 0.5 AND y_true = 0) AS fp,
  count_if(y_score < 0.5 AND y_true = 0) AS tn, count_if(y_score < 0.5 AND y_true = 1) AS fn FROM s GROUP BY ALL)"""
_counts = "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn"


@query(f"WITH {S}, {C} SELECT approach, model, {_counts} FROM c")
def confusion_counts(spark, sf_dir):
    return M.confusion(statements(spark, sf_dir), KEYS)


@query(f"""WITH {S}, {C} SELECT approach, model, round((tp + tn) * 1.0 / nullif(tp + fp + tn + fn, 0), 6) AS accuracy,
  round((tp * 1.0 / nullif(tp + fn, 0) + tn * 1.0 / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy, round(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0), 6) AS "precision",
  round(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def threshold_metrics(spark, sf_dir):
    out = M.threshold_metrics(M.confusion(statements(spark, sf_dir), KEYS))
    return out.select(*KEYS, *[r6(F.col(c)).alias(c) for c in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")])


@query(f"""WITH {S}, {C} SELECT approach, model, round(coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) /
  nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM c""")
def mcc(spark, sf_dir):
    return M.threshold_metrics(M.confusion(statements(spark, sf_dir), KEYS)).select(*KEYS, r6(F.col("mcc")).alias("mcc"))


@query(f"""WITH {S}, r AS (SELECT *, rank() OVER (PARTITION BY approach, model ORDER BY y_score) + (count(*) OVER (PARTITION BY approach, model, y_score) - 1) / 2.0 AS rk FROM s),
  g AS (SELECT approach, model, sum(CASE WHEN y_true = 1 THEN rk END) AS sr, sum(y_true) AS p, count(*) - sum(y_true) AS n FROM r GROUP BY ALL)
  SELECT approach, model, round((sr - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n), 6) AS roc_auc FROM g""")
def roc_auc(spark, sf_dir):
    return M.ranking_metrics(statements(spark, sf_dir), KEYS).select(*KEYS, r6(F.col("roc_auc")).alias("roc_auc"))


@query(f"""WITH {S}, d AS (SELECT approach, model, y_score, sum(y_true) AS pos, count(*) AS n FROM s GROUP BY ALL),
  c AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY approach, model) AS p FROM d WINDOW w AS (PARTITION BY approach, model ORDER BY y_score DESC))
  SELECT approach, model, round(sum(pos * (CAST(cp AS DOUBLE) / cn)) / max(p), 6) AS pr_auc FROM c GROUP BY ALL""")
def average_precision(spark, sf_dir):
    return M.ranking_metrics(statements(spark, sf_dir), KEYS).select(*KEYS, r6(F.col("pr_auc")).alias("pr_auc"))


#: Per fold: mean score and precision at one half.
P = f"""{S}, p AS (SELECT fold, approach, model, avg(y_score) AS f1, avg(CASE WHEN y_true = 1 THEN y_score ELSE 1 - y_score END) AS recall FROM s GROUP BY ALL)"""


def per_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = F.when(F.col("y_true") == 1, F.col("y_score")).otherwise(1 - F.col("y_score"))
    return statements(spark, sf_dir).groupBy("fold", *KEYS).agg(F.avg("y_score").alias("f1"), F.avg(right).alias("recall"))


@query(f"""WITH {P} SELECT approach, model, round(avg(f1), 6) AS f1, round(stddev_samp(f1), 6) AS "f1 (std)", round(avg(recall), 6) AS recall, round(stddev_samp(recall), 6) AS "recall (std)",
  count(DISTINCT fold) AS n_folds FROM p GROUP BY ALL""")
def metric_summary(spark, sf_dir):
    out = M.summary(per_fold(spark, sf_dir), KEYS, ["f1", "recall"])
    return out.select(*KEYS, *[r6(F.col(c)).alias(c) for c in ("f1", "f1 (std)", "recall", "recall (std)")], "n_folds")


TITLES = ["1-URGENT", "2-HIGH"]


@query(f"""WITH {P}, l AS (SELECT model, approach, 'f1' AS metric, f1 AS value FROM p UNION ALL SELECT model, approach, 'recall', recall FROM p)
  SELECT model, metric, round(avg(CASE WHEN approach = '1-URGENT' THEN value END), 6) AS first, round(avg(CASE WHEN approach = '2-HIGH' THEN value END), 6) AS second,
  round(avg(CASE WHEN approach = '2-HIGH' THEN value END) - avg(CASE WHEN approach = '1-URGENT' THEN value END), 6) AS delta FROM l GROUP BY ALL""")
def comparison_pivot(spark, sf_dir):
    long = M.long_metrics(per_fold(spark, sf_dir), ["fold", *KEYS], ["f1", "recall"])
    out = M.comparison(long, TITLES, (TITLES[0], TITLES[1]))
    return out.select("model", "metric", *[r6(F.col(f"`{a}`")).alias(b) for a, b in zip([*TITLES, "delta"], ["first", "second", "delta"])])


@query(f"WITH {P} SELECT approach, model, fold, round(f1, 6) AS f1, round(recall, 6) AS recall FROM p")
def key_metrics_projection(spark, sf_dir):
    shown = per_fold(spark, sf_dir).withColumn("f1 (std)", F.lit(0.0)).withColumn("seconds", F.lit(1.0))
    kept = [c for c in shown.columns if not c.endswith("(std)") and (c in ("approach", "model", "fold") or c in M.KEY_METRICS)]
    return shown.select(*kept).withColumns({c: r6(F.col(c)) for c in kept if c in M.KEY_METRICS})


#: Importance of four features by approach and model.
FEATURES = ("quantity", "price", "tax", "y_score")
I = f"""{S}, i AS (SELECT approach, model, fold, feature, avg(value) AS native, sum(CASE WHEN feature <> 'tax' THEN value END) / 1000 AS shap, CAST(NULL AS DOUBLE) AS permutation
  FROM (SELECT approach, model, fold, unnest(['quantity', 'price', 'tax', 'y_score']) AS feature, unnest([quantity, price, tax, y_score]) AS value FROM s) GROUP BY ALL)"""


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = statements(spark, sf_dir).unpivot(["approach", "model", "fold", "method_id"], list(FEATURES), "feature", "value")
    return long.groupBy("approach", "model", "fold", "feature").agg(
        F.avg("value").alias("native"), (F.sum(F.when(F.col("feature") != "tax", F.col("value"))) / 1000).alias("shap"), F.lit(None).cast("double").alias("permutation")
    )


@query(f"WITH {I} SELECT approach, model, feature, round(avg(native), 6) AS native, round(avg(shap), 4) AS shap FROM i GROUP BY ALL")
def importance_mean(spark, sf_dir):
    return M.importance_mean(importance(spark, sf_dir), ["native", "shap"]).withColumns({"native": r6(F.col("native")), "shap": F.round("shap", 4)})


@query(f"""WITH {I}, m AS (SELECT approach, model, feature, avg(shap) AS shap FROM i GROUP BY ALL)
  SELECT approach, model, feature, round(shap, 4) AS shap, CAST(row_number() OVER (PARTITION BY approach, model ORDER BY shap DESC NULLS LAST, feature) AS INTEGER) AS rank FROM m""")
def importance_mean_rank(spark, sf_dir):
    out = M.ranked(M.importance_mean(importance(spark, sf_dir), ["shap"]), "shap", KEYS)
    return out.withColumn("shap", F.round("shap", 4))


@query(f"""WITH {I} SELECT feature, fold, approach, model, CAST(row_number() OVER (PARTITION BY approach, model, fold ORDER BY native DESC NULLS LAST, feature) AS INTEGER) AS rank FROM i""")
def importance_rank(spark, sf_dir):
    return M.ranked(importance(spark, sf_dir), "native", [*KEYS, "fold"]).select("feature", "fold", *KEYS, "rank")


@query(f"""WITH {I} SELECT approach, model, CASE WHEN count(shap) > 0 THEN 'shap' WHEN count(permutation) > 0 THEN 'permutation' WHEN count(native) > 0 THEN 'native' END AS importance_basis FROM i GROUP BY ALL""")
def importance_basis_pick(spark, sf_dir):
    return M.basis_of(importance(spark, sf_dir), KEYS, ["shap", "permutation", "native"])


@query(f"""WITH {I}, m AS (SELECT approach, model, feature, avg(shap) AS shap FROM i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY approach, model ORDER BY shap DESC, feature) AS rank FROM m WHERE shap IS NOT NULL)
  SELECT approach, model, feature, round(shap, 4) AS shap, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""")
def plot_source_topk(spark, sf_dir):
    mean = M.importance_mean(importance(spark, sf_dir), ["shap"]).where("shap is not null")
    return M.ranked(mean, "shap", KEYS).where("rank <= 2").withColumn("shap", F.round("shap", 4)).select("approach", "model", "feature", "shap", "rank")


@query(f"""WITH {S} SELECT approach, model, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS n_pos, count(DISTINCT group_id) AS n_groups FROM s GROUP BY ALL""")
def dataset_info(spark, sf_dir):
    return statements(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("y_true").cast("long").alias("n_pos"), F.count_distinct("group_id").alias("n_groups"))


#: Contributions: centred features.
V = f"""{S}, a AS (SELECT avg(quantity) AS q, avg(tax) AS t, avg(y_score) AS y FROM s),
  v AS (SELECT method_id || ':' || line AS sample_id, feature, value, x FROM (SELECT method_id, line, unnest(['quantity', 'tax', 'y_score']) AS feature,
  unnest([round((quantity - q) * 0.1, 4), round((tax - t) * 2, 4), round((y_score - y) * -1.5, 4)]) AS value, unnest([quantity, tax, y_score]) AS x FROM s, a))"""
WEIGHTS = {"quantity": 0.1, "tax": 2.0, "y_score": -1.5}


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weight * (value - mean) of each feature of each statement: exact for a linear model of independent features."""
    rows = statements(spark, sf_dir).withColumn("sample_id", F.concat_ws(":", F.col("method_id").cast("string"), F.col("line").cast("string")))
    means = rows.agg(*[F.avg(c) for c in WEIGHTS]).first()
    vectors = rows.select("sample_id", array_to_vector(F.array(*[F.col(c).cast("double") for c in WEIGHTS])).alias("features"))
    made = models.contributions(vectors, list(WEIGHTS.values()), list(means), list(WEIGHTS))
    return made.withColumn("value", F.round("value", 4))


@query(f"WITH {V} SELECT sample_id, feature, value FROM v")
def linear_contrib(spark, sf_dir):
    return contributions(spark, sf_dir).drop("x")


@query(f"WITH {V} SELECT feature, round(avg(abs(value)), 5) AS mean_abs, round(avg(value), 5) + 0.0 AS mean FROM v GROUP BY 1")
def contrib_mean_abs(spark, sf_dir):
    return contributions(spark, sf_dir).groupBy("feature").agg(F.round(F.avg(F.abs("value")), 5).alias("mean_abs"), (F.round(F.avg("value"), 5) + F.lit(0.0)).alias("mean"))


@query(f"WITH {V} SELECT feature, round(corr(value, x), 5) AS corr FROM v GROUP BY 1")
def feature_corr(spark, sf_dir):
    return contributions(spark, sf_dir).groupBy("feature").agg(F.round(M.correlation("value", "x"), 5).alias("corr"))


@query(f"""WITH {V}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY abs(value) DESC, feature) AS k FROM v WHERE value <> 0)
  SELECT sample_id, feature, value, CAST(k AS INTEGER) AS contribution_rank, CASE WHEN value > 0 THEN '-> vulnerable' ELSE '-> aman' END AS direction FROM r WHERE k <= 2""")
def topk_contributions(spark, sf_dir):
    return M.top_contributions(contributions(spark, sf_dir).drop("x"), 2)


_SAMPLES = f"{S}, t AS (SELECT method_id || ':' || line AS sample_id, y_score FROM s)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select(F.concat_ws(":", F.col("method_id").cast("string"), F.col("line").cast("string")).alias("sample_id"), "y_score")


@query(f"WITH {_SAMPLES} SELECT * FROM t ORDER BY y_score DESC, sample_id LIMIT 25")
def topn_samples(spark, sf_dir):
    return M.top_samples(_samples(spark, sf_dir), 25)


@query(f"""WITH {_SAMPLES}, u AS (SELECT sample_id, max(y_score) AS y_score FROM t GROUP BY 1),
  top AS (SELECT *, CAST(row_number() OVER (ORDER BY y_score DESC, sample_id) AS INTEGER) AS sample_rank FROM u QUALIFY sample_rank <= 25),
  rest AS (SELECT *, CAST(NULL AS INTEGER) AS sample_rank FROM u WHERE sample_id NOT IN (SELECT sample_id FROM top) ORDER BY md5(sample_id || '|42'), sample_id LIMIT 75) SELECT * FROM top UNION ALL SELECT * FROM rest""")
def explain_sample_rest(spark, sf_dir):
    # an order may have a line number twice: the greater score stands for both
    every = _samples(spark, sf_dir).groupBy("sample_id").agg(F.max("y_score").alias("y_score"))
    return M.explain_sample(every, 25, 100)


@query(f"""WITH {S}, l AS (SELECT unnest(['quantity', 'price', 'tax', 'y_score']) AS feature, unnest([quantity, price, tax, y_score]) AS value FROM s)
  SELECT feature, round(var_pop(value) / 1000, 3) AS variance FROM l GROUP BY 1 ORDER BY var_pop(value) DESC, feature LIMIT 2""")
def variance_topk(spark, sf_dir):
    long = statements(spark, sf_dir).unpivot(["method_id"], list(FEATURES), "feature", "value")
    return long.groupBy("feature").agg(F.round(F.var_pop("value") / 1000, 3).alias("variance")).orderBy(F.desc("variance"), "feature").limit(2)


@query("SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS score FROM customer")
def logistic_squash(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", r6(M.squash(F.col("c_acctbal") / 1000)).alias("score"))


@query(f"""WITH {S}, u AS (SELECT method_id || ':' || line AS group_id, approach || '|' || model AS stratum, max(tax) AS tax FROM s GROUP BY ALL),
  a AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(group_id || '|42'), group_id) AS rn, row_number() OVER (PARTITION BY stratum ORDER BY md5(group_id || '|42|0'), group_id) AS rs FROM u)
  SELECT x.group_id, x.stratum, y.tax AS tax FROM a x JOIN a y ON x.stratum = y.stratum AND x.rn = y.rs""")
def permutation_shuffle(spark, sf_dir):
    """One column dealt out anew inside each model's test rows: what permutation importance scores again."""
    id_ = F.concat_ws(":", F.col("method_id").cast("string"), F.col("line").cast("string"))
    rows = statements(spark, sf_dir).groupBy(id_.alias("group_id"), F.concat_ws("|", *KEYS).alias("stratum")).agg(F.max("tax").alias("tax"))
    ids = rows.select("group_id", "stratum")
    here, there = D.places(ids, 42), D.places(ids, "42|0")
    other = rows.join(there, ["group_id", "stratum"]).select("stratum", "place", "tax")
    return here.join(other, ["stratum", "place"]).select("group_id", "stratum", "tax")
