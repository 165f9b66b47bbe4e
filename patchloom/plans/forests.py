"""Queries of trees: Shapley values, cuts of boosting, extremely randomised trees."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from patchloom.operators import forests
from patchloom.operators import metrics as M
from patchloom.plans.base import S, query, r6, read, statements

# Two trees over parts: p_size <= 20 ? 0.2 : p_retailprice <= 970 ? 0.5 : 0.9 and p_retailprice <= 940 ? (p_size <= 10 ? 1 : 0.4) : 0.1
_V = {
    "v1s": "CASE WHEN s1 THEN 0.2 ELSE b1 END", "v1p": "l1 * 0.2 + (1 - l1) * CASE WHEN p1 THEN 0.5 ELSE 0.9 END", "v1": "CASE WHEN s1 THEN 0.2 WHEN p1 THEN 0.5 ELSE 0.9 END", "v10": "l1 * 0.2 + (1 - l1) * b1",
    "v2s": "l2 * CASE WHEN s2 THEN 1.0 ELSE 0.4 END + (1 - l2) * 0.1", "v2p": "CASE WHEN p2 THEN b2 ELSE 0.1 END", "v2": "CASE WHEN NOT p2 THEN 0.1 WHEN s2 THEN 1.0 ELSE 0.4 END", "v20": "l2 * b2 + (1 - l2) * 0.1",
}
_SHAP = f"""WITH t AS (SELECT p_partkey, p_size <= 20 AS s1, p_retailprice <= 970 AS p1, p_retailprice <= 940 AS p2, p_size <= 10 AS s2 FROM part),
  c AS (SELECT avg(CAST(s1 AS INT)) AS l1, avg(CASE WHEN NOT s1 THEN CASE WHEN p1 THEN 0.5 ELSE 0.9 END END) AS b1, avg(CAST(p2 AS INT)) AS l2, avg(CASE WHEN p2 THEN CASE WHEN s2 THEN 1.0 ELSE 0.4 END END) AS b2 FROM t),
  v AS (SELECT p_partkey, {", ".join(f"{sql} AS {name}" for name, sql in _V.items())} FROM t, c)
SELECT p_partkey AS sample_id, feature, round(value, 6) AS value FROM (SELECT p_partkey, unnest(['size', 'price']) AS feature,
  unnest([(v1s - v10 + v1 - v1p) / 4 + (v2s - v20 + v2 - v2p) / 4, (v1p - v10 + v1 - v1s) / 4 + (v2p - v20 + v2 - v2s) / 4]) AS value FROM v)"""


@query(_SHAP)
def shap_tree(spark, sf_dir):
    """Shapley values of the mean of two trees, whose covers are the table's own counts."""
    parts = read(spark, sf_dir, "part")
    features = array_to_vector(F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")))
    rows = parts.select(F.col("p_partkey").alias("sample_id"), features.alias("features"))
    size, price = F.col("p_size"), F.col("p_retailprice")
    nodes = [F.lit(True), size <= 20, size > 20, (size > 20) & (price <= 970), (size > 20) & (price > 970), price <= 940, price > 940, (price <= 940) & (size <= 10), (price <= 940) & (size > 10)]
    n = parts.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(nodes)]).first()
    first = forests.Tree(np.array([0, -1, 1, -1, -1]), np.array([20.0, 0, 970, 0, 0]), np.array([1, -1, 3, -1, -1]), np.array([2, -1, 4, -1, -1]), np.array([0, 0.1, 0, 0.25, 0.45]), np.array(n[:5], float))
    second = forests.Tree(np.array([1, 0, -1, -1, -1]), np.array([940.0, 10, 0, 0, 0]), np.array([1, 3, -1, -1, -1]), np.array([2, 4, -1, -1, -1]), np.array([0, 0, 0.05, 0.5, 0.2]), np.array([n[0], *n[5:]], float))
    return forests.shapley(rows, forests.Forest([first, second], 2), ["size", "price"]).select("sample_id", "feature", r6(F.col("value")).alias("value"))


NAMES = ["quantity", "tax", "discount"]


def labelled(spark, sf_dir):
    """Statements with features and label."""
    rows = statements(spark, sf_dir)
    values = F.array(F.col("quantity").cast("double"), F.col("tax").cast("double"), F.col("y_score").cast("double"))
    return rows.select(F.concat_ws(":", "method_id", "line").alias("sample_id"), array_to_vector(values).alias("features"), F.col("y_true").cast("double").alias("label"))


@query(f"""WITH {S}, u AS (SELECT unnest([0, 1, 2]) AS f, unnest([quantity, tax, y_score]) AS x, y_true AS y FROM s), p AS (SELECT avg(y_true) AS p, count(*) AS n FROM s),
  b AS (SELECT f, x, sum(p - y) AS g, sum(p * (1 - p)) AS h, count(*) AS n FROM u, p GROUP BY f, x),
  w AS (SELECT f, x, lead(x) OVER k AS nx, sum(g) OVER k AS gl, sum(h) OVER k AS hl, sum(n) OVER k AS nl, sum(g) OVER o AS gt, sum(h) OVER o AS ht, sum(n) OVER o AS nt FROM b WINDOW k AS (PARTITION BY f ORDER BY x), o AS (PARTITION BY f)),
  e AS (SELECT *, gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) - gt * gt / ht AS gain FROM w WHERE nl >= 20 AND nt - nl >= 20 AND nx IS NOT NULL)
SELECT CASE f WHEN 0 THEN 'quantity' WHEN 1 THEN 'tax' ELSE 'discount' END AS feature, round((x + nx) / 2, 6) AS threshold, round(-0.1 * gl / hl, 6) AS value_left, round(-0.1 * (gt - gl) / (ht - hl), 6) AS value_right
FROM e ORDER BY gain DESC, f, x LIMIT 1""")
def boosting_first_cut(spark, sf_dir):
    """The only cut of boosting with one tree of two leaves."""
    (tree,) = forests.HistBoosting(maxIter=1, maxLeaves=2, earlyStopping=False).fit(labelled(spark, sf_dir)).trees
    f, t, left, right = int(tree.feature[0]), float(tree.threshold[0]), *(float(tree.value[i]) for i in (tree.left[0], tree.right[0]))
    return spark.createDataFrame([(NAMES[f], round(t, 6), round(left, 6), round(right, 6))], "feature string, threshold double, value_left double, value_right double")


@query()
def boosting_scores(spark, sf_dir):
    """Scores of boosting over histograms; leaves of the greatest gain grow first."""
    rows = labelled(spark, sf_dir)
    return forests.HistBoosting(maxIter=5, maxLeaves=8, earlyStopping=False).fit(rows).scored(rows).select("sample_id", r6(F.col("y_score")).alias("y_score"))


@query()
def extra_trees_metrics(spark, sf_dir):
    """Ranking metrics of extremely randomised trees on the rows that they were grown from."""
    rows = labelled(spark, sf_dir)
    scored = forests.ExtraTrees(numTrees=8, maxDepth=5).fit(rows).scored(rows)
    return M.metrics(scored.select(F.lit("extra_trees").alias("model"), F.col("label").cast("int").alias("y_true"), "y_score"), ["model"])
