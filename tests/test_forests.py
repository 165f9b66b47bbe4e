"""Shapley values of trees by brute force, extremely randomised trees, boosting over histograms."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import classification as ml
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from patchloom.operators import classify, forests, models


def random_tree(r, width, depth):
    g = forests.Grown()
    g.nodes[0][5] = 100.0

    def grow(n, d):
        cover = g.nodes[n][5]
        if d == 0 or r.random() < 0.15:
            g.nodes[n][4] = r.normal()
            return
        left, right = g.split(n, int(r.integers(width)), float(r.random()))
        share = r.uniform(0.1, 0.9)
        g.nodes[left][5], g.nodes[right][5] = cover * share, cover * (1 - share)
        grow(left, d - 1)
        grow(right, d - 1)

    grow(0, depth)
    return g.tree()


def worth(tree, x, known, n=0):
    f = tree.feature[n]
    if f < 0:
        return tree.value[n]
    left, right = tree.left[n], tree.right[n]
    if f in known:
        return worth(tree, x, known, left if x[f] <= tree.threshold[n] else right)
    return (tree.cover[left] * worth(tree, x, known, left) + tree.cover[right] * worth(tree, x, known, right)) / tree.cover[n]


def all_coalitions(trees, x, width):
    out = []
    for i in range(width):
        rest, total = [j for j in range(width) if j != i], 0.0
        for k in range(width):
            for own in itertools.combinations(rest, k):
                total += math.factorial(k) * math.factorial(width - k - 1) / math.factorial(width) * sum(worth(t, x, {*own, i}) - worth(t, x, set(own)) for t in trees)
        out.append(total)
    return np.array(out)


def test_shapley_values_against_all_coalitions():
    r = np.random.default_rng(1)
    for _ in range(40):
        tree, x = random_tree(r, 6, int(r.integers(0, 8))), r.random(6)
        found = forests.shapley_of(forests.paths(tree), x, 6)
        assert np.allclose(found, all_coalitions([tree], x, 6), atol=1e-12)
        assert np.isclose(found.sum() + forests.paths(tree).expected(), tree.value[tree.leaf_of(x[None])[0]])


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    x = r.random((400, 4)).round(3)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + r.normal(0, 0.2, 400) > 0.8).astype(float)
    data = [(i, [float(v) for v in row], float(label), 1.0 + i % 3) for i, (row, label) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "sample_id long, x array<double>, label double, weight double").withColumn("features", array_to_vector("x")).drop("x").persist()


@pytest.mark.parametrize(
    "make",
    [
        lambda: ml.DecisionTreeClassifier(maxDepth=4, weightCol="weight"), lambda: ml.RandomForestClassifier(numTrees=20, maxDepth=4, seed=1), lambda: ml.GBTClassifier(maxIter=5, maxDepth=3, seed=1),
        lambda: forests.HistBoosting(maxIter=4, maxLeaves=6), lambda: forests.ExtraTrees(numTrees=20, maxDepth=4),
    ],
    ids=["decision_tree", "random_forest", "gradient_boosting", "hist_gradient_boosting", "extra_trees"],
)
def test_shapley_values_add_up_to_scores(spark, rows, make):
    fitted = models.Fitted(None, make().fit(rows), 0.0)
    forest = forests.of_model(spark, fitted.model)
    names = [f"f{i}" for i in range(4)]
    parts = forests.shapley(rows.select("sample_id", "features"), forest, names)
    assert parts.count() == 1600
    total = parts.groupBy("sample_id").agg(F.sum("value").alias("s"))
    scores = models.score(fitted, rows.select("sample_id", "features")).join(total, "sample_id").collect()
    base = forests.base_value(forest)
    for r in scores:
        margin = base + r["s"]
        assert math.isclose(r["y_score"], margin if forest.link is None else 1 / (1 + math.exp(-margin)), abs_tol=1e-9)
    x = np.array(rows.where("sample_id = 7").first()["features"].toArray())
    mine = {r["feature"]: r["value"] for r in parts.where("sample_id = 7").collect()}
    assert np.allclose([mine[n] for n in names], all_coalitions(forest.trees, x, 4), atol=1e-9)


def test_models_without_trees_have_no_forest(spark, rows):
    assert forests.of_model(spark, ml.LogisticRegression().fit(rows)) is None


def auc(rows, model):
    scored = model.scored(rows).select("label", "y_score").toPandas()
    a, b = scored[scored.label == 1].y_score.to_numpy(), scored[scored.label == 0].y_score.to_numpy()
    return (a[:, None] > b).mean() + (a[:, None] == b).mean() / 2


def test_extra_trees(spark, rows):
    one, again, other = (forests.ExtraTrees(numTrees=10, maxDepth=6, seed=s).fit(rows) for s in (1, 1, 2))
    cuts = [[(int(f), float(t)) for tree in m.trees for f, t in zip(tree.feature, tree.threshold) if f >= 0] for m in (one, again, other)]
    assert cuts[0] == cuts[1] and not set(cuts[0]) & set(cuts[2])
    assert math.isclose(sum(one.importances()), 1) and np.argmax(one.importances()) == 0
    assert auc(rows, one) > 0.9
    values = {float(t) for _, t in cuts[0]}
    assert len(values) > 50  # anywhere between values, not at them or midway
    # a cut leaves rows on both sides, and classes add up
    for tree in one.trees:
        for i in np.flatnonzero(tree.feature >= 0):
            assert tree.cover[tree.left[i]] > 0 and tree.cover[tree.right[i]] > 0
            assert math.isclose(tree.cover[tree.left[i]] + tree.cover[tree.right[i]], tree.cover[i])


def test_extra_trees_grow_until_pure(spark):
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in range(16)], "v double, label double").select(array_to_vector(F.array("v", F.lit(1.0))).alias("features"), "label")
    model = forests.ExtraTrees(numTrees=3).fit(df)
    assert auc(df, model) == 1.0 and model.importances()[1] == 0
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0)], "v double, label double").select(array_to_vector(F.array("v")).alias("features"), "label")
    assert [len(t.feature) for t in forests.ExtraTrees(numTrees=2).fit(same).trees] == [1, 1]
    groups = forests.ExtraTrees(numTrees=3)
    groups.CELLS = 2  # a node a pass
    assert [t.threshold.tolist() for t in groups.fit(df).trees] == [t.threshold.tolist() for t in model.trees]


def plain_leafwise(x, y, w, margin, leaves, least, rate):
    """One tree of boosting, grown leaf by leaf in memory, with a cut between any two values."""
    p = 1 / (1 + np.exp(-margin))
    g, h = w * (p - y), w * p * (1 - p)

    def cut(own):
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[own, f])
            for t in (values[:-1] + values[1:]) / 2:
                left = own[x[own, f] <= t]
                right = own[x[own, f] > t]
                if min(len(left), len(right)) < least:
                    continue
                gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - g[own].sum() ** 2 / h[own].sum()
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, t, left, right)
        return best

    found = [(np.arange(len(x)), cut(np.arange(len(x))))]
    while len(found) < leaves and any(c for _, c in found):
        i = max((i for i, (_, c) in enumerate(found) if c), key=lambda i: found[i][1][0])
        _, (_, _, _, left, right) = found.pop(i)
        found += [(left, cut(left)), (right, cut(right))]
    out = np.zeros(len(x))
    for own, _ in found:
        out[own] = -rate * g[own].sum() / h[own].sum()
    return out, len(found)


def test_boosting_grows_the_best_leaf_first(spark, rows):
    data = rows.orderBy("sample_id").toPandas()
    x, y, w = np.stack([v.toArray() for v in data.features]), data.label.to_numpy(), data.weight.to_numpy()
    model = forests.HistBoosting(maxIter=3, maxLeaves=9, minLeaf=5, maxBins=1000, earlyStopping=False).fit(rows)
    share = (w * y).sum() / w.sum()
    margin = np.full(len(x), math.log(share / (1 - share)))
    for tree in model.trees:
        step, n = plain_leafwise(x, y, w, margin, 9, 5, 0.1)
        assert n == 9 == len(np.unique(tree.leaf_of(x)))
        assert np.allclose(tree.value[tree.leaf_of(x)], step, atol=1e-9)
        margin = margin + step
    assert np.allclose(model.margins(x), margin)


def test_boosting_separates_stops_and_takes_few_bins(spark, rows):
    model = forests.HistBoosting(maxIter=12, maxLeaves=8, maxBins=16).fit(rows)
    assert auc(rows, model) > 0.94 and math.isclose(sum(model.importances()), 1)
    r = np.random.default_rng(2)
    noise = spark.createDataFrame([([float(v) for v in r.random(2)], float(r.random() < 0.5)) for _ in range(300)], "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    stopped = forests.HistBoosting(maxIter=30, maxLeaves=8, patience=2, earlyStopping=True).fit(noise)
    assert len(stopped.trees) < 30
    one = spark.createDataFrame([([1.0], 1.0), ([1.0], 0.0)], "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    assert forests.HistBoosting(maxIter=3).fit(one).trees == []


def test_explanations_of_a_forest(spark, rows):
    config = classify.Config(local=3, explained=20, permutation=False)
    train = rows.select("features", "label")
    fitted = models.fit(models.spec({"name": "random_forest", "params": {"numTrees": 5, "maxDepth": 3}}), train)
    test = rows.where("sample_id < 60").withColumn("y_true", F.col("label").cast("int")).select("sample_id", "y_true", "features")
    scored = test.join(models.score(fitted, test.select("sample_id", "features")), "sample_id")
    table, local, notes = classify.explain(fitted, train, scored, [f"f{i}" for i in range(4)], config)
    found = table.collect()
    assert all(r["shap_mean_abs"] is not None and r["native_importance"] is not None for r in found) and "probability" in notes[0]
    for rank in (1, 2, 3):
        own = local.where(F.col("sample_rank") == rank).collect()
        assert math.isclose(own[0]["base_value"] + sum(r["shap_value"] for r in own), own[0]["y_score"], abs_tol=1e-6)


def test_kernel_values_are_near_exact_ones(spark):
    """Eight features, all coalitions, and drawn ones, against the definition over the same background."""
    from patchloom.operators import kernel

    r = np.random.default_rng(8)
    train = spark.createDataFrame([([float(v) for v in r.random(8)],) for _ in range(20)], "x array<double>").select(array_to_vector("x").alias("features"))
    x = r.random(8)
    asked = spark.createDataFrame([(1, [float(v) for v in x])], "sample_id long, x array<double>").select("sample_id", array_to_vector("x").alias("features"))

    def plain(v):
        return 1 / (1 + np.exp(-(2 * v[..., 0] * v[..., 1] - v[..., 2] + v[..., 3] ** 2 - v[..., 7])))

    def score(df):
        from pyspark.ml.functions import vector_to_array

        v = vector_to_array("features")
        return df.withColumn("y_score", 1 / (1 + F.exp(-(2 * F.get(v, F.lit(0)) * F.get(v, F.lit(1)) - F.get(v, F.lit(2)) + F.get(v, F.lit(3)) ** 2 - F.get(v, F.lit(7))))))

    names = [f"f{i}" for i in range(8)]
    rows = np.array([row["features"].toArray() for row in train.collect()])

    def worth(known):
        return plain(np.where([i in known for i in range(8)], x, rows)).mean()

    exact = []
    for i in range(8):
        rest, total = [j for j in range(8) if j != i], 0.0
        for k in range(8):
            for own in itertools.combinations(rest, k):
                total += math.factorial(k) * math.factorial(7 - k) / math.factorial(8) * (worth({*own, i}) - worth(set(own)))
        exact.append(total)
    for most, near in ((None, 1e-9), (120, 0.01)):
        found, base = kernel.shapley(score, asked, train, names, most=most)
        got = {q["feature"]: q["value"] for q in found.collect()}
        assert math.isclose(base, worth(set()), abs_tol=1e-9)
        assert np.allclose([got[n] for n in names], exact, atol=near)
        assert math.isclose(sum(got.values()) + base, worth(set(range(8))), abs_tol=1e-9)


def test_kernel_values_in_explanations_are_off_by_default(spark, rows):
    train = rows.select("features", "label")
    fitted = models.fit(models.spec("naive_bayes"), train)
    test = rows.where("sample_id < 12").withColumn("y_true", F.col("label").cast("int")).select("sample_id", "y_true", "features")
    scored = test.join(models.score(fitted, test.select("sample_id", "features")), "sample_id")
    names = [f"f{i}" for i in range(4)]
    table, local, notes = classify.explain(fitted, train, scored, names, classify.Config(local=2, explained=4, permutation=False))
    assert local is None and "no Shapley values" in notes[0]
    table, local, notes = classify.explain(fitted, train, scored, names, classify.Config(local=2, explained=4, permutation=False, kernel=True))
    own = local.where("sample_rank = 1").collect()
    assert math.isclose(own[0]["base_value"] + sum(r["shap_value"] for r in own), own[0]["y_score"], abs_tol=1e-6) and "coalitions" in notes[0]


def test_bins_have_every_value_however_often_rows_repeat(spark):
    """Forty different rows, a thousand times each: a sample picked by their digest would miss most values."""
    df = spark.range(40_000).select(array_to_vector(F.array((F.col("id") % 40).cast("double"), (F.col("id") % 7).cast("double"))).alias("features"), (F.col("id") % 40 >= 23).cast("double").alias("label"))
    (tree,) = forests.HistBoosting(maxIter=1, maxLeaves=2, earlyStopping=False).fit(df).trees
    assert (tree.feature[0], tree.threshold[0]) == (0, 22.5)
    one = forests._rows_of(df).agg(F.count("*"), F.sum("n"), F.sum("w")).first()
    assert tuple(one) == (280, 40_000, 40_000.0)
    edges = forests.HistBoosting()._bins(forests._rows_of(df).persist())
    assert np.array_equal(edges[0], np.arange(39) + 0.5) and np.array_equal(edges[1], np.arange(6) + 0.5)


def test_bins_of_many_values_are_at_quantiles_of_all_rows(spark):
    rows = forests._rows_of(spark.range(30_000).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), F.lit(1.0).alias("label"))).persist()
    (edges,) = forests.HistBoosting(maxBins=10)._bins(rows)
    assert len(edges) == 9 and np.allclose(edges, 3000 * np.arange(1, 10), atol=10)
