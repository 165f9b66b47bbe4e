"""Classifiers by name and their scores."""

from __future__ import annotations

import importlib
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml import classification as ml
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.operators import metrics as M
from patchloom.operators.forests import ExtraTrees, HistBoosting
from patchloom.sources.tables import stored


class AdaBoost:
    """Boosted stumps (discrete SAMME of two classes): each round's stump is fitted with rows weighed by the misses so far.

    A stump is a comparison of one feature, so weights and scores are expressions over features and
    no round's rows are stored.
    """

    def __init__(self, rounds: int = 50, learning_rate: float = 1.0, seed: int = 42):
        self.rounds, self.rate, self.seed = rounds, learning_rate, seed

    def fit(self, train: DataFrame) -> Boosted:
        rows = train.select("features", "label", vector_to_array("features").alias("_x")).persist()
        stumps: list[tuple[float, int, float, float, float]] = []
        weight = F.lit(1.0)
        for _ in range(self.rounds):
            tree = ml.DecisionTreeClassifier(maxDepth=1, weightCol="weight", seed=self.seed).fit(rows.withColumn("weight", weight))
            root = tree._call_java("rootNode")
            if root.subtreeDepth() == 0:
                break
            split = root.split()
            stump = (split.featureIndex(), split.threshold(), root.leftChild().prediction(), root.rightChild().prediction())
            missed = (_says(stump) != F.col("label")).cast("double")
            err, total = rows.agg(F.sum(weight * missed), F.sum(weight)).first()
            err /= total
            if err >= 0.5:
                break
            alpha = self.rate * math.log((1 - err) / max(err, 1e-10))
            stumps.append((alpha, *stump))
            if err <= 1e-10:
                break
            # in proportion, so that weights stay near 1 however many rounds there are
            weight = weight * F.exp(missed * alpha) * F.lit(1 / (1 - err + err * math.exp(alpha)))
        rows.unpersist()
        return Boosted(stumps, len(train.select("features").first()[0]))


def _says(stump: tuple[int, float, float, float]) -> Column:
    at, threshold, left, right = stump
    return F.when(F.get("_x", F.lit(at)) <= threshold, left).otherwise(right)


@dataclass
class Boosted:
    """stumps: (weight, feature, threshold, what it says up to it, and beyond)."""

    stumps: list[tuple[float, int, float, float, float]]
    width: int

    def scored(self, df: DataFrame) -> DataFrame:
        total = sum(alpha for alpha, *_ in self.stumps) or 1.0
        margin = F.lit(0.0)
        for alpha, *stump in self.stumps:
            margin = margin + F.lit(alpha / total) * (2 * _says(tuple(stump)) - 1)
        return df.withColumn("_x", vector_to_array("features")).withColumn("y_score", M.squash(margin)).drop("_x")

    def importances(self) -> list[float]:
        out = np.zeros(self.width)
        for alpha, at, *_ in self.stumps:
            out[at] += alpha
        return (out / (out.sum() or 1.0)).tolist()


class KernelSvm:
    """An RBF support vector machine on random Fourier features: a linear one over components cosines approximates the kernel's."""

    def __init__(self, components: int = 512, gamma: float | None = None, regParam: float = 0.01, maxIter: int = 200, seed: int = 42):
        self.components, self.gamma, self.seed = components, gamma, seed
        self.linear = ml.LinearSVC(featuresCol="cosines", regParam=regParam, maxIter=maxIter)

    def fit(self, train: DataFrame) -> Kernel:
        spread = train.select(F.posexplode(vector_to_array("features"))).agg(F.var_pop("col"), F.max("pos")).first()
        width = spread[1] + 1
        gamma = self.gamma or 1 / (width * (spread[0] or 1.0))
        made = np.random.default_rng(self.seed)
        kernel = Kernel(made.normal(0, math.sqrt(2 * gamma), (width, self.components)), made.uniform(0, 2 * math.pi, self.components))
        linear = self.linear.setWeightCol("weight") if "weight" in train.columns else self.linear
        kernel.linear = linear.fit(kernel.cosines(train))
        return kernel


class Kernel:
    def __init__(self, directions: np.ndarray, phases: np.ndarray):
        self.directions, self.phases, self.linear = directions, phases, None

    def cosines(self, df: DataFrame) -> DataFrame:
        directions, phases = self.directions, self.phases

        @F.pandas_udf("array<double>")
        def of(x: pd.Series) -> pd.Series:
            return pd.Series(list(math.sqrt(2 / len(phases)) * np.cos(np.stack(x.to_numpy()) @ directions + phases))) if len(x) else pd.Series([], dtype=object)

        return df.withColumn("cosines", array_to_vector(of(vector_to_array("features"))))

    def scored(self, df: DataFrame) -> DataFrame:
        out = self.linear.transform(self.cosines(df))
        return out.withColumn("y_score", M.squash(F.element_at(vector_to_array("rawPrediction"), 2))).select(*df.columns, "y_score")


class Nearest:
    """The mean label of the k nearest rows, exact, without all pairs: training rows stand around pivots, and a scored row meets the rows of its nearest pivot first.

    The distance of the k-th of these tells, by the triangle inequality, around which further pivots
    there may be nearer ones. Rows around a pivot, and those that ask for them, are dealt out in blocks.
    """

    #: Rows of a block of scored and of training rows; pivots at most.
    ASKED, KNOWN, PIVOTS = 8192, 8192, 256
    #: What rounding may add to a distance.
    EPS = 1e-6

    def __init__(self, k: int = 5):
        self.k = k

    def fit(self, train: DataFrame) -> Nearest:
        rows = train.select("label", vector_to_array("features").alias("x"))
        n = rows.count()
        picked = rows.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(max(1, min(self.PIVOTS, round(math.sqrt(n))))).collect()
        self.pivots = np.array([r["x"] for r in picked], float)
        at = F.col("_near")
        self.train = stored(rows.withColumn("_near", self._near(F.col("x"))).select("label", "x", at["p"].alias("p"), at["d"].alias("d")))
        self.around = {r["p"]: (r["n"], r["far"]) for r in self.train.groupBy("p").agg(F.count("*").alias("n"), F.max("d").alias("far")).collect()}  # a row a pivot
        return self

    def _near(self, x: Column) -> Column:
        """The nearest pivot and how far it is."""
        pivots = self.pivots

        @F.pandas_udf("p int, d double")
        def of(x: pd.Series) -> pd.DataFrame:
            d = _apart(np.stack(x.to_numpy()), pivots) if len(x) else np.zeros((0, len(pivots)))
            return pd.DataFrame({"p": d.argmin(1).astype(np.int32) if len(x) else [], "d": np.sqrt(d.min(1)) if len(x) else []})

        return of(x)

    def _meet(self, asked: DataFrame) -> DataFrame:
        """(_id, d, label, n) of the k nearest of each block of training rows around p, for asked (_id, x, p)."""
        k = self.k
        blocks = F.create_map(*[F.lit(v) for p, (n, _) in sorted(self.around.items()) for v in (p, -(-n // self.KNOWN))])
        counts = {r["p"]: r["n"] for r in asked.groupBy("p").agg(F.count("*").alias("n")).collect()}  # a row a pivot
        if not counts:
            return asked.select("_id", F.lit(0.0).alias("d"), F.lit(0.0).alias("label"), F.lit(0).cast("long").alias("n"))
        groups = F.create_map(*[F.lit(v) for p, n in sorted(counts.items()) for v in (p, -(-n // self.ASKED))])
        digest = F.xxhash64("x")
        mine = asked.withColumns({"_a": F.pmod("_id", groups[F.col("p")]), "_k": F.explode(F.sequence(F.lit(0), blocks[F.col("p")] - 1))})
        theirs = self.train.where(F.col("p").isin(*counts)).withColumns({"_n": digest, "_k": F.pmod(F.xxhash64(digest, "label", F.lit(7)), blocks[F.col("p")]), "_a": F.explode(F.sequence(F.lit(0), groups[F.col("p")] - 1))})

        def near(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            if not len(mine) or not len(theirs):
                return pd.DataFrame({"_id": [], "d": [], "label": [], "n": []})
            theirs = theirs.sort_values(["label", "_n"])
            b, out = np.stack(theirs["x"].to_numpy()), []
            for at in range(0, len(mine), 512):
                part = mine.iloc[at : at + 512]
                apart = _apart(np.stack(part["x"].to_numpy()), b).round(9)
                first = np.argsort(apart, axis=1, kind="stable")[:, :k]
                own = np.repeat(part["_id"].to_numpy(), first.shape[1])
                out.append(pd.DataFrame({"_id": own, "d": np.take_along_axis(apart, first, 1).ravel(), "label": theirs["label"].to_numpy(dtype=float)[first].ravel(), "n": theirs["_n"].to_numpy()[first].ravel()}))
            return pd.concat(out)

        keys = ("p", "_k", "_a")
        return mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(near, "_id long, d double, label double, n long")

    def scored(self, df: DataFrame) -> DataFrame:
        """df with y_score; of rows at equal distance those of smaller label and digest come first."""
        k, eps, pivots, around = self.k, self.EPS, self.pivots, self.around
        # the same features are asked for once
        asked = df.select(vector_to_array("features").alias("x")).withColumn("_id", F.xxhash64("x")).dropDuplicates(["_id"])
        asked = stored(asked.withColumn("p", self._near(F.col("x"))["p"]))
        first = stored(self._meet(asked))
        # the k-th distance so far, if there are k
        within = first.groupBy("_id").agg(F.sort_array(F.collect_list("d")).alias("ds")).select("_id", F.sqrt(F.try_element_at("ds", F.lit(k))).alias("within"))

        @F.pandas_udf("array<int>")
        def others(x: pd.Series, p: pd.Series, within: pd.Series) -> pd.Series:
            at = np.array(sorted(around))
            far = np.array([around[i][1] for i in at])
            out = []
            for i in range(0, len(x), 512):
                d = np.sqrt(_apart(np.stack(x.iloc[i : i + 512].to_numpy()), pivots[at]))
                bound = within.iloc[i : i + 512].fillna(np.inf).to_numpy()[:, None]
                ask = (d - far <= bound + eps) & (at != p.iloc[i : i + 512].to_numpy()[:, None])
                out += [at[row].tolist() for row in ask]
            return pd.Series(out, dtype=object)

        further = asked.join(within, "_id", "left").select("_id", "x", F.explode(others("x", "p", "within")).alias("p"))
        found = first.union(self._meet(stored(further)))
        best = F.slice(F.array_sort(F.collect_list(F.struct("d", "label", "n"))), 1, k)
        mean = F.aggregate(best, F.lit(0.0), lambda s, r: s + r["label"]) / F.size(best)
        scores = found.groupBy("_id").agg(mean.alias("y_score"))
        keyed = df.withColumn("_id", F.xxhash64(vector_to_array("features")))
        return keyed.join(scores, "_id").select(*df.columns, "y_score")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two small blocks."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


# Aliases, the class behind each, its default parameters, whether features are scaled first, whether classes are weighed alike.
MODELS: dict[str, tuple[str, dict[str, Any], bool, bool]] = {
    "random_forest": ("RandomForestClassifier", {"numTrees": 300, "maxDepth": 30}, False, True),
    "extra_trees": ("ExtraTrees", {"numTrees": 300, "maxDepth": 30}, False, True),
    "decision_tree": ("DecisionTreeClassifier", {"maxDepth": 30}, False, True),
    "gradient_boosting": ("GBTClassifier", {"maxIter": 100, "maxDepth": 3}, False, False),
    "hist_gradient_boosting": ("HistBoosting", {"maxIter": 100, "maxLeaves": 31}, False, True),
    "adaboost": ("AdaBoost", {"rounds": 50}, False, False),
    "logistic_regression": ("LogisticRegression", {"maxIter": 5000}, True, True),
    "svm": ("KernelSvm", {}, True, True),
    "linear_svm": ("LinearSVC", {"maxIter": 10000}, True, True),
    "knn": ("Nearest", {"k": 5}, True, False),
    "naive_bayes": ("NaiveBayes", {"modelType": "gaussian"}, False, False),
    "mlp": ("MultilayerPerceptronClassifier", {"maxIter": 2000}, True, False),
}
#: Aliases that need packages Spark doesn't bring.
OUTSIDE = {"xgboost": "xgboost", "lightgbm": "lightgbm"}
OWN = {c.__name__: c for c in (AdaBoost, ExtraTrees, HistBoosting, KernelSvm, Nearest)}


@dataclass(frozen=True)
class Spec:
    label: str
    estimator: Any
    scale: bool
    balance: bool = True


def spec(raw: str | dict[str, Any], seed: int = 42) -> Spec:
    """A model from an alias, or from name or class (a dotted path), params, label, scale, balance."""
    given = {"name": raw} if isinstance(raw, str) else dict(raw)
    if path := given.get("class"):
        module, _, name = path.rpartition(".")
        kind, defaults, scale, balance = getattr(importlib.import_module(module), name), {}, False, False
    else:
        alias = str(given.get("name", "")).strip().lower()
        if alias in OUTSIDE:
            raise ImportError(f"{alias} needs the package {OUTSIDE[alias]}, which isn't installed")
        if alias not in MODELS:
            raise ValueError(f"unknown model {alias!r}; known: {', '.join(sorted(MODELS))}")
        name, defaults, scale, balance = MODELS[alias]
        kind = OWN.get(name) or getattr(ml, name)
    params = {k: v for k, v in (defaults | given.get("params", {})).items() if v is not None}
    made = kind(**params)
    if isinstance(made, Estimator) and made.hasParam("seed") and "seed" not in params:
        made = made.setSeed(seed)
    return Spec(given.get("label") or given.get("name") or name, made, given.get("scale", scale), given.get("balance", balance))


def specs(raw: list[str | dict[str, Any]], seed: int = 42) -> list[Spec]:
    """Models with unique labels: a repeated label gets _2, _3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for one in raw:
        s = spec(one, seed)
        seen[s.label] = seen.get(s.label, 0) + 1
        out.append(s if seen[s.label] == 1 else Spec(f"{s.label}_{seen[s.label]}", s.estimator, s.scale, s.balance))
    return out


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """df with weight: rows of both classes count the same in total."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two classes
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, sum(counts.values()) / (len(counts) * n)).otherwise(weight)
    return df.withColumn("weight", weight)


@dataclass
class Scaler:
    """Mean and population deviation of each feature."""

    mean: np.ndarray
    std: np.ndarray

    @classmethod
    def of(cls, train: DataFrame) -> Scaler:
        found = train.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("s")).select("s.mean", "s.variance", "s.count").first()
        n = found["count"]
        return cls(found["mean"].toArray(), np.sqrt(found["variance"].toArray() * (n - 1) / max(n, 1)))


@dataclass
class Fitted:
    """A model and the scaling before it; mean and spread of the features, if they were scaled."""

    scaler: Any
    model: Any
    seconds: float

    def scaled(self, df: DataFrame) -> DataFrame:
        if self.scaler is None:
            return df
        others = [c for c in df.columns if c != "features"]
        mean, spread = (F.array(*[F.lit(float(v)) for v in values]) for values in (self.scaler.mean, self.scaler.std))
        scaled = F.transform(vector_to_array("features"), lambda v, i: F.when(F.get(spread, i) > 0, (v - F.get(mean, i)) / F.get(spread, i)).otherwise(0.0))
        return df.select(*others, array_to_vector(scaled).alias("features"))


def fit(s: Spec, train: DataFrame, width: int | None = None) -> Fitted:
    """A model of features and label, and weight, if there is one and the model is to weigh classes alike."""
    train = train if s.balance else train.drop("weight")
    scaler = Scaler.of(train) if s.scale else None
    out = Fitted(scaler, None, 0.0)
    rows, estimator = out.scaled(train), s.estimator
    if isinstance(estimator, Estimator):
        estimator = estimator.copy()
        if estimator.hasParam("layers") and width:
            estimator = estimator.setLayers([width, 100, 2])
        if estimator.hasParam("weightCol") and "weight" in rows.columns:
            estimator = estimator.setWeightCol("weight")
    began = time.perf_counter()
    out.model = estimator.fit(rows)
    out.seconds = round(time.perf_counter() - began, 3)
    return out


def score(fitted: Fitted, df: DataFrame) -> DataFrame:
    """df with y_score: the probability of class 1, or its squashed margin."""
    columns = [c for c in df.columns if c != "features"]
    rows = fitted.scaled(df)
    if hasattr(fitted.model, "scored"):
        return fitted.model.scored(rows).select(*columns, "y_score")
    out = fitted.model.transform(rows)
    if "probability" in out.columns:
        made = F.element_at(vector_to_array("probability"), 2)
    else:
        made = M.squash(F.element_at(vector_to_array("rawPrediction"), 2))
    return out.withColumn("y_score", made).select(*columns, "y_score")


def native_importance(fitted: Fitted, names: list[str]) -> list[tuple[str, float]] | None:
    """(feature, importance): trees' importances or sizes of coefficients; None if the model has neither."""
    own = getattr(fitted.model, "importances", None)
    if own is not None:
        return list(zip(names, own()))
    values = getattr(fitted.model, "featureImportances", None)
    if values is None:
        values = getattr(fitted.model, "coefficients", None)
    return None if values is None else [(n, abs(float(v))) for n, v in zip(names, values.toArray())]


def linear_parts(fitted: Fitted, train: DataFrame) -> tuple[list[float], list[float], float] | None:
    """(weight, mean) of each unscaled feature and the margin at the means, of a linear model; None for others."""
    coefficients = getattr(fitted.model, "coefficients", None)
    if coefficients is None:
        return None
    weights, intercept = coefficients.toArray(), float(fitted.model.intercept)
    if fitted.scaler is not None:
        mean, spread = fitted.scaler.mean, fitted.scaler.std
        return [float(w / s) if s else 0.0 for w, s in zip(weights, spread)], mean.tolist(), intercept
    per = train.select(F.posexplode(vector_to_array("features"))).groupBy("pos").agg(F.avg("col").alias("m")).collect()  # a row a feature
    means = [m for _, m in sorted((r["pos"], r["m"]) for r in per)]
    return weights.tolist(), means, intercept + float(np.dot(weights, means))


def contributions(df: DataFrame, weights: list[float], means: list[float], names: list[str]) -> DataFrame:
    """(sample_id, feature, value, x) for each feature that isn't at its mean or has no weight: weight * (x - mean), the exact Shapley value of a linear model of independent features."""
    x = df.select("sample_id", vector_to_array("features").alias("_x"))
    parts = [F.array(*[F.lit(v) for v in values]) for values in (weights, means, names)]
    made = F.transform("_x", lambda v, i: F.struct(F.get(parts[2], i).alias("feature"), (F.get(parts[0], i) * (v - F.get(parts[1], i))).alias("value"), v.alias("x")))
    return x.select("sample_id", F.inline(made))


def permutation_importance(fitted: Fitted, test: DataFrame, names: list[str], candidates: list[str], places, metric: str = "pr_auc", repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, permutation_mean, permutation_std): how much the metric drops when one feature of test is dealt out anew.

    test has sample_id (unique), y_true and features; places(ids, seed) numbers ids from 1 in an
    order of its own for each seed. Rows of one order get a feature of the rows of another, so no
    task gets all rows. All dealt copies are scored in one job.
    """
    base = test.select("sample_id", "y_true", vector_to_array("features").alias("_x")).persist()
    ids = base.select(F.col("sample_id").alias("group_id"))
    here = base.join(places(ids, seed).withColumnRenamed("group_id", "sample_id"), "sample_id")
    at = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(names.index(n)).alias("j")) for n in candidates])

    def dealt(r: int) -> DataFrame:
        other = base.join(places(ids, f"{seed}|{r}").withColumnRenamed("group_id", "sample_id"), "sample_id").select("place", F.col("_x").alias("_d"))
        return here.join(other, "place").select("sample_id", "y_true", "_x", "_d", F.lit(r).alias("repeat"))

    copies: Iterator[DataFrame] = (dealt(r) for r in range(repeats))
    every = next(copies)
    for more in copies:
        every = every.unionByName(more)
    every = every.select("sample_id", "y_true", "_x", "_d", "repeat", F.inline(at))
    changed = array_to_vector(F.transform("_x", lambda v, i: F.when(i == F.col("j"), F.get("_d", i)).otherwise(v)))
    rows = every.select("sample_id", "y_true", "feature", "repeat", changed.alias("features"))
    rows = rows.unionByName(base.select("sample_id", "y_true", F.lit("").alias("feature"), F.lit(0).alias("repeat"), array_to_vector("_x").alias("features")))
    per = M.metrics(score(fitted, rows), ["feature", "repeat"]).select("feature", "repeat", F.col(metric).alias("m")).persist()
    before = per.where("feature = ''").first()["m"]
    drops = per.where("feature <> ''").withColumn("d", F.lit(before).cast("double") - F.col("m"))
    out = drops.groupBy("feature").agg(F.avg("d").alias("permutation_mean"), F.stddev_pop("d").alias("permutation_std"))
    base.unpersist()
    return out
