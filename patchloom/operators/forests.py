"""Trees as tables of nodes: Shapley values of any ensemble, extremely randomised trees, leaf-wise boosting over histograms.

A model is what its driver holds, as with Spark's own trees: it travels to the tasks as arrays. Rows
stay where they are; each pass over them gives statistics of nodes that Spark sums up.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from patchloom.sources.tables import shared_dir

#: Rows that a task works on at once.
BLOCK = 1024


@dataclass
class Tree:
    """Nodes by number, the root first; a row goes left if its feature is at most the threshold. feature is -1 in leaves; cover is the weight of the training rows of a node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            goes_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)


@dataclass
class Forest:
    """Trees whose values add up to base and more: to a probability, or to a margin of which the score is the logistic function times link."""

    trees: list[Tree]
    width: int
    base: float = 0.0
    link: float | None = None  # None: values are probabilities
    gains: np.ndarray | None = field(default=None, repr=False)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.value[tree.leaf_of(x)]
        return out

    def scored(self, df: DataFrame) -> DataFrame:
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def of(x: pa.Array) -> pa.Array:
            return pa.array(np.concatenate([np.zeros(0), *(model.value.margins(_matrix(x.slice(i, BLOCK), model.value.width)) for i in range(0, len(x), BLOCK))]))

        margin = of(vector_to_array("features"))
        return df.withColumn("y_score", margin if self.link is None else 1 / (1 + F.exp(-self.link * margin)))

    def importances(self) -> list[float]:
        """Gain of each feature's splits, summed and scaled to 1."""
        gains = np.zeros(self.width) if self.gains is None else self.gains
        return (gains / (gains.sum() or 1.0)).tolist()


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"


def node_table(spark: SparkSession, model: Any) -> DataFrame:
    """(tree, id, feature, threshold, left, right, says, stats) of a fitted tree model of Spark's, by way of its saved form."""
    path = _folder(spark)
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "nodeData" in saved.columns:
        saved = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        saved = saved.withColumn("tree", F.lit(0))
    threshold = F.get("split.leftCategoriesOrThreshold", F.lit(0))
    return saved.select("tree", "id", F.col("split.featureIndex").alias("feature"), threshold.alias("threshold"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("prediction").alias("says"), F.col("impurityStats").alias("stats"))


def of_model(spark: SparkSession, model: Any) -> Forest | None:
    """The forest of a fitted model of trees, in the units that its score is made of; None for other kinds of models."""
    if isinstance(model, Forest):
        return model
    kind = type(model).__name__
    if kind not in ("DecisionTreeClassificationModel", "RandomForestClassificationModel", "GBTClassificationModel"):
        return None
    boosted = kind == "GBTClassificationModel"  # twice its margin is the log odds
    weights = [2 * w for w in model.treeWeights] if boosted else [1 / len(model.trees)] * len(model.trees) if hasattr(model, "trees") else [1.0]
    nodes = node_table(spark, model).orderBy("tree", "id").toPandas()  # a model is its driver's already
    trees = []
    for (_, own), weight in zip(nodes.groupby("tree", sort=True), weights, strict=True):
        stats = np.stack(own["stats"].to_numpy()).astype(float)
        cover = stats[:, 0] if boosted else stats.sum(1)
        value = own["says"].to_numpy(float) if boosted else stats[:, 1] / np.maximum(cover, 1e-300)
        inner = own["left"].to_numpy() >= 0
        trees.append(Tree(np.where(inner, own["feature"], -1).astype(np.int64), np.where(inner, own["threshold"], 0.0).astype(float), own["left"].to_numpy(np.int64), own["right"].to_numpy(np.int64), weight * value, cover))
    return Forest(trees, int(model.numFeatures), 0.0, 1.0 if boosted else None)


# Shapley values


@dataclass
class Paths:
    """Ways to the leaves of a tree: for each leaf and each feature on its way the interval that leads on and the share of training rows in it."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray

    def expected(self) -> float:
        return float((self.value * self.share.prod(1)).sum())


def paths(tree: Tree) -> Paths:
    found: list[tuple[dict[int, tuple[float, float, float]], float]] = []
    stack: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
    while stack:
        node, way = stack.pop()
        f = int(tree.feature[node])
        if f < 0:
            found.append((way, float(tree.value[node])))
            continue
        low, high, share = way.get(f, (-math.inf, math.inf, 1.0))
        t, cover = float(tree.threshold[node]), max(float(tree.cover[node]), 1e-300)
        for child, own in ((int(tree.left[node]), (low, min(high, t))), (int(tree.right[node]), (max(low, t), high))):
            stack.append((child, way | {f: (*own, share * float(tree.cover[child]) / cover)}))
    depth = max((len(way) for way, _ in found), default=0)
    n = len(found)
    out = Paths(np.zeros((n, depth), np.int64), np.full((n, depth), -math.inf), np.full((n, depth), math.inf), np.ones((n, depth)), np.array([v for _, v in found]))
    for i, (way, _) in enumerate(found):
        for j, (f, (low, high, share)) in enumerate(way.items()):
            out.feature[i, j], out.low[i, j], out.high[i, j], out.share[i, j] = f, low, high, share
    return out


def shapley_of(own: Paths, x: np.ndarray, width: int) -> np.ndarray:
    """Exact Shapley values of one tree for one row: absent features follow the training rows' shares.

    In a leaf's game a coalition is worth the value times, for each feature of the way, 1 or 0 if it
    is in (does the row go this way?), the share if it is not. A feature's Shapley value is the
    integral over t of the others' factors at share (1 - t) + goes t, times goes - share: a
    polynomial in t, one degree less than the features of the way, so Gauss's rule with half as
    many points gives it exactly, in time linear in the features.
    """
    if not own.feature.size:
        return np.zeros(width)
    v = x[own.feature]
    goes = ((v > own.low) & (v <= own.high)).astype(float)
    points, weights = np.polynomial.legendre.leggauss(-(-own.feature.shape[1] // 2))
    total = np.zeros_like(goes)
    for t, w in zip((points + 1) / 2, weights / 2):
        factors = own.share * (1 - t) + goes * t
        # a way that no training row goes has a factor of 0: then the others' product counts for its feature alone, whose goes and share agree
        total += w * np.divide(factors.prod(1, keepdims=True), factors, out=np.zeros_like(factors), where=factors > 0)
    return np.bincount(own.feature.ravel(), ((goes - own.share) * total * own.value[:, None]).ravel(), width)


#: Trees that one task takes of a model.
TREES = 16


def base_value(forest: Forest) -> float:
    """What a forest says of a row without features: its mean over training rows."""
    return forest.base + sum(paths(t).expected() for t in forest.trees)


def shapley(df: DataFrame, forest: Forest, names: list[str]) -> DataFrame:
    """(sample_id, feature, value, x) of each row of df (sample_id, features) and each feature.

    A row meets the trees in groups of TREES, each a task's work of its own; values of a row and
    feature are summed. Together with base_value() they add up to the forest's margin.
    """
    spark = df.sparkSession
    model = spark.sparkContext.broadcast([paths(t) for t in forest.trees])
    width, groups = len(names), max(1, -(-len(forest.trees) // TREES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sample, x, group in zip(batch["sample_id"], batch["x"], batch["part"]):
                x = np.asarray(x, float)
                total = sum((shapley_of(own, x, width) for own in model.value[group * TREES : (group + 1) * TREES]), np.zeros(width))
                at = np.flatnonzero(total) if group else np.arange(width)
                yield pd.DataFrame({"sample_id": [sample] * len(at), "at": at.astype(np.int32), "value": total[at]})

    asked = df.select("sample_id", vector_to_array("features").alias("x"))
    kind = asked.schema["sample_id"].dataType.simpleString()
    parts = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition("sample_id", "part")
    summed = parts.mapInPandas(run, f"sample_id {kind}, at int, value double").groupBy("sample_id", "at").agg(F.sum("value").alias("value"))
    named = F.array(*[F.lit(n) for n in names])
    return summed.join(asked, "sample_id").select("sample_id", F.get(named, F.col("at")).alias("feature"), "value", F.get("x", F.col("at")).alias("x"))


# growing trees by passes over the rows


def _rows_of(train: DataFrame) -> DataFrame:
    """(x, y, w, n): each different row of features and label once, with its weight and how often it stands there."""
    weight = F.col("weight") if "weight" in train.columns else F.lit(1.0)
    rows = train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), weight.cast("double").alias("w"))
    return rows.groupBy("x", "y").agg(F.sum("w").alias("w"), F.count("*").alias("n"))


def _matrix(x: pa.Array, width: int) -> np.ndarray:
    """Lists of equal length as rows."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)


def _passed(rows: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """The rows that work(x, y, w, n) gives for each block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                part = batch.slice(i, BLOCK)
                x = _matrix(part["x"], len(part["x"][0]))
                yield pa.RecordBatch.from_pandas(pd.DataFrame(work(x, *(part[c].to_numpy(zero_copy_only=False) for c in "ywn"))), kinds, preserve_index=False)

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return rows.mapInArrow(run, schema)


class Grown:
    """A tree that grows node by node."""

    def __init__(self):
        self.nodes: list[list[float]] = [[-1, 0.0, -1, -1, 0.0, 0.0]]

    def split(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        left = len(self.nodes)
        self.nodes[node][:4] = [feature, threshold, left, left + 1]
        self.nodes += [[-1, 0.0, -1, -1, 0.0, 0.0], [-1, 0.0, -1, -1, 0.0, 0.0]]
        return left, left + 1

    def tree(self, scale: float = 1.0) -> Tree:
        a = np.array(self.nodes, float)
        return Tree(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4] * scale, a[:, 5])


class ExtraTrees:
    """Extremely randomised trees: every node draws one cut for each of a few random features, between the least and greatest value in it, and takes the best.

    Two passes over the rows a level, for all trees at once: ranges of the drawn features in each
    open node, then class weights on either side of the cuts. Nodes are worked on in groups, so that
    what a pass gives stays bounded. All trees see all rows.
    """

    #: Nodes and drawn features whose statistics one pass gives at most.
    CELLS = 200_000

    def __init__(self, numTrees: int = 300, maxDepth: int = 30, minSplit: int = 2, maxFeatures: int | None = None, seed: int = 42):
        self.n, self.depth, self.least, self.drawn, self.seed = numTrees, maxDepth, minSplit, maxFeatures, seed

    def fit(self, train: DataFrame) -> Forest:
        rows = _rows_of(train).persist()
        width = len(rows.first()["x"])
        k = min(width, self.drawn or max(1, round(math.sqrt(width))))
        grown = [Grown() for _ in range(self.n)]
        gains = np.zeros(width)
        first = rows.groupBy("y").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()  # two classes
        weight = [sum(r["w"] for r in first if r["y"] == y) for y in (0.0, 1.0)]
        open_ = {(t, 0): (*weight, sum(r["n"] for r in first)) for t in range(self.n)}
        for t, g in enumerate(grown):
            g.nodes[0][4:] = [weight[1] / sum(weight), sum(weight)]
        for _ in range(self.depth):
            open_ = {key: s for key, s in open_.items() if s[0] > 0 and s[1] > 0 and s[2] >= self.least}
            if not open_:
                break
            ready, later = sorted(open_), {}
            for at in range(0, len(ready), max(1, self.CELLS // (2 * k))):
                later |= self._level(rows, grown, {key: open_[key] for key in ready[at : at + max(1, self.CELLS // (2 * k))]}, k, width, gains)
            open_ = later
        rows.unpersist()
        return Forest([g.tree(1 / self.n) for g in grown], width, 0.0, None, gains)

    def _chance(self, tree: int, node: int) -> np.random.Generator:
        return np.random.default_rng([self.seed, tree, node])

    def _level(self, rows: DataFrame, grown: list[Grown], open_: dict, k: int, width: int, gains: np.ndarray) -> dict:
        """Split these nodes; the new ones with their class weights and rows."""
        # twice as many features as are compared, for those that are constant in a node
        drawn = {key: self._chance(*key).permutation(width)[: 2 * k] for key in open_}
        cells = {}
        spark = rows.sparkSession
        trees = {t: grown[t].tree() for t, _ in open_}
        asked: dict[int, list[int]] = {}
        for t, node in open_:
            asked.setdefault(t, []).append(node)

        def blocks(x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
            for t, nodes in asked.items():
                at = trees_.value[0][t].leaf_of(x)
                for node in nodes:
                    own = np.flatnonzero(at == node)
                    if len(own):
                        yield t, node, own

        trees_ = spark.sparkContext.broadcast((trees, drawn))

        def ranges(x: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
            out: dict[str, list] = {c: [np.zeros(0)] for c in ("t", "node", "f", "low", "high")}
            for t, node, own in blocks(x):
                f = trees_.value[1][t, node]
                part = x[np.ix_(own, f)]
                for c, v in zip(out, (np.full(len(f), t), np.full(len(f), node), f, part.min(0), part.max(0))):
                    out[c].append(v)
            return {c: np.concatenate(v) for c, v in out.items()}

        seen = _passed(rows, ranges, "t int, node int, f int, low double, high double").groupBy("t", "node", "f").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        for r in seen.where("low < high").collect():  # CELLS at most
            cells.setdefault((r["t"], r["node"]), {})[r["f"]] = (r["low"], r["high"])
        cuts = {}
        for key, own in cells.items():
            chance = self._chance(key[0], key[1] + (1 << 32))
            found = [(int(f), float(low + (high - low) * chance.random())) for f in drawn[key] if f in own for low, high in [own[f]]][:k]
            # a cut at the greatest value would leave nothing on the right
            cuts[key] = ([f for f, _ in found], [min(c, math.nextafter(own[f][1], -math.inf)) for f, c in found])
        cuts_ = spark.sparkContext.broadcast({key: (np.array(f), np.array(c)) for key, (f, c) in cuts.items()})

        def sides(x: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
            out: dict[str, list] = {c: [np.zeros(0)] for c in ("t", "node", "f", "zeros", "ones", "n")}
            for t, node, own in blocks(x):
                if (t, node) not in cuts_.value:
                    continue
                f, cut = cuts_.value[t, node]
                left = x[np.ix_(own, f)] <= cut
                weight, one = w[own][:, None] * left, (y[own] == 1)[:, None]
                for c, v in zip(out, (np.full(len(f), t), np.full(len(f), node), f, (weight * ~one).sum(0), (weight * one).sum(0), (n[own][:, None] * left).sum(0))):
                    out[c].append(v)
            return {c: np.concatenate(v) for c, v in out.items()}

        summed = _passed(rows, sides, "t int, node int, f int, zeros double, ones double, n double").groupBy("t", "node", "f").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "n")])
        best: dict[tuple[int, int], tuple] = {}
        for r in summed.collect():
            key = (r["t"], r["node"])
            zeros, ones, n = open_[key]
            f, cut = cuts[key]
            i = f.index(r["f"])
            right = (zeros - r["zeros"], ones - r["ones"], n - r["n"])
            gain = _impurity(zeros, ones) - _impurity(r["zeros"], r["ones"]) - _impurity(*right[:2])
            if right[2] > 0 and r["n"] > 0:
                best[key] = max(best.get(key, (-1.0,)), (gain, -i, r["f"], cut[i], (r["zeros"], r["ones"], r["n"]), right))
        new = {}
        for (t, node), (gain, _, f, cut, *both) in sorted(best.items()):
            gains[f] += max(gain, 0.0)
            for child, own in zip(grown[t].split(node, f, cut), both):
                total = max(own[0] + own[1], 1e-300)
                grown[t].nodes[child][4:] = [max(own[1], 0.0) / total, total]
                new[t, child] = tuple(v if abs(v) > 1e-9 else 0.0 for v in own)
        return new


def _impurity(zeros: float, ones: float) -> float:
    """Gini impurity times weight."""
    total = zeros + ones
    return 2 * zeros * ones / total if total > 0 else 0.0


class HistBoosting:
    """Boosting of log loss over histograms: each tree grows at the leaf of greatest gain first, up to a number of leaves.

    Rows equal in features and label are one, with their number. Features are cut into bins between
    their values, or at quantiles of all rows. A pass sums
    gradients and hessians of each open leaf, feature and bin; cumulative sums and the best cut of a
    leaf are window functions. A pass takes all leaves that the order by gain may reach next, so a
    tree takes about as many passes as it is deep, with the same result as one leaf at a time. With
    more than EARLY rows a tenth of them, picked by hash, tells when to stop.
    """

    SAMPLE = 20_000
    ACCURACY = 10_000
    EARLY = 10_000

    def __init__(self, maxIter: int = 100, maxLeaves: int = 31, learningRate: float = 0.1, minLeaf: int = 20, maxBins: int = 255, l2: float = 0.0, patience: int = 10, earlyStopping: bool | None = None, seed: int = 42):
        self.rounds, self.leaves, self.rate, self.least, self.bins, self.l2, self.patience, self.early, self.seed = maxIter, maxLeaves, learningRate, minLeaf, maxBins, l2, patience, earlyStopping, seed

    def fit(self, train: DataFrame) -> Forest:
        rows = _rows_of(train).persist()
        spark, n = rows.sparkSession, rows.agg(F.sum("n")).first()[0]
        edges = self._bins(rows)
        width = len(edges)
        held = F.pmod(F.xxhash64("x", "y", F.lit(self.seed + 1)), F.lit(10)) == 0
        stops = n > self.EARLY if self.early is None else self.early
        fitted, kept = (rows.where(~held), rows.where(held)) if stops else (rows, None)
        total, ones = fitted.agg(F.sum("w"), F.sum(F.col("w") * F.col("y"))).first()
        share = min(max(ones / total, 1e-6), 1 - 1e-6)
        forest = Forest([], width, math.log(share / (1 - share)), 1.0, np.zeros(width))
        best, waited = math.inf, 0
        for _ in range(self.rounds):
            tree = self._tree(spark, fitted, forest, edges)
            if tree is None:
                break
            forest.trees.append(tree)
            if kept is not None:
                lost = self._loss(spark, kept, forest)
                best, waited = (lost, 0) if lost < best - 1e-7 else (best, waited + 1)
                if waited >= self.patience:
                    break
        rows.unpersist()
        return forest

    def _bins(self, rows: DataFrame) -> list[np.ndarray]:
        """Upper ends of each feature's bins, from all rows.

        Values are counted by feature, in each block and then over all. A feature of at most bins
        values has a cut between any two; the others' are midway between neighbours of quantiles,
        exact up to ACCURACY rows and near that of their rank beyond.
        """
        def values(x: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
            found = [np.unique(x[:, f], return_inverse=True) for f in range(x.shape[1])]
            counts = [np.bincount(at.ravel(), n, len(own)) for own, at in found]
            return {"f": np.repeat(np.arange(x.shape[1]), [len(own) for own, _ in found]), "v": np.concatenate([own for own, _ in found]), "n": np.concatenate(counts)}

        counted = _passed(rows, values, "f int, v double, n double").groupBy("f", "v").agg(F.sum("n").cast("long").alias("n")).persist()
        per = counted.groupBy("f").agg(F.count("*").alias("values"), F.sum("n").alias("rows")).collect()  # a row a feature
        edges = [np.zeros(0)] * len(per)
        whole = {r["f"] for r in per if r["values"] <= self.bins or r["rows"] <= self.SAMPLE}
        own: dict[int, list[tuple[float, int]]] = {}
        for r in counted.where(F.col("f").isin(whole)).collect() if whole else []:  # bins or SAMPLE values of a feature at most
            own.setdefault(r["f"], []).append((r["v"], r["n"]))
        for f, found in own.items():
            v, n = (np.array(c) for c in zip(*sorted(found)))
            edges[f] = (v[:-1] + v[1:]) / 2 if len(v) <= self.bins else _edges(np.repeat(v, n), self.bins)
        if len(whole) < len(per):
            shares = [i / self.bins for i in range(1, self.bins)]
            each = counted.where(~F.col("f").isin(whole)).select("f", "v", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
            for r in each.groupBy("f").agg(F.percentile_approx("v", shares, self.ACCURACY).alias("q")).collect():
                edges[r["f"]] = np.unique(r["q"])
        counted.unpersist()
        return edges

    def _loss(self, spark: SparkSession, kept: DataFrame, forest: Forest) -> float:
        model = spark.sparkContext.broadcast(forest)

        def work(x: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
            return {"loss": [float((w * np.logaddexp(0, np.where(y == 1, -1, 1) * model.value.margins(x))).sum())], "w": [float(w.sum())]}

        lost, weight = _passed(kept, work, "loss double, w double").agg(F.sum("loss"), F.sum("w")).first()
        return lost / weight if weight else 0.0

    def _tree(self, spark: SparkSession, rows: DataFrame, forest: Forest, edges: list[np.ndarray]) -> Tree | None:
        grown = Grown()
        # every node's best cut, once known: (gain, feature, threshold, sums left, sums right); None without one
        known: dict[int, tuple | None] = {}
        sums: dict[int, tuple[float, float, float]] = {}
        children: dict[int, tuple[int, int]] = {}
        waiting = [0]
        while waiting:
            for node, (own, cut) in self._cuts(spark, rows, forest, grown.tree(), waiting, edges).items():
                known[node] = cut
                sums.setdefault(node, own)
            for node in waiting:
                known.setdefault(node, None)
            # go through the leaves by gain as far as cuts are known, and ask for the rest that may be reached
            taken, waiting, leaves, heap = [], [], 1, [(-known[0][0], 0)] if known.get(0) else []
            while heap and leaves < self.leaves:
                _, node = heapq.heappop(heap)
                taken.append(node)
                leaves += 1
                if node not in children:
                    _, f, threshold, left, right = known[node]
                    children[node] = grown.split(node, f, threshold)
                    sums |= dict(zip(children[node], (left, right)))
                for child in children[node]:
                    if child not in known:
                        if sums[child][2] >= 2 * self.least:
                            waiting.append(child)
                        else:
                            known[child] = None
                    if known.get(child):
                        heapq.heappush(heap, (-known[child][0], child))
        if 0 not in children:
            return None
        # what was split to look ahead, but not reached in the end, is a leaf
        for node in children:
            if node not in taken:
                grown.nodes[node][:4] = [-1, 0.0, -1, -1]
        for node in taken:
            forest.gains[known[node][1]] += known[node][0]
        for node, (g, h, _) in sums.items():
            grown.nodes[node][4:] = [-self.rate * g / (h + self.l2 + 1e-12), h]
        return grown.tree()

    def _cuts(self, spark: SparkSession, rows: DataFrame, forest: Forest, tree: Tree, nodes: list[int], edges: list[np.ndarray]) -> dict[int, tuple[tuple, tuple | None]]:
        """Of each of these nodes that has rows: its sums and its best cut."""
        model = spark.sparkContext.broadcast((forest, tree, edges))
        size = max(len(e) for e in edges) + 1

        def cells(x: np.ndarray, y: np.ndarray, w: np.ndarray, times: np.ndarray) -> dict[str, np.ndarray]:
            before, grown, edges = model.value
            p = 1 / (1 + np.exp(-before.margins(x)))
            g, h, at = w * (p - y), w * p * (1 - p), grown.leaf_of(x)
            bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1) + size * np.arange(x.shape[1])
            out: dict[str, list] = {c: [np.zeros(0)] for c in ("node", "f", "b", "g", "h", "n")}
            for node in nodes:
                own = np.flatnonzero(at == node)
                flat, repeated = bins[own].ravel(), np.repeat(own, x.shape[1])
                n = np.bincount(flat, times[repeated], 1)
                seen = np.flatnonzero(n)
                for c, v in zip(out, (np.full(len(seen), node), seen // size, seen % size, np.bincount(flat, g[repeated])[seen] if len(own) else seen, np.bincount(flat, h[repeated])[seen] if len(own) else seen, n[seen])):
                    out[c].append(v)
            return {c: np.concatenate(v) for c, v in out.items()}

        summed = _passed(rows, cells, "node int, f int, b int, g double, h double, n double").groupBy("node", "f", "b").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
        # bins of a feature: maxBins at most
        so_far, whole = Window.partitionBy("node", "f").orderBy("b"), Window.partitionBy("node", "f")
        both = summed.select("node", "f", "b", *[F.sum(c).over(so_far).alias(f"{c}l") for c in ("g", "h", "n")], *[F.sum(c).over(whole).alias(f"{c}t") for c in ("g", "h", "n")])
        both = both.withColumns({f"{c}r": F.col(f"{c}t") - F.col(f"{c}l") for c in ("g", "h", "n")})
        l2 = F.lit(self.l2 + 1e-12)
        gain = F.col("gl") ** 2 / (F.col("hl") + l2) + F.col("gr") ** 2 / (F.col("hr") + l2) - F.col("gt") ** 2 / (F.col("ht") + l2)
        allowed = (F.col("nl") >= self.least) & (F.col("nr") >= self.least) & (F.col("hl") >= 1e-3) & (F.col("hr") >= 1e-3) & (gain > 1e-12)
        cut = F.max(F.when(allowed, F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), *[f"{c}{side}" for side in "lr" for c in "ghn"]))).alias("cut")
        found = both.groupBy("node").agg(cut, *[F.max_by(f"{c}t", "f").alias(f"{c}t") for c in ("g", "h", "n")])
        out = {}
        for r in found.collect():  # a row a node
            c = r["cut"]
            own = (r["gt"], r["ht"], r["nt"])
            out[r["node"]] = (own, None if c is None else (c["gain"], -c["f"], float(edges[-c["f"]][-c["b"]]), (c["gl"], c["hl"], c["nl"]), (c["gr"], c["hr"], c["nr"])))
        return out


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Upper ends of all bins but the last: midway between values that follow each other, or between quantiles."""
    own = np.unique(values)
    if len(own) <= bins:
        return (own[:-1] + own[1:]) / 2
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="midpoint"))
