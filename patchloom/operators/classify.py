"""Method level against statement level: both datasets, the same folds, all models, metrics, explanations."""

from __future__ import annotations

import math
import warnings
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain
from typing import Any

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vector, Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom import config as settings
from patchloom.functions import text as T
from patchloom.operators import datasets as D
from patchloom.operators import metrics as M
from patchloom.operators import forests, kernel, models
from patchloom.sources.tables import stored

# Titles of the comparison's columns by approach and evaluation level, and of the difference of the first two.
TITLES = {("raw", "method"): "raw | method", ("split", "method"): "split | method (agregasi statement)", ("split", "statement"): "split | statement"}
DELTA = "selisih (split - raw) @method"
READ = ("cve_id", "vulnerability_type", "origin", "statement_id", "statement_type", "function_name", "language", "raw_text", "label")
#: Texts' weights that a worker remembers.
REMEMBERED = 1 << 16
EXPLAINED = ("native_importance", "shap_mean_abs", "shap_mean", "shap_value_corr", "permutation_mean", "permutation_std")


@dataclass(frozen=True)
class Config:
    models: list = field(default_factory=lambda: ["random_forest"])
    group_by: str = "method"
    test_size: float = 0.2
    cv_folds: int = 0
    seed: int = 42
    threshold: float = 0.5
    rollup: str = "max"
    max_terms: int = 2000
    min_df: int = 1
    numeric: tuple[str, ...] = tuple(settings.DEFAULTS["classification"]["split_features"]["numeric"])
    categorical: tuple[str, ...] = tuple(settings.DEFAULTS["classification"]["split_features"]["categorical"])
    statement_terms: int = 0
    importance: bool = True
    shap: bool = True
    explained: int = 300
    local: int = 10
    align: bool = True
    kernel: bool = False
    top_k: int = 20
    permutation: bool = True
    repeats: int = 5
    scoring: str = "average_precision"
    permuted: int = 100

    def columns(self) -> list[str]:
        """Columns of the statement table that compare() reads."""
        return list(dict.fromkeys([*READ, *self.numeric, *self.categorical]))

    @classmethod
    def of(cls, found: dict[str, Any], **over: Any) -> Config:
        """From settings as config.load() gives them; over's values, where not None, come first."""
        c = found["classification"]
        split, raw, rows, xai = c["split"], c["raw_features"], c["split_features"], c["xai"]
        given = {
            "models": list(c["models"]), "group_by": split["group_by"], "test_size": D.parse_test_size(split["test_size"]), "cv_folds": int(split["cv_folds"] or 0), "seed": int(split["random_state"]),
            "threshold": float(c["threshold"]), "rollup": c["method_aggregation"], "max_terms": int(raw["max_features"]), "min_df": int(raw["min_df"]), "numeric": tuple(rows["numeric"]), "categorical": tuple(rows["categorical"]),
            "statement_terms": int(rows["tfidf_max_features"]) if rows["raw_text_tfidf"] else 0, "importance": bool(xai["enabled"]), "shap": bool(xai["shap"]), "explained": int(xai["shap_max_samples"]),
            "local": int(xai["local_explanations"]), "top_k": int(xai["top_k"]), "permutation": bool(xai["permutation"]), "repeats": int(xai["permutation_repeats"]), "scoring": xai["permutation_scoring"], "permuted": int(xai["permutation_max_features"]), "align": bool(c.get("align_samples", True)), "kernel": bool(xai.get("shap_kernel_fallback", False)),
        }
        return cls(**(given | {k: v for k, v in over.items() if v is not None}))


def statements_of(pairs: DataFrame, table: DataFrame, by: str) -> DataFrame:
    """The statement table with row_index, side, method_id, group_id and method_label.

    Statements whose pair isn't in pairs raise an error; of those whose pair has another cve_id a
    warning tells.
    """
    rows = stored(table.withColumn("row_index", T.row_index_of(F.col("statement_id"))))
    if not D.orphans(rows, pairs).isEmpty():
        raise ValueError("statements of pairs that aren't there: was the table made of another input?")
    if "cve_id" in rows.columns and "cve_id" in pairs.columns and (n := D.lineage_mismatches(rows, pairs)):
        warnings.warn(f"{n} statements have another cve_id than their pair: was the table made of another input?", stacklevel=2)
    keys = pairs.select("row_index", D.group_key(by).alias("group_id"))
    method = F.concat_ws(":", F.col("row_index").cast("string"), "origin")
    joined = rows.join(keys, "row_index").withColumn("side", F.col("origin"))
    return joined.withColumns({"method_id": method, "method_label": (F.col("origin") == "vulnerable").cast("int"), "label": T.to_number(F.col("label")).cast("int")})


def term_vectors(rows: DataFrame, id_column: str, text: str, size: int, min_df: int = 1) -> tuple[DataFrame, list[str]]:
    """rows with features, TF-IDF fitted on those that aren't test rows, and the terms; rows without terms get zeros.

    Terms are at most size, so each row's weights are worked out where it is; weights are those of D.tfidf().
    """
    train = rows.where("not is_test")
    found = D.most_frequent(D.term_counts(train, text), size, min_df).orderBy("term").collect()  # at most size
    n_docs, terms = train.count(), [r["term"] for r in found]
    idf = {r["term"]: (i, math.log((1 + n_docs) / (1 + r["df"])) + 1) for i, r in enumerate(found)}

    inside = {part for t in terms for at in (0, *(i for i, c in enumerate(t) if c == " ")) for part in (t[:at], t[at + bool(at) :])}
    known: dict[tuple, Vector] = {}

    @F.udf(VectorUDT())
    def weights(tokens):
        # texts that differ in tokens of no term have the same weights
        tokens = tuple(t if t in inside else None for t in tokens or ())
        if tokens not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            counts = Counter(t for t in chain(tokens, (f"{a} {b}" for a, b in zip(tokens, tokens[1:]) if a is not None and b is not None)) if t in idf)
            cells = sorted((idf[t][0], (1 + math.log(n)) * idf[t][1]) for t, n in counts.items())
            norm = math.sqrt(sum(w * w for _, w in cells))
            known[tokens] = Vectors.sparse(len(idf), [i for i, _ in cells], [w / norm for _, w in cells])
        return known[tokens]

    return rows.withColumn("features", weights(T.code_tokens(F.col(text)))), terms


def statement_vectors(rows: DataFrame, config: Config) -> tuple[DataFrame, list[str]]:
    """rows with features and their names: numbers, a column for each category seen in training, and, if asked for, terms of the text."""
    numeric, categorical = D.feature_columns(list(config.numeric)), D.feature_columns(list(config.categorical))
    D.check_columns(rows, numeric + categorical)
    made: dict[str, Column] = {f"_f{i}": T.to_number(F.col(c)) for i, c in enumerate(numeric)}
    rows, inputs, names = rows.withColumns(made), list(made), list(numeric)
    if categorical:
        # a sparse column for each, however many categories there are; the report names each
        places = stored(D.numbered(D.one_hot(rows.where("not is_test"), "statement_id", categorical).select("feature").distinct(), "feature"))
        found = [r["feature"] for r in places.orderBy("i").collect()]
        own = {c: [i for i, f in enumerate(found) if f.startswith(f"{c}=")] for c in sorted(set(categorical), key=lambda c: f"{c}=")}
        for n, (c, at) in enumerate(own.items()):
            # few names: a broadcast; what training has not seen is beyond the last, which the encoder gives no cell
            here = F.col("i") - F.lit(min(at, default=0))
            rows = rows.join(places.select(F.col("feature").alias(f"_of{n}"), here.cast("double").alias(f"_at{n}")), D.category(c) == F.col(f"_of{n}"), "left").drop(f"_of{n}")
            rows = rows.withColumn(f"_at{n}", F.coalesce(f"_at{n}", F.lit(float(max(1, len(at))))))
        before, after = [f"_at{n}" for n in range(len(own))], [f"_c{n}" for n in range(len(own))]
        # the encoder learns how many categories there are from the last one's place
        last = rows.sparkSession.createDataFrame([tuple(float(max(1, len(at)) - 1) for at in own.values())], before)
        rows = OneHotEncoder(inputCols=before, outputCols=after, handleInvalid="keep").fit(last).transform(rows).drop(*before)
        inputs, names = [*inputs, *after], names + [x for c, at in own.items() for x in ([found[i] for i in at] or [f"{c}=none"])]
    if config.statement_terms:
        rows, terms = term_vectors(rows, "statement_id", "raw_text", config.statement_terms)
        rows, inputs, names = rows.withColumnRenamed("features", "_terms"), [*inputs, "_terms"], [*names, *[f"term={t}" for t in terms]]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(rows).drop(*inputs), names


def explain(fitted: models.Fitted, train: DataFrame, scored: DataFrame, names: list[str], config: Config) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """(importance by feature, local explanations, notes) of a model.

    scored are the test rows with sample_id, y_true, y_score and features. Models of trees have exact
    Shapley values by the shares of training rows along their ways, linear ones those of independent
    features; others have values by coalitions, if the settings ask for them, or a note that there are none.
    """
    spark, notes = train.sparkSession, []
    table = spark.createDataFrame([(n,) for n in names], "feature string")
    native = models.native_importance(fitted, names)
    table = table.join(F.broadcast(spark.createDataFrame(native, "feature string, native_importance double")), "feature", "left") if native else table.withColumn("native_importance", F.lit(None).cast("double"))
    forest = forests.of_model(spark, fitted.model) if config.shap else None
    linear = models.linear_parts(fitted, train) if config.shap and forest is None else None
    local = None
    other = config.shap and config.kernel and not forest and not linear
    if forest or linear or other:
        sample = M.explain_sample(scored.select("sample_id", "y_true", "y_score", "features"), config.local, config.explained, config.seed)
        sample = stored(sample)
        if forest:
            base, parts = forests.base_value(forest), stored(forests.shapley(fitted.scaled(sample), forest, names))
            notes.append("Shapley values of trees by the shares of training rows along their ways, in units of " + ("probability" if forest.link is None else "log odds"))
        elif other:
            parts, base = kernel.shapley(lambda rows: models.score(fitted, rows), sample, train, names, seed=config.seed)
            notes.append(f"Shapley values by coalitions of features against {kernel.BACKGROUND} training rows, in units of the score")
        else:
            weights, means, base = linear
            parts = models.contributions(sample, weights, means, names)
            notes.append("Shapley values of a linear model of independent features, in units of its margin")
        of_feature = parts.groupBy("feature").agg(F.avg(F.abs("value")).alias("shap_mean_abs"), F.avg("value").alias("shap_mean"), M.correlation("x", "value").alias("shap_value_corr"))
        table = table.join(of_feature, "feature", "left")
        best = M.top_contributions(parts.join(F.broadcast(sample.where("sample_rank is not null").select("sample_id")), "sample_id"), config.top_k)
        local = best.join(sample.drop("features"), "sample_id").select(
            "sample_rank", "sample_id", "y_true", "y_score", (F.col("y_score") >= config.threshold).cast("int").alias("y_pred"), F.lit(base).alias("base_value"), "contribution_rank", "feature",
            F.col("x").alias("feature_value"), F.col("value").alias("shap_value"), "direction",
        )
    else:
        table = table.withColumns({c: F.lit(None).cast("double") for c in ("shap_mean_abs", "shap_mean", "shap_value_corr")})
        notes.append("no Shapley values for this kind of model" if config.shap else "Shapley values are turned off")
    metric = {"average_precision": "pr_auc"}.get(config.scoring, config.scoring)
    if config.permutation and metric in ("pr_auc", "roc_auc") and scored.select("y_true").distinct().count() < 2:
        notes.append(f"no permutation importance: the test rows have one class only ({config.scoring})")
        permuted = None
    elif config.permutation:
        candidates = names
        if len(names) > config.permuted:
            by = "shap_mean_abs" if forest or linear or other else "native_importance" if native else None
            order = table if by else variances(scored, names)
            candidates = [r["feature"] for r in order.orderBy(F.desc_nulls_last(by or "variance"), "feature").limit(config.permuted).collect()]  # a setting bounds them
            notes.append(f"permutation importance of the {config.permuted} first of {len(names)} features alone")
        permuted = models.permutation_importance(fitted, scored, names, candidates, D.places, metric, config.repeats, config.seed)
    else:
        permuted = None
    table = table.join(permuted, "feature", "left") if permuted is not None else table.withColumns({c: F.lit(None).cast("double") for c in ("permutation_mean", "permutation_std")})
    return table.select("feature", *EXPLAINED), local, notes


def variances(rows: DataFrame, names: list[str]) -> DataFrame:
    """(feature, variance) of the rows' features."""
    per = rows.select(F.posexplode(vector_to_array("features"))).groupBy("pos").agg(F.var_pop("col").alias("variance"))
    return per.select(F.get(F.array(*[F.lit(n) for n in names]), F.col("pos")).alias("feature"), "variance")


def compare(pairs: DataFrame, table: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:  # noqa: B008
    """The report's tables over all folds, models and approaches: raw (whole methods) and split (statements, and methods by their statements)."""
    spark = pairs.sparkSession
    # what is read again is stored, so that plans stay short however many folds and models there are
    statements = stored(statements_of(pairs, table, config.group_by))
    methods = D.raw_methods(pairs, config.group_by)
    methods = stored(D.align(methods, statements) if config.align else methods)
    groups = D.strata(statements)
    if not config.align:  # groups of methods without statements have no positive one
        others = methods.select("group_id").distinct().join(groups, "group_id", "left_anti")
        groups = stored(groups.unionByName(others.withColumn("stratum", F.lit(0).cast(groups.schema["stratum"].dataType))))
    folds = D.kfold(groups, config.cv_folds, config.seed) if config.cv_folds else D.holdout(groups, config.test_size, config.seed).select("group_id", F.when(F.col("is_test"), 0).otherwise(1).alias("fold"))
    folds = stored(folds)
    for c in ("cve_id", "vulnerability_type", "language", "method"):
        if c not in methods.columns:
            methods = methods.withColumn(c, F.lit(None).cast("string"))
    meta = ["cve_id", "vulnerability_type", "language", "side"]
    predicted, importance, local, info, notes, seconds = [], [], [], [], [], []
    for fold in range(config.cv_folds or 1):
        side = folds.select("group_id", (F.col("fold") == fold).alias("is_test"))
        m, terms = term_vectors(methods.join(side, "group_id"), "method_id", "code", config.max_terms, config.min_df)
        s, columns = statement_vectors(statements.join(side, "group_id"), config)
        approaches = {
            "raw": ("method", m.select(F.col("method_id").alias("sample_id"), "method_id", "group_id", "is_test", F.col("label").cast("int").alias("label"), "features", *meta, "method", T.preview(F.col("code")).alias("text_preview")), terms),
            "split": ("statement", s.select(F.col("statement_id").alias("sample_id"), "statement_id", "method_id", "group_id", "is_test", "label", "method_label", "features", *meta, "function_name", "statement_type", T.preview(F.col("raw_text")).alias("text_preview")), columns),
        }
        ready = {}
        for approach, (unit, rows, names) in approaches.items():
            rows = stored(rows)
            test = F.col("is_test")
            counted = rows.agg(
                F.count_if(~test).alias("n_train"), F.count_if(~test & (F.col("label") == 1)).alias("n_train_pos"), F.count_if(test).alias("n_test"), F.count_if(test & (F.col("label") == 1)).alias("n_test_pos"),
                F.count_distinct(F.when(~test, F.col("group_id"))).alias("n_train_groups"), F.count_distinct(F.when(test, F.col("group_id"))).alias("n_test_groups"),
            ).first()
            info.append({"fold": fold + 1, "approach": approach, "unit": unit, "n_features": len(names)} | counted.asDict())
            usable = 0 < counted["n_train_pos"] < counted["n_train"] and counted["n_test"] > 0
            if usable:
                ready[approach] = (unit, rows, models.balanced(rows.where("not is_test").select("label", "features")).persist(), names)
            else:
                warnings.warn(f"fold {fold + 1}, {approach}: one class only to train on, or nothing to test; left out", stacklevel=2)
        for one in models.specs(config.models, config.seed):
            for approach, (unit, rows, train, names) in ready.items():
                fitted = models.fit(one, train, len(names))
                tags = {"fold": F.lit(fold + 1), "approach": F.lit(approach), "model": F.lit(one.label)}
                seconds.append((fold + 1, approach, one.label, fitted.seconds))
                test = rows.where("is_test").withColumn("y_true", F.col("label"))
                scored = test.select("sample_id", "features").join(models.score(fitted, test.select("sample_id", "features")), "sample_id")
                scored = test.drop("features", "is_test").join(scored, "sample_id")
                scored = stored(scored)
                own = M.predict(scored, config.threshold).drop("features", "label", "method_label")
                predicted.append(own.withColumns(tags | {"eval_level": F.lit(unit)}))
                if approach == "split":
                    up = M.predict(M.rollup(scored, config.rollup), config.threshold).withColumn("sample_id", F.col("method_id"))
                    up = up.join(methods.select("method_id", *meta, "method"), "method_id", "left")
                    predicted.append(up.withColumns(tags | {"eval_level": F.lit("method")}))
                if config.importance:
                    made, here, said = explain(fitted, train, scored, names, config)
                    importance.append(stored(made).withColumns(tags))
                    notes += [(fold + 1, approach, one.label, n) for n in said]
                    if here is not None:
                        local.append(here.join(scored.select("sample_id", "text_preview"), "sample_id").withColumns(tags))
    if not predicted:
        raise ValueError("no model could be trained: every training fold has one class only")

    def union(frames: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    front = ["fold", "approach", "eval_level", "model"]
    every = union(predicted).withColumnRenamed("group_id", "group")
    first = [*front, "sample_id", "group", "y_true", "y_score", "y_pred"]
    every = every.select(*first, *[c for c in every.columns if c not in (*first, "text_preview")], "text_preview")
    every = stored(every)
    timed = spark.createDataFrame(seconds, "fold int, approach string, model string, train_seconds double")
    per_fold = M.metrics(every, front, config.threshold).join(F.broadcast(timed), ["fold", "approach", "model"])
    per_fold = per_fold.select(*front, "n_test", "n_test_pos", *M.METRICS, "tp", "fp", "tn", "fn", "train_seconds")
    per_fold = stored(per_fold)
    title = reduce(lambda rest, x: F.when((F.col("approach") == x[0][0]) & (F.col("eval_level") == x[0][1]), x[1]).otherwise(rest), TITLES.items(), F.lit(None).cast("string"))
    by_title = M.long_metrics(per_fold.withColumn("approach", title), ["fold", "approach", "model"], list(M.METRICS))
    compared = M.comparison(by_title, list(TITLES.values()), (TITLES["raw", "method"], TITLES["split", "method"])).withColumnRenamed("delta", DELTA)
    keys = ["approach", "model"]
    out = {
        "comparison": compared, "summary": M.summary(per_fold, ["approach", "eval_level", "model"], [*M.METRICS, "tp", "fp", "tn", "fn", "n_test", "n_test_pos", "train_seconds"]), "metrics": per_fold, "predictions": every,
        "dataset_info": spark.createDataFrame(info, "fold int, approach string, unit string, n_train long, n_train_pos long, n_test long, n_test_pos long, n_features int, n_train_groups long, n_test_groups long"),
    }
    if importance:
        folded = union(importance)
        out["importance"] = M.ranked_by_basis(M.importance_mean(folded, list(EXPLAINED)), keys)
        if config.cv_folds:
            out["importance_folds"] = M.ranked_by_basis(folded, ["fold", *keys])
        out["xai_notes"] = spark.createDataFrame(notes, "fold int, approach string, model string, note string")
    if local:
        out["local_explanations"] = union(local).select("fold", "approach", "model", "sample_rank", "sample_id", "y_true", "y_score", "y_pred", "base_value", "contribution_rank", "feature", "feature_value", "shap_value", "direction", "text_preview")
    return out


#: What the report's tables are.
README = [
    ("raw", "a row is a whole method; features are TF-IDF weights of its code tokens"),
    ("split", "a row is a statement; features are numbers and categories of the statement table"),
    ("eval_level", "statement: scores of statements; method: of methods, for split the greatest or mean score of their statements"),
    ("folds", "groups of rows (of one method, unless set otherwise) stand on one side, the same for both approaches"),
    ("comparison", "means over folds: a row a model and metric, a column an approach and level"),
    ("summary, metrics", "metrics, averaged over folds and of each fold"),
    ("importance", "native importance, drop of a metric when a feature is dealt out anew, and Shapley values of trees and linear models"),
    ("local_explanations", "contributions to the scores of the test rows of greatest score"),
    ("predictions, dataset_info, xai_notes, config", "scores of all test rows, sizes of each fold, remarks, and the settings used"),
]
