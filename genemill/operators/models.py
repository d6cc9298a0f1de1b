"""Spark ML fits: candidates, cross-validation, ensembles, attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genemill.operators import evaluate as E
from genemill.operators.distributed import ordinal_ranks, top_per_key
from genemill.operators.normalize import tagged


def estimator(kind: str, seed: int = 42, **o):
    """One named classifier; an RBF kernel has no distributed form, so svm is linear."""
    if kind == "logistic":
        return LogisticRegression(maxIter=o.get("max_iter", 50), regParam=o.get("reg", 0.01))
    if kind == "elastic_net":
        return LogisticRegression(
            maxIter=o.get("max_iter", 50), regParam=o.get("reg", 0.01), elasticNetParam=o.get("l1_ratio", 0.5)
        )
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=o.get("trees", 100), maxDepth=o.get("depth", 5), seed=seed)
    if kind == "gbt":
        return GBTClassifier(maxIter=o.get("rounds", 20), maxDepth=o.get("depth", 3), seed=seed)
    if kind == "svm":
        return LinearSVC(maxIter=o.get("max_iter", 50), regParam=o.get("reg", 0.01))
    raise ValueError(f"unknown model {kind}")


def predict(model, data: DataFrame, name: str, unit: str = "sample_id") -> DataFrame:
    """Prediction rows (model, id, y, yhat, score) of a fitted binary classifier."""
    out = model.transform(data)
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
    else:
        score = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.select(
        F.lit(name).alias("model"), F.col(unit).alias("id"), F.col("label").cast("int").alias("y"),
        F.col("prediction").cast("int").alias("yhat"), score.alias("score"),
    )


def cross_validate(data: DataFrame, models: dict, k: int = 5, seed: int = 42) -> DataFrame:
    """Out-of-fold predictions of each model, with the fold."""
    folded = E.stratified_folds(data, k, "label", "sample_id", seed).persist()
    parts = None
    for name, est in models.items():
        for f in range(k):
            fit = est.fit(folded.filter(F.col("fold") != f))
            p = predict(fit, folded.filter(F.col("fold") == f), name).withColumn("fold", F.lit(f))
            parts = p if parts is None else parts.unionByName(p)
    return parts


def cv_metrics(cv: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC per model and fold."""
    keys = ("model", "fold")
    m = E.classification_metrics(cv, keys).select(
        *keys, "accuracy", "precision_weighted", "recall_weighted", "f1_weighted"
    )
    return m.join(E.auc(cv, keys).select(*keys, "roc_auc"), list(keys))


def cv_summary(cv: DataFrame) -> DataFrame:
    names = ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "roc_auc")
    return E.metric_summary(cv_metrics(cv), ("model",), names)


def cv_accuracy(data: DataFrame, folds: int = 3, max_iter: int = 20) -> float:
    cv = cross_validate(data, {"m": estimator("logistic", max_iter=max_iter)}, folds)
    return cv.agg(F.avg(F.when(F.col("y") == F.col("yhat"), 1.0).otherwise(0.0))).first()[0]


def grid_search(data: DataFrame, est, grid, k: int = 3, parallelism: int = 4, seed: int = 42):
    """Best model of a parameter grid by ROC AUC over stratified folds."""
    folded = E.stratified_folds(data, k, "label", "sample_id", seed).withColumn("fold", F.col("fold").cast("int"))
    cv = CrossValidator(
        estimator=est, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(),
        numFolds=k, parallelism=parallelism, foldCol="fold",
    )
    return cv.fit(folded)


def train_candidates(data: DataFrame, models: dict, k: int = 3) -> DataFrame:
    """Grid search per model {name: (estimator, grid)}: mean AUC of every grid point."""
    rows = []
    for name, (est, grid) in models.items():
        fit = grid_search(data, est, grid, k)
        for i, auc in enumerate(fit.avgMetrics):
            text = ", ".join(f"{p.name}={v}" for p, v in sorted(grid[i].items(), key=lambda x: x[0].name))
            rows.append((name, text, float(auc), bool(auc == max(fit.avgMetrics))))
    return data.sparkSession.createDataFrame(
        rows, "model string, params string, roc_auc double, best boolean"
    )


def nested_cv(data: DataFrame, models: dict, outer: int = 3, inner: int = 2, seed: int = 42) -> DataFrame:
    """Outer-fold predictions of the best inner grid point of each model."""
    folded = E.stratified_folds(data, outer, "label", "sample_id", seed, "outer").persist()
    parts = None
    for name, (est, grid) in models.items():
        for f in range(outer):
            fit = grid_search(folded.filter(F.col("outer") != f), est, grid, inner, seed=seed + f)
            p = predict(fit.bestModel, folded.filter(F.col("outer") == f), name).withColumn("fold", F.lit(f))
            parts = p if parts is None else parts.unionByName(p)
    return parts


def soft_vote(pred: DataFrame, weights: dict[str, float], name: str = "ensemble") -> DataFrame:
    """Weighted mean of the scores of several models for each case."""
    from genemill.functions.columns import lookup

    w = lookup("model", weights, 0.0)
    g = pred.groupBy("id", "y").agg((F.sum(w * F.col("score")) / F.sum(w)).alias("score"))
    return g.select(
        F.lit(name).alias("model"), "id", "y", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("yhat"), "score"
    )


def evaluate_set(data: DataFrame, models: dict, k: int = 5) -> DataFrame:
    """Cross-validated and in-sample metrics per model, told apart by `scope`."""
    cv = cross_validate(data, models, k).drop("fold")
    fit = None
    for name, est in models.items():
        p = predict(est.fit(data), data, name)
        fit = p if fit is None else fit.unionByName(p)
    both = tagged({"cross_validated": cv, "in_sample": fit}, "scope")
    keys = ("scope", "model")
    return E.classification_metrics(both, keys).join(E.auc(both, keys), list(keys))


def permutation_importance(model, data: DataFrame, names: Sequence[str], seed: int = 42) -> DataFrame:
    """Accuracy lost when one feature is shuffled over the cases, per feature.

    A shuffle pairs each case with the value at the same position of another
    hash order, by an equi-join on position.
    """
    base_rows = data.select("sample_id", "label", vector_to_array("features").alias("x")).persist()
    acc = lambda p: p.agg(F.avg(F.when(F.col("y") == F.col("yhat"), 1.0).otherwise(0.0))).first()[0]
    from pyspark.ml.functions import array_to_vector

    base = acc(predict(model, data, "m"))
    h = base_rows.withColumn("_a", F.xxhash64("sample_id", F.lit(seed)) / 2.0**20)
    left = ordinal_ranks(h, [], "_a", "sample_id", "pos")
    rows = []
    for i, name in enumerate(names):
        o = base_rows.withColumn("_b", F.xxhash64("sample_id", F.lit(seed + 1 + i)) / 2.0**20)
        right = ordinal_ranks(o, [], "_b", "sample_id", "pos").select("pos", F.col("x")[i].alias("_v"))
        parts = [F.col("_v") if j == i else F.col("x")[j] for j in range(len(names))]
        mixed = left.join(right, "pos").select(
            "sample_id", "label", array_to_vector(F.array(*parts)).alias("features")
        )
        rows.append((name, float(base - acc(predict(model, mixed, "m")))))
    out = data.sparkSession.createDataFrame(rows, "feature string, importance double")
    cut = out.agg((F.avg("importance") + 2 * F.stddev_pop("importance")).alias("c")).scalar()
    return out.withColumn("flagged", F.col("importance") > cut)


def linear_attribution(values: DataFrame, coefficients: DataFrame) -> DataFrame:
    """phi = coefficient * (value - mean value): sample_id, feature, value, phi.

    Exact for linear models. `values` is long (sample_id, feature, value).
    """
    means = values.groupBy("feature").agg(F.avg("value").alias("_m"))
    side = means.join(coefficients.select("feature", "coef"), "feature")
    return values.join(side, "feature").select(
        "sample_id", "feature", "value", (F.col("coef") * (F.col("value") - F.col("_m"))).alias("phi")
    )


def attribution_summary(phi: DataFrame) -> DataFrame:
    """Mean |phi|, mean phi and deviation per feature."""
    return phi.groupBy("feature").agg(
        F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean"), F.stddev_pop("phi").alias("std")
    )


def attribution_dependence(phi: DataFrame) -> DataFrame:
    return phi.groupBy("feature").agg(F.corr("value", "phi").alias("correlation"), F.count(F.lit(1)).alias("n"))


def top_contributions(phi: DataFrame, n: int = 5) -> DataFrame:
    """The n largest contributions of each sample."""
    d = phi.withColumn("_a", F.abs("phi"))
    return top_per_key(d, ["sample_id"], "_a", "feature", n).drop("_a")


def explain_sample(phi: DataFrame, sample_id: str) -> DataFrame:
    return phi.filter(F.col("sample_id") == sample_id).orderBy(F.abs("phi").desc(), "feature")


def train_and_evaluate(data: DataFrame, kind: str = "logistic", test_share: float = 0.2, **o) -> DataFrame:
    """Split, fit on the training part, score the held-out part."""
    s = E.stratified_split(data, {"train": 1 - test_share, "test": test_share}).persist()
    fit = estimator(kind, **o).fit(s.filter("split = 'train'"))
    return E.holdout_report(predict(fit, s.filter("split = 'test'"), kind))


def leak_safe(expr: DataFrame, samples: DataFrame, label: str, n: int = 20, kind: str = "logistic", test_share: float = 0.25) -> DataFrame:
    """Split samples first, select features on the training part only, then fit and score."""
    from genemill.operators import selection as S

    side = E.stratified_split(samples, {"train": 1 - test_share, "test": test_share}, label)
    train = side.filter("split = 'train'")
    feats = S.top_scores(S.f_scores(expr, train, label), n)
    data, _ = S.feature_matrix(expr, side, label, feats)
    data = data.join(side.select("sample_id", "split"), "sample_id").persist()
    fit = estimator(kind).fit(data.filter("split = 'train'"))
    pred = predict(fit, data.filter("split = 'test'"), kind)
    return E.holdout_report(pred).withColumn("n_features", F.lit(n))
