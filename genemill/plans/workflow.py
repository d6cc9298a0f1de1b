"""Whole analyses: each chains operators into one set of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genemill.operators import batch, normalize, qc, results, selection, stats, validate
from genemill.operators import evaluate as E
from genemill.operators import models as M
from genemill.operators.distributed import reuse
from genemill.operators.normalize import tagged


def selection_run(
    expr: DataFrame,
    samples: DataFrame,
    label: str = "label",
    n: int = 50,
    embedded=("lasso", "random_forest"),
    consensus: float = 0.25,
) -> dict[str, DataFrame]:
    """Filter and embedded selections, votes, consensus."""
    picked = reuse(selection.filter_select(expr, samples, label, n=n))
    candidates = picked.select("feature").distinct()
    data, names = selection.feature_matrix(expr, samples, label, candidates)
    data = reuse(data)
    parts = {m: selection.embedded_select(data, names, m, n) for m in embedded}
    every = picked.select("method", "feature", "score", "rank")
    if parts:
        every = every.unionByName(tagged(parts).select("method", "feature", "score", "rank"))
    every = reuse(every)
    return {
        "selections": every,
        "votes": selection.ensemble_vote(every),
        "consensus": selection.consensus(every, consensus),
    }


def biomarker_run(
    expr: DataFrame,
    samples: DataFrame,
    label: str = "label",
    transform_method: str = "log2",
    batch_method: str | None = "mean_centering",
    final: str = "none",
    min_detection: float = 0.1,
    top: int = 50,
) -> dict[str, DataFrame]:
    """Checks, quality, filter, normalisation, tests, selection and the ranked biomarkers.

    A failed check stops the run before any heavy work.
    """
    checks = validate.six_checks(expr, samples, label)
    validate.raise_on_errors(checks, "status", "failed")
    kept = qc.filter_sequential(expr, min_detection)
    matrix = reuse(
        normalize.staged_normalize(kept, samples, transform_method, batch_method, final)
    )
    classes = samples.agg(F.count_distinct(label)).first()[0]
    tests = None
    for m in stats.choose_methods(classes):
        t = stats.differential_expression(matrix, samples, label, m)
        t = t.select("method", F.col("gene_id").alias("gene"), "p_value", "p_adj", F.col("significant_adj").alias("significant"))
        tests = t if tests is None else tests.unionByName(t)
    tests = reuse(tests)
    picked = selection_run(matrix, samples, label, top, embedded=("lasso",))
    ml = picked["consensus"].select(F.col("feature").alias("gene"), "consensus_score")
    every = selection.consensus(picked["selections"], 0.0).select(F.col("feature").alias("gene"), "consensus_score")
    return {
        "checks": checks,
        "sample_metrics": qc.sample_metrics(expr, False),
        "gene_metrics": qc.gene_metrics(expr, False),
        "tests": tests,
        "selections": picked["selections"],
        "biomarkers": results.merge_evidence(tests, ml, every, top),
    }


def ml_run(expr: DataFrame, samples: DataFrame, label: str = "label", n: int = 10, folds: int = 3) -> dict[str, DataFrame]:
    """Select, cross-validate, test against shuffled labels, advise."""
    feats = selection.top_scores(selection.f_scores(expr, samples, label), n)
    data, names = selection.feature_matrix(expr, samples, label, feats)
    cv = reuse(M.cross_validate(reuse(data), {"logistic": M.estimator("logistic", max_iter=20)}, folds))
    report = E.holdout_report(cv.drop("fold"))
    perm = E.permutation_accuracy_exact(cv).select("model", "p_value")
    facts = report.select("model", "roc_auc").join(perm, "model").withColumn("n_features", F.lit(len(names)))
    return {
        "predictions": cv,
        "metrics": report,
        "fold_summary": M.cv_summary(cv),
        "permutation": perm,
        "advice": E.recommendations(facts),
    }
