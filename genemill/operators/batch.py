"""Detection and removal of batch effects on long matrices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from genemill.operators import pca as P
from genemill.operators.distributed import percentiles, reuse
from genemill.operators.padjust import adjust_p
from genemill.operators.stats import anova, group_moments, labelled


def _with_batch(expr: DataFrame, samples: DataFrame, batch: str) -> DataFrame:
    return labelled(expr, samples, batch).withColumnRenamed("grp", "batch")


def location_scale(expr: DataFrame, samples: DataFrame, batch: str = "batch") -> DataFrame:
    """(x - batch mean) / batch deviation * gene deviation + gene mean, per gene.

    This is what the "combat" name computes; there is no empirical Bayes step.
    """
    d = _with_batch(expr, samples, batch)
    b = d.groupBy("gene_id", "batch").agg(
        F.avg("value").alias("_bm"), F.stddev_samp("value").alias("_bs")
    )
    g = d.groupBy("gene_id").agg(F.avg("value").alias("_gm"), F.stddev_samp("value").alias("_gs"))
    j = d.join(b, ["gene_id", "batch"]).join(g, "gene_id")
    gap = F.col("value") - F.col("_bm")
    scaled = F.when(F.col("_bs") > 0, gap / F.col("_bs") * F.col("_gs")).otherwise(gap)
    return j.select("gene_id", "sample_id", (scaled + F.col("_gm")).alias("value"))


def mean_centering(expr: DataFrame, samples: DataFrame, batch: str = "batch") -> DataFrame:
    """x - batch mean + gene mean."""
    d = _with_batch(expr, samples, batch)
    b = d.groupBy("gene_id", "batch").agg(F.avg("value").alias("_bm"))
    g = d.groupBy("gene_id").agg(F.avg("value").alias("_gm"))
    j = d.join(b, ["gene_id", "batch"]).join(g, "gene_id")
    return j.select(
        "gene_id", "sample_id", (F.col("value") - F.col("_bm") + F.col("_gm")).alias("value")
    )


@F.pandas_udf(ArrayType(DoubleType()))
def _solve(xtx: pd.Series, xty: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(xtx, xty):
        b = np.asarray(b, dtype=float)
        out.append(np.linalg.pinv(np.asarray(a, dtype=float).reshape(len(b), len(b))) @ b)
    return pd.Series(out)


def linear_correction(
    expr: DataFrame,
    samples: DataFrame,
    batch: str = "batch",
    covariates: Sequence[str] = (),
) -> DataFrame:
    """Residuals of a per-gene least-squares fit on batch and covariates, plus the gene mean.

    Values and covariates are first centred within (gene, batch), which takes the
    batch columns out of the fit; what is left is one small system per gene.
    """
    covariates = list(covariates)
    if not covariates:
        return mean_centering(expr, samples, batch)
    side = samples.select("sample_id", F.col(batch).alias("batch"), *covariates)
    d = expr.filter(F.col("value").isNotNull()).join(side, "sample_id").dropna(subset=["batch", *covariates])
    cols = ["value", *covariates]
    b = d.groupBy("gene_id", "batch").agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    c = d.join(b, ["gene_id", "batch"])
    for col in cols:
        c = c.withColumn(f"_c_{col}", F.col(col) - F.col(f"_m_{col}"))
    x = [F.col(f"_c_{v}") for v in covariates]
    fit = c.groupBy("gene_id").agg(
        F.array(*[F.sum(a * e) for a in x for e in x]).alias("_xx"),
        F.array(*[F.sum(a * F.col("_c_value")) for a in x]).alias("_xy"),
        F.avg("value").alias("_gm"),
    )
    fit = fit.select("gene_id", "_gm", _solve("_xx", "_xy").alias("_beta"))
    fitted = F.lit(0.0)
    for i, a in enumerate(x):
        fitted = fitted + F.col("_beta")[i] * a
    return c.join(fit, "gene_id").select(
        "gene_id", "sample_id", (F.col("_c_value") - fitted + F.col("_gm")).alias("value")
    )


def linear_coefficients(expr: DataFrame, samples: DataFrame, covariate: str, batch: str = "batch") -> DataFrame:
    """Per-gene slope of one covariate once the batch means are taken out."""
    d = (
        expr.filter(F.col("value").isNotNull())
        .join(samples.select("sample_id", F.col(batch).alias("batch"), F.col(covariate).alias("x")), "sample_id")
        .groupBy("gene_id", "batch")
        .agg(
            F.covar_pop("value", "x").alias("cov"),
            F.var_pop("x").alias("vx"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    num, den = F.sum(F.col("cov") * F.col("n")), F.sum(F.col("vx") * F.col("n"))
    return d.groupBy("gene_id").agg(F.when(den > 0, num / den).alias("coefficient"))


def pca_correction(
    expr: DataFrame,
    samples: DataFrame,
    batch: str = "batch",
    n_components: int = 10,
    threshold: float = 0.1,
    keep_rest: bool = False,
) -> DataFrame:
    """Drop the components whose batch score passes the threshold and rebuild the matrix.

    The matrix is rebuilt from the kept components; with `keep_rest` the flagged
    ones are subtracted instead, so variation beyond `n_components` stays.
    """
    comp = P.pca(expr, n_components)
    flags = P.component_batch_scores(comp.scores, samples, batch)
    bad = {r[0] for r in flags.filter(F.col("batch_score") > threshold).select("component").collect()}
    if not bad:
        return expr
    kept = F.col("component").isin(sorted(bad))
    kept = kept if keep_rest else ~kept
    s = comp.scores.filter(kept).groupBy("sample_id").agg(
        F.map_from_entries(F.collect_list(F.struct("component", "score"))).alias("_s")
    )
    g = comp.loadings.filter(kept).groupBy("gene_id").agg(
        F.map_from_entries(F.collect_list(F.struct("component", "loading"))).alias("_l")
    )
    stats = expr.groupBy("gene_id").agg(
        F.avg("value").alias("_m"), F.stddev_pop("value").alias("_sd")
    )
    part = F.aggregate(
        F.map_keys("_s"), F.lit(0.0), lambda a, c: a + F.col("_s")[c] * F.coalesce(F.col("_l")[c], F.lit(0.0))
    )
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    j = expr.join(stats, "gene_id").join(s, "sample_id", "left").join(g, "gene_id", "left")
    part = F.coalesce(part, F.lit(0.0))
    value = F.col("value") - sd * part if keep_rest else F.col("_m") + sd * part
    return j.select("gene_id", "sample_id", value.alias("value"))


METHODS = {
    "combat": location_scale,
    "limma": linear_correction,
    "pca": pca_correction,
    "linear_regression": linear_correction,
    "mean_centering": mean_centering,
}


def correct(expr: DataFrame, samples: DataFrame, method: str = "combat", batch: str = "batch", **options):
    if method not in METHODS:
        raise ValueError(f"unknown batch method {method}; use one of {sorted(METHODS)}")
    return METHODS[method](expr, samples, batch, **options)


def batch_sizes(samples: DataFrame, batch: str = "batch") -> DataFrame:
    return samples.groupBy(F.col(batch).alias("batch")).agg(F.count(F.lit(1)).alias("n_samples"))


def batch_statistics(expr: DataFrame, samples: DataFrame, batch: str = "batch") -> DataFrame:
    """Per batch: samples, mean of the sample means, mean of the sample deviations."""
    d = _with_batch(expr, samples, batch)
    per = d.groupBy("batch", "sample_id").agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("s")
    )
    return per.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg("m").alias("mean_expression"),
        F.avg("s").alias("std_expression"),
    )


def gene_batch_cv(expr: DataFrame, samples: DataFrame, batch: str = "batch") -> DataFrame:
    """Per gene: population deviation over mean of its batch means (0 when the mean is not positive)."""
    means = (
        _with_batch(expr, samples, batch).groupBy("gene_id", "batch").agg(F.avg("value").alias("m"))
    )
    return means.groupBy("gene_id").agg(
        F.when(F.avg("m") > 0, F.stddev_pop("m") / F.avg("m")).otherwise(F.lit(0.0)).alias("cv")
    )


def batch_cv_distribution(expr: DataFrame, samples: DataFrame, batch: str = "batch") -> DataFrame:
    cv = reuse(gene_batch_cv(expr, samples, batch))
    q = percentiles(cv, [], "cv", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    out = cv.agg(F.avg("cv").alias("mean"), F.stddev_pop("cv").alias("std"))
    for name in ("median", "q25", "q75"):
        out = out.withColumn(name, q.select(name).scalar())
    return out


def anova_detection(expr: DataFrame, samples: DataFrame, batch: str = "batch") -> DataFrame:
    return adjust_p(anova(expr, samples, batch), "p_value", "fdr_bh", "p_adj")


def anova_detection_summary(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    raw, fdr = F.count_if(F.col("p_value") < alpha), F.count_if(F.col("p_adj") < alpha)
    return tests.agg(
        F.count("p_value").alias("n_tests"),
        raw.alias("n_significant"),
        fdr.alias("n_significant_fdr"),
        (raw / F.count("p_value")).alias("proportion_significant"),
        (fdr / F.count("p_value")).alias("proportion_significant_fdr"),
    )


def batch_correlations(
    expr: DataFrame, samples: DataFrame, batch: str = "batch", covariates: Sequence[str] = ()
) -> DataFrame:
    """|r| of every gene with each batch indicator and covariate: gene_id, variable, abs_r.

    The correlation with an indicator follows from group sizes and means, so the
    number of batches does not widen the plan.
    """
    d = labelled(expr, samples, batch)
    part = group_moments(d).select("gene_id", "grp", F.col("n").alias("nb"), F.col("mean").alias("mb"))
    whole = d.groupBy("gene_id").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")
    )
    r = (
        F.abs(F.col("mb") - F.col("m"))
        / F.col("sd")
        * F.sqrt(F.col("nb") / (F.col("n") - F.col("nb")))
    )
    ok = (F.col("sd") > 0) & (F.col("n") > F.col("nb"))
    out = part.join(whole, "gene_id").select(
        "gene_id", F.concat(F.lit("batch_"), F.col("grp")).alias("variable"), F.when(ok, r).alias("abs_r")
    )
    if covariates:
        j = expr.filter(F.col("value").isNotNull()).join(
            samples.select("sample_id", *covariates), "sample_id"
        )
        wide = j.groupBy("gene_id").agg(*[F.abs(F.corr("value", c)).alias(c) for c in covariates])
        out = out.unionByName(wide.unpivot(["gene_id"], list(covariates), "variable", "abs_r"))
    return out.filter(F.col("abs_r").isNotNull() & ~F.isnan("abs_r"))


def correlation_summary(correlations: DataFrame, high: float = 0.3) -> DataFrame:
    correlations = reuse(correlations)
    med = percentiles(correlations, ["variable"], "abs_r", {"median_correlation": 0.5})
    return (
        correlations.groupBy("variable")
        .agg(
            F.avg("abs_r").alias("mean_correlation"),
            F.max("abs_r").alias("max_correlation"),
            F.count_if(F.col("abs_r") > high).alias("n_high_correlation"),
        )
        .join(med, "variable")
    )


def detect(
    expr: DataFrame, samples: DataFrame, batch: str = "batch", n_components: int = 10
) -> DataFrame:
    """One row with the four batch-effect scores and their mean."""
    expr = reuse(expr)
    scores = P.component_batch_scores(P.pca(expr, n_components).scores, samples, batch)
    tests = anova_detection_summary(anova_detection(expr, samples, batch))
    corr = batch_correlations(expr, samples, batch).groupBy("variable").agg(F.avg("abs_r").alias("m"))
    cv = gene_batch_cv(expr, samples, batch).agg(F.avg("cv")).scalar()
    out = tests.select(F.col("proportion_significant_fdr").alias("anova_score"))
    out = (
        out.withColumn("pca_score", scores.agg(F.avg("batch_score")).scalar())
        .withColumn("correlation_score", corr.agg(F.avg("m")).scalar())
        .withColumn("cv_score", F.least(F.lit(1.0), cv / 0.5))
    )
    four = [F.col(c) for c in ("pca_score", "anova_score", "correlation_score", "cv_score")]
    return out.withColumn("overall_score", (four[0] + four[1] + four[2] + four[3]) / 4)


def evaluate(original: DataFrame, corrected: DataFrame, samples: DataFrame, batch: str = "batch") -> DataFrame:
    """Drop of every score from the original to the corrected matrix."""
    names = ("pca_score", "anova_score", "correlation_score", "overall_score")
    a = detect(original, samples, batch).select(*[F.col(c).alias(f"before_{c}") for c in names])
    b = detect(corrected, samples, batch)
    for c in names:
        a = a.withColumn(f"after_{c}", b.select(c).scalar())
    for c in names:
        a = a.withColumn(f"{c}_improvement", F.col(f"before_{c}") - F.col(f"after_{c}"))
    return a.withColumn("effective", F.col("overall_score_improvement") > 0.1)
