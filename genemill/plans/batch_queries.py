"""Batch-effect detection, correction and principal components."""

from __future__ import annotations

from pyspark.sql import functions as F

from genemill.operators import batch as B
from genemill.operators import pca as P
from genemill.plans.registry import query, rounded
from genemill.plans.standins import sql_f_sf_df1_4, with_views

_D = "d AS (SELECT gene_id, sample_id, batch, age, value FROM expr JOIN samples USING (sample_id))"
_BM = "b AS (SELECT gene_id, batch, avg(value) AS bm, stddev_samp(value) AS bs, count(*) AS nb FROM d GROUP BY 1, 2)"
_GM = "g AS (SELECT gene_id, avg(value) AS gm, stddev_samp(value) AS gs, stddev_pop(value) AS gp, count(*) AS n FROM d GROUP BY 1)"
_JOIN = "FROM d JOIN b USING (gene_id, batch) JOIN g USING (gene_id)"


@query(
    "batch_location_scale",
    with_views(
        "expr samples",
        f"""WITH {_D}, {_BM}, {_GM} SELECT gene_id, sample_id, round(CASE WHEN bs > 0 THEN (value - bm) / bs * gs
        ELSE value - bm END + gm, 6) AS value {_JOIN}""",
    ),
)
def location_scale(t):
    return rounded(B.correct(t.expr(), t.samples(), "combat"))


_MC = with_views(
    "expr samples",
    f"WITH {_D}, {_BM}, {_GM} SELECT gene_id, sample_id, round(value - bm + gm, 6) AS value {_JOIN}",
)


@query("batch_mean_centering", _MC)
def mean_centering(t):
    return rounded(B.correct(t.expr(), t.samples(), "mean_centering"))


@query("batch_linear_no_covariates", _MC)
def limma(t):
    return rounded(B.correct(t.expr(), t.samples(), "limma"))


@query(
    "batch_linear_with_covariate",
    with_views(
        "expr samples",
        f"""WITH {_D}, b AS (SELECT gene_id, batch, avg(value) AS bm, avg(age) AS am FROM d GROUP BY 1, 2), {_GM},
        f AS (SELECT gene_id, sum((value - bm) * (age - am)) / sum((age - am) * (age - am)) AS beta
            FROM d JOIN b USING (gene_id, batch) GROUP BY 1)
        SELECT gene_id, sample_id, round(value - bm - beta * (age - am) + gm, 6) AS value {_JOIN} JOIN f USING (gene_id)""",
    ),
)
def linear(t):
    return rounded(B.correct(t.expr(), t.samples(), "linear_regression", covariates=["age"]))


@query(
    "batch_linear_coefficients",
    with_views(
        "expr samples",
        f"""WITH {_D}, b AS (SELECT gene_id, batch, avg(value) AS bm, avg(age) AS am FROM d GROUP BY 1, 2)
        SELECT gene_id, round(sum((value - bm) * (age - am)) / sum((age - am) * (age - am)), 9) AS coefficient
        FROM d JOIN b USING (gene_id, batch) GROUP BY 1""",
    ),
)
def coefficients(t):
    return rounded(B.linear_coefficients(t.expr(), t.samples(), "age"), 9)


@query(
    "batch_sizes",
    with_views("samples", "SELECT batch, count(*) AS n_samples FROM samples GROUP BY 1"),
)
def sizes(t):
    return B.batch_sizes(t.samples())


@query(
    "batch_statistics",
    with_views(
        "expr samples",
        f"""WITH {_D}, s AS (SELECT batch, sample_id, avg(value) AS m, stddev_samp(value) AS s FROM d GROUP BY 1, 2)
        SELECT batch, count(*) AS n_samples, round(avg(m), 6) AS mean_expression, round(avg(s), 6) AS std_expression FROM s GROUP BY 1""",
    ),
)
def statistics(t):
    return rounded(B.batch_statistics(t.expr(), t.samples()))


@query(
    "batch_cv_distribution",
    with_views(
        "expr samples",
        f"""WITH {_D}, {_BM}, c AS (SELECT gene_id, CASE WHEN avg(bm) > 0 THEN stddev_pop(bm) / avg(bm) ELSE 0 END AS cv FROM b GROUP BY 1)
        SELECT round(avg(cv), 6) AS mean, round(stddev_pop(cv), 6) AS std, round(quantile_cont(cv, 0.5), 6) AS median,
        round(quantile_cont(cv, 0.25), 6) AS q25, round(quantile_cont(cv, 0.75), 6) AS q75 FROM c""",
    ),
)
def cv(t):
    return rounded(B.batch_cv_distribution(t.expr(), t.samples()))


_ANOVA = f"""{_D}, {_BM}, {_GM},
    s AS (SELECT gene_id, count(*) AS k, sum(nb) AS n, sum((nb - 1) * bs * bs) AS ssw, sum(nb * pow(bm - gm, 2)) AS ssb
        FROM b JOIN g USING (gene_id) GROUP BY 1),
    f AS (SELECT gene_id, (ssb / 4) / (ssw / (n - 5)) AS f, CAST(n - 5 AS DOUBLE) AS d2 FROM s),
    p AS (SELECT gene_id, f, {sql_f_sf_df1_4('f', 'd2')} AS p FROM f),
    a AS (SELECT *, least(1.0::DOUBLE, min(p * m / rk) OVER (ORDER BY p DESC, gene_id)) AS p_adj FROM
        (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) AS rk FROM p))"""


@query(
    "batch_anova_detection",
    with_views(
        "expr samples",
        f"WITH {_ANOVA} SELECT gene_id, round(f, 6) AS statistic, round(p, 6) AS p_value, round(p_adj, 6) AS p_adj FROM a",
    ),
)
def anova(t):
    return rounded(
        B.anova_detection(t.expr(), t.samples()).select("gene_id", "statistic", "p_value", "p_adj")
    )


@query(
    "batch_anova_summary",
    with_views(
        "expr samples",
        f"""WITH {_ANOVA} SELECT count(*) AS n_tests, count(*) FILTER (p < 0.05) AS n_significant, count(*) FILTER (p_adj < 0.05) AS n_significant_fdr,
        round(count(*) FILTER (p < 0.05) / count(*)::DOUBLE, 6) AS proportion_significant,
        round(count(*) FILTER (p_adj < 0.05) / count(*)::DOUBLE, 6) AS proportion_significant_fdr FROM a""",
    ),
)
def anova_summary(t):
    return rounded(B.anova_detection_summary(B.anova_detection(t.expr(), t.samples())))


_CORR = f"""{_D}, lv AS (SELECT DISTINCT batch AS lv FROM d),
    c AS (SELECT gene_id, 'batch_' || lv AS variable, abs(corr(value, CASE WHEN batch = lv THEN 1.0::DOUBLE ELSE 0 END)) AS r FROM d, lv GROUP BY 1, 2
        UNION ALL SELECT gene_id, 'age', abs(corr(value, age)) FROM d GROUP BY 1)"""


@query(
    "batch_correlations",
    with_views(
        "expr samples", f"WITH {_CORR} SELECT gene_id, variable, round(r, 6) AS abs_r FROM c WHERE NOT isnan(r)"
    ),
)
def correlations(t):
    return rounded(B.batch_correlations(t.expr(), t.samples(), covariates=["age"]))


@query(
    "batch_correlation_summary",
    with_views(
        "expr samples",
        f"""WITH {_CORR} SELECT variable, round(avg(r), 6) AS mean_correlation, round(max(r), 6) AS max_correlation,
        count(*) FILTER (r > 0.3) AS n_high_correlation, round(quantile_cont(r, 0.5), 6) AS median_correlation FROM c GROUP BY 1""",
    ),
)
def correlation_summary(t):
    return rounded(B.correlation_summary(B.batch_correlations(t.expr(), t.samples(), covariates=["age"])))


@query("pca_variance")
def pca_variance(t):
    return rounded(P.pca(t.expr(), 10).variance)


@query(
    "pca_gram_from_scores",
    with_views(
        "expr",
        """WITH s AS (SELECT gene_id, avg(value) AS m, stddev_pop(value) AS sd FROM expr GROUP BY 1),
        z AS (SELECT gene_id, sample_id, (value - m) / sd AS z FROM expr JOIN s USING (gene_id) WHERE sd > 0)
        SELECT a.sample_id AS sample_1, b.sample_id AS sample_2, round(sum(a.z * b.z), 4) + 0.0 AS product
        FROM z a JOIN z b ON a.gene_id = b.gene_id AND a.sample_id <= b.sample_id GROUP BY 1, 2""",
    ),
)
def pca_gram(t):
    """Scores of all components give back the inner products of the samples."""
    s = P.pca(t.expr(), t.samples().count()).scores
    return P.inner_products(s).select("sample_1", "sample_2", (F.round("product", 4) + 0.0).alias("product"))


@query("pca_scores")
def pca_scores(t):
    return rounded(P.pca(t.expr(), 5).scores, 5)


@query("pca_component_batch_scores")
def pca_batch(t):
    return rounded(P.component_batch_scores(P.pca(t.expr(), 10).scores, t.samples()))


@query("batch_pca_correction")
def pca_correction(t):
    return rounded(B.correct(t.expr(), t.samples(), "pca"), 5)


@query("batch_detect_scores")
def detect(t):
    return rounded(B.detect(t.expr(), t.samples()))


@query("batch_evaluate_correction")
def evaluate(t):
    e, s = t.expr(), t.samples()
    return rounded(B.evaluate(e, B.mean_centering(e, s), s))


@query(
    "pca_cumulative_variance",
    """WITH v AS (SELECT label AS component, var_samp(x) AS variance FROM
        (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1)
    SELECT component, round(sum(variance) OVER (ORDER BY component) / sum(variance) OVER (), 6) AS cumulative_ratio FROM v""",
)
def cumulative(t):
    """Running share of variance over ordered components (here: classes of the vectors)."""
    from genemill.operators.distributed import ordered_scan

    v = (
        t.embeddings.select("label", F.explode("embedding").alias("x"))
        .groupBy(F.col("label").alias("component"))
        .agg(F.var_samp(F.col("x").cast("double")).alias("variance"))
    )
    total = v.agg(F.sum("variance").alias("t")).scalar()
    run = ordered_scan(v, [], "component", {"cum": ("sum", "variance", "asc")})
    return rounded(run.select("component", (F.col("cum") / total).alias("cumulative_ratio")))
