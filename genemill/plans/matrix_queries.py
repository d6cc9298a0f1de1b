"""Normalisation, transforms and scalar functions on the matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from genemill.operators import normalize as N
from genemill.operators import transform as T
from genemill.plans.registry import query, rounded
from genemill.plans.standins import with_views


def _matrix_sql(view, ctes, value, source, places=6):
    ctes = f"WITH {ctes}" if ctes else ""
    return with_views(
        view, f"{ctes} SELECT gene_id, sample_id, round({value}, {places}) AS value FROM {source}"
    )


@query(
    "norm_log_cpm",
    _matrix_sql(
        "counts",
        "lib AS (SELECT sample_id, sum(value) AS lib FROM counts GROUP BY 1)",
        "log2(value * 1e6 / lib + 1)",
        "counts JOIN lib USING (sample_id)",
    ),
)
def log_cpm(t):
    return rounded(N.log_cpm(t.counts()))


@query("norm_log_tpm", _matrix_sql("expr", "", "log2(value + 1)", "expr"))
def log_tpm(t):
    return rounded(N.log_tpm(t.expr()))


_QUANTILE = """r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY value, gene_id) AS rk FROM {v}),
    q AS (SELECT rk, avg(value) AS q FROM r GROUP BY 1)"""


@query(
    "norm_quantile",
    _matrix_sql("expr", _QUANTILE.format(v="expr"), "q", "r JOIN q USING (rk)"),
)
def quantile(t):
    return rounded(N.quantile_normalize(t.expr()))


_Z = "s AS (SELECT gene_id, avg(value) AS m, {f}(value) AS s FROM expr GROUP BY 1)"


@query(
    "norm_z_score_population",
    _matrix_sql("expr", _Z.format(f="stddev_pop"), "(value - m) / s", "expr JOIN s USING (gene_id)"),
)
def z_pop(t):
    return rounded(N.z_score(t.expr(), ddof=0))


@query(
    "transform_z_score_sample",
    _matrix_sql("expr", _Z.format(f="stddev_samp"), "(value - m) / s", "expr JOIN s USING (gene_id)"),
)
def z_samp(t):
    return rounded(T.transform(t.expr(), "z_score"))


@query(
    "norm_robust_z_iqr",
    _matrix_sql(
        "expr",
        """s AS (SELECT gene_id, quantile_cont(value, 0.5) AS m,
        quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS s FROM expr GROUP BY 1)""",
        "(value - m) / CASE WHEN s > 0 THEN s ELSE 1 END",
        "expr JOIN s USING (gene_id)",
    ),
)
def robust_iqr(t):
    return rounded(N.robust_z_iqr(t.expr()))


@query(
    "transform_robust_z_mad",
    _matrix_sql(
        "expr",
        """m AS (SELECT gene_id, quantile_cont(value, 0.5) AS m FROM expr GROUP BY 1),
        s AS (SELECT gene_id, m, quantile_cont(abs(value - m), 0.5) AS s FROM expr JOIN m USING (gene_id) GROUP BY 1, 2)""",
        "CASE WHEN s > 0 THEN (value - m) / s END",
        "expr JOIN s USING (gene_id)",
    ),
)
def robust_mad(t):
    return rounded(N.robust_z_mad(t.expr()))


@query(
    "norm_min_max",
    _matrix_sql(
        "expr",
        "s AS (SELECT min(value) AS lo, max(value) AS hi FROM expr)",
        "(value - lo) / (hi - lo)",
        "expr, s",
    ),
)
def min_max(t):
    return rounded(N.min_max(t.expr()))


def _median_ratio_sql(pseudo):
    return _matrix_sql(
        "counts",
        f"""g AS (SELECT gene_id, exp(avg(ln(value + {pseudo}))) AS geo FROM counts GROUP BY 1),
        f AS (SELECT sample_id, quantile_cont(value / geo, 0.5) AS f FROM counts JOIN g USING (gene_id) GROUP BY 1)""",
        "value / f",
        "counts JOIN f USING (sample_id)",
    )


@query("norm_median_ratio", _median_ratio_sql("1.0"))
def median_ratio(t):
    return rounded(N.median_ratio(t.counts()))


@query("norm_median_ratio_small_pseudo", _median_ratio_sql("1e-10"))
def median_ratio_small(t):
    return rounded(N.median_ratio(t.counts(), 1e-10))


@query(
    "norm_tmm",
    _matrix_sql(
        "counts",
        """lib AS (SELECT sample_id, sum(value) AS lib FROM counts GROUP BY 1),
        med AS (SELECT quantile_cont(lib, 0.5) AS m FROM lib),
        ref AS (SELECT sample_id AS ref FROM lib, med ORDER BY abs(lib - m), sample_id LIMIT 1),
        rv AS (SELECT gene_id, value AS r FROM counts, ref WHERE sample_id = ref),
        ma AS (SELECT sample_id, log2(value + 1) - log2(r + 1) AS m, 0.5 * (log2(value + 1) + log2(r + 1)) AS a
            FROM counts JOIN rv USING (gene_id)),
        cut AS (SELECT sample_id, quantile_cont(a, 0.3) AS lo, quantile_cont(a, 0.7) AS hi FROM ma GROUP BY 1),
        f AS (SELECT sample_id, CASE WHEN sample_id = (SELECT ref FROM ref) THEN 1.0::DOUBLE
            ELSE exp(sum(m / (1 + a)) / sum(1 / (1 + a))) END AS f
            FROM ma JOIN cut USING (sample_id) WHERE a BETWEEN lo AND hi GROUP BY 1)""",
        "value / f",
        "counts JOIN f USING (sample_id)",
    ),
)
def tmm(t):
    return rounded(N.tmm(t.counts()))


@query(
    "norm_z_score_by_sample",
    _matrix_sql(
        "expr",
        "s AS (SELECT sample_id, avg(value) AS m, stddev_samp(value) AS s FROM expr GROUP BY 1)",
        "(value - m) / s",
        "expr JOIN s USING (sample_id)",
    ),
)
def z_by_sample(t):
    return rounded(N.z_score_by_sample(t.expr()))


@query(
    "norm_final_stage",
    _matrix_sql(
        "expr", _Z.format(f="stddev_pop"), "(value - m) / s", "expr JOIN s USING (gene_id)"
    ),
)
def final_stage(t):
    return rounded(N.final_normalization(t.expr(), "zscore"))


@query(
    "norm_staged",
    _matrix_sql(
        "expr samples",
        """l AS (SELECT gene_id, sample_id, batch, log2(value + 1) AS v FROM expr JOIN samples USING (sample_id)),
        b AS (SELECT gene_id, batch, avg(v) AS bm FROM l GROUP BY 1, 2),
        g AS (SELECT gene_id, avg(v) AS gm FROM l GROUP BY 1),
        value_table AS (SELECT gene_id, sample_id, v - bm + gm AS value FROM l JOIN b USING (gene_id, batch) JOIN g USING (gene_id)),
        """
        + _QUANTILE.format(v="value_table"),
        "q",
        "r JOIN q USING (rk)",
        4,
    ),
)
def staged(t):
    """log2, mean-centring of batches, quantile. Near ties make single ranks unstable: 4 places."""
    return rounded(
        N.staged_normalize(t.expr(), t.samples(), "log2", "mean_centering", "quantile"), 4
    )


_SKEW = """CASE WHEN count(*) > 2 THEN skewness({v}) END"""
_STATS = """count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
    round(min(value), 6) AS min, round(max(value), 6) AS max, round(skewness(value), 6) AS skewness,
    round(kurtosis(value), 6) AS kurtosis, round(quantile_cont(value, 0.5), 6) AS median"""


@query(
    "norm_summary_before_after",
    with_views(
        "counts",
        f"""WITH lib AS (SELECT sample_id, sum(value) AS lib FROM counts GROUP BY 1),
        u AS (SELECT 'before' AS stage, value FROM counts UNION ALL
            SELECT 'after', log2(value * 1e6 / lib + 1) FROM counts JOIN lib USING (sample_id))
        SELECT stage, {_STATS} FROM u GROUP BY 1""",
    ),
)
def norm_summary(t):
    e = t.counts()
    return rounded(N.normalization_summary(e, N.log_cpm(e)))


@query(
    "norm_compare_methods",
    with_views(
        "counts",
        f"""WITH lib AS (SELECT sample_id, sum(value) AS lib FROM counts GROUP BY 1),
        s AS (SELECT gene_id, avg(value) AS m, stddev_pop(value) AS s FROM counts GROUP BY 1),
        u AS (SELECT 'log_tpm' AS method, log2(value + 1) AS value FROM counts UNION ALL
            SELECT 'log_cpm', log2(value * 1e6 / lib + 1) FROM counts JOIN lib USING (sample_id) UNION ALL
            SELECT 'z_score', round((value - m) / s, 9) FROM counts JOIN s USING (gene_id))
        SELECT method, {_STATS.replace('round(avg(value), 6)', 'round(avg(value), 6) + 0.0')} FROM u GROUP BY 1""",
    ),
)
def compare(t):
    out = N.compare_methods(t.counts(), ["log_tpm", "log_cpm", "z_score"])
    return rounded(out).withColumn("mean", F.col("mean") + 0.0)


@query(
    "norm_detect_scale",
    with_views(
        "expr",
        """WITH g AS (SELECT gene_id, skewness(value) AS sk FROM expr GROUP BY 1),
        b AS (SELECT bool_or(value < 0) AS has_negative, bool_or(value % 1 <> 0) AS has_decimals,
            min(value) AS min, max(value) AS max, (SELECT avg(CASE WHEN sk > 0 THEN 1.0 ELSE 0.0 END) FROM g) AS share FROM expr)
        SELECT has_negative, has_decimals, min, max, round(share, 6) AS positive_skew_share,
        CASE WHEN has_negative THEN 'z_score' WHEN NOT has_decimals AND max < 100 THEN 'raw_counts'
            WHEN share > 0.7 THEN 'log_transformed' WHEN has_decimals THEN 'tpm_fpkm' ELSE 'unknown' END AS detected FROM b""",
    ),
)
def detect(t):
    return rounded(N.detect_scale(t.expr()))


@query("transform_log2", _matrix_sql("expr", "", "log2(value + 1)", "expr"))
def t_log2(t):
    return rounded(T.transform(t.expr(), "log2"))


@query("transform_log10", _matrix_sql("expr", "", "log10(value + 1)", "expr"))
def t_log10(t):
    return rounded(T.transform(t.expr(), "log10"))


@query("transform_sqrt", _matrix_sql("expr", "", "sqrt(value)", "expr"))
def t_sqrt(t):
    return rounded(T.transform(t.expr(), "sqrt"))


@query("transform_custom", _matrix_sql("expr", "", "value / (1 + value)", "expr"))
def t_custom(t):
    return rounded(T.custom(t.expr(), lambda v: v / (1 + v)))


def _rank_sql(expr):
    return _matrix_sql(
        "expr",
        f"""r AS (SELECT gene_id, sample_id, CAST({expr} AS DOUBLE) AS value FROM expr)""",
        "value",
        "r",
    )


_RANKS = {
    "average": "rank() OVER (PARTITION BY gene_id ORDER BY value) + (count(*) OVER (PARTITION BY gene_id, value) - 1) / 2.0",
    "min": "rank() OVER (PARTITION BY gene_id ORDER BY value)",
    "max": "rank() OVER (PARTITION BY gene_id ORDER BY value) + count(*) OVER (PARTITION BY gene_id, value) - 1",
    "dense": "dense_rank() OVER (PARTITION BY gene_id ORDER BY value)",
    "first": "row_number() OVER (PARTITION BY gene_id ORDER BY value, sample_id)",
}


def _register_rank(method, sql):
    @query(f"transform_rank_{method}", _rank_sql(sql))
    def run(t):
        return T.rank_transform(t.expr(), method)


for _m, _s in _RANKS.items():
    _register_rank(_m, _s)


@query(
    "transform_quantile_uniform",
    _matrix_sql(
        "expr",
        f"""r AS (SELECT gene_id, sample_id, {_RANKS['average']} AS rk, count(*) OVER (PARTITION BY gene_id) AS n FROM expr)""",
        "(rk - 1) / (n - 1)",
        "r",
    ),
)
def t_quantile(t):
    return rounded(T.quantile_transform(t.expr()))


@query("transform_quantile_normal")
def t_quantile_normal(t):
    return rounded(T.quantile_transform(t.expr(), "normal"))


_YJ = "CASE WHEN abs({l}) < 1e-12 THEN ln(1 + value) ELSE (pow(value + 1, {l}) - 1) / ({l}) END"


def _lambda_sql(view="expr", formula=_YJ, log="ln(1 + value)"):
    passes, step, prev = [], 1.0, None
    for k in range(7):
        reach = 4 if k else 16
        src = view if prev is None else f"{view} JOIN {prev} USING (gene_id)"
        centre = "0.0::DOUBLE" if prev is None else "lam"
        passes.append(
            f"""c{k} AS (SELECT gene_id, value, i, {centre} + i * {step}::DOUBLE AS l FROM {src}, range({-reach}, {reach + 1}) o(i)),
            l{k} AS (SELECT gene_id, i, l, var_pop({formula.format(l='l')}) AS v, count(*) AS n, sum({log}) AS j FROM c{k} GROUP BY 1, 2, 3),
            b{k} AS (SELECT gene_id, l AS lam FROM (SELECT *, row_number() OVER (PARTITION BY gene_id
                ORDER BY CASE WHEN v > 0 AND v < 1e300 THEN -n / 2.0 * ln(v) + (l - 1) * j END DESC NULLS LAST, i) AS rn FROM l{k}) WHERE rn = 1)"""
        )
        prev = f"b{k}"
        step = step / 4
    return ", ".join(passes), prev


_PASSES, _LAST = _lambda_sql()


@query(
    "transform_yeo_johnson_lambda",
    with_views("expr", f'WITH {_PASSES} SELECT gene_id, round(lam, 6) AS "lambda" FROM {_LAST}'),
)
def yj_lambda(t):
    return rounded(T.power_lambdas(t.expr(), "yeo-johnson"))


@query(
    "transform_yeo_johnson",
    _matrix_sql(
        "expr",
        _PASSES
        + f""", y AS (SELECT gene_id, sample_id, {_YJ.format(l='lam')} AS y FROM expr JOIN {_LAST} USING (gene_id)),
        s AS (SELECT gene_id, avg(y) AS m, stddev_pop(y) AS s FROM y GROUP BY 1)""",
        "(y - m) / s",
        "y JOIN s USING (gene_id)",
    ),
)
def yj(t):
    return rounded(T.transform(t.expr(), "yeo_johnson"))


_BC = "CASE WHEN abs({l}) < 1e-12 THEN ln(value) ELSE (pow(value, {l}) - 1) / ({l}) END"
_BC_PASSES, _BC_LAST = _lambda_sql("counts", _BC, "ln(value)")


@query(
    "transform_box_cox",
    _matrix_sql(
        "counts",
        _BC_PASSES
        + f""", y AS (SELECT gene_id, sample_id, {_BC.format(l='lam')} AS y FROM counts JOIN {_BC_LAST} USING (gene_id)),
        s AS (SELECT gene_id, avg(y) AS m, stddev_pop(y) AS s FROM y GROUP BY 1)""",
        "(y - m) / s",
        "y JOIN s USING (gene_id)",
    ),
)
def box_cox(t):
    return rounded(T.power_transform(t.counts(), "box-cox"))


@query("transform_shapiro_wilk")
def shapiro(t):
    return rounded(T.shapiro_wilk(t.expr()))


@query("transform_normality_scores")
def normality(t):
    return rounded(T.normality_scores(t.expr()))


@query("transform_best_method")
def best(t):
    return rounded(T.best_transformation(t.expr()))


@query(
    "transform_statistics",
    with_views(
        "expr",
        """WITH g AS (SELECT gene_id, skewness(value) AS sk, kurtosis(value) AS ku FROM expr GROUP BY 1)
        SELECT count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (isinf(value)) AS infinite,
        count(*) FILTER (value < 0) AS negative, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
        min(value) AS min, max(value) AS max, (SELECT round(avg(sk), 6) FROM g) AS skewness_mean,
        (SELECT round(stddev_samp(sk), 6) FROM g) AS skewness_std, (SELECT round(avg(ku), 6) FROM g) AS kurtosis_mean,
        (SELECT round(stddev_samp(ku), 6) FROM g) AS kurtosis_std FROM expr""",
    ),
)
def t_stats(t):
    return rounded(T.transformation_stats(t.expr()))


@query(
    "transform_compare",
    with_views(
        "expr",
        f"""WITH u AS (SELECT 'log2' AS method, log2(value + 1) AS value FROM expr UNION ALL
            SELECT 'log10', log10(value + 1) FROM expr UNION ALL SELECT 'sqrt', sqrt(value) FROM expr)
        SELECT method, {_STATS} FROM u GROUP BY 1""",
    ),
)
def t_compare(t):
    return rounded(T.compare_transformations(t.expr(), ["log2", "log10", "sqrt"]))


@query(
    "scalar_sign_log_fold_change",
    with_views(
        "expr samples",
        """WITH m AS (SELECT gene_id, avg(value) FILTER (label = 0) AS m0, avg(value) FILTER (label = 1) AS m1
            FROM expr JOIN samples USING (sample_id) GROUP BY 1)
        SELECT gene_id, round(sign(m1 - m0) * log2(abs(m1 - m0) + 1), 6) AS sign_log,
        round(log2(m1 + 1e-9) - log2(m0 + 1e-9), 6) AS log2fc FROM m""",
    ),
)
def fold_change(t):
    from genemill.functions.columns import log2_fold_change, sign_log
    from genemill.operators.stats import labelled

    d = labelled(t.expr(), t.samples(), "label")
    m = d.groupBy("gene_id").agg(
        F.avg(F.when(F.col("grp") == 0, F.col("value"))).alias("m0"),
        F.avg(F.when(F.col("grp") == 1, F.col("value"))).alias("m1"),
    )
    return rounded(
        m.select(
            "gene_id",
            sign_log(F.col("m1") - F.col("m0")).alias("sign_log"),
            log2_fold_change("m1", "m0").alias("log2fc"),
        )
    )
