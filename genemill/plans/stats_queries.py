"""Per-gene tests, p-value correction, volcano rows and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from genemill.operators import normalize, padjust, stats
from genemill.plans.registry import query, rounded
from genemill.plans.standins import (
    sql_chi2_even,
    sql_f_sf_df1_2,
    sql_normal_two_sided,
    sql_t_two_sided,
    with_views,
)


_TWO = """SELECT gene_id, count(*) FILTER (label = 0) AS n1, count(*) FILTER (label = 1) AS n2,
    avg(value) FILTER (label = 0) AS mean1, avg(value) FILTER (label = 1) AS mean2,
    var_samp(value) FILTER (label = 0) AS var1, var_samp(value) FILTER (label = 1) AS var2
    FROM {t} JOIN samples USING (sample_id) WHERE value IS NOT NULL GROUP BY gene_id"""

_TTEST = f"""m AS ({_TWO.format(t='expr')}),
    s AS (SELECT *, ((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2) AS sp,
        CAST(n1 + n2 - 2 AS DOUBLE) AS df FROM m),
    r AS (SELECT gene_id, n1, n2, mean1, mean2, df, sqrt(var1) AS std1, sqrt(var2) AS std2,
        (mean1 - mean2) / sqrt(sp * (1.0 / n1 + 1.0 / n2)) AS statistic,
        (mean1 - mean2) / sqrt(sp) AS effect_size FROM s),
    tt AS (SELECT *, {sql_t_two_sided('statistic', 'df')} AS p_value FROM r)"""

_LOGCPM = """lib AS (SELECT sample_id, sum(value) AS lib FROM counts GROUP BY 1),
    logcpm AS (SELECT gene_id, sample_id, log2(value * 1e6 / lib + 1) AS value
        FROM counts JOIN lib USING (sample_id))"""

_WELCH = f"""m AS ({_TWO.format(t='{t}')}),
    v AS (SELECT *, var1 / n1 AS a, var2 / n2 AS b FROM m),
    r AS (SELECT gene_id, n1, n2, mean1, mean2, (mean1 - mean2) / sqrt(a + b) AS statistic,
        (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) AS df,
        log2(mean2 + 1e-9) - log2(mean1 + 1e-9) AS log2fc FROM v),
    w AS (SELECT *, {sql_t_two_sided('statistic', 'df')} AS p_value FROM r)"""

# BH over the column p of a table, as SQL: smallest p * m / rank from the current rank upwards
_BH = """(SELECT *, least(1.0, min(p_value * m / rk) OVER (ORDER BY p_value DESC, gene_id DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj
    FROM (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p_value)
        + count(*) OVER (PARTITION BY p_value) - 1 AS rk FROM {t}))"""


@query(
    "flagship_welch_ranking",
    with_views(
        "counts samples",
        f"""WITH {_LOGCPM}, {_WELCH.replace('{t}', 'logcpm')}, a AS {_BH.format(t='w')}
        SELECT gene_id, n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2,
        round(log2fc, 6) AS log2fc, round(p_value, 6) AS p_value, round(p_adj, 6) AS fdr,
        row_number() OVER (ORDER BY p_value, gene_id) AS rank FROM a ORDER BY p_value, gene_id LIMIT 50""",
    ),
)
def flagship(t):
    expr = normalize.log_cpm(t.counts())
    res = stats.welch_test(expr, t.samples(), "label")
    from genemill.operators.distributed import ordinal_ranks

    top = res.orderBy("p_value", "gene_id").limit(50)
    top = ordinal_ranks(top, [], "p_value", "gene_id", "rank", small=True)
    return rounded(
        top.select("gene_id", "n1", "n2", "mean1", "mean2", "log2fc", "p_value", "fdr", "rank")
    )


@query(
    "stats_t_test",
    with_views(
        "expr samples",
        f"""WITH {_TTEST} SELECT gene_id, n1, n2, df, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2,
        round(std1, 6) AS std1, round(std2, 6) AS std2, round(statistic, 6) AS statistic,
        round(effect_size, 6) AS effect_size, round(p_value, 6) AS p_value FROM tt""",
    ),
)
def t_test(t):
    return rounded(stats.t_test(t.expr(), t.samples(), "label"))


@query(
    "stats_welch_simple_fdr",
    with_views(
        "expr samples",
        f"""WITH {_WELCH.replace('{t}', 'expr')} SELECT gene_id, n1, n2, round(mean1, 6) AS mean1,
        round(mean2, 6) AS mean2, round(statistic, 6) AS statistic, round(df, 6) AS df,
        round(log2fc, 6) AS log2fc, round(p_value, 6) AS p_value,
        round(least(1.0, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, gene_id)), 6) AS fdr
        FROM w""",
    ),
)
def welch(t):
    res = stats.welch_test(t.expr(), t.samples(), "label", simple=True)
    return rounded(
        res.select(
            "gene_id", "n1", "n2", "mean1", "mean2", "statistic", "df", "log2fc", "p_value", "fdr"
        )
    )


@query(
    "stats_paired_t_test",
    with_views(
        "omics",
        f"""WITH d AS (SELECT a.gene_id, a.value / 10 - b.value * 10 AS d FROM omics a JOIN omics b USING (gene_id, sample_id)
            WHERE a.layer = 'expression' AND b.layer = 'methylation'),
        m AS (SELECT gene_id, count(*) AS n, avg(d) AS mean_diff, stddev_samp(d) AS std_diff FROM d GROUP BY 1),
        s AS (SELECT *, mean_diff / (std_diff / sqrt(n)) AS statistic, CAST(n - 1 AS DOUBLE) AS df FROM m)
        SELECT gene_id, n, df, round(mean_diff, 6) AS mean_diff, round(std_diff, 6) AS std_diff,
        round(statistic, 6) AS statistic, round({sql_t_two_sided('statistic', 'df')}, 6) AS p_value FROM s""",
    ),
)
def paired(t):
    om = t.omics()
    one = om.filter("layer = 'expression'").select("gene_id", "sample_id", (F.col("value") / 10).alias("value1"))
    two = om.filter("layer = 'methylation'").select("gene_id", "sample_id", (F.col("value") * 10).alias("value2"))
    return rounded(stats.paired_t_test(one.join(two, ["gene_id", "sample_id"])))


_RANKED = """d AS (SELECT gene_id, value, {g} AS grp FROM expr JOIN samples USING (sample_id)),
    rk AS (SELECT *, rank() OVER (PARTITION BY gene_id ORDER BY value)
        + (count(*) OVER (PARTITION BY gene_id, value) - 1) / 2.0 AS rank FROM d),
    ties AS (SELECT gene_id, sum(c * c * c - c) AS tie FROM
        (SELECT gene_id, value, CAST(count(*) AS DOUBLE) AS c FROM d GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "stats_mann_whitney",
    with_views(
        "expr samples",
        f"""WITH {_RANKED.format(g='label')},
        s AS (SELECT gene_id, count(*) FILTER (grp = 0) AS n1, count(*) FILTER (grp = 1) AS n2,
            CAST(sum(rank) FILTER (grp = 0) AS DOUBLE) AS r1, avg(value) FILTER (grp = 0) AS mean1,
            avg(value) FILTER (grp = 1) AS mean2, quantile_cont(value, 0.5) FILTER (grp = 0) AS median1,
            quantile_cont(value, 0.5) FILTER (grp = 1) AS median2 FROM rk GROUP BY 1),
        u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS statistic FROM s JOIN ties USING (gene_id)),
        z AS (SELECT *, (greatest(statistic, n1 * n2 - statistic) - n1 * n2 / 2.0 - 0.5)
            / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - tie / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z FROM u)
        SELECT gene_id, n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, median1, median2,
        statistic, round(2 * statistic / (n1 * n2) - 1, 6) AS effect_size,
        round(CASE WHEN z > 0 THEN {sql_normal_two_sided('z')} ELSE 1.0 END, 6) AS p_value FROM z""",
    ),
)
def mann_whitney(t):
    return rounded(stats.mann_whitney(t.expr(), t.samples(), "label"))


@query(
    "stats_anova",
    with_views(
        "expr samples",
        f"""WITH d AS (SELECT gene_id, tier, value FROM expr JOIN samples USING (sample_id)),
        g AS (SELECT gene_id, tier, count(*) AS n, avg(value) AS mean, var_samp(value) AS v FROM d GROUP BY 1, 2),
        gm AS (SELECT gene_id, avg(value) AS gmean FROM d GROUP BY 1),
        s AS (SELECT gene_id, count(*) AS k, CAST(sum(n) AS BIGINT) AS n_total, sum((n - 1) * v) AS ss_within,
            sum(n * pow(mean - gmean, 2)) AS ss_between FROM g JOIN gm USING (gene_id) GROUP BY 1),
        f AS (SELECT *, (ss_between / 2) / (ss_within / (n_total - 3)) AS statistic FROM s)
        SELECT gene_id, k, n_total, round(ss_within, 3) AS ss_within, round(ss_between, 3) AS ss_between,
        round(statistic, 6) AS statistic, round({sql_f_sf_df1_2('statistic', '(n_total - 3)')}, 6) AS p_value,
        round(ss_between / (ss_between + ss_within), 6) AS effect_size FROM f""",
    ),
)
def anova(t):
    res = stats.anova(t.expr(), t.samples(), "tier")
    return rounded(
        res.withColumn("ss_within", F.round("ss_within", 3)).withColumn(
            "ss_between", F.round("ss_between", 3)
        )
    )


@query(
    "stats_kruskal",
    with_views(
        "expr samples",
        f"""WITH {_RANKED.format(g='tier')},
        g AS (SELECT gene_id, grp, count(*) AS n, CAST(sum(rank) AS DOUBLE) AS r FROM rk GROUP BY 1, 2),
        s AS (SELECT gene_id, count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(r * r / n) AS q FROM g GROUP BY 1),
        h AS (SELECT gene_id, k, n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS h
            FROM s JOIN ties USING (gene_id))
        SELECT gene_id, k, CAST(n AS BIGINT) AS n_total, round(h, 6) AS statistic,
        round({sql_chi2_even('h', 2)}, 6) AS p_value, round(greatest(0, (h - k + 1) / (n - k)), 6) AS effect_size FROM h""",
    ),
)
def kruskal(t):
    return rounded(stats.kruskal(t.expr(), t.samples(), "tier"))


_CORR_P = f"""SELECT gene_id, n, round(mean, 6) AS mean, round(std, 6) AS std, round(r, 6) AS statistic,
    round({sql_t_two_sided('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')}, 6) AS p_value FROM c"""


@query(
    "stats_correlation_pearson",
    with_views(
        "expr samples",
        f"""WITH c AS (SELECT gene_id, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std,
        corr(value, age) AS r FROM expr JOIN samples USING (sample_id) GROUP BY 1) {_CORR_P}""",
    ),
)
def pearson(t):
    return rounded(stats.correlation(t.expr(), t.samples(), "age"))


@query(
    "stats_correlation_spearman",
    with_views(
        "expr samples",
        f"""WITH d AS (SELECT gene_id, value, age,
            rank() OVER (PARTITION BY gene_id ORDER BY value) + (count(*) OVER (PARTITION BY gene_id, value) - 1) / 2.0::DOUBLE AS rx,
            rank() OVER (PARTITION BY gene_id ORDER BY age) + (count(*) OVER (PARTITION BY gene_id, age) - 1) / 2.0::DOUBLE AS ry
            FROM expr JOIN samples USING (sample_id)),
        c AS (SELECT gene_id, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std,
            corr(rx, ry) AS r FROM d GROUP BY 1) {_CORR_P}""",
    ),
)
def spearman(t):
    return rounded(stats.correlation(t.expr(), t.samples(), "age", method="spearman"))


@query(
    "stats_regression",
    with_views(
        "expr samples",
        f"""WITH g AS (SELECT gene_id, count(*) AS n, regr_slope(age, value) AS slope,
            regr_intercept(age, value) AS intercept, regr_r2(age, value) AS r2
            FROM expr JOIN samples USING (sample_id) GROUP BY 1),
        f AS (SELECT *, r2 / (1 - r2) * (n - 2) AS f FROM g)
        SELECT gene_id, n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r_squared,
        round(f, 6) AS statistic, round({sql_t_two_sided('sqrt(f)', '(n - 2)')}, 6) AS p_value FROM f""",
    ),
)
def regression(t):
    res = stats.regression(t.expr(), t.samples(), "age")
    return rounded(res.withColumn("intercept", F.round("intercept", 4)))


@query(
    "stats_differential_expression",
    with_views(
        "expr samples",
        f"""WITH {_TTEST}, a AS {_BH.format(t='tt')}
        SELECT gene_id, 't_test' AS method, round(p_value, 6) AS p_value, round(p_adj, 6) AS p_adj,
        p_value < 0.05 AS significant, p_adj < 0.05 AS significant_adj FROM a""",
    ),
)
def de(t):
    res = stats.differential_expression(t.expr(), t.samples(), "label", "t_test")
    return rounded(
        res.select("gene_id", "method", "p_value", "p_adj", "significant", "significant_adj")
    )


@query(
    "stats_significant_features",
    with_views(
        "expr samples",
        f"WITH {_TTEST} SELECT gene_id, round(p_value, 6) AS p_value FROM tt WHERE p_value < 0.05",
    ),
)
def significant(t):
    res = stats.differential_expression(t.expr(), t.samples(), "label", "t_test")
    return rounded(res.filter("significant").select("gene_id", "p_value"))


def _volcano_sql(rule, x):
    return with_views(
        "expr samples",
        f"""WITH {_TTEST}, a AS {_BH.format(t='tt')}, v AS (SELECT *, {x} AS x FROM a)
        SELECT gene_id, round(x, 6) AS x, round(-log10(p_adj + 1e-10), 5) AS neg_log10_p,
        (p_adj < 0.3 AND {rule}) AS significant FROM v""",
    )


@query(
    "stats_volcano_t_test",
    _volcano_sql(
        "abs(x) >= log2(1.5)", "sign(mean1 - mean2) * log2(abs(mean1 - mean2) + 1)"
    ),
)
def volcano(t):
    res = stats.differential_expression(t.expr(), t.samples(), "label", "t_test")
    v = stats.volcano_rows(res, "t_test", p_threshold=0.3)
    return rounded(v.withColumn("neg_log10_p", F.round("neg_log10_p", 5)))


# Bodies of the other tests, unrounded, for their volcano rows.
_WILCOXON_BODY = f"""{_RANKED.format(g='label')},
    s AS (SELECT gene_id, count(*) FILTER (grp = 0) AS n1, count(*) FILTER (grp = 1) AS n2,
        CAST(sum(rank) FILTER (grp = 0) AS DOUBLE) AS r1, quantile_cont(value, 0.5) FILTER (grp = 0) AS median1,
        quantile_cont(value, 0.5) FILTER (grp = 1) AS median2 FROM rk GROUP BY 1),
    u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS statistic FROM s JOIN ties USING (gene_id)),
    z AS (SELECT *, (greatest(statistic, n1 * n2 - statistic) - n1 * n2 / 2.0 - 0.5)
        / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - tie / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z FROM u),
    tt AS (SELECT *, CASE WHEN z > 0 THEN {sql_normal_two_sided('z')} ELSE 1.0 END AS p_value FROM z)"""
_ANOVA_BODY = f"""d AS (SELECT gene_id, tier, value FROM expr JOIN samples USING (sample_id)),
    g AS (SELECT gene_id, tier, count(*) AS n, avg(value) AS mean, var_samp(value) AS v FROM d GROUP BY 1, 2),
    gm AS (SELECT gene_id, avg(value) AS gmean FROM d GROUP BY 1),
    s AS (SELECT gene_id, CAST(sum(n) AS BIGINT) AS n_total, sum((n - 1) * v) AS ss_within,
        sum(n * pow(mean - gmean, 2)) AS ss_between FROM g JOIN gm USING (gene_id) GROUP BY 1),
    f AS (SELECT *, (ss_between / 2) / (ss_within / (n_total - 3)) AS statistic FROM s),
    tt AS (SELECT *, {sql_f_sf_df1_2('statistic', '(n_total - 3)')} AS p_value,
        ss_between / (ss_between + ss_within) AS effect_size FROM f)"""
_KRUSKAL_BODY = f"""{_RANKED.format(g='tier')},
    g AS (SELECT gene_id, grp, count(*) AS n, CAST(sum(rank) AS DOUBLE) AS r FROM rk GROUP BY 1, 2),
    s AS (SELECT gene_id, count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(r * r / n) AS q FROM g GROUP BY 1),
    h AS (SELECT gene_id, k, n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS h
        FROM s JOIN ties USING (gene_id)),
    tt AS (SELECT gene_id, {sql_chi2_even('h', 2)} AS p_value, greatest(0, (h - k + 1) / (n - k)) AS effect_size FROM h)"""
_CORRELATION_BODY = f"""c AS (SELECT gene_id, count(*) AS n, corr(value, age) AS r FROM expr JOIN samples USING (sample_id) GROUP BY 1),
    tt AS (SELECT *, {sql_t_two_sided('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')} AS p_value FROM c)"""
_REGRESSION_BODY = f"""g AS (SELECT gene_id, count(*) AS n, regr_slope(age, value) AS slope, regr_r2(age, value) AS r2
        FROM expr JOIN samples USING (sample_id) GROUP BY 1),
    f AS (SELECT *, r2 / (1 - r2) * (n - 2) AS f FROM g),
    tt AS (SELECT *, {sql_t_two_sided('sqrt(f)', '(n - 2)')} AS p_value FROM f)"""


def _register_volcano(kind, label, body, x, rule):
    sql = with_views(
        "expr samples",
        f"""WITH {body}, a AS {_BH.format(t='tt')}, v AS (SELECT *, {x} AS x FROM a)
        SELECT gene_id, round(x, 6) AS x, round(-log10(p_adj + 1e-10), 5) AS neg_log10_p,
        coalesce(p_adj < 0.9 AND {rule}, false) AS significant FROM v""",
    )

    @query(f"stats_volcano_{kind}", sql)
    def run(t):
        res = stats.differential_expression(t.expr(), t.samples(), label, kind)
        v = stats.volcano_rows(res, kind, p_threshold=0.9)
        return rounded(v.withColumn("neg_log10_p", F.round("neg_log10_p", 5)))


_register_volcano(
    "wilcoxon", "label", _WILCOXON_BODY, "sign(median1 - median2) * log2(abs(median1 - median2) + 1)", "abs(x) >= log2(1.5)"
)
_register_volcano("anova", "tier", _ANOVA_BODY, "effect_size", "x >= 0.1")
_register_volcano("kruskal", "tier", _KRUSKAL_BODY, "effect_size", "x >= 0.1")
_register_volcano("correlation", "age", _CORRELATION_BODY, "r", "abs(x) >= 0.3")
_register_volcano("regression", "age", _REGRESSION_BODY, "coalesce(slope, 0.0)", "true")


@query(
    "stats_rank_features",
    with_views(
        "expr samples",
        f"""WITH {_TTEST}, a AS {_BH.format(t='tt')},
        sc AS (SELECT gene_id, -log10(p_value + 1e-10) * abs(effect_size) AS score FROM a)
        SELECT gene_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, gene_id) AS rank
        FROM sc ORDER BY score DESC, gene_id LIMIT 50""",
    ),
)
def rank_features(t):
    res = stats.t_test(t.expr(), t.samples(), "label")
    ranked = stats.rank_features(res, "combined", 50, p="p_value")
    return rounded(ranked.select("gene_id", "score", "rank"))


@query(
    "stats_analysis_summary",
    with_views(
        "expr samples",
        f"""WITH {_TTEST}, a AS {_BH.format(t='tt')}
        SELECT 't_test' AS method, count(*) AS n_genes, count(*) FILTER (p_value < 0.05) AS n_significant,
        count(*) FILTER (p_adj < 0.05) AS n_significant_adj, round(min(p_value), 6) AS min_p FROM a""",
    ),
)
def summary(t):
    return rounded(
        stats.analysis_summary(stats.differential_expression(t.expr(), t.samples(), "label"))
    )


@query("stats_auto_methods")
def auto_methods(t):
    """Test names chosen from the label column, all run, tagged by method."""
    samples = t.samples()
    n_classes = samples.agg(F.count_distinct("label")).first()[0]
    parts = [
        stats.differential_expression(t.expr(), samples, "label", m).select(
            "method", "gene_id", "statistic", "p_value", "p_adj", "effect_size"
        )
        for m in stats.choose_methods(n_classes)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


@query(
    "stats_de_filter_summary",
    with_views(
        "expr_fine samples results",
        """SELECT count(*) AS n, count(*) FILTER (log2fc > 0) AS n_up, count(*) FILTER (log2fc < 0) AS n_down,
        round(avg(log2fc), 6) AS mean_log2fc, round(quantile_cont(p_value, 0.5), 6) AS median_p
        FROM results WHERE p_value <= 0.5 AND abs(log2fc) >= 0.5""",
    ),
)
def de_summary(t):
    return rounded(stats.de_filter_summary(t.results(), 0.5, 0.5))


# ---- correction methods over the result table -------------------------------------------------

_M = """r AS (SELECT gene, p_value AS p FROM results),
    t AS (SELECT p, count(*) AS c FROM r GROUP BY p),
    u AS (SELECT p, c, sum(c) OVER (ORDER BY p) AS cum, (SELECT count(*) FROM r) AS m FROM t)"""

_STEPS = {
    "bonferroni": "p * m",
    "sidak": "1 - pow(1 - p, m)",
    "fdr_bh": "min(p * m / cum) OVER (ORDER BY p DESC)",
    "fdr_by": "min(p * m / cum) OVER (ORDER BY p DESC) * (SELECT sum(1.0::DOUBLE / i) FROM range(1, (SELECT count(*) + 1 FROM r)) x(i))",
    "holm": "max((m - cum + c) * p) OVER (ORDER BY p)",
    "holm-sidak": "max(1 - pow(1 - p, m - cum + c)) OVER (ORDER BY p)",
    "simes-hochberg": "min((m - cum + 1) * p) OVER (ORDER BY p DESC)",
    "fdr_gbs": "max(CASE WHEN p >= 1 THEN 1 ELSE (m - cum + c) / (cum - c + 1) * p / (1 - p) END) OVER (ORDER BY p)",
}


def _padj_sql(step):
    return with_views(
        "results",
        f"""WITH {_M}, s AS (SELECT p, CAST({step} AS DOUBLE) AS raw FROM u)
        SELECT gene, p AS p_value, round(least(1.0::DOUBLE, raw), 6) AS p_adj FROM r JOIN s USING (p)""",
    )


def _register_padj(method, step):
    @query("padjust_" + method.replace("-", "_"), _padj_sql(step))
    def run(t):
        return rounded(
            padjust.adjust_p(t.results().select("gene", "p_value"), "p_value", method, "p_adj")
        )

    return run


for _name, _step in _STEPS.items():
    _register_padj(_name, _step)


def _two_stage_sql(factor, alpha=0.05):
    return with_views(
        "results",
        f"""WITH {_M}, s AS (SELECT p, c, m, min(p * m / cum) OVER (ORDER BY p DESC) AS raw FROM u),
        h AS (SELECT coalesce(sum(c) FILTER (raw <= {alpha} / {factor}), 0) AS r1 FROM s)
        SELECT gene, p AS p_value, round(least(1.0::DOUBLE, raw * {factor}
            * CASE WHEN r1 = 0 OR r1 = m THEN 1.0::DOUBLE ELSE (m - r1) / m END), 6) AS p_adj
        FROM r JOIN s USING (p), h""",
    )


@query("padjust_fdr_tsbh", _two_stage_sql("1.0::DOUBLE"))
def tsbh(t):
    return rounded(padjust.adjust_p(t.results().select("gene", "p_value"), "p_value", "fdr_tsbh"))


@query("padjust_fdr_tsbky", _two_stage_sql("1.05::DOUBLE"))
def tsbky(t):
    return rounded(padjust.adjust_p(t.results().select("gene", "p_value"), "p_value", "fdr_tsbky"))


@query("padjust_hommel")
def hommel(t):
    return rounded(
        padjust.adjust_p(
            t.results().select("run_id", "gene", "p_value"), "p_value", "hommel", keys=["run_id"]
        )
    )


@query(
    "padjust_none",
    with_views("results", "SELECT gene, p_value, p_value AS p_adj FROM results"),
)
def no_correction(t):
    return padjust.adjust_p(t.results().select("gene", "p_value"), "p_value", "none")
