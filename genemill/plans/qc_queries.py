"""Quality metrics, filters, validation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from genemill.operators import qc as Q
from genemill.operators import validate as V
from genemill.plans.registry import query, rounded
from genemill.plans.standins import with_views

_M = """count(*) AS {n}, {lib} count(*) FILTER (value > 0) AS detected, round(avg(value), 6) AS mean_expression,
    round(stddev_samp(value), 6) AS std_expression, {var} count(*) FILTER (value IS NULL) AS missing_values,
    count(*) FILTER (value = 0) AS zero_values, round(count(*) FILTER (value > 0) / count(*)::DOUBLE, 6) AS detection_rate,
    round(CASE WHEN avg(value) <> 0 THEN stddev_samp(value) / avg(value) END, 6) AS cv_expression,
    round(count(*) FILTER (value IS NULL) / count(*)::DOUBLE * 100, 6) AS missing_pct,
    round(count(*) FILTER (value = 0) / count(*)::DOUBLE * 100, 6) AS zero_pct"""
_SM = "SELECT sample_id, " + _M.format(n="total_genes", lib="round(sum(value), 6) AS library_size,", var="")
_GM = "SELECT gene_id, " + _M.format(n="total_samples", lib="", var="round(var_samp(value), 6) AS variance,")


@query(
    "qc_data_summary",
    with_views(
        "expr_nulls",
        """WITH s AS (SELECT sample_id, avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.5) AS med
            FROM expr_nulls GROUP BY 1)
        SELECT count(DISTINCT gene_id) AS n_genes, count(DISTINCT sample_id) AS n_samples, count(*) AS total_values,
        count(*) FILTER (value IS NULL) AS missing_values, count(*) FILTER (value = 0) AS zero_values,
        count(*) FILTER (isinf(value)) AS infinite_values, count(*) FILTER (value < 0) AS negative_values,
        min(value) AS min, max(value) AS max, round(count(*) FILTER (value IS NULL) / count(*)::DOUBLE, 6) AS missing_ratio,
        round(count(*) FILTER (value = 0) / count(*)::DOUBLE, 6) AS zero_ratio,
        round(count(*) FILTER (value < 0) / count(*)::DOUBLE, 6) AS negative_ratio,
        (SELECT round(avg(m), 6) FROM s) AS mean, (SELECT round(avg(s), 6) FROM s) AS std,
        (SELECT round(quantile_cont(med, 0.5), 6) FROM s) AS median FROM expr_nulls""",
    ),
)
def data_summary(t):
    return rounded(Q.data_summary(t.expr_nulls()))


@query(
    "qc_sample_metrics",
    with_views(
        "expr_nulls",
        _SM
        + """, round(log2(sum(value) + 1), 6) AS log_library_size,
        round(quantile_cont(value, 0.5), 6) AS median_expression FROM expr_nulls GROUP BY 1""",
    ),
)
def sample_metrics(t):
    return rounded(Q.sample_metrics(t.expr_nulls()))


@query(
    "qc_gene_metrics",
    with_views(
        "expr_nulls",
        _GM + ", round(quantile_cont(value, 0.5), 6) AS median_expression FROM expr_nulls GROUP BY 1",
    ),
)
def gene_metrics(t):
    return rounded(Q.gene_metrics(t.expr_nulls()))


_LONG = f"""s AS (SELECT sample_id AS id, sum(value) AS library_size, avg(value) AS mean_expression,
        count(*) FILTER (value > 0) / count(*)::DOUBLE AS detection_rate FROM expr_nulls GROUP BY 1),
    g AS (SELECT gene_id AS id, avg(value) AS mean_expression, var_samp(value) AS variance,
        count(*) FILTER (value > 0) / count(*)::DOUBLE AS detection_rate FROM expr_nulls GROUP BY 1),
    l AS (SELECT 'sample' AS level, id, metric, value FROM (UNPIVOT s ON {{s}} INTO NAME metric VALUE value)
        UNION ALL SELECT 'gene', id, metric, value FROM (UNPIVOT g ON mean_expression, variance, detection_rate INTO NAME metric VALUE value))"""


@query(
    "qc_distributions",
    with_views(
        "expr_nulls",
        f"""WITH {_LONG.format(s='library_size, detection_rate')}
        SELECT level, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
        round(max(value), 6) AS max, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median,
        round(quantile_cont(value, 0.75), 6) AS q75 FROM l GROUP BY 1, 2""",
    ),
)
def distributions(t):
    return rounded(Q.distributions(t.expr_nulls()))


@query(
    "qc_outliers_iqr",
    with_views(
        "expr_nulls",
        f"""WITH {_LONG.format(s='library_size, detection_rate, mean_expression')},
        q AS (SELECT level, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY 1, 2)
        SELECT level, metric, id, round(value, 6) AS value, round(q1 - 1.5 * (q3 - q1), 6) AS lower,
        round(q3 + 1.5 * (q3 - q1), 6) AS upper FROM l JOIN q USING (level, metric)
        WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
    ),
)
def outliers(t):
    return rounded(Q.outliers(t.expr_nulls()))


@query(
    "qc_quality_flags",
    with_views(
        "expr_sparse",
        f"""WITH s AS ({_SM} FROM expr_sparse GROUP BY 1), g AS ({_GM} FROM expr_sparse GROUP BY 1),
        a AS (SELECT count(*) FILTER (value = 0) / count(*)::DOUBLE * 100 AS z FROM expr_sparse)
        SELECT 'sample' AS level, sample_id AS id, 'high_missing' AS issue, missing_pct AS measured FROM s WHERE missing_pct > 50
        UNION ALL SELECT 'sample', sample_id, 'high_zero', zero_pct FROM s WHERE zero_pct > 90
        UNION ALL SELECT 'sample', sample_id, 'low_library', library_size FROM s WHERE library_size < 1000
        UNION ALL SELECT 'gene', gene_id, 'high_missing', missing_pct FROM g WHERE missing_pct > 50
        UNION ALL SELECT 'gene', gene_id, 'high_zero', zero_pct FROM g WHERE zero_pct > 90
        UNION ALL SELECT 'gene', gene_id, 'zero_variance', variance FROM g WHERE variance = 0
        UNION ALL SELECT 'data', 'all', 'high_zero', round(z, 6) FROM a WHERE z > 80""",
    ),
)
def quality_flags(t):
    return rounded(Q.quality_flags(t.expr_sparse()))


@query(
    "qc_filtering_recommendations",
    with_views(
        "expr_nulls",
        f"""WITH s AS ({_SM} FROM expr_nulls GROUP BY 1), g AS ({_GM} FROM expr_nulls GROUP BY 1)
        SELECT (SELECT round(least(50.0, quantile_cont(missing_pct, 0.95)), 4) FROM s) AS sample_max_missing,
        (SELECT round(least(90.0, quantile_cont(zero_pct, 0.95)), 4) FROM s) AS sample_max_zero,
        (SELECT round(greatest(1000.0, quantile_cont(library_size, 0.05)), 4) FROM s) AS sample_min_library,
        (SELECT round(least(50.0, quantile_cont(missing_pct, 0.95)), 4) FROM g) AS gene_max_missing,
        (SELECT round(least(90.0, quantile_cont(zero_pct, 0.95)), 4) FROM g) AS gene_max_zero,
        (SELECT round(quantile_cont(variance, 0.1), 4) FROM g) AS gene_min_variance,
        greatest(1000.0::DOUBLE, count(DISTINCT gene_id) * 0.1::DOUBLE) AS min_genes_per_sample,
        greatest(5.0::DOUBLE, count(DISTINCT sample_id) * 0.1::DOUBLE) AS min_samples_per_gene,
        least(10000.0::DOUBLE, count(DISTINCT gene_id) * 0.8::DOUBLE) AS min_variance_genes FROM expr_nulls""",
    ),
)
def recommendations(t):
    return rounded(Q.filtering_recommendations(t.expr_nulls()), 4)


def _filter_sql(where_s, where_g, view="expr_nulls"):
    return with_views(
        view,
        f"""WITH s AS ({_SM} FROM {view} GROUP BY 1), g AS ({_GM} FROM {view} GROUP BY 1)
        SELECT gene_id, sample_id, value FROM {view}
        WHERE sample_id IN (SELECT sample_id FROM s WHERE {where_s}) AND gene_id IN (SELECT gene_id FROM g WHERE {where_g})""",
    )


@query(
    "filter_qc_samples_and_genes",
    _filter_sql(
        "missing_pct <= 50 AND zero_pct <= 90 AND library_size >= 1000",
        "missing_pct <= 20 AND zero_pct <= 30 AND variance >= 0",
    ),
)
def filter_qc(t):
    return Q.filter_qc(t.expr_nulls(), gene_max_missing=20, gene_max_zero=30)


@query("filter_low_quality_samples", _filter_sql("library_size >= 2500 AND detected >= 100", "true"))
def filter_samples(t):
    return Q.filter_low_quality_samples(t.expr_nulls(), 2500, 100)


@query("filter_low_quality_genes", _filter_sql("true", "variance >= 350 AND detection_rate >= 0.6"))
def filter_genes(t):
    return Q.filter_low_quality_genes(t.expr_nulls(), 350, 0.6)


@query(
    "filter_sequential_genes",
    _filter_sql(
        "true", "detection_rate >= 0.6 AND variance >= 300 AND missing_values / total_samples <= 0.2"
    ),
)
def filter_seq(t):
    return Q.filter_sequential(t.expr_nulls(), 0.6, 300, 0.2)


@query(
    "filter_shape_change",
    with_views(
        "expr_nulls",
        f"""WITH g AS ({_GM} FROM expr_nulls GROUP BY 1),
        a AS (SELECT * FROM expr_nulls WHERE gene_id IN (SELECT gene_id FROM g WHERE detection_rate >= 0.6
            AND missing_values / total_samples <= 0.5)),
        x AS (SELECT count(DISTINCT gene_id) AS gb, count(DISTINCT sample_id) AS sb FROM expr_nulls),
        y AS (SELECT count(DISTINCT gene_id) AS ga, count(DISTINCT sample_id) AS sa FROM a)
        SELECT gb AS genes_before, sb AS samples_before, ga AS genes_after, sa AS samples_after,
        gb - ga AS genes_removed, sb - sa AS samples_removed FROM x, y""",
    ),
)
def shape(t):
    e = t.expr_nulls()
    return Q.shape_change(e, Q.filter_sequential(e, 0.6))


@query(
    "qc_summary_rules",
    with_views(
        "expr_nulls",
        f"""WITH s AS ({_SM} FROM expr_nulls GROUP BY 1), {_LONG.format(s='library_size, detection_rate, mean_expression').replace('s AS (', 's2 AS (').replace('UNPIVOT s ON', 'UNPIVOT s2 ON')},
        q AS (SELECT level, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY 1, 2),
        o AS (SELECT count(*) AS c FROM l JOIN q USING (level, metric) WHERE level = 'sample'
            AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))),
        e AS (SELECT count(*) FILTER (value IS NULL) / count(*)::DOUBLE AS miss, count(*) FILTER (value = 0) / count(*)::DOUBLE AS zero FROM expr_nulls),
        cv AS (SELECT stddev_samp(library_size) / avg(library_size) AS lib, stddev_samp(detected::DOUBLE / total_genes) / avg(detected::DOUBLE / total_genes) AS det FROM s)
        SELECT 'missing_ratio' AS warning, round(miss, 6) AS measured FROM e WHERE miss > 0.1
        UNION ALL SELECT 'zero_ratio', round(zero, 6) FROM e WHERE zero > 0.8
        UNION ALL SELECT 'library_size_cv', round(lib, 6) FROM cv WHERE lib > 0.5
        UNION ALL SELECT 'detection_rate_cv', round(det, 6) FROM cv WHERE det > 0.3
        UNION ALL SELECT 'sample_outliers', c FROM o WHERE c > 0""",
    ),
)
def qc_summary(t):
    return rounded(Q.qc_summary(t.expr_nulls()).select("warning", "measured"))


@query(
    "validate_drop_all_null",
    with_views(
        "expr_nulls",
        """SELECT gene_id, sample_id, value FROM expr_nulls WHERE gene_id IN (SELECT gene_id FROM expr_nulls WHERE value IS NOT NULL)
        AND sample_id IN (SELECT sample_id FROM expr_nulls WHERE value IS NOT NULL)""",
    ),
)
def drop_null(t):
    return V.drop_all_null(t.expr_nulls())


@query(
    "validate_drop_empty_genes",
    with_views(
        "expr_sparse",
        """SELECT * FROM expr_sparse WHERE gene_id IN
        (SELECT gene_id FROM expr_sparse GROUP BY 1 HAVING max(abs(value)) > 0)""",
    ),
)
def drop_empty(t):
    return V.drop_empty_genes(t.expr_sparse())


@query(
    "join_sample_alignment",
    with_views(
        "expr samples",
        "SELECT sample_id, gene_id, value, label, tier, batch, age FROM expr JOIN samples USING (sample_id)",
    ),
)
def alignment(t):
    return V.align(t.expr(), t.samples())


_HALF = "(SELECT * FROM samples WHERE age >= 1000)"


@query(
    "join_sample_set_differences",
    with_views(
        "expr samples",
        f"""WITH e AS (SELECT DISTINCT sample_id FROM expr), s AS (SELECT DISTINCT sample_id FROM {_HALF}),
        j AS (SELECT e.sample_id AS a, s.sample_id AS b FROM e FULL JOIN s ON e.sample_id = s.sample_id)
        SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS common, count(*) FILTER (b IS NULL) AS expression_only,
        count(*) FILTER (a IS NULL) AS label_only, round(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(a)::DOUBLE, 6) AS overlap_ratio FROM j""",
    ),
)
def overlap(t):
    return rounded(V.sample_overlap(t.expr(), t.samples().filter("age >= 1000")))


@query(
    "set_sample_intersect",
    with_views(
        "expr samples",
        f"SELECT sample_id FROM expr INTERSECT SELECT sample_id FROM {_HALF}",
    ),
)
def intersect(t):
    return t.expr().select("sample_id").intersect(t.samples().filter("age >= 1000").select("sample_id"))


@query(
    "set_sample_except",
    with_views("expr samples", f"SELECT sample_id FROM expr EXCEPT SELECT sample_id FROM {_HALF}"),
)
def except_(t):
    return t.expr().select("sample_id").subtract(t.samples().filter("age >= 1000").select("sample_id"))


@query(
    "agg_class_distribution",
    with_views("samples", "SELECT tier AS class, count(*) AS n FROM samples GROUP BY 1"),
)
def class_distribution(t):
    return V.class_distribution(t.samples(), "tier")


@query(
    "agg_class_balance",
    with_views(
        "samples",
        """WITH c AS (SELECT tier, count(*) AS n FROM samples GROUP BY 1)
        SELECT count(*) AS n_classes, min(n) AS min_class, max(n) AS max_class,
        round(max(n) / min(n)::DOUBLE, 6) AS imbalance_ratio, round(min(n) / max(n)::DOUBLE, 6) AS balance_ratio FROM c""",
    ),
)
def class_balance(t):
    return rounded(V.class_balance(t.samples(), "tier"))


@query(
    "agg_duplicate_counting",
    """SELECT CAST((SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_partkey, l_suppkey)) AS BIGINT) AS duplicate_cells,
    (SELECT count(*) - count(DISTINCT o_custkey) FROM orders) AS duplicate_samples""",
)
def duplicates(t):
    cells = t.lineitem.select(F.col("l_partkey").alias("gene_id"), F.col("l_suppkey").alias("sample_id"))
    return V.duplicates(cells, t.orders.select(F.col("o_custkey").alias("sample_id")))


@query(
    "agg_distinct_members",
    with_views(
        "expr samples",
        """SELECT count(DISTINCT gene_id) AS n_genes, count(DISTINCT sample_id) AS n_samples,
        (SELECT count(DISTINCT tier) FROM samples) AS n_labels FROM expr""",
    ),
)
def distinct_members(t):
    labels = t.samples().agg(F.count_distinct("tier").alias("n")).scalar()
    return t.expr().agg(
        F.count_distinct("gene_id").alias("n_genes"), F.count_distinct("sample_id").alias("n_samples")
    ).withColumn("n_labels", labels)


@query(
    "validate_integrity_issues",
    with_views(
        "expr_nulls samples",
        f"""WITH e AS (SELECT DISTINCT sample_id FROM expr_nulls), s AS (SELECT DISTINCT sample_id FROM {_HALF}),
        m AS (SELECT count(*) FILTER (value IS NULL) / count(*)::DOUBLE * 100 AS m FROM expr_nulls)
        SELECT 'expression_only_samples' AS "check", 'warning' AS severity, CAST(count(*) AS DOUBLE) AS measured FROM e
            WHERE sample_id NOT IN (SELECT sample_id FROM s) HAVING count(*) > 0
        UNION ALL SELECT 'high_missing_values', 'warning', round(m, 6) FROM m WHERE m > 20 AND m <= 50
        UNION ALL SELECT 'several_batches', 'warning', count(DISTINCT batch) FROM {_HALF}""",
    ),
)
def integrity(t):
    return rounded(V.integrity_issues(t.expr_nulls(), t.samples().filter("age >= 1000"), "label", "batch"))


_SIX = f"""WITH e AS (SELECT DISTINCT sample_id FROM expr_nulls), s AS (SELECT DISTINCT sample_id FROM {_HALF}),
    o AS (SELECT count(*) FILTER (s.sample_id IS NOT NULL) / count(*)::DOUBLE AS r FROM e LEFT JOIN s USING (sample_id)),
    f AS (SELECT count(*) AS n, count(*) FILTER (value IS NULL) / count(*)::DOUBLE * 100 AS miss, count(*) FILTER (value < 0) AS neg FROM expr_nulls),
    v AS (SELECT count(*) FILTER (v = 0) AS flat FROM (SELECT var_samp(value) AS v FROM expr_nulls GROUP BY gene_id)),
    c AS (SELECT max(n) / min(n)::DOUBLE AS r, min(n) AS mn FROM (SELECT count(*) AS n FROM {_HALF} GROUP BY label)),
    k AS (SELECT 'data_types' AS "check", 'passed' AS status, CAST(n AS DOUBLE) AS measured FROM f
    UNION ALL SELECT 'sample_intersection', CASE WHEN r < 1 THEN 'warning' ELSE 'passed' END, round(r, 6) FROM o
    UNION ALL SELECT 'duplicates', 'passed', 0
    UNION ALL SELECT 'missing_values', CASE WHEN miss > 10 THEN 'warning' ELSE 'passed' END, round(miss, 6) FROM f
    UNION ALL SELECT 'data_quality', CASE WHEN neg + flat > 0 THEN 'warning' ELSE 'passed' END, neg + flat FROM f, v
    UNION ALL SELECT 'label_distribution', CASE WHEN r > 3 OR mn < 5 THEN 'warning' ELSE 'passed' END, round(r, 6) FROM c)"""


@query("validate_six_checks", with_views("expr_nulls samples", _SIX + " SELECT * FROM k"))
def six(t):
    return rounded(V.six_checks(t.expr_nulls(), t.samples().filter("age >= 1000")))


@query(
    "validate_overall_status",
    with_views(
        "expr_nulls samples",
        _SIX
        + """ SELECT CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'passed' END AS status,
        count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'warning') AS n_warning FROM k""",
    ),
)
def status(t):
    return V.overall_status(V.six_checks(t.expr_nulls(), t.samples().filter("age >= 1000")))


@query(
    "validate_expression_upload",
    """SELECT count(*) AS n_rows, 0.0::DOUBLE AS missing_pct, count(*) FILTER (p_size < 0) + count(*) FILTER (p_retailprice < 0) AS negatives,
    count(*) FILTER (p_size = 0) + count(*) FILTER (p_retailprice = 0) AS zeros, least(min(p_size), min(p_retailprice)) AS min,
    greatest(max(p_size), max(p_retailprice)) AS max, true AS has_gene_column,
    count(*) - count(DISTINCT (p_name, p_size, p_retailprice)) AS duplicate_rows, 0 AS duplicate_columns, false AS missing_warning FROM part""",
)
def upload(t):
    return rounded(V.expression_upload_check(t.part.select("p_name", "p_size", "p_retailprice"), "p_name"))


@query(
    "validate_clinical_upload",
    """SELECT count(*) AS n_rows, count(*) - count(DISTINCT c_custkey) AS duplicate_samples,
    0.0::DOUBLE AS missing_pct, true AS has_sample_id, 3 AS numeric_columns, 2 AS text_columns, false AS missing_warning FROM customer""",
)
def clinical(t):
    return V.clinical_upload_check(t.customer, "c_custkey")


@query(
    "validate_raw_counts",
    with_views(
        "expr_nulls samples",
        """SELECT 'not_numeric' AS "check", 'error' AS severity, CAST(count(*) AS DOUBLE) AS measured
        FROM expr_nulls WHERE value IS NULL HAVING count(*) > 0""",
    ),
)
def raw_counts(t):
    return V.raw_count_issues(t.expr_nulls(), t.samples(), "label")


@query(
    "validate_count_matrix",
    with_views(
        "expr_fine",
        """WITH c AS (SELECT gene_id, sample_id, CAST(round_even(value, 0) AS BIGINT) AS count FROM expr_fine)
        SELECT * FROM c WHERE gene_id IN (SELECT gene_id FROM c GROUP BY 1 HAVING max(count) > 0 AND sum(count) >= 700)""",
    ),
)
def count_matrix(t):
    return V.count_matrix(t.expr_fine(), 700)


@query(
    "validate_label_codes",
    with_views(
        "samples",
        """SELECT sample_id, tier, CAST(dense_rank() OVER (ORDER BY tier) - 1 AS INT) AS code FROM samples""",
    ),
)
def label_codes(t):
    from genemill.functions.columns import encode_labels

    return encode_labels(t.samples().select("sample_id", "tier"), "tier")


@query(
    "validate_label_discovery",
    with_views("samples", "SELECT sample_id, label AS y FROM samples"),
)
def discovery(t):
    s = t.samples()
    sample_col, label_col = V.discover_columns(s)
    return s.select(F.col(sample_col).alias("sample_id"), F.col(label_col).alias("y"))


@query(
    "validate_table_summary",
    """SELECT count(*) AS n_rows, 4 AS n_columns, count(*) FILTER (quality IS NULL) + count(*) FILTER (toxic IS NULL) AS missing_cells,
    count(*) - count(DISTINCT (doc_id, source, quality, toxic)) AS duplicate_rows, true AS valid,
    count(*) FILTER (quality IS NULL) + count(*) FILTER (toxic IS NULL) > 0.5 * count(*) AS many_missing
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def table_summary(t):
    j = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return V.table_summary(j, "doc_id")


@query(
    "scalar_one_hot",
    with_views(
        "samples",
        """SELECT sample_id, batch, CASE WHEN batch = 'AFRICA' THEN 1 ELSE 0 END AS "batch_AFRICA",
        CASE WHEN batch = 'AMERICA' THEN 1 ELSE 0 END AS "batch_AMERICA", CASE WHEN batch = 'ASIA' THEN 1 ELSE 0 END AS "batch_ASIA",
        CASE WHEN batch = 'EUROPE' THEN 1 ELSE 0 END AS "batch_EUROPE",
        CASE WHEN batch = 'MIDDLE EAST' THEN 1 ELSE 0 END AS "batch_MIDDLE EAST" FROM samples""",
    ),
)
def one_hot(t):
    from genemill.functions.columns import one_hot as hot

    return hot(t.samples().select("sample_id", "batch"), "batch")
