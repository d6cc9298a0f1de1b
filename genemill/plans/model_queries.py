"""Feature selection, model fits and evaluation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from genemill.operators import evaluate as E
from genemill.operators import models as M
from genemill.operators import selection as S
from genemill.operators.distributed import reuse
from genemill.plans.registry import query, rounded
from genemill.plans.standins import sql_normal_two_sided, sql_t_two_sided, with_views

# ---- filter scores -------------------------------------------------------------------------

_D = "d AS (SELECT gene_id, sample_id, value, label, tier, age FROM expr JOIN samples USING (sample_id))"
_VAR = "SELECT gene_id AS feature, var_samp(value) AS score FROM expr GROUP BY 1"
_F = """SELECT gene_id AS feature, (ssb / (k - 1)) / (ssw / (n - k)) AS score FROM (SELECT gene_id, count(*) AS k, sum(c) AS n,
    sum((c - 1) * v) AS ssw, sum(c * pow(m - gm, 2)) AS ssb FROM
    (SELECT gene_id, tier, count(*) AS c, avg(value) AS m, var_samp(value) AS v FROM d GROUP BY 1, 2)
    JOIN (SELECT gene_id, avg(value) AS gm FROM d GROUP BY 1) USING (gene_id) GROUP BY 1)"""
_COR = """SELECT gene_id AS feature, abs(corr(value, code)) AS score
    FROM (SELECT *, dense_rank() OVER (ORDER BY tier) - 1 AS code FROM d) GROUP BY 1"""
_MI = """SELECT gene_id AS feature, greatest(0, sum(nxy / n * ln(nxy * n / (nx * ny)))) AS score FROM
    (SELECT *, sum(nxy) OVER (PARTITION BY gene_id, bin) AS nx, sum(nxy) OVER (PARTITION BY gene_id, tier) AS ny,
        sum(nxy) OVER (PARTITION BY gene_id) AS n FROM
        (SELECT gene_id, tier, CASE WHEN hi > lo THEN least(9, floor((value - lo) / (hi - lo) * 10)) ELSE 0 END AS bin, count(*)::DOUBLE AS nxy
            FROM d JOIN (SELECT gene_id, min(value) AS lo, max(value) AS hi FROM d GROUP BY 1) USING (gene_id) GROUP BY 1, 2, 3)) GROUP BY 1"""
_PSI = "(-0.5772156649015329 + coalesce(list_sum([1.0 / i FOR i IN range(1, CAST({n} AS BIGINT))]), 0))"
_KNN = f"""SELECT feature, greatest(0, {_PSI.format(n='n')} + pk - pc - pm) AS score FROM
    (SELECT gene_id AS feature, count(*) AS n, avg({_PSI.format(n='k')}) AS pk, avg({_PSI.format(n='c')}) AS pc, avg({_PSI.format(n='m')}) AS pm
    FROM (SELECT r.gene_id, r.sample_id, any_value(r.k) AS k, any_value(r.c) AS c,
        count(*) FILTER (abs(o.value - r.value) < r.dist OR (r.dist = 0 AND o.value = r.value)) AS m
        FROM (SELECT *, least(3, c - 1) AS k, near[CAST(least(3, c - 1) AS BIGINT)] AS dist FROM (SELECT a.gene_id, a.sample_id, a.value, a.c, list_sort(list(abs(a.value - b.value))) AS near
            FROM (SELECT *, count(*) OVER (PARTITION BY gene_id, tier) AS c FROM d) a
            JOIN d b ON a.gene_id = b.gene_id AND a.tier = b.tier AND a.sample_id <> b.sample_id GROUP BY ALL)) r
        JOIN (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY gene_id, tier) AS c FROM d) WHERE c > 1) o ON o.gene_id = r.gene_id
        GROUP BY 1, 2) GROUP BY 1)"""
_CHI = """SELECT gene_id AS feature, sum(pow(o - e, 2) / e) AS score FROM
    (SELECT gene_id, coalesce(o, 0) AS o, share * t AS e FROM (SELECT gene_id, sum(value) AS t FROM d GROUP BY 1)
        CROSS JOIN (SELECT tier, count(DISTINCT sample_id) / (SELECT count(DISTINCT sample_id) FROM d)::DOUBLE AS share FROM d GROUP BY 1) s
        LEFT JOIN (SELECT gene_id, tier, sum(value) AS o FROM d GROUP BY 1, 2) USING (gene_id, tier)) GROUP BY 1"""


def _score_sql(body, n=50):
    return with_views(
        "expr samples",
        f"""WITH {_D}, s AS ({body}) SELECT feature, round(score, 6) AS score,
        row_number() OVER (ORDER BY score DESC, feature) AS rank FROM s ORDER BY score DESC, feature LIMIT {n}""",
    )


def _register(name, fn, body):
    @query(f"select_filter_{name}", _score_sql(body))
    def run(t):
        return rounded(S.top_scores(fn(t.expr(), t.samples(), "tier"), 50))


_register("variance", S.variance_scores, _VAR)
_register("f_test", S.f_scores, _F)
_register("anova", S.FILTERS["anova"], _F)
_register("correlation", S.correlation_scores, _COR)
_register("mutual_info", S.mutual_information_scores, _MI)
_register("mutual_info_knn", S.neighbour_information_scores, _KNN)
_register("chi2", S.chi2_scores, _CHI)

_ALL = f"""{_D}, al AS (SELECT 'variance' AS method, * FROM ({_VAR}) UNION ALL SELECT 'f_test', * FROM ({_F})
    UNION ALL SELECT 'mutual_info', * FROM ({_MI}) UNION ALL SELECT 'correlation', * FROM ({_COR})),
    rk AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, feature) AS rank FROM al),
    sel AS (SELECT * FROM rk WHERE rank <= 20)"""


def _all_scores(t):
    return S.filter_scores(t.expr(), t.samples(), "tier")


def _all(t, n=20):
    return S.top_per_method(_all_scores(t), n)


@query(
    "select_filter_dispatcher",
    with_views("expr samples", f"WITH {_ALL} SELECT method, feature, round(score, 6) AS score, rank FROM sel"),
)
def dispatcher(t):
    return rounded(_all(t))


@query(
    "select_variance_threshold_strict",
    with_views(
        "expr",
        """WITH v AS (SELECT gene_id AS feature, var_samp(value) AS s, var_pop(value) AS p FROM expr GROUP BY 1),
        c AS (SELECT min(s) AS c FROM (SELECT s FROM v ORDER BY s DESC LIMIT 40))
        SELECT feature, round(p, 6) AS score FROM v, c WHERE p > c""",
    ),
)
def strict(t):
    return rounded(S.variance_threshold(t.expr(), 40, strict=True))


@query(
    "select_ensemble_vote",
    with_views(
        "expr samples",
        f"""WITH {_ALL} SELECT feature, count(DISTINCT method) AS votes FROM sel GROUP BY 1 HAVING count(DISTINCT method) >= 2""",
    ),
)
def vote(t):
    return S.ensemble_vote(_all(t), 0.5)


@query(
    "select_consensus",
    with_views(
        "expr samples",
        f"""WITH {_ALL} SELECT feature, count(*) AS selection_count, string_agg(method, ',' ORDER BY method) AS methods,
        round(count(*) / 4.0::DOUBLE, 6) AS consensus_score FROM sel GROUP BY 1 HAVING count(*) / 4.0 >= 0.25""",
    ),
)
def consensus(t):
    return rounded(S.consensus(_all(t)))


@query(
    "select_normalized_consensus",
    with_views(
        "expr samples",
        f"""WITH {_ALL}, m AS (SELECT method, max(score) AS mx FROM al GROUP BY 1)
        SELECT feature, round(avg(score / mx), 6) AS consensus_score FROM al JOIN m USING (method) GROUP BY 1""",
    ),
)
def normalized(t):
    return rounded(S.normalized_consensus(_all_scores(t)))


@query(
    "window_top_k_stability",
    with_views(
        "expr samples",
        f"""WITH {_ALL} SELECT feature, round(avg(CASE WHEN rank <= 30 THEN 1.0 ELSE 0 END), 6) AS stability FROM rk GROUP BY 1""",
    ),
)
def stability(t):
    return rounded(S.top_k_stability(_all_scores(t), 30))


@query(
    "select_final_features",
    with_views(
        "expr samples",
        f"""WITH {_ALL}, m AS (SELECT method, max(score) AS mx FROM al GROUP BY 1),
        c AS (SELECT feature, avg(score / mx) AS cs FROM al JOIN m USING (method) GROUP BY 1),
        st AS (SELECT feature, avg(CASE WHEN rank <= 30 THEN 1.0::DOUBLE ELSE 0 END) AS st FROM rk GROUP BY 1)
        SELECT feature, round(cs, 6) AS consensus_score, round(st, 6) AS stability FROM c JOIN st USING (feature) WHERE st >= 0.6
        ORDER BY cs DESC, feature LIMIT 30""",
    ),
)
def final(t):
    return rounded(S.final_selection(_all_scores(t), 30))


@query(
    "topk_features_per_method",
    with_views("expr samples", f"WITH {_ALL} SELECT method, feature, rank FROM rk WHERE rank <= 10"),
)
def per_method(t):
    return _all(t, 10).select("method", "feature", "rank")


@query(
    "select_summary",
    with_views(
        "expr samples",
        f"""WITH {_ALL} SELECT CASE WHEN method = 'variance' THEN 'unsupervised' ELSE 'supervised' END AS category,
        count(DISTINCT method) AS n_methods, count(*) AS n_selections, count(DISTINCT feature) AS n_features FROM sel GROUP BY 1""",
    ),
)
def selection_summary(t):
    kinds = {"variance": "unsupervised", "f_test": "supervised", "mutual_info": "supervised", "correlation": "supervised"}
    return S.selection_summary(_all(t), kinds)


@query(
    "set_overlap_stability",
    with_views(
        "expr samples",
        f"""WITH {_ALL}, b AS (SELECT feature FROM sel WHERE method = 'f_test')
        SELECT method AS run, count(b.feature) / 20.0::DOUBLE AS overlap, round(count(*) / 150.0::DOUBLE, 6) AS chance
        FROM sel LEFT JOIN b USING (feature) WHERE method <> 'f_test' GROUP BY 1""",
    ),
)
def overlap(t):
    a = _all(t)
    n = t.expr().select("gene_id").distinct().count()
    runs = a.filter("method <> 'f_test'").select(F.col("method").alias("run"), "feature")
    return rounded(S.overlap_stability(a.filter("method = 'f_test'"), runs, n))


@query("set_overlap_t_test")
def overlap_t(t):
    a = _all(t)
    runs = a.filter("method <> 'f_test'").select(F.col("method").alias("run"), "feature")
    return rounded(S.overlap_t_test(S.overlap_stability(a.filter("method = 'f_test'"), runs, 150)))


# ---- model-based selection -----------------------------------------------------------------


def _matrix(t, n=12):
    expr = reuse(t.expr())  # read for the scores and for the matrix
    feats = S.top_scores(S.f_scores(expr, t.samples(), "label"), n)
    data, names = S.feature_matrix(expr, t.samples(), "label", feats)
    return data.persist(), names


@query(
    "select_feature_matrix",
    with_views(
        "expr samples",
        """WITH f AS (SELECT gene_id FROM expr GROUP BY 1 ORDER BY var_samp(value) DESC, gene_id LIMIT 5),
        g AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) AS i FROM f),
        v AS (SELECT sample_id, i, value FROM expr JOIN g USING (gene_id))
        SELECT s.sample_id, CAST(label AS DOUBLE) AS label, coalesce(max(value) FILTER (i = 1), 0) AS f0, coalesce(max(value) FILTER (i = 2), 0) AS f1,
        coalesce(max(value) FILTER (i = 3), 0) AS f2, coalesce(max(value) FILTER (i = 4), 0) AS f3, coalesce(max(value) FILTER (i = 5), 0) AS f4
        FROM samples s JOIN v USING (sample_id) GROUP BY 1, 2""",
    ),
)
def feature_matrix(t):
    from pyspark.ml.functions import vector_to_array

    feats = S.top_scores(S.variance_scores(t.expr()), 5)
    data, _ = S.feature_matrix(t.expr(), t.samples(), "label", feats)
    x = vector_to_array("features")
    return data.select("sample_id", "label", *[x[i].alias(f"f{i}") for i in range(5)])


def _register_model(name, method, **o):
    @query(f"select_embedded_{name}")
    def run(t):
        data, names = _matrix(t)
        return rounded(S.embedded_select(data, names, method, **o))


_register_model("lasso", "lasso", alpha=0.02)
_register_model("elastic_net", "elastic_net", alpha=0.02)
_register_model("random_forest", "random_forest", trees=20)
_register_model("boosted_trees", "gbt", rounds=5)
_register_model("svm", "svm")


@query("select_rfe")
def rfe(t):
    data, names = _matrix(t)
    return rounded(S.rfe(data, names, 6, step=0.25))


@query("select_sequential_forward")
def forward(t):
    data, names = _matrix(t, 4)
    return rounded(S.sequential(data, names, 2, "forward", 2, 5))


@query("select_sequential_backward")
def backward(t):
    data, names = _matrix(t, 4)
    return rounded(S.sequential(data, names, 2, "backward", 2, 5))


@query("select_stability_selection")
def stability_selection(t):
    data, names = _matrix(t)
    return rounded(S.stability_selection(data, names, alpha=0.02))


@query("select_bootstrap_consensus")
def bootstrap_consensus(t):
    return rounded(S.bootstrap_consensus(t.expr(), t.samples(), "label", 100, 50, 0.4))


@query("select_evaluate_top_features")
def evaluate_top(t):
    """Cross-validated metrics of a logistic model on the first 5 and 10 features."""
    parts = {}
    for n in (5, 10):
        data, _ = _matrix(t, n)
        cv = M.cross_validate(data, {f"top_{n}": M.estimator("logistic", max_iter=20)}, 3)
        parts[str(n)] = M.cv_summary(cv)
    out = parts["5"].unionByName(parts["10"])
    return rounded(out)


# ---- evaluation over prediction rows ---------------------------------------------------------

_CM = """c AS (SELECT model, count(*) FILTER (y = 1 AND yhat = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND yhat = 1)::DOUBLE AS fp,
    count(*) FILTER (y = 1 AND yhat = 0)::DOUBLE AS fn, count(*) FILTER (y = 0 AND yhat = 0)::DOUBLE AS tn FROM predictions GROUP BY 1),
    m AS (SELECT *, tp + fp + fn + tn AS n, tp + fn AS p1, tn + fp AS p0, tp / (tp + fp) AS pr1, tn / (tn + fn) AS pr0,
        tp / (tp + fn) AS r1, tn / (tn + fp) AS r0 FROM c),
    k AS (SELECT *, 2 * pr1 * r1 / (pr1 + r1) AS f1, 2 * pr0 * r0 / (pr0 + r0) AS f0 FROM m)"""
_METRICS = """model, CAST(n AS BIGINT) AS n, round((tp + tn) / n, 6) AS accuracy, round((r1 + r0) / 2, 6) AS balanced_accuracy,
    round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc,
    round((pr1 * p1 + pr0 * p0) / n, 6) AS precision_weighted, round((r1 * p1 + r0 * p0) / n, 6) AS recall_weighted,
    round((f1 * p1 + f0 * p0) / n, 6) AS f1_weighted, round((pr1 + pr0) / 2, 6) AS precision_macro,
    round((r1 + r0) / 2, 6) AS recall_macro, round((f1 + f0) / 2, 6) AS f1_macro,
    round(CASE WHEN p1 < p0 THEN r1 ELSE r0 END, 6) AS minority_recall,
    round(greatest(p1, p0) / least(p1, p0), 6) AS imbalance_ratio, greatest(p1, p0) / least(p1, p0) > 3 AS imbalanced"""
_AUC = """s AS (SELECT model, score, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS q FROM predictions GROUP BY 1, 2),
    u AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY model) AS pp,
        sum(q) OVER (PARTITION BY model) AS qq FROM s WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
    a AS (SELECT model, sum(p * (qq - fp + q / 2)) / (max(pp) * max(qq)) AS roc_auc,
        sum(p * tp / (tp + fp)) / max(pp) AS average_precision FROM u GROUP BY 1)"""


@query(
    "eval_confusion",
    with_views("predictions", "SELECT model, y, yhat, count(*) AS n FROM predictions GROUP BY 1, 2, 3"),
)
def confusion(t):
    return E.confusion(t.predictions())


@query("eval_classification_metrics", with_views("predictions", f"WITH {_CM} SELECT {_METRICS} FROM k"))
def metrics(t):
    return rounded(E.classification_metrics(t.predictions()))


@query(
    "eval_per_class",
    with_views(
        "predictions",
        f"""WITH {_CM} SELECT model, 1 AS cls, CAST(p1 AS BIGINT) AS support, CAST(tp AS BIGINT) AS correct, CAST(tp + fp AS BIGINT) AS predicted,
        round(pr1, 6) AS "precision", round(r1, 6) AS recall, round(f1, 6) AS f1 FROM k
        UNION ALL SELECT model, 0, CAST(p0 AS BIGINT), CAST(tn AS BIGINT), CAST(tn + fn AS BIGINT), round(pr0, 6), round(r0, 6), round(f0, 6) FROM k""",
    ),
)
def per_class(t):
    return rounded(E.per_class(t.predictions()))


@query(
    "eval_auc_average_precision",
    with_views(
        "predictions",
        f"WITH {_AUC} SELECT model, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM a",
    ),
)
def auc(t):
    return rounded(E.auc(t.predictions()))


@query(
    "window_roc_curve",
    with_views(
        "predictions",
        f"WITH {_AUC} SELECT model, score AS threshold, round(tp / pp, 6) AS tpr, round(fp / qq, 6) AS fpr FROM u",
    ),
)
def roc(t):
    return rounded(E.roc_curve(t.predictions()))


@query(
    "window_pr_curve",
    with_views(
        "predictions",
        f'WITH {_AUC} SELECT model, score AS threshold, round(tp / (tp + fp), 6) AS "precision", round(tp / pp, 6) AS recall FROM u',
    ),
)
def pr(t):
    return rounded(E.pr_curve(t.predictions()))


@query(
    "eval_calibration",
    with_views(
        "predictions",
        """SELECT model, CAST(least(9, floor(score * 10)) AS INT) AS bin, count(*) AS n, round(avg(y), 6) AS fraction_positive,
        round(avg(score), 6) AS mean_score FROM predictions GROUP BY 1, 2""",
    ),
)
def calibration(t):
    return rounded(E.calibration(t.predictions()))


@query(
    "eval_brier",
    with_views("predictions", "SELECT model, round(avg(pow(score - y, 2)), 6) AS brier FROM predictions GROUP BY 1"),
)
def brier(t):
    return rounded(E.brier(t.predictions()))


@query(
    "eval_mcnemar",
    with_views(
        "predictions",
        f"""WITH j AS (SELECT a.yhat = a.y AS oa, b.yhat = b.y AS ob FROM predictions a JOIN predictions b USING (id)
            WHERE a.model = 'price' AND b.model = 'season'),
        c AS (SELECT count(*) FILTER (oa AND ob) AS both_right, count(*) FILTER (oa AND NOT ob) AS only_a,
            count(*) FILTER (ob AND NOT oa) AS only_b, count(*) FILTER (NOT oa AND NOT ob) AS both_wrong FROM j),
        s AS (SELECT *, pow(greatest(0, abs(only_a - only_b) - 1.0), 2) / (only_a + only_b) AS st FROM c)
        SELECT both_right, only_a, only_b, both_wrong, round(st, 6) AS statistic,
        round({sql_normal_two_sided('sqrt(st)')}, 6) AS p_value FROM s""",
    ),
)
def mcnemar(t):
    return rounded(E.mcnemar(t.predictions(), "price", "season"))


@query(
    "eval_holdout_report",
    with_views(
        "predictions",
        f"""WITH {_CM}, {_AUC}, b AS (SELECT model, avg(pow(score - y, 2)) AS brier FROM predictions GROUP BY 1)
        SELECT {_METRICS}, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(brier, 6) AS brier
        FROM k JOIN a USING (model) JOIN b USING (model)""",
    ),
)
def holdout(t):
    return rounded(E.holdout_report(t.predictions()))


_FOLDS = """f AS (SELECT model, id % 5 AS fold, avg(CASE WHEN y = yhat THEN 1.0::DOUBLE ELSE 0 END) AS score
    FROM predictions GROUP BY 1, 2)"""


def _fold_scores(t):
    p = t.predictions().withColumn("fold", F.col("id") % 5)
    return p.groupBy("model", "fold").agg(
        F.avg(F.when(F.col("y") == F.col("yhat"), 1.0).otherwise(0.0)).alias("score")
    )


@query(
    "eval_compare_models",
    with_views(
        "predictions",
        f"""WITH {_FOLDS}, p AS (SELECT a.model AS model_a, b.model AS model_b, a.score AS sa, b.score AS sb
            FROM f a JOIN f b ON a.fold = b.fold AND a.model < b.model),
        g AS (SELECT model_a, model_b, count(*) AS folds, avg(sa - sb) AS md, stddev_samp(sa - sb) AS sd,
            sqrt((var_samp(sa) + var_samp(sb)) / 2) AS pooled FROM p GROUP BY 1, 2),
        s AS (SELECT *, md / (sd / sqrt(folds)) AS st FROM g)
        SELECT model_a, model_b, folds, round(md, 6) AS mean_diff, round(st, 6) AS statistic,
        round({sql_t_two_sided('st', '(folds - 1)')}, 6) AS p_value, round(md / pooled, 6) AS cohens_d FROM s""",
    ),
)
def compare(t):
    return rounded(E.compare_models(_fold_scores(t)))


@query(
    "eval_best_model",
    with_views("predictions", f"WITH {_AUC} SELECT model, round(roc_auc, 6) AS roc_auc FROM a ORDER BY roc_auc DESC, model LIMIT 1"),
)
def best(t):
    return rounded(E.best_model(E.auc(t.predictions()), "roc_auc"))


@query(
    "eval_metric_summary",
    with_views(
        "predictions",
        f"WITH {_FOLDS} SELECT model, 'score' AS metric, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM f GROUP BY 1",
    ),
)
def metric_summary(t):
    return rounded(E.metric_summary(_fold_scores(t), ("model",), ("score",)))


@query("eval_bootstrap_auc_delta")
def bootstrap(t):
    return rounded(E.bootstrap_auc_delta(t.predictions(), "price", "season"))


@query("eval_permutation_exact")
def permutation_exact(t):
    return rounded(E.permutation_accuracy_exact(t.predictions()))


@query("eval_permutation_fixed_prediction")
def permutation(t):
    return rounded(E.permutation_accuracy(t.predictions()))


@query(
    "eval_recommendations",
    with_views(
        "predictions",
        f"""WITH {_AUC}, m AS (SELECT model, roc_auc, CASE WHEN model = 'price' THEN 3 ELSE 200 END AS nf FROM a)
        SELECT model, CASE WHEN roc_auc >= 0.9 THEN 'excellent discrimination: validate on an independent cohort'
            WHEN roc_auc >= 0.8 THEN 'good discrimination: consider more samples'
            WHEN roc_auc >= 0.7 THEN 'moderate discrimination: refine the feature set'
            ELSE 'weak discrimination: revisit preprocessing and features' END AS recommendation FROM m
        UNION ALL SELECT model, 'few features: the selection may be too strict' FROM m WHERE nf < 5
        UNION ALL SELECT model, 'many features: the model may overfit' FROM m WHERE nf > 100
        UNION ALL SELECT model, 'not better than shuffled labels' FROM m""",
    ),
)
def recommend(t):
    m = E.auc(t.predictions()).withColumn("n_features", F.when(F.col("model") == "price", 3).otherwise(200))
    return E.recommendations(m.withColumn("p_value", F.lit(0.5)))


@query(
    "eval_soft_vote",
    with_views(
        "predictions",
        """WITH v AS (SELECT id, y, (2 * max(score) FILTER (model = 'price') + max(score) FILTER (model = 'season')) / 3 AS score FROM predictions GROUP BY 1, 2)
        SELECT 'ensemble' AS model, id, y, CASE WHEN round(score, 9) >= 0.5 THEN 1 ELSE 0 END AS yhat, round(score, 6) AS score FROM v""",
    ),
)
def soft_vote(t):
    out = M.soft_vote(t.predictions(), {"price": 2.0, "season": 1.0})
    return rounded(out.withColumn("yhat", F.when(F.round("score", 9) >= 0.5, 1).otherwise(0)))


# ---- splits, fits, attribution ---------------------------------------------------------------


def _vectors(t):
    """Embedding rows as a two-class problem."""
    return t.embeddings.select(
        F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("sample_id"),
        F.when(F.col("label") < 5, 1.0).otherwise(0.0).alias("label"),
        array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"),
    ).persist()


@query(
    "model_stratified_split_sizes",
    """WITH c AS (SELECT CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE 0 END AS label, count(*) AS n FROM embeddings GROUP BY 1),
    r AS (SELECT label, (i - 0.5) / n AS pos FROM c, LATERAL (SELECT unnest(range(1, n + 1)) AS i))
    SELECT label, CASE WHEN pos < 0.7 THEN 'train' WHEN pos < 0.85 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM r GROUP BY 1, 2""",
)
def split_sizes(t):
    s = E.stratified_split(_vectors(t).select("sample_id", "label"), {"train": 0.7, "validation": 0.15, "test": 0.15})
    return s.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query("model_train_and_evaluate")
def train(t):
    return rounded(M.train_and_evaluate(_vectors(t), "logistic"))


@query("model_cross_validation")
def cross_validation(t):
    return rounded(M.cv_summary(M.cross_validate(_vectors(t), {"logistic": M.estimator("logistic", max_iter=20)}, 3)))


@query("model_train_candidates")
def candidates(t):
    lr = M.estimator("logistic", max_iter=10)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1]).build()
    return rounded(M.train_candidates(_vectors(t), {"logistic": (lr, grid)}, 2))


@query("model_nested_cv")
def nested(t):
    lr = M.estimator("logistic", max_iter=10)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1]).build()
    return rounded(M.cv_metrics(M.nested_cv(_vectors(t), {"logistic": (lr, grid)}, 2, 2)))


@query("model_evaluate_set")
def evaluate_set(t):
    ms = {"logistic": M.estimator("logistic", max_iter=10), "svm": M.estimator("svm", max_iter=10)}
    return rounded(M.evaluate_set(_vectors(t), ms, 2))


@query("model_permutation_importance")
def importance(t):
    data, names = _matrix(t, 5)
    fit = M.estimator("logistic", max_iter=20).fit(data)
    return rounded(M.permutation_importance(fit, data, names))


@query("model_leak_safe_holdout")
def leak_safe(t):
    return rounded(M.leak_safe(t.expr(), t.samples(), "label", 10))


_PHI = """c AS (SELECT gene_id AS feature, regr_slope(label, value) AS coef FROM expr JOIN samples USING (sample_id) GROUP BY 1),
    m AS (SELECT gene_id AS feature, avg(value) AS m FROM expr GROUP BY 1),
    phi AS (SELECT sample_id, gene_id AS feature, value, coef * (value - m) AS phi FROM expr JOIN c ON gene_id = c.feature JOIN m ON gene_id = m.feature)"""


def _phi(t):
    d = t.expr().join(t.samples(), "sample_id")
    coef = d.groupBy(F.col("gene_id").alias("feature")).agg(F.regr_slope("label", "value").alias("coef"))
    return M.linear_attribution(t.expr().withColumnRenamed("gene_id", "feature"), coef)


@query(
    "model_linear_attribution",
    with_views("expr samples", f"WITH {_PHI} SELECT sample_id, feature, value, round(phi, 8) AS phi FROM phi"),
)
def attribution(t):
    return rounded(_phi(t), 8)


@query(
    "model_attribution_summary",
    with_views(
        "expr samples",
        f"""WITH {_PHI} SELECT feature, round(avg(abs(phi)), 8) AS mean_abs, round(stddev_pop(phi), 8) AS std FROM phi GROUP BY 1""",
    ),
)
def attribution_summary(t):
    return rounded(M.attribution_summary(_phi(t)).drop("mean"), 8)


@query(
    "model_attribution_dependence",
    with_views(
        "expr samples",
        f"WITH {_PHI} SELECT feature, round(corr(value, phi), 6) AS correlation, count(*) AS n FROM phi GROUP BY 1",
    ),
)
def dependence(t):
    return rounded(M.attribution_dependence(_phi(t)))


@query(
    "model_attribution_top_per_sample",
    with_views(
        "expr samples",
        f"""WITH {_PHI}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY abs(phi) DESC, feature) AS rank FROM phi)
        SELECT sample_id, feature, value, round(phi, 8) AS phi, rank FROM r WHERE rank <= 3""",
    ),
)
def top_contributions(t):
    return rounded(M.top_contributions(_phi(t), 3), 8)


@query(
    "model_attribution_one_sample",
    with_views(
        "expr samples",
        f"WITH {_PHI} SELECT sample_id, feature, value, round(phi, 8) AS phi FROM phi WHERE sample_id = 'S1'",
    ),
)
def one_sample(t):
    return rounded(M.explain_sample(_phi(t), "S1"), 8)


@query("model_custom_estimator")
def custom_estimator(t):
    """Any Spark ML estimator can take part: a user-made decision tree here."""
    from pyspark.ml.classification import DecisionTreeClassifier

    cv = M.cross_validate(_vectors(t), {"tree": DecisionTreeClassifier(maxDepth=3)}, 2)
    return rounded(E.holdout_report(cv.drop("fold")))


@query(
    "model_custom_selector",
    with_views(
        "expr",
        "SELECT gene_id AS feature FROM expr GROUP BY 1 HAVING avg(value) > 34",
    ),
)
def custom_selector(t):
    """A user selector is any function from a DataFrame to rows (feature)."""
    selector = lambda e: e.groupBy(F.col("gene_id").alias("feature")).agg(F.avg("value").alias("m")).filter("m > 34").select("feature")
    return selector(t.expr())
