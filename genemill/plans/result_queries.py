"""Result tables, annotation joins, text joins, clinical rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from genemill.functions import columns as C
from genemill.operators import annotate as A
from genemill.operators import clinical as CL
from genemill.operators import results as R
from genemill.plans.registry import query, rounded
from genemill.plans.standins import with_views

NOW = "2024-02-01 00:00:00"


@query(
    "results_biomarkers_of_run",
    with_views(
        "results",
        """SELECT run_id, gene, p_value, log2fc, importance, level, biomarker_type, owner, created_at, round(pow(2, log2fc), 6) AS fold_change
        FROM results WHERE run_id = 'run_promo' AND p_value <= 0.5 ORDER BY p_value, gene LIMIT 25 OFFSET 5""",
    ),
)
def biomarkers(t):
    return rounded(R.biomarkers_of_run(t.results(), "run_promo", 0.5, 5, 25))


@query(
    "results_multi_predicate_search",
    with_views(
        "results",
        """SELECT * FROM results WHERE run_id = 'run_small' AND gene ILIKE '%p1%' AND biomarker_type = 'Brand#4' AND level = 'B' AND p_value <= 0.6""",
    ),
)
def search(t):
    return R.search(t.results(), "run_small", "p1", "Brand#4", "B", 0.6)


_RUNS = """runs AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'completed' END AS status,
    o_orderdate AS created_at, o_custkey AS owner, o_orderpriority AS tenant FROM orders)"""


def _runs(t):
    s = F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_orderkey").alias("run_id"),
        F.when(s == "F", "failed").when(s == "O", "running").otherwise("completed").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("tenant"),
    )


@query(
    "results_run_listing",
    f"WITH {_RUNS} SELECT * FROM runs WHERE status = 'completed' ORDER BY created_at DESC, run_id LIMIT 50",
)
def run_listing(t):
    return R.list_runs(_runs(t), "completed", 50)


@query("results_tenant_filter", f"WITH {_RUNS} SELECT * FROM runs WHERE tenant = '5-LOW' AND owner = 42")
def tenant(t):
    return R.owned_rows(_runs(t), "5-LOW", 42)


@query(
    "results_retention_filter",
    f"WITH {_RUNS} SELECT * FROM runs WHERE status = 'failed' AND created_at < TIMESTAMP '2000-01-01' - INTERVAL 7 DAY",
)
def retention(t):
    return R.expired_runs(_runs(t), "2000-01-01 00:00:00", 7)


@query(
    "agg_run_status_counts",
    f"""WITH {_RUNS} SELECT count(*) AS total, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'completed') AS completed,
    count(*) FILTER (status = 'failed') AS failed, count(DISTINCT owner) AS users,
    count(DISTINCT owner) FILTER (created_at >= TIMESTAMP '2001-06-01' - INTERVAL 24 HOUR) AS active_users FROM runs""",
)
def status_counts(t):
    return R.status_counts(_runs(t), "2001-06-01 00:00:00", 24)


@query(
    "join_membership_visibility",
    """WITH m AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 7)
    SELECT o_orderkey AS project_id, o_custkey AS owner FROM orders WHERE o_custkey = 7 OR o_orderkey IN (SELECT l_orderkey FROM m)""",
)
def visibility(t):
    projects = t.orders.select(F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("owner"))
    members = t.lineitem.select(F.col("l_orderkey").alias("project_id"), F.col("l_suppkey").alias("user_id"))
    return R.visible_projects(projects, members, 7)


_POINTS = """p AS (SELECT gene, log2fc, p_value, -log10(greatest(p_value, 1e-300)) AS neg_log10_p,
    0.6 * least(-log10(greatest(p_value, 1e-300)) / 12, 1) + 0.4 * least(abs(importance), 1) AS z,
    p_value <= 0.05 AND abs(log2fc) >= 1 AS significant FROM results ORDER BY p_value, gene LIMIT 50)"""


@query(
    "agg_dashboard_points",
    with_views(
        "results",
        f"WITH {_POINTS} SELECT gene, log2fc, p_value, round(neg_log10_p, 6) AS neg_log10_p, round(z, 6) AS z, significant FROM p",
    ),
)
def dashboard(t):
    return rounded(R.dashboard(t.results(), 50))


@query(
    "agg_dashboard_summary",
    with_views(
        "results",
        f"""WITH {_POINTS} SELECT count(*) AS n, count(*) FILTER (significant) AS n_significant, round(max(neg_log10_p), 6) AS max_neg_log10_p,
        round(quantile_cont(neg_log10_p, 0.5), 6) AS median_neg_log10_p FROM p""",
    ),
)
def dashboard_summary(t):
    return rounded(R.dashboard_summary(R.dashboard(t.results(), 50)))


@query(
    "agg_export_summary",
    with_views(
        "results",
        """SELECT count(*) AS total, count(*) FILTER (p_value < 0.05) AS significant, count(*) FILTER (importance > 0.8) AS high_confidence,
        round(avg(p_value), 6) AS mean_p, round(avg(importance), 6) AS mean_confidence, round(quantile_cont(abs(log2fc), 0.5), 6) AS median_abs_log2fc FROM results""",
    ),
)
def export_summary(t):
    return rounded(R.export_summary(t.results()))


@query(
    "topk_by_p_value",
    with_views("results", "SELECT run_id, gene, p_value FROM results ORDER BY p_value, gene LIMIT 40"),
)
def topk(t):
    return t.results().select("run_id", "gene", "p_value").orderBy("p_value", "gene").limit(40)


@query(
    "topk_pagination",
    with_views("results", "SELECT run_id, gene, p_value FROM results ORDER BY p_value DESC, gene LIMIT 20 OFFSET 40"),
)
def pagination(t):
    return R.page(t.results().select("run_id", "gene", "p_value"), [F.col("p_value").desc(), F.col("gene")], 3, 20)


@query(
    "topk_page_info",
    with_views(
        "results",
        "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, 3 < ceil(count(*) / 20.0) AS has_next, true AS has_previous FROM results",
    ),
)
def page_info(t):
    return R.page_info(t.results(), 3, 20)


@query(
    "window_version_numbering",
    """SELECT o_custkey, o_orderpriority, o_orderkey, o_orderdate, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderpriority
    ORDER BY o_orderdate, o_orderkey) AS INT) AS version FROM orders""",
)
def versions(t):
    o = t.orders.select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")
    return R.number_versions(o, ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey")


@query(
    "window_latest_per_key",
    """SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def latest(t):
    return R.latest(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey")


# ---- merges of evidence ------------------------------------------------------------------------

_MERGE = """st AS (SELECT gene, 'p' AS method, p_value < 0.25 AS sig FROM results UNION ALL SELECT gene, 'fc', abs(log2fc) > 1 FROM results),
    h AS (SELECT gene, count(DISTINCT method) AS n_methods FROM st WHERE sig GROUP BY 1),
    ml AS (SELECT gene, importance AS cs FROM results WHERE importance > 0.6),
    j AS (SELECT gene, coalesce(n_methods, 0) AS n_methods, coalesce(n_methods / 2.0::DOUBLE, 0) AS stat_score, coalesce(cs, 0) AS consensus_score
        FROM h FULL JOIN ml USING (gene)),
    k AS (SELECT *, 0.6 * stat_score + 0.4 * consensus_score AS final_score FROM j)"""


def _merged(t):
    r = t.results()
    stat = r.select("gene", F.lit("p").alias("method"), (F.col("p_value") < 0.25).alias("significant")).unionByName(
        r.select("gene", F.lit("fc").alias("method"), (F.abs("log2fc") > 1).alias("significant"))
    )
    ml = r.filter("importance > 0.6").select("gene", F.col("importance").alias("consensus_score"))
    return R.merge_evidence(stat, ml)


@query(
    "join_evidence_full_outer_merge",
    with_views(
        "results",
        f"""WITH {_MERGE} SELECT gene, n_methods, stat_score, round(consensus_score, 6) AS consensus_score, round(final_score, 6) AS final_score FROM k""",
    ),
)
def merge(t):
    return rounded(_merged(t).drop("final_rank"))


@query(
    "window_biomarker_rank",
    with_views(
        "results",
        f"""WITH {_MERGE} SELECT gene, round(final_score, 6) AS final_score,
        CAST(row_number() OVER (ORDER BY round(final_score, 9) DESC, gene) AS INT) AS final_rank FROM k""",
    ),
)
def biomarker_rank(t):
    return rounded(_merged(t).select("gene", "final_score", "final_rank"))


@query(
    "agg_pipeline_summary",
    with_views(
        "results",
        f"""WITH {_MERGE} SELECT count(*) AS total, count(*) FILTER (n_methods > 0) AS statistically_significant,
        count(*) FILTER (consensus_score > 0) AS ml_selected, count(*) FILTER (final_score > 0.7) AS high_confidence FROM k""",
    ),
)
def pipeline_summary(t):
    return R.evidence_summary(_merged(t))


@query(
    "set_feature_union",
    with_views("results", "SELECT gene FROM results WHERE p_value < 0.25 UNION SELECT gene FROM results WHERE importance > 0.6"),
)
def feature_union(t):
    r = t.results()
    return r.filter("p_value < 0.25").select("gene").union(r.filter("importance > 0.6").select("gene")).distinct()


@query(
    "join_method_result_merge",
    with_views(
        "results",
        """WITH s AS (SELECT gene FROM results WHERE importance > 0.5), x AS (SELECT * FROM results WHERE level <> 'D')
        SELECT count(*) AS n_selected, count(*) FILTER (p_value < 0.4) AS n_significant, count(*) FILTER (log2fc > 1) AS n_up,
        count(*) FILTER (log2fc < -1) AS n_down FROM s LEFT JOIN x USING (gene)""",
    ),
)
def method_merge(t):
    r = t.results()
    return R.merge_method_results(r.filter("importance > 0.5").select("gene"), r.filter("level <> 'D'").drop("importance"), 0.4)


_KNOWN = """kn AS (SELECT 'P' || ps AS gene FROM (SELECT s_suppkey * 25 AS ps FROM supplier)),
    rk AS (SELECT *, row_number() OVER (ORDER BY p_value, gene) AS rank FROM results),
    lk AS (SELECT gene, p_value IS NOT NULL AS found, CAST(rank AS INT) AS rank, importance AS score, p_value, coalesce(p_value < 0.3, false) AS significant
        FROM kn LEFT JOIN rk USING (gene))"""


def _known(t):
    return t.supplier.select(F.concat(F.lit("P"), (F.col("s_suppkey") * 25).cast("string")).alias("gene"))


@query("join_known_biomarker_lookup", with_views("results", f"WITH {_KNOWN} SELECT * FROM lk"))
def known(t):
    return R.known_lookup(_known(t), t.results(), 0.3)


@query(
    "agg_discovery_rates",
    with_views(
        "results",
        f"""WITH {_KNOWN} SELECT count(*) AS known, count(*) FILTER (found) AS n_found, round(avg(CASE WHEN found THEN 1.0 ELSE 0 END), 6) AS discovery_rate,
        round(avg(CASE WHEN significant THEN 1.0 ELSE 0 END), 6) AS significance_rate FROM lk""",
    ),
)
def discovery(t):
    return rounded(R.discovery_rates(R.known_lookup(_known(t), t.results(), 0.3)))


@query(
    "join_benchmark_overlap",
    with_views(
        "results",
        f"""WITH {_KNOWN}, top AS (SELECT gene FROM results ORDER BY p_value, gene LIMIT 200)
        SELECT count(*) AS overlap, count(*) >= 3 AS passed FROM top WHERE gene IN (SELECT gene FROM kn)""",
    ),
)
def benchmark(t):
    return R.benchmark_overlap(t.results(), _known(t), 200, 3)


@query(
    "agg_benchmark_summary",
    with_views(
        "results",
        """WITH d AS (SELECT run_id, CASE WHEN count(*) >= 300 THEN 'ok' ELSE 'failed' END AS status, count(*) AS n_genes,
            count(*) FILTER (p_value < 0.3) AS n_significant, avg(importance) AS discovery_rate FROM results GROUP BY 1)
        SELECT count(*) AS datasets, count(*) FILTER (status = 'ok') AS datasets_ok, round(avg(n_genes) FILTER (status = 'ok'), 6) AS mean_genes,
        round(avg(n_significant) FILTER (status = 'ok'), 6) AS mean_significant, round(avg(discovery_rate) FILTER (status = 'ok'), 6) AS mean_discovery_rate FROM d""",
    ),
)
def benchmark_summary(t):
    d = t.results().groupBy("run_id").agg(
        F.when(F.count(F.lit(1)) >= 300, "ok").otherwise("failed").alias("status"),
        F.count(F.lit(1)).alias("n_genes"),
        F.count_if(F.col("p_value") < 0.3).alias("n_significant"),
        F.avg("importance").alias("discovery_rate"),
    )
    return rounded(R.benchmark_summary(d))


@query(
    "agg_known_gene_contrast",
    with_views(
        "expr samples",
        """WITH k AS (SELECT DISTINCT p_brand || '_PROMO' AS gene FROM part UNION SELECT 'Brand#99_PROMO'),
        m AS (SELECT gene_id AS gene, avg(value) FILTER (label = 1) AS a, avg(value) FILTER (label = 0) AS b FROM expr JOIN samples USING (sample_id) GROUP BY 1)
        SELECT gene, a IS NULL AS missing, round(a, 6) AS case_mean, round(b, 6) AS control_mean, round(a / b, 6) AS fold_change FROM k LEFT JOIN m USING (gene)""",
    ),
)
def contrast(t):
    k = t.part.select(F.concat(F.col("p_brand"), F.lit("_PROMO")).alias("gene")).union(
        t.spark.createDataFrame([("Brand#99_PROMO",)], "gene string")
    ).distinct()
    out = R.known_contrast(t.expr(), t.samples(), k, 1, 0)
    return rounded(out.drop("statistic", "p_value"))


@query(
    "join_feature_importance_summary",
    with_views(
        "results",
        """SELECT r.gene AS feature, c.importance AS consensus_score, s.p_value AS stability, a.log2fc AS attribution
        FROM results r LEFT JOIN results c ON c.gene = r.gene AND c.importance > 0.5 LEFT JOIN results s ON s.gene = r.gene AND s.level <> 'A'
        LEFT JOIN results a ON a.gene = r.gene AND a.log2fc > 0 WHERE r.p_value < 0.4""",
    ),
)
def importance_summary(t):
    r = t.results().withColumnRenamed("gene", "feature")
    return R.importance_summary(
        r.filter("p_value < 0.4").select("feature"),
        r.filter("importance > 0.5").select("feature", F.col("importance").alias("consensus_score")),
        r.filter("level <> 'A'").select("feature", F.col("p_value").alias("stability")),
        r.filter("log2fc > 0").select("feature", F.col("log2fc").alias("attribution")),
    )


_TASKS = """tasks AS (SELECT o_orderpriority AS queue, o_custkey % 16 AS worker, CASE o_orderstatus WHEN 'O' THEN 'reserved' ELSE 'done' END AS state,
    CAST(month(o_orderdate) % 3 AS BIGINT) AS retries FROM orders)"""


def _tasks(t):
    return t.orders.select(
        F.col("o_orderpriority").alias("queue"), (F.col("o_custkey") % 16).alias("worker"),
        F.when(F.col("o_orderstatus") == "O", "reserved").otherwise("done").alias("state"),
        (F.month("o_orderdate") % 3).cast("long").alias("retries"),
    )


@query("agg_task_queue_counts", f"WITH {_TASKS} SELECT queue, count(*) AS n_tasks FROM tasks GROUP BY 1")
def queue_counts(t):
    return R.queue_counts(_tasks(t))


@query(
    "agg_worker_retries",
    f"WITH {_TASKS} SELECT worker, count(*) FILTER (state = 'reserved') AS reserved, CAST(sum(retries) AS BIGINT) AS retries FROM tasks GROUP BY 1",
)
def worker_retries(t):
    return R.worker_retries(_tasks(t))


@query(
    "join_delivery_deduplication",
    """WITH e AS (SELECT user_id AS subscription, event_type AS event, props AS payload, sha256(event_type || ':' || sha256(props)) AS idempotency_key, event_id FROM events),
    sent AS (SELECT subscription, idempotency_key FROM e WHERE event_id < 3000 AND 200 + (event_id % 4) * 100 <= 399)
    SELECT subscription, idempotency_key, event, payload, event_id FROM e WHERE (subscription, idempotency_key) NOT IN (SELECT subscription, idempotency_key FROM sent)""",
)
def delivery(t):
    e = t.events.select(F.col("user_id").alias("subscription"), F.col("event_type").alias("event"), F.col("props").alias("payload"), "event_id")
    key = F.sha2(F.concat_ws(":", "event", F.sha2("payload", 256)), 256)
    log = e.filter("event_id < 3000").select(
        "subscription", key.alias("idempotency_key"), (200 + F.col("event_id") % 4 * 100).alias("status_code")
    )
    return R.new_deliveries(e, log)


@query(
    "agg_collection_summary",
    """WITH l AS (SELECT user_id AS source, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, CAST(floor(value) AS BIGINT) AS records,
        CAST(1 AS BIGINT) AS samples, round(value / 10, 3) AS seconds FROM events)
    SELECT count(*) AS sources, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed, CAST(sum(records) AS BIGINT) AS records,
    CAST(sum(samples) AS BIGINT) AS samples, round(sum(seconds), 3) AS total_seconds, round(avg(seconds), 6) AS mean_seconds FROM l""",
)
def collection_summary(t):
    log = t.events.select(
        F.col("user_id").alias("source"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.floor("value").alias("records"), F.lit(1).cast("long").alias("samples"), F.round(F.col("value") / 10, 3).alias("seconds"),
    )
    return rounded(R.collection_summary(log), 6, total_seconds=3)


@query(
    "filter_adaptive_parameters",
    with_views(
        "expr",
        """WITH p AS (SELECT count(DISTINCT sample_id) AS n, count(DISTINCT gene_id) AS m FROM expr)
        SELECT n AS n_samples, m AS n_features, CASE WHEN n < 5 THEN 'tiny' WHEN n < 20 THEN 'small' WHEN n < 100 THEN 'medium' WHEN n < 500 THEN 'large' ELSE 'very_large' END AS category,
        CASE WHEN n < 5 THEN 0.1::DOUBLE ELSE 0.05 END AS alpha, CASE WHEN n >= 100 AND n < 500 THEN least(10, greatest(5, n // 10)) ELSE 10 END AS cv_folds FROM p""",
    ),
)
def adaptive(t):
    return R.adaptive_parameters(t.expr()).select("n_samples", "n_features", "category", "alpha", F.col("cv_folds").cast("long").alias("cv_folds"))


# ---- annotation --------------------------------------------------------------------------------

_ANN = """ann AS (SELECT o_orderkey AS record_id, 'P' || (o_orderkey * 7 % 2500) AS gene, CASE o_orderstatus WHEN 'F' THEN 'cancer' WHEN 'O' THEN 'clinical' ELSE 'drug' END AS database,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Pathogenic' WHEN '2-HIGH' THEN 'Likely benign' ELSE 'Uncertain' END AS significance,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'B' ELSE 'C' END AS level, o_totalprice AS score,
    c_mktsegment AS condition FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _annotations(t):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("record_id"),
        F.concat(F.lit("P"), (F.col("o_orderkey") * 7 % 2500).cast("string")).alias("gene"),
        F.when(s == "F", "cancer").when(s == "O", "clinical").otherwise("drug").alias("database"),
        F.when(p == "1-URGENT", "Pathogenic").when(p == "2-HIGH", "Likely benign").otherwise("Uncertain").alias("significance"),
        F.when(p == "1-URGENT", "A").when(p == "2-HIGH", "B").otherwise("C").alias("level"),
        F.col("o_totalprice").alias("score"), F.col("c_mktsegment").alias("condition"),
    )


@query(
    "join_gene_id_mapping",
    with_views(
        "expr_fine",
        """WITH m AS (SELECT 'P' || p_partkey AS from_id, p_name AS to_id FROM part WHERE p_size < 40)
        SELECT coalesce(to_id, gene_id) AS gene_id, sample_id, round(avg(value), 6) AS value FROM expr_fine LEFT JOIN m ON gene_id = from_id GROUP BY 1, 2""",
    ),
)
def mapping(t):
    m = t.part.filter("p_size < 40").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("from_id"), F.col("p_name").alias("to_id")
    )
    return rounded(A.map_gene_ids(t.expr_fine(), m))


@query(
    "join_annotation",
    with_views(
        "results",
        f"""WITH {_ANN}, d AS (SELECT unnest(['cancer', 'clinical', 'depmap']) AS database), g AS (SELECT DISTINCT gene FROM results),
        p AS (SELECT database, gene, count(*) AS n, min(level) AS best_level, bool_or(contains(significance, 'Pathogenic')) AS hp FROM ann GROUP BY 1, 2)
        SELECT gene, database, coalesce(n, 0) AS n_records, best_level, coalesce(hp, false) AS has_pathogenic,
        CASE WHEN n > 0 THEN 'found' WHEN database = 'depmap' THEN 'database_not_available' ELSE 'no_records' END AS status
        FROM g CROSS JOIN d LEFT JOIN p USING (gene, database)""",
    ),
)
def annotation(t):
    return A.annotate_genes(t.results(), _annotations(t), ["cancer", "clinical", "depmap"])


_FLAGS = f"""{_ANN}, g AS (SELECT DISTINCT gene FROM results),
    a AS (SELECT * FROM ann WHERE gene IN (SELECT gene FROM g)),
    fl AS (SELECT gene, count(*) AS n, bool_or(database = 'cancer') AS c, bool_or(contains(significance, 'Pathogenic')) AS p, bool_or(database = 'drug') AS d,
        min(level) AS level FROM a GROUP BY 1),
    ff AS (SELECT gene, coalesce(n, 0) AS n_records, coalesce(c, false) AS is_cancer_gene, coalesce(p, false) AS has_pathogenic,
        coalesce(d, false) AS has_therapeutic, level FROM g LEFT JOIN fl USING (gene))"""


def _flags(t):
    return A.annotation_flags(t.results(), _annotations(t))


@query("join_annotation_flags", with_views("results", f"WITH {_FLAGS} SELECT * FROM ff"))
def flags(t):
    return _flags(t)


@query(
    "agg_annotation_summary",
    with_views(
        "results",
        f"""WITH {_FLAGS} SELECT count(*) AS n_genes, count(*) FILTER (is_cancer_gene) AS with_cancer_hit,
        count(*) FILTER (has_pathogenic OR has_therapeutic) AS with_clinical_hit FROM ff""",
    ),
)
def annotation_summary(t):
    return A.annotation_summary(_flags(t))


@query("filter_annotation_gene_lists", with_views("results", f"WITH {_FLAGS} SELECT gene FROM ff WHERE is_cancer_gene"))
def gene_lists(t):
    return A.genes_with_flag(_flags(t), "is_cancer_gene")


@query(
    "join_run_annotation",
    with_views(
        "results",
        f"""WITH {_FLAGS}, top AS (SELECT gene, p_value FROM results WHERE run_id = 'run_small' ORDER BY p_value, gene LIMIT 20)
        SELECT * FROM top LEFT JOIN ff USING (gene)""",
    ),
)
def run_annotation(t):
    return A.annotate_run(t.results(), _annotations(t), "run_small", 20)


@query(
    "filter_annotation_tables",
    f"""WITH {_ANN} SELECT record_id, gene, database, significance, level, score, condition FROM ann
    WHERE condition ILIKE '%auto%' AND level = 'A' AND significance ILIKE '%patho%' ORDER BY record_id LIMIT 100""",
)
def filter_annotation(t):
    return A.filter_annotations(_annotations(t), None, "auto", "A", "patho", 100)


@query(
    "clinical_evidence_card",
    with_views("results", f"""WITH {_FLAGS} SELECT gene, is_cancer_gene, n_records, has_pathogenic, has_therapeutic, level FROM ff"""),
)
def card(t):
    c = A.evidence_card(_flags(t))
    return c.select("gene", "cancer.*", "clinical.*")


@query(
    "set_evidence_list_union",
    with_views(
        "evidence",
        """WITH u AS (SELECT biomarker, study_type AS therapy, significance FROM evidence),
        g AS (SELECT biomarker, string_agg(DISTINCT therapy, ',' ORDER BY therapy) AS therapies, count(*) AS n_publications,
            avg(CASE significance WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END) AS m FROM u GROUP BY 1)
        SELECT biomarker, therapies, n_publications, round(m, 6) AS mean_significance, CASE WHEN m >= 2.5 THEN 'high' WHEN m >= 1.5 THEN 'moderate' ELSE 'low' END AS level,
        round(m / 3, 6) AS confidence FROM g""",
    ),
)
def evidence_union(t):
    e = t.evidence().select("biomarker", F.col("study_type").alias("therapy"), F.lit(1).alias("publication"), "significance")
    return rounded(A.evidence_union(e))


@query(
    "join_evidence_source_union",
    """SELECT doc_id AS id, source AS title, 'local' AS source_type FROM documents UNION ALL SELECT item_id, 'item' || item_id, 'literature' FROM benchmark""",
)
def source_union(t):
    local = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("title"))
    lit = t.benchmark.select(F.col("item_id").alias("id"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("title"))
    return A.source_union(local, lit)


@query(
    "clinical_literature_dedup",
    """SELECT l_partkey AS pmid, arg_min(l_shipdate, l_orderkey * 10 + l_linenumber) AS title FROM
    (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_orderkey, l_linenumber ORDER BY l_shipdate) = 1) GROUP BY 1""",
)
def literature(t):
    first = t.lineitem.groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("title"))
    rows = first.select(F.col("l_partkey").alias("pmid"), "title", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"))
    return A.distinct_literature(rows)


_WORDS = ["the", "and", "of", "to", "in", "re", "on", "er", "th", "la", "le", "une"]


@query(
    "join_text_co_mentions",
    f"""WITH g AS (SELECT upper(unnest({_WORDS!r})) AS g), h AS (SELECT doc_id, g FROM documents, g WHERE contains(upper(text), g))
    SELECT a.g AS source, b.g AS target, count(*) AS weight FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.g < b.g GROUP BY 1, 2""",
)
def co_mentions(t):
    return A.co_mentions(t.documents, _WORDS)


@query(
    "join_snippet_retrieval",
    """WITH s AS (SELECT doc_id AS id, source || ' LA' AS title, list_transform(str_split(text, ' '), lambda x: upper(x)) AS genes FROM documents),
    m AS (SELECT id, title, list_sort(list_distinct(list_intersect(['LA', 'OF', 'SRC3', 'THE', 'UNE'], genes))) AS m FROM s)
    SELECT id, CAST(len(m) * 10 + CASE WHEN contains(upper(title), 'SRC3') THEN 1 ELSE 0 END AS INT) AS match_score, array_to_string(m, ',') AS matched
    FROM m WHERE len(m) > 0 ORDER BY 2 DESC, 1 LIMIT 25""",
)
def snippets(t):
    s = t.documents.select(
        F.col("doc_id").alias("id"), F.concat(F.col("source"), F.lit(" LA")).alias("title"), F.split("text", " ").alias("genes")
    )
    return A.retrieve_snippets(s, ["the", "of", "la", "une", "SRC3"], 25)


@query(
    "scalar_mention_check",
    """WITH c AS (SELECT contains(upper(text), 'THE') AND contains(upper(text), 'OF') AS ok FROM documents)
    SELECT count(*) AS cases, count(*) FILTER (ok) AS passed, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 6) AS pass_rate FROM c""",
)
def mentions(t):
    d = t.documents.select("text", F.array(F.lit("the"), F.lit("of")).alias("genes"))
    return rounded(A.mention_check(d))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]]


@query(
    "join_column_pair_correlation",
    " UNION ALL ".join(
        f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, round(corr({a}, {b}), 6) AS correlation FROM lineitem HAVING abs(corr({a}, {b})) >= 0.001"
        for a, b in _PAIRS
    ),
)
def column_correlation(t):
    return rounded(A.column_correlations(t.lineitem, _COLS, 0.001))


# ---- clinical ----------------------------------------------------------------------------------

_STRENGTH = """w AS (SELECT *, CASE level WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.8 WHEN 'C' THEN 0.6 ELSE 0.4 END::DOUBLE
        * CASE study_type WHEN 'RCT' THEN 1.0 WHEN 'meta-analysis' THEN 0.9 WHEN 'cohort' THEN 0.7 WHEN 'case-control' THEN 0.5 WHEN 'guideline' THEN 0.8 ELSE 0.3 END::DOUBLE
        * least(1.0, n / 1000.0::DOUBLE) * least(1.0, impact / 20) * greatest(0.5, 1 - (2024 - year) / 10.0::DOUBLE) AS w FROM evidence),
    s AS (SELECT biomarker, disease, sum(w * (1 - p) * abs(effect)) / sum(w) AS strength_score, count(*) AS n_studies, min(level) AS evidence_level,
        bool_or(level = 'A') AS has_a, bool_or(level = 'B') AS has_b, bool_or(significance = 'high') AS has_high, bool_or(study_type = 'RCT') AS has_rct,
        bool_or(n > 1000) AS has_large, avg((1 - p) * abs(effect)) AS support_score FROM w GROUP BY 1, 2)"""


@query(
    "clinical_evidence_strength",
    with_views(
        "evidence",
        f"""WITH {_STRENGTH} SELECT biomarker, disease, round(strength_score, 6) AS strength_score, n_studies, evidence_level, has_a, has_b, has_high, has_rct, has_large,
        round(support_score, 6) AS support_score FROM s""",
    ),
)
def strength(t):
    return rounded(CL.evidence_strength(t.evidence()))


@query(
    "scalar_evidence_weight",
    with_views("evidence", f"WITH {_STRENGTH} SELECT biomarker, disease, level, study_type, round(sum(w), 6) AS weight FROM w GROUP BY 1, 2, 3, 4"),
)
def weight(t):
    e = t.evidence().withColumn("w", C.evidence_weight(2024))
    return rounded(e.groupBy("biomarker", "disease", "level", "study_type").agg(F.sum("w").alias("weight")))


@query(
    "join_evidence_equi",
    with_views(
        "evidence",
        """SELECT biomarker, disease, count(*) AS n FROM evidence WHERE (biomarker, disease) IN
        (SELECT n_name, 'BUILDING' FROM nation WHERE n_regionkey = 1) GROUP BY 1, 2""",
    ),
)
def evidence_equi(t):
    asked = t.nation.filter("n_regionkey = 1").select(F.col("n_name").alias("biomarker"), F.lit("BUILDING").alias("disease"))
    return CL.evidence_for(t.evidence(), asked).groupBy("biomarker", "disease").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_evidence_quality",
    with_views(
        "evidence",
        f"""WITH {_STRENGTH} SELECT biomarker AS gene, evidence_level AS evidence_tier, round(strength_score, 4) AS evidence_strength_score, n_studies AS study_count
        FROM s WHERE disease = 'BUILDING'""",
    ),
)
def quality(t):
    return CL.evidence_quality(t.evidence(), "BUILDING")


def _patients(t):
    return t.customer.select(
        F.col("c_custkey").alias("patient"), F.col("c_mktsegment").alias("disease"),
        (F.col("c_custkey") % 90).cast("int").alias("age"),
        F.when(F.col("c_nationkey") < 5, F.array(F.lit("liver_disease"))).otherwise(F.array().cast("array<string>")).alias("comorbidities"),
        F.when(F.col("c_acctbal") < 0, F.array(F.lit("warfarin"))).otherwise(F.array().cast("array<string>")).alias("medications"),
    )


_RECOMMEND = f"""{_STRENGTH}, rec AS (SELECT c_custkey AS patient, biomarker, disease, CASE WHEN strength_score >= 0.8 THEN 'strong' WHEN strength_score >= 0.6 THEN 'moderate' ELSE 'weak' END AS strength,
    round(strength_score, 6) AS strength_score, evidence_level,
    concat_ws('; ', CASE WHEN c_custkey % 90 < 18 THEN 'paediatric patient' END, CASE WHEN c_nationkey < 5 THEN 'liver disease' END, CASE WHEN c_acctbal < 0 THEN 'interaction with warfarin' END) AS contraindications,
    concat_ws('; ', CASE WHEN has_a THEN 'every 3 to 6 months' END, CASE WHEN has_high THEN 'treatment response' END, CASE WHEN has_rct THEN 'adverse events' END) AS monitoring,
    CASE WHEN has_a THEN 6 WHEN has_b THEN 12 ELSE 24 END AS follow_up_months,
    CASE WHEN (has_a OR has_b) AND has_large THEN 'cost-effective' WHEN has_a OR has_b THEN 'moderately cost-effective' ELSE 'unclear' END AS cost_effectiveness
    FROM customer JOIN s ON c_mktsegment = disease)"""


@query("clinical_recommendations", with_views("evidence", f"WITH {_RECOMMEND} SELECT * FROM rec"))
def recommendations(t):
    return rounded(CL.recommend(t.evidence(), _patients(t)).drop("text"))


@query(
    "clinical_recommendation_ranking",
    with_views(
        "evidence",
        f"""WITH {_RECOMMEND}, p AS (SELECT patient, biomarker, CAST(CASE strength WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END
            + CASE evidence_level WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 ELSE 1 END AS INT) AS points FROM rec)
        SELECT * FROM p ORDER BY points DESC, patient, biomarker LIMIT 100""",
    ),
)
def ranking(t):
    r = CL.recommend(t.evidence(), _patients(t))
    return CL.rank_recommendations(r, 100).select("patient", "biomarker", "points")


@query(
    "clinical_recommendation_text",
    with_views(
        "evidence",
        f"""WITH {_RECOMMEND} SELECT DISTINCT biomarker, disease, strength || ' (level ' || evidence_level || ', review in ' || follow_up_months || ' months) | '
        || biomarker || ' | ' || disease AS text FROM rec""",
    ),
)
def text(t):
    return CL.recommend(t.evidence(), _patients(t)).select("biomarker", "disease", "text").distinct()


_DEC = """dec AS (SELECT c_custkey AS decision_id, n_name AS biomarker, c_mktsegment AS disease,
    CASE WHEN c_acctbal > 0 THEN c_acctbal / 10000 END AS guideline_score FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    "clinical_decision_validation",
    with_views(
        "evidence",
        f"""WITH {_DEC}, s AS (SELECT biomarker, disease, avg((1 - p) * abs(effect)) AS e, count(*) AS n FROM evidence GROUP BY 1, 2),
        j AS (SELECT decision_id, biomarker, disease, guideline_score, coalesce(e, 0) AS e, coalesce(n, 0) AS n,
            0.6 * coalesce(guideline_score, 0) + 0.4 * coalesce(e, 0) AS v FROM dec LEFT JOIN s USING (biomarker, disease))
        SELECT decision_id, biomarker, disease, round(e, 6) AS evidence_score, n AS n_studies, e > 0.5 AS supported, round(v, 6) AS validation_score,
        concat_ws('; ', CASE WHEN v < 0.5 THEN 'seek more evidence before deciding' END, CASE WHEN guideline_score IS NULL THEN 'check the guidelines' END,
            CASE WHEN e <= 0.5 THEN 'limited evidence: consider alternatives' END) AS advice FROM j""",
    ),
)
def decision(t):
    d = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("decision_id"), F.col("n_name").alias("biomarker"), F.col("c_mktsegment").alias("disease"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 10000).alias("guideline_score"),
    )
    return rounded(CL.validate_decisions(d, t.evidence()))


def _guidelines(t):
    return t.nation.select(
        F.lit("BUILDING").alias("disease"), F.col("n_name").alias("biomarker"),
        F.when(F.col("n_regionkey") == 0, "B").when(F.col("n_regionkey") == 1, "A").alias("min_level"),
        (F.col("n_regionkey") == 2).alias("required_validation"),
        F.when(F.col("n_regionkey") > 2, F.array(F.lit("consent"), F.lit("audit"))).alias("requirements"),
    )


@query(
    "clinical_rule_table",
    """SELECT 'BUILDING_' || n_name AS rule_key, CASE n_regionkey WHEN 0 THEN 'B' WHEN 1 THEN 'A' ELSE 'C' END AS min_level, n_regionkey = 2 AS required_validation,
    CASE WHEN n_regionkey > 2 THEN 2 ELSE 0 END AS n_requirements FROM nation""",
)
def rules(t):
    return CL.rule_table(_guidelines(t)).select("rule_key", "min_level", "required_validation", F.size("requirements").alias("n_requirements"))


@query(
    "clinical_rule_compliance",
    """WITH d AS (SELECT c_custkey AS decision_id, c_mktsegment || '_' || n_name AS rule_key, CASE WHEN c_mktsegment = 'BUILDING' THEN n_regionkey END AS rk,
        CASE WHEN c_acctbal < 2000 THEN 1 WHEN c_acctbal < 6000 THEN 3 ELSE 4 END AS lv, c_acctbal > 0 AS validated, c_custkey % 2 AS k
        FROM customer JOIN nation ON c_nationkey = n_nationkey),
    r AS (SELECT *, lv < CASE rk WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 2 END AS low, coalesce(rk = 2, false) AND NOT validated AS unval,
        CASE WHEN rk > 2 THEN CASE WHEN k = 0 THEN 1 ELSE 2 END ELSE 0 END AS miss FROM d)
    SELECT decision_id, rule_key, NOT low AS valid, unval AS validation_missing, miss AS requirements_missing,
    round(greatest(0.0, 1.0 - CASE WHEN low THEN 0.3 ELSE 0 END - CASE WHEN unval THEN 0.2 ELSE 0 END - 0.1 * miss)::DOUBLE, 6) AS compliance_score FROM r""",
)
def compliance(t):
    a = F.col("c_acctbal")
    d = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("decision_id"), F.col("n_name").alias("biomarker"), F.col("c_mktsegment").alias("disease"),
        F.when(a < 2000, "D").when(a < 6000, "B").otherwise("A").alias("level"), (a > 0).alias("validated"),
        F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("consent"))).otherwise(F.array(F.lit("other"))).alias("compliance"),
    )
    return rounded(CL.rule_compliance(d, CL.rule_table(_guidelines(t))))


@query("clinical_strength_model")
def strength_model(t):
    """Forest on past recommendations; predicted strength per case."""
    r = CL.recommend(t.evidence(), _patients(t)).select("biomarker", "disease", "evidence_level", "strength").distinct()
    fit = CL.strength_model(r)
    return fit.transform(r).select("biomarker", "disease", "strength", "prediction")


@query(
    "clinical_combined_annotation",
    with_views(
        "evidence",
        """WITH g AS (SELECT biomarker, avg(CASE significance WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END) AS m, count(*) AS n FROM evidence GROUP BY 1)
        SELECT biomarker, n AS n_publications, round(m / 3, 6) AS confidence FROM g""",
    ),
)
def combined(t):
    e = t.evidence().select("biomarker", F.col("study_type").alias("therapy"), F.lit(1).alias("publication"), "significance")
    return rounded(A.evidence_union(e).select("biomarker", "n_publications", "confidence"))


# ---- scalar functions --------------------------------------------------------------------------


@query(
    "scalar_string_normalisation",
    """SELECT c_custkey, upper(trim(c_name)) AS symbol, CASE WHEN regexp_matches(upper(trim(c_mktsegment || c_custkey)), '^[0-9]+$') THEN 'GSE' || c_custkey END AS accession,
    'GSE' || c_custkey AS prefixed, replace(trim(regexp_replace(c_name || ' #' || c_mktsegment, '[^A-Za-z0-9 _\\-]', '', 'g')), ' ', '_') AS run_name FROM customer""",
)
def strings(t):
    key = F.col("c_custkey").cast("string")
    return t.customer.select(
        "c_custkey", C.normalize_symbol("c_name").alias("symbol"),
        C.series_accession(F.concat("c_mktsegment", key)).alias("accession"), C.series_accession(key).alias("prefixed"),
        C.clean_run_id(F.concat("c_name", F.lit(" #"), "c_mktsegment")).alias("run_name"),
    )


@query(
    "scalar_title_assay_type",
    """SELECT doc_id, CASE WHEN regexp_matches(t, 'methylation') THEN 'methylation' WHEN regexp_matches(t, 'chip-?seq') THEN 'chip_seq' WHEN regexp_matches(t, 'atac-?seq') THEN 'atac_seq'
    WHEN regexp_matches(t, 'rna-?seq') THEN 'rna_seq' WHEN regexp_matches(t, 'mirna|microrna') THEN 'mirna' WHEN contains(t, 'lncrna') THEN 'lncrna' ELSE 'expression' END AS assay
    FROM (SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'ChIP-seq of ' WHEN 1 THEN 'microchip ' WHEN 2 THEN 'miRNA-seq ' WHEN 3 THEN 'MicroRNA ' WHEN 4 THEN 'scATACseq '
        WHEN 5 THEN 'lncRNA ' WHEN 6 THEN 'RNAseq ' WHEN 7 THEN 'DNA methylation ' WHEN 8 THEN 'ATAC-seq ' WHEN 9 THEN 'chipseq ' WHEN 10 THEN 'mirna ' ELSE '' END || lower(text) AS u,
        lower(u) AS t FROM documents)""",
)
def assay(t):
    words = ("ChIP-seq of ", "microchip ", "miRNA-seq ", "MicroRNA ", "scATACseq ", "lncRNA ", "RNAseq ", "DNA methylation ", "ATAC-seq ", "chipseq ", "mirna ", "")
    title = F.concat(F.element_at(F.array(*map(F.lit, words)), (F.col("doc_id") % 12 + 1).cast("int")), "text")
    return t.documents.select("doc_id", C.assay_type(title).alias("assay"))


@query(
    "scalar_stage_label",
    """WITH s AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'Stage 0' WHEN 1 THEN 'stage I' WHEN 2 THEN 'Stage IIA' WHEN 3 THEN 'STAGE III' WHEN 4 THEN 'Stage IVB' WHEN 5 THEN 'Stage V' ELSE 'not reported' END AS stage, c_custkey % 7 AS k FROM customer)
    SELECT c_custkey, stage, CASE WHEN k BETWEEN 3 AND 5 THEN 1 WHEN k < 3 THEN 0 END AS label FROM s""",
)
def stage(t):
    k = F.col("c_custkey") % 7
    names = ["Stage 0", "stage I", "Stage IIA", "STAGE III", "Stage IVB", "Stage V"]
    text = None
    for i, n in enumerate(names):
        text = F.when(k == i, n) if text is None else text.when(k == i, n)
    d = t.customer.select("c_custkey", text.otherwise("not reported").alias("stage"))
    return d.withColumn("label", C.stage_binary("stage"))


@query(
    "scalar_median_split_label",
    """WITH a AS (SELECT o_custkey, min(o_totalprice) AS age FROM orders GROUP BY 1), m AS (SELECT quantile_cont(age, 0.5) AS m FROM a)
    SELECT o_custkey AS case_id, age, CASE WHEN age >= m THEN 1 ELSE 0 END AS label FROM a, m""",
)
def median_label(t):
    from genemill.operators.distributed import median_by

    a = t.orders.groupBy(F.col("o_custkey").alias("case_id")).agg(F.min("o_totalprice").alias("age"))
    med = median_by(a, [], "age", "m").scalar()
    return a.withColumn("label", F.when(F.col("age") >= med, 1).otherwise(0))


@query(
    "scalar_json_columns",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
)
def json_columns(t):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    "scalar_array_handling",
    """WITH w AS (SELECT trim(unnest(str_split_regex(p_name || ',' || p_brand || ';' || p_type, '[,;]'))) AS item FROM part)
    SELECT item, count(*) AS n FROM w WHERE item <> '' GROUP BY 1""",
)
def arrays(t):
    text = F.concat("p_name", F.lit(","), "p_brand", F.lit(";"), "p_type")
    return t.part.select(F.explode(C.split_list(text)).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query(
    "scalar_time_window",
    f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR",
)
def time_window(t):
    edge = F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(48))
    return t.events.filter(F.col("ts") >= edge).select("event_id", "ts")
