"""Queries over result and run tables: filters, pages, versions, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genemill.operators.distributed import median_by, ordinal_ranks, reuse


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page of a sorted table."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    pages = F.ceil(F.col("total") / size)
    return (
        df.agg(F.count(F.lit(1)).alias("total"))
        .withColumn("pages", pages)
        .withColumn("has_next", F.lit(number) < F.col("pages"))
        .withColumn("has_previous", F.lit(number > 1))
    )


def biomarkers_of_run(results: DataFrame, run_id: str, p_max: float = 0.05, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Rows of one run up to a p-value, best first, with the fold change."""
    hit = results.filter((F.col("run_id") == run_id) & (F.col("p_value") <= p_max))
    out = hit.withColumn("fold_change", F.pow(F.lit(2.0), F.col("log2fc"))).orderBy("p_value", "gene").offset(skip)
    return out if limit is None else out.limit(limit)


def search(
    results: DataFrame,
    run_id: str | None = None,
    gene_contains: str | None = None,
    biomarker_type: str | None = None,
    level: str | None = None,
    p_max: float | None = None,
) -> DataFrame:
    """All given predicates together; the gene is matched without regard to case."""
    keep = F.lit(True)
    if run_id is not None:
        keep = keep & (F.col("run_id") == run_id)
    if gene_contains is not None:
        keep = keep & F.contains(F.lower("gene"), F.lit(gene_contains.lower()))
    if biomarker_type is not None:
        keep = keep & (F.col("biomarker_type") == biomarker_type)
    if level is not None:
        keep = keep & (F.col("level") == level)
    if p_max is not None:
        keep = keep & (F.col("p_value") <= p_max)
    return results.filter(keep)


def list_runs(runs: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    out = runs if status is None else runs.filter(F.col("status") == status)
    out = out.orderBy(F.col("created_at").desc(), "run_id")
    return out if limit is None else out.limit(limit)


def owned_rows(df: DataFrame, tenant, user=None, is_admin: bool = False, tenant_col="tenant", user_col="owner") -> DataFrame:
    """Row filter by tenant and, unless an administrator asks, by owner."""
    out = df.filter(F.col(tenant_col) == F.lit(tenant))
    return out if is_admin or user is None else out.filter(F.col(user_col) == F.lit(user))


def expired_runs(runs: DataFrame, now, days: int = 7) -> DataFrame:
    """Failed runs older than `days` before `now`: the rows to purge."""
    edge = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return runs.filter((F.col("status") == "failed") & (F.col("created_at") < edge))


def visible_projects(projects: DataFrame, members: DataFrame, user) -> DataFrame:
    """Projects owned by the user or shared with them."""
    shared = members.filter(F.col("user_id") == F.lit(user)).select("project_id").distinct()
    own = projects.filter(F.col("owner") == F.lit(user))
    other = projects.filter(F.col("owner") != F.lit(user)).join(shared, "project_id", "left_semi")
    return own.unionByName(other)


def dashboard(results: DataFrame, top: int = 50) -> DataFrame:
    """Volcano points of the best rows: -log10 p, combined size, significance."""
    best = results.orderBy("p_value", "gene").limit(top)
    logp = -F.log10(F.greatest(F.col("p_value"), F.lit(1e-300)))
    importance = F.least(F.abs(F.coalesce("importance", F.lit(0.0))), F.lit(1.0))
    return best.select(
        "gene", "log2fc", "p_value", logp.alias("neg_log10_p"),
        (0.6 * F.least(logp / 12, F.lit(1.0)) + 0.4 * importance).alias("z"),
        ((F.col("p_value") <= 0.05) & (F.abs("log2fc") >= 1)).alias("significant"),
    )


def dashboard_summary(points: DataFrame) -> DataFrame:
    med = median_by(points, [], "neg_log10_p", "m").scalar()
    return points.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("significant").alias("n_significant"),
        F.max("neg_log10_p").alias("max_neg_log10_p"),
    ).withColumn("median_neg_log10_p", med)


def export_summary(results: DataFrame) -> DataFrame:
    med = median_by(results.withColumn("_a", F.abs("log2fc")), [], "_a", "m").scalar()
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("p_value") < 0.05).alias("significant"),
        F.count_if(F.col("importance") > 0.8).alias("high_confidence"),
        F.avg("p_value").alias("mean_p"),
        F.avg("importance").alias("mean_confidence"),
    ).withColumn("median_abs_log2fc", med)


def status_counts(runs: DataFrame, now, hours: int = 24) -> DataFrame:
    recent = F.col("created_at") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours))
    is_ = lambda s: F.count_if(F.col("status") == s)
    return runs.agg(
        F.count(F.lit(1)).alias("total"),
        is_("running").alias("running"),
        is_("completed").alias("completed"),
        is_("failed").alias("failed"),
        F.count_distinct("owner").alias("users"),
        F.count_distinct(F.when(recent, F.col("owner"))).alias("active_users"),
    )


def number_versions(rows: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """Version 1, 2, ... of the rows of each key in time order."""
    t = rows.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")).cast("double"))
    return ordinal_ranks(t, list(keys), "_t", tie, "version").drop("_t")


def latest(rows: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """Newest row of each key, by one aggregation."""
    cols = [c for c in rows.columns if c not in keys]
    top = F.max_by(F.struct(*cols), F.struct(time, tie)).alias("_r")
    return rows.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def merge_evidence(
    stat: DataFrame, ml: DataFrame, scores: DataFrame | None = None, fallback_top: int | None = None
) -> DataFrame:
    """Union of statistically significant genes and consensus genes, scored and ranked.

    `stat` holds (method, gene, significant) for every tested method, `ml`
    (gene, consensus_score). final = 0.6 * share of methods + 0.4 * consensus. With
    `fallback_top` (off by default) and no significant gene, the best that many of
    `scores` are taken instead when there is no consensus gene either, or more.
    """
    total = stat.agg(F.count_distinct("method").alias("m")).scalar()
    hits = stat.filter("significant").groupBy("gene").agg(F.count_distinct("method").alias("n_methods"))
    n_ml = ml.count()
    if fallback_top and scores is not None and hits.isEmpty() and (n_ml == 0 or n_ml > fallback_top):
        ml = scores.orderBy(F.col("consensus_score").desc(), "gene").limit(fallback_top)
    j = hits.join(ml.select("gene", "consensus_score"), "gene", "full")
    share = F.coalesce(F.col("n_methods") / total, F.lit(0.0))
    score = F.coalesce("consensus_score", F.lit(0.0))
    j = j.select(
        "gene",
        F.coalesce("n_methods", F.lit(0)).alias("n_methods"),
        share.alias("stat_score"),
        score.alias("consensus_score"),
        # whole weights: 0.6 * 0.5 and 0.4 * 0.75 differ in the last digit, and equal scores go by gene
        ((6 * share + 4 * score) / 10).alias("final_score"),
    )
    return ordinal_ranks(reuse(j), [], "final_score", "gene", "final_rank", descending=True)


def evidence_summary(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("n_methods") > 0).alias("statistically_significant"),
        F.count_if(F.col("consensus_score") > 0).alias("ml_selected"),
        F.count_if(F.col("final_score") > 0.7).alias("high_confidence"),
    )


def merge_method_results(selected: DataFrame, tests: DataFrame, p_max: float = 0.05) -> DataFrame:
    """Selected features with p and log2 fold change, and the counts of each kind."""
    j = selected.join(tests, "gene", "left")
    return j.agg(
        F.count(F.lit(1)).alias("n_selected"),
        F.count_if(F.col("p_value") < p_max).alias("n_significant"),
        F.count_if(F.col("log2fc") > 1).alias("n_up"),
        F.count_if(F.col("log2fc") < -1).alias("n_down"),
    )


def known_lookup(known: DataFrame, results: DataFrame, p_max: float = 0.05) -> DataFrame:
    """Known genes with rank, score and p where the results hold them."""
    ranked = ordinal_ranks(results, [], "p_value", "gene", "rank")
    return known.join(ranked.select("gene", "rank", "importance", "p_value"), "gene", "left").select(
        "gene", F.col("p_value").isNotNull().alias("found"), "rank", F.col("importance").alias("score"),
        "p_value", F.coalesce(F.col("p_value") < p_max, F.lit(False)).alias("significant"),
    )


def discovery_rates(lookup: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    return lookup.agg(
        F.count(F.lit(1)).alias("known"), F.count_if("found").alias("n_found"),
        share("found").alias("discovery_rate"), share("significant").alias("significance_rate"),
    )


def benchmark_overlap(results: DataFrame, gold: DataFrame, top: int = 50, minimum: int = 1) -> DataFrame:
    """How many of the best `top` genes are in a gold list, and whether that is enough."""
    best = results.orderBy("p_value", "gene").limit(top)
    hits = best.join(gold.select("gene").distinct(), "gene", "left_semi")
    return hits.agg(F.count(F.lit(1)).alias("overlap")).withColumn("passed", F.col("overlap") >= minimum)


def benchmark_summary(per_dataset: DataFrame) -> DataFrame:
    """Across datasets: how many worked, mean genes, significant genes and discovery rate."""
    ok = F.col("status") == "ok"
    return per_dataset.agg(
        F.count(F.lit(1)).alias("datasets"),
        F.count_if(ok).alias("datasets_ok"),
        F.avg(F.when(ok, F.col("n_genes"))).alias("mean_genes"),
        F.avg(F.when(ok, F.col("n_significant"))).alias("mean_significant"),
        F.avg(F.when(ok, F.col("discovery_rate"))).alias("mean_discovery_rate"),
    )


def importance_summary(selected: DataFrame, consensus: DataFrame, stability: DataFrame, attribution: DataFrame) -> DataFrame:
    """Selected features with whatever each table knows about them."""
    return (
        selected.join(consensus, "feature", "left")
        .join(stability, "feature", "left")
        .join(attribution, "feature", "left")
    )


def known_contrast(expr: DataFrame, samples: DataFrame, known: DataFrame, case, control, label: str = "label") -> DataFrame:
    """Case against control for known genes; genes without values are flagged."""
    from genemill.operators.stats import t_test

    res = t_test(expr.join(known.select(F.col("gene").alias("gene_id")), "gene_id", "left_semi"), samples, label, levels=(case, control))
    fold = F.when(F.col("mean2") > 0, F.col("mean1") / F.col("mean2")).otherwise(F.lit(float("inf")))
    return known.join(res.withColumnRenamed("gene_id", "gene"), "gene", "left").select(
        "gene", F.col("n1").isNull().alias("missing"), F.col("mean1").alias("case_mean"),
        F.col("mean2").alias("control_mean"), F.when(F.col("n1").isNotNull(), fold).alias("fold_change"),
        "statistic", "p_value",
    )


def queue_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("queue").agg(F.count(F.lit(1)).alias("n_tasks"))


def worker_retries(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("worker").agg(
        F.count_if(F.col("state") == "reserved").alias("reserved"), F.sum("retries").alias("retries")
    )


def new_deliveries(events: DataFrame, log: DataFrame) -> DataFrame:
    """Deliveries not yet sent with success; the key hashes the event name and its payload."""
    body = F.sha2(F.col("payload"), 256)
    keyed = events.withColumn("idempotency_key", F.sha2(F.concat_ws(":", "event", body), 256))
    sent = log.filter(F.col("status_code").between(200, 399)).select("subscription", "idempotency_key")
    return keyed.join(sent, ["subscription", "idempotency_key"], "left_anti")


def collection_summary(log: DataFrame) -> DataFrame:
    """Sources asked, ok and failed, totals of records and samples, time in all and per source."""
    return log.agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") != "ok").alias("failed"),
        F.sum("records").alias("records"),
        F.sum("samples").alias("samples"),
        F.sum("seconds").alias("total_seconds"),
        F.avg("seconds").alias("mean_seconds"),
    )


def source_names(log: DataFrame) -> DataFrame:
    """Names per status, as rows."""
    return log.select("status", "source").distinct()


# Size classes by number of samples, and the parameters of each class.
SIZE_CLASSES = (("tiny", 5), ("small", 20), ("medium", 100), ("large", 500))
PARAMETERS = {
    "tiny": (0.1, "none", 0.0, 1.0, 2, 0, 10),
    "small": (0.05, "fdr_bh", 0.01, 0.99, 3, 50, 50),
    "medium": (0.05, "fdr_bh", 0.1, 0.5, 5, 100, 200),
    "large": (0.05, "fdr_bh", 0.1, 0.3, 10, 100, 500),
    "very_large": (0.05, "fdr_bh", 0.1, 0.2, 10, 100, 1000),
}
PARAMETER_NAMES = (
    "alpha", "fdr_method", "min_detection_rate", "max_missing_ratio", "cv_folds", "n_bootstraps", "max_features",
)


def adaptive_parameters(expr: DataFrame) -> DataFrame:
    """Profile of the data, its size class, and the analysis parameters of that class.

    The fold, bootstrap and feature limits are upper bounds that shrink with the data.
    """
    prof = expr.agg(
        F.count_distinct("sample_id").alias("n_samples"), F.count_distinct("gene_id").alias("n_features")
    )
    n, m = F.col("n_samples"), F.col("n_features")
    size = None
    for name, edge in SIZE_CLASSES:
        size = F.when(n < edge, name) if size is None else size.when(n < edge, name)
    table = expr.sparkSession.createDataFrame(
        [(k, *v) for k, v in PARAMETERS.items()],
        "category string, alpha double, fdr_method string, min_detection_rate double,"
        " max_missing_ratio double, cv_folds int, n_bootstraps int, max_features int",
    )
    out = prof.withColumn("category", size.otherwise("very_large")).join(F.broadcast(table), "category")
    cat = F.col("category")
    folds = (
        F.when(cat == "small", F.least(F.lit(3), F.greatest(F.lit(2), F.floor(n / 2))))
        .when(cat == "medium", F.least(F.lit(5), F.greatest(F.lit(3), F.floor(n / 5))))
        .when(cat == "large", F.least(F.lit(10), F.greatest(F.lit(5), F.floor(n / 10))))
        .otherwise(F.col("cv_folds"))
    )
    boots = (
        F.when((cat == "small") & (n < 4), 0)
        .when(cat == "small", F.least(F.lit(50), F.greatest(F.lit(10), n * 5)))
        .when(cat == "medium", F.least(F.lit(100), F.greatest(F.lit(50), n * 2)))
        .otherwise(F.col("n_bootstraps"))
    )
    fdr = F.when((cat == "small") & (m <= 10), "none").otherwise(F.col("fdr_method"))
    return (
        out.withColumn("cv_folds", folds.cast("int"))
        .withColumn("n_bootstraps", boots.cast("int"))
        .withColumn("fdr_method", fdr)
        .withColumn("max_features", F.least(F.col("max_features").cast("long"), m).cast("int"))
        .withColumn("batch_correction", (cat != "tiny") & (n >= 6))
        .withColumn("quantile_normalization", ~cat.isin("tiny", "small"))
        .withColumn("wrapper_methods", (cat.isin("medium", "large")) | ((cat == "small") & (n >= 8)))
        .withColumn("recommended", F.when(cat.isin("tiny", "small"), "log2,z_score").otherwise("log2,quantile,z_score"))
    )
