"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from genemill.operators.distributed import release  # noqa: E402
from genemill.plans import load_queries  # noqa: E402
from genemill.session import local_session  # noqa: E402

HEADLINE = (
    "flagship_welch_ranking",
    "qc_sample_metrics",
    "qc_gene_metrics",
    "filter_qc_samples_and_genes",
    "norm_log_cpm",
    "norm_quantile",
    "norm_robust_z_iqr",
    "norm_tmm",
    "transform_yeo_johnson",
    "stats_t_test",
    "stats_mann_whitney",
    "stats_anova",
    "stats_kruskal",
    "padjust_fdr_bh",
    "batch_location_scale",
    "batch_linear_with_covariate",
    "pca_variance",
    "survival_kaplan_meier",
    "survival_logrank_two_groups",
    "select_filter_mutual_info",
    "eval_auc_average_precision",
    "pathway_over_representation",
    "network_smooth_only",
    "join_annotation_flags",
    "join_text_co_mentions",
    "agg_federated_average",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    spark = local_session(cores=cores, shuffle_partitions=cores)
    queries, _ = load_queries()
    # start-up (JVM warm-up, Python workers) is not part of any query
    queries["flagship_welch_ranking"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        release()  # nothing kept for the next query
        spark.catalog.clearCache()
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
