"""Sinks of the analyses: written, read back, and held against the SQL of the analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from genemill.operators import batch as B
from genemill.operators import selection as S
from genemill.operators import stats
from genemill.plans import batch_queries, integration_queries, model_queries, result_queries, stats_queries  # noqa: F401
from genemill.plans.registry import ORACLE, query, rounded
from genemill.sources import writers as W
from genemill.streaming.monitor import scratch


def _csv(t, path, schema):
    return t.spark.read.schema(schema).csv(path, header=True)


def _tests(t, alpha=0.05):
    de = stats.differential_expression(t.expr(), t.samples(), "label", "t_test", alpha)
    return de.select("gene_id", "method", "p_value", "p_adj", "significant", "significant_adj")


@query("sink_statistics_json", f"SELECT * FROM ({ORACLE['stats_differential_expression']})")
def statistics_json(t):
    path, rows = scratch(t.spark, "statistics"), _tests(t)
    W.write_statistics(rows, path, "json")
    return rounded(t.spark.read.schema(rows.schema).json(f"{path}/tests"))


@query(
    "sink_statistics_csv",
    f"SELECT method, gene_id AS gene FROM ({ORACLE['stats_differential_expression']}) WHERE p_adj < 0.95",
)
def statistics_csv(t):
    path = scratch(t.spark, "statistics")
    W.write_statistics(_tests(t, 0.95), path, "csv")
    return _csv(t, path, "method string, gene string")


@query("sink_selection_csv", f"SELECT * FROM ({ORACLE['select_consensus']})")
def selection_csv(t):
    path = scratch(t.spark, "selection")
    chosen = model_queries._all(t)
    W.write_selection(chosen, rounded(S.consensus(chosen)), path, "csv")
    return _csv(t, path, "feature string, consensus_score double, selection_count bigint, methods string")


@query("sink_selection_json", f"SELECT * FROM ({ORACLE['select_filter_dispatcher']})")
def selection_json(t):
    path = scratch(t.spark, "selection")
    chosen = rounded(model_queries._all(t))
    W.write_selection(chosen, S.consensus(chosen), path, "json")
    return t.spark.read.schema(chosen.schema).json(f"{path}/selections")


@query(
    "sink_pathways_csv",
    f"SELECT gene_set, 'ora' AS method, p_adj AS q FROM ({ORACLE['pathway_over_representation_adjusted']}) WHERE p_adj < 0.9",
)
def pathways_csv(t):
    path = scratch(t.spark, "pathways")
    W.write_pathways(rounded(integration_queries._ora(t), 5), None, path, "csv", 0.9)
    return _csv(t, path, "gene_set string, method string, q double")


@query(
    "sink_annotation_csv",
    f"""SELECT n_genes, with_cancer_hit AS cancer_genes_count, with_clinical_hit AS clinical_genes_count, 'cosmic,clinvar' AS databases
    FROM ({ORACLE['agg_annotation_summary']})""",
)
def annotation_csv(t):
    path = scratch(t.spark, "annotation")
    W.write_annotation(result_queries._flags(t), ["cosmic", "clinvar"], path, "csv")
    return _csv(t, path, "n_genes bigint, cancer_genes_count bigint, clinical_genes_count bigint, databases string")


@query("sink_annotation_json", f"SELECT * FROM ({ORACLE['join_annotation_flags']})")
def annotation_json(t):
    path, flags = scratch(t.spark, "annotation"), result_queries._flags(t)
    W.write_annotation(flags, ["cosmic", "clinvar"], path, "json")
    return t.spark.read.schema(flags.schema).json(f"{path}/flags")


# ---- every name of the correction dispatcher -----------------------------------------------------------

_NAMED = {
    "combat": "batch_location_scale",
    "limma": "batch_linear_no_covariates",
    "linear_regression": "batch_linear_no_covariates",
    "mean_centering": "batch_mean_centering",
}


@query(
    "batch_dispatcher",
    " UNION ALL ".join(f"SELECT '{m}' AS method, * FROM ({ORACLE[q]})" for m, q in _NAMED.items()),
)
def dispatcher(t):
    """Each named correction of the same matrix; `pca` has its own query."""
    out = None
    for method in _NAMED:
        rows = B.correct(t.expr(), t.samples(), method).select(F.lit(method).alias("method"), "gene_id", "sample_id", "value")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out)
