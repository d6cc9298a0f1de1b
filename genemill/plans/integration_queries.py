"""Pathways, networks, omics layers, federated averages."""

from __future__ import annotations

from pyspark.sql import functions as F

from genemill.operators import federated as FD
from genemill.operators import network as NW
from genemill.operators import omics as O
from genemill.operators import pathways as PW
from genemill.plans.registry import query, rounded
from genemill.plans.standins import with_views

# ---- pathways ----------------------------------------------------------------------------------

_SCORES = """d AS (SELECT gene_id AS gene, value, label FROM expr JOIN samples USING (sample_id)),
    sc AS (SELECT gene, round(avg(value) FILTER (label = 1) - avg(value) FILTER (label = 0), 6) AS score FROM d GROUP BY 1)"""


def _scores(t):
    d = t.expr().join(t.samples(), "sample_id")
    mean = lambda v: F.avg(F.when(F.col("label") == v, F.col("value")))
    return d.groupBy(F.col("gene_id").alias("gene")).agg(F.round(mean(1) - mean(0), 6).alias("score"))


_ORA = f"""{_SCORES}, mine AS (SELECT gene FROM sc WHERE score > 2), u AS (SELECT count(*) AS n_all FROM sc),
    q AS (SELECT count(*) AS n_mine FROM mine),
    st AS (SELECT gene_set, count(*) AS m, count(mine.gene) AS k, string_agg(mine.gene, ';' ORDER BY mine.gene) AS genes
        FROM (SELECT * FROM gene_sets WHERE gene IN (SELECT gene FROM sc)) g LEFT JOIN mine ON mine.gene = g.gene GROUP BY 1 HAVING count(mine.gene) > 0),
    pv AS (SELECT *, least(1.0::DOUBLE, list_sum(list_transform(range(k, least(m, n_mine) + 1), lambda j: exp(
        lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) + lgamma(n_all - m + 1) - lgamma(n_mine - j + 1) - lgamma(n_all - m - n_mine + j + 1)
        - lgamma(n_all + 1) + lgamma(n_mine + 1) + lgamma(n_all - n_mine + 1))))) AS p_value,
        CASE WHEN (m - k) * (n_mine - k) > 0 THEN k * (n_all - m - n_mine + k) / ((m - k) * (n_mine - k))::DOUBLE ELSE 'Infinity'::DOUBLE END AS odds FROM st, u, q),
    adj AS (SELECT *, min(p_value * c / rk) OVER (ORDER BY p_value DESC) AS p_adj FROM (SELECT *, count(*) OVER () AS c,
        rank() OVER (ORDER BY p_value) + count(*) OVER (PARTITION BY p_value) - 1 AS rk FROM (SELECT * REPLACE (round(p_value, 12) AS p_value) FROM pv)))"""


def _ora(t):
    s = _scores(t)
    return PW.over_representation(s.filter("score > 2").select("gene"), t.gene_sets(), s.select("gene"))


@query(
    "pathway_over_representation",
    with_views(
        "expr samples gene_sets",
        f"""WITH {_ORA} SELECT gene_set, m AS set_size, k AS overlap, genes, round(p_value, 6) AS p_value, round(odds, 6) AS odds_ratio,
        round(-ln(p_value) * odds, 5) AS combined_score FROM adj""",
    ),
)
def ora(t):
    return rounded(_ora(t).drop("p_adj"), 6, combined_score=5)


@query(
    "pathway_over_representation_adjusted",
    with_views("expr samples gene_sets", f"WITH {_ORA} SELECT gene_set, round(least(1, p_adj), 5) AS p_adj FROM adj"),
)
def ora_adj(t):
    return rounded(_ora(t).select("gene_set", "p_adj"), 5)


_ES = f"""{_SCORES}, rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, gene) AS pos, count(*) OVER () AS n FROM sc),
    h AS (SELECT gene_set, gene, pos, n, abs(score) AS a FROM gene_sets JOIN rk USING (gene)),
    z AS (SELECT *, count(*) OVER (PARTITION BY gene_set) AS k FROM h QUALIFY count(*) OVER (PARTITION BY gene_set) BETWEEN 5 AND 500),
    r AS (SELECT *, sum(a) OVER w / sum(a) OVER (PARTITION BY gene_set) - (pos - row_number() OVER w) / (n - k)::DOUBLE AS after,
        (sum(a) OVER w - a) / sum(a) OVER (PARTITION BY gene_set) - (pos - row_number() OVER w) / (n - k)::DOUBLE AS before FROM z
        WINDOW w AS (PARTITION BY gene_set ORDER BY pos)),
    e AS (SELECT gene_set, max(k) AS set_size, CASE WHEN max(after) >= -min(before) THEN max(after) ELSE min(before) END AS es,
        CASE WHEN max(after) >= -min(before) THEN arg_max(pos, after) ELSE arg_min(pos, before) END AS peak FROM r GROUP BY 1)"""


@query(
    "pathway_enrichment_score",
    with_views(
        "expr samples gene_sets",
        f"""WITH {_ES} SELECT gene_set, set_size, round(es, 6) AS es, peak, string_agg(gene, ';' ORDER BY gene) AS leading_edge
        FROM e JOIN h USING (gene_set) WHERE (es >= 0 AND pos <= peak) OR (es < 0 AND pos >= peak) GROUP BY ALL""",
    ),
)
def es(t):
    return rounded(PW.enrichment_scores(_scores(t), t.gene_sets(), 5, 500)).withColumn("peak", F.col("peak").cast("long"))


@query("pathway_gsea")
def gsea(t):
    return rounded(PW.gsea(_scores(t), t.gene_sets(), 5, 500))


@query(
    "pathway_de_ranking",
    with_views(
        "expr samples",
        """SELECT gene_id AS gene, round(log2(avg(value) FILTER (label = 1) + 1e-9) - log2(avg(value) FILTER (label = 0) + 1e-9), 6) AS log2fc
        FROM expr JOIN samples USING (sample_id) GROUP BY 1""",
    ),
)
def de_ranking(t):
    from genemill.operators.stats import welch_test

    r = welch_test(t.expr(), t.samples(), "label", levels=(0, 1))
    return rounded(r.orderBy("p_value").select(F.col("gene_id").alias("gene"), "log2fc"))


@query(
    "pathway_summary",
    with_views(
        "expr samples gene_sets",
        f"""WITH {_ORA} SELECT CASE WHEN gene_set LIKE 'Brand%' THEN 'brand' ELSE 'type' END AS library, count(*) AS n_pathways,
        count(*) FILTER (p_adj < 0.5) AS n_significant FROM adj GROUP BY 1""",
    ),
)
def summary(t):
    rows = _ora(t).withColumn("lib", F.when(F.col("gene_set").startswith("Brand"), "brand").otherwise("type"))
    return PW.pathway_summary(rows, "lib", "p_adj", 0.5)


@query("topk_significant_pathways")
def significant(t):
    g = PW.gsea(_scores(t), t.gene_sets(), 5, 500)
    return rounded(PW.significant_pathways(g, _ora(t), 0.9))


@query("pathway_run_both")
def both(t):
    s = _scores(t)
    return rounded(PW.pathway_run(s.filter("score > 2").select("gene"), s, t.gene_sets(), "both", min_size=5))


@query(
    "join_gene_set_membership",
    with_views("gene_sets", "SELECT gene_set, count(*) AS n FROM gene_sets WHERE gene LIKE '%_PROMO' GROUP BY 1"),
)
def membership(t):
    mine = t.gene_sets().filter(F.col("gene").endswith("_PROMO")).select("gene").distinct()
    return t.gene_sets().join(mine, "gene").groupBy("gene_set").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pathway_library_names",
    """SELECT n_nationkey, CASE n_nationkey % 8 WHEN 0 THEN 'KEGG_2021_Human' WHEN 1 THEN 'Reactome_2022' WHEN 2 THEN 'GO_Biological_Process_2021'
    WHEN 3 THEN 'GO_Molecular_Function_2021' WHEN 4 THEN 'GO_Cellular_Component_2021' WHEN 5 THEN 'MSigDB_Hallmark_2020' WHEN 6 THEN 'MSigDB_Curated_2020'
    ELSE n_name END AS library FROM nation""",
)
def libraries(t):
    from genemill.functions.columns import lookup

    names = F.array(*map(F.lit, ("KEGG", "REACTOME", "GO_BP", "GO_MF", "GO_CC", "HALLMARK", "CURATED")))
    d = t.nation.select("n_nationkey", F.coalesce(F.get(names, (F.col("n_nationkey") % 8).cast("int")), "n_name").alias("a"))
    return d.select("n_nationkey", F.coalesce(lookup("a", PW.LIBRARIES, None), "a").alias("library"))


# ---- networks ----------------------------------------------------------------------------------

_ADJ = """g AS (SELECT DISTINCT gene_id AS gene FROM expr),
    und AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight FROM edges WHERE src IN (SELECT gene FROM g) AND dst IN (SELECT gene FROM g) GROUP BY 1, 2),
    adj AS (SELECT src, dst, weight FROM und UNION ALL SELECT dst, src, weight FROM und UNION ALL SELECT gene, gene, 1.0::DOUBLE FROM g),
    deg AS (SELECT src, sum(weight) + 1e-8 AS d FROM adj GROUP BY 1),
    nrm AS (SELECT a.src, a.dst, weight / sqrt(x.d * y.d) AS weight FROM adj a JOIN deg x ON a.src = x.src JOIN deg y ON a.dst = y.src)"""


_RESTRICTED = _ADJ.replace("FROM expr)", "FROM expr WHERE gene_id LIKE '%O%')")  # restriction to a list of genes


def _net_genes(t):
    return t.expr().select(F.col("gene_id").alias("gene")).distinct()


def _adj(t):
    return NW.adjacency(t.edges(), _net_genes(t))


@query(
    "network_undirected_edges",
    with_views(
        "edges",
        "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight FROM edges WHERE weight >= 0.2 GROUP BY 1, 2",
    ),
)
def undirected(t):
    return NW.undirected(t.edges(), 0.2)


@query("join_edge_restriction", with_views("edges expr", f"WITH {_RESTRICTED} SELECT src, dst, weight FROM adj"))
def adjacency(t):
    return NW.adjacency(t.edges(), _net_genes(t).where(F.col("gene").contains("O")))


@query(
    "network_normalized_adjacency",
    with_views("edges expr", f"WITH {_ADJ} SELECT src, dst, round(weight, 8) AS weight FROM nrm"),
)
def normalized(t):
    return rounded(NW.normalized_adjacency(_adj(t)), 8)


_SMOOTH = """SELECT src || '{s}' AS gene_id, sample_id, round(sum(weight * value), 6) AS value FROM nrm JOIN expr ON dst = gene_id GROUP BY 1, 2"""


@query("network_smooth_only", with_views("edges expr", f"WITH {_ADJ} {_SMOOTH.format(s='_sm')}"))
def smooth(t):
    return rounded(NW.smooth_expression(t.expr(), NW.normalized_adjacency(_adj(t)), "smooth_only"))


@query(
    "network_smooth_concat",
    with_views(
        "edges expr",
        f"WITH {_ADJ} SELECT gene_id, sample_id, value FROM expr UNION ALL {_SMOOTH.format(s='_nbr')}",
    ),
)
def smooth_concat(t):
    return rounded(NW.smooth_expression(t.expr(), NW.normalized_adjacency(_adj(t)), "concat"))


@query(
    "network_nodes",
    with_views(
        "edges",
        """WITH n AS (SELECT src AS gene FROM edges WHERE weight >= 0.5 UNION SELECT dst FROM edges WHERE weight >= 0.5),
        s AS (SELECT DISTINCT p_brand || '_PROMO' AS gene FROM part)
        SELECT gene, s.gene IS NOT NULL AS is_seed FROM n FULL JOIN s USING (gene)""",
    ),
)
def nodes(t):
    seeds = t.part.select(F.concat("p_brand", F.lit("_PROMO")).alias("gene"))
    return NW.nodes(t.edges().filter("weight >= 0.5"), seeds)


# ---- omics layers --------------------------------------------------------------------------------


def _layer_filter_sql(layer, rule, value="value"):
    return with_views(
        "omics",
        f"""WITH l AS (SELECT * FROM omics WHERE layer = '{layer}') SELECT gene_id, sample_id, round({value}, 6) AS value FROM l
        WHERE gene_id IN (SELECT gene_id FROM l GROUP BY 1 HAVING {rule} AND count(*) = count(value))""",
    )


def _layer(t, name):
    return t.omics().filter(F.col("layer") == name).select("gene_id", "sample_id", "value")


@query("scan_methylation_filter", _layer_filter_sql("methylation", "var_samp(value) > 0.025"))
def methylation(t):
    return rounded(O.filter_methylation(_layer(t, "methylation"), 0.025))


@query("scan_copy_number_filter", _layer_filter_sql("expression", "var_samp(value) > 2400"))
def copy_number(t):
    return rounded(O.filter_copy_number(_layer(t, "expression"), 2400))


@query("scan_protein_filter", _layer_filter_sql("protein", "max(value) > 80000", "log2(value + 1)"))
def proteins(t):
    return rounded(O.filter_proteins(_layer(t, "protein"), 80000))


def _some_layers(t):
    """Layers with different sample sets."""
    s = t.samples().filter("age >= 2000").select("sample_id")
    om = t.omics()
    return om.filter("layer = 'expression'").join(s, "sample_id", "left_semi").unionByName(om.filter("layer <> 'expression'"))


_SOME = """sub AS (SELECT * FROM omics WHERE layer <> 'expression' OR sample_id IN (SELECT sample_id FROM samples WHERE age >= 2000))"""


@query(
    "join_layer_alignment",
    with_views(
        "omics samples",
        f"""WITH {_SOME} SELECT layer, gene_id, sample_id, round(value, 6) AS value FROM sub WHERE sample_id IN (SELECT sample_id FROM sub WHERE layer = 'expression')""",
    ),
)
def align(t):
    return rounded(O.align_layers(_some_layers(t)))


@query(
    "join_layer_correlation",
    with_views(
        "omics",
        """SELECT a.layer AS layer_1, b.layer AS layer_2, round(corr(a.value, b.value), 6) AS correlation, count(*) AS n_cells
        FROM omics a JOIN omics b USING (gene_id, sample_id) WHERE a.layer < b.layer GROUP BY 1, 2""",
    ),
)
def layer_corr(t):
    return rounded(O.layer_correlations(t.omics()))


@query(
    "omics_normalize_zscore",
    with_views(
        "omics",
        """WITH s AS (SELECT layer, sample_id, avg(value) AS m, stddev_pop(value) AS s FROM omics GROUP BY 1, 2)
        SELECT layer, gene_id, sample_id, round((value - m) / s, 5) AS value FROM omics JOIN s USING (layer, sample_id)""",
    ),
)
def layer_z(t):
    return rounded(O.normalize_layer(t.omics(), "zscore"), 5)


@query(
    "omics_normalize_quantile",
    with_views(
        "omics",
        """WITH o AS (SELECT layer, gene_id, sample_id, round(value, 6) AS value FROM omics),
        r AS (SELECT *, row_number() OVER (PARTITION BY layer, sample_id ORDER BY value, gene_id) AS rk FROM o),
        q AS (SELECT layer, rk, avg(value) AS q FROM r GROUP BY 1, 2)
        SELECT layer, gene_id, sample_id, round(q, 5) AS value FROM r JOIN q USING (layer, rk)""",
    ),
)
def layer_quantile(t):
    return rounded(O.normalize_layer(rounded(t.omics()), "quantile"), 5)


@query(
    "set_layer_concat",
    with_views("omics", "SELECT layer || '_' || gene_id AS gene_id, sample_id, round(value, 6) AS value FROM omics"),
)
def concat(t):
    return rounded(O.concat_layers(t.omics()))


@query(
    "omics_factor_integration",
    with_views(
        "omics",
        """WITH s AS (SELECT layer, sample_id, avg(value) AS m, stddev_pop(value) AS s FROM omics GROUP BY 1, 2)
        SELECT layer || '_' || gene_id AS gene_id, sample_id, round((value - m) / s, 5) AS value FROM omics JOIN s USING (layer, sample_id)""",
    ),
)
def factor(t):
    return rounded(O.factor_integration(t.omics()), 5)


@query("omics_pca_integration")
def pca_integration(t):
    return rounded(O.pca_integration(t.omics(), 5), 5)


@query(
    "omics_integrate_top_variance",
    with_views(
        "omics",
        """WITH c AS (SELECT layer || '_' || gene_id AS gene_id, sample_id, value FROM omics),
        v AS (SELECT gene_id FROM c GROUP BY 1 ORDER BY var_samp(value) DESC, gene_id LIMIT 120)
        SELECT gene_id, sample_id, round(value, 6) AS value FROM c WHERE gene_id IN (SELECT gene_id FROM v)""",
    ),
)
def integrate(t):
    return rounded(O.integrate(t.omics(), "concatenation", 120))


@query(
    "topk_by_variance_with_fill",
    with_views(
        "expr_nulls",
        """WITH m AS (SELECT sample_id, quantile_cont(value, 0.5) AS m FROM expr_nulls GROUP BY 1),
        f AS (SELECT gene_id, sample_id, coalesce(value, m, 0) AS value FROM expr_nulls LEFT JOIN m USING (sample_id)),
        v AS (SELECT gene_id FROM f GROUP BY 1 ORDER BY var_samp(value) DESC, gene_id LIMIT 40)
        SELECT * FROM f WHERE gene_id IN (SELECT gene_id FROM v)""",
    ),
)
def top_variance(t):
    return O.top_variance(O.fill_missing(t.expr_nulls()), 40)


@query(
    "omics_integration_summary",
    with_views(
        "omics samples",
        f"""WITH {_SOME} SELECT layer, count(DISTINCT gene_id) AS n_features, count(DISTINCT sample_id) AS n_samples, count(*) AS n_cells FROM sub GROUP BY 1""",
    ),
)
def omics_summary(t):
    return O.integration_summary(_some_layers(t))


# ---- federated averages --------------------------------------------------------------------------

_UPD = """upd AS (SELECT o_custkey % 3 AS round_id, o_custkey % 8 AS participant, o_orderpriority AS layer, o_orderkey AS uid,
    [o_totalprice / 100000, month(o_orderdate) / 12.0::DOUBLE, day(o_orderdate) / 31.0::DOUBLE] AS weights, o_custkey % 50 + 1 AS n,
    month(o_orderdate) / 12.0::DOUBLE AS loss, day(o_orderdate) / 31.0::DOUBLE AS accuracy, o_orderstatus = 'P' AS aggregated, o_orderdate AS created_at FROM orders),
    lw AS (SELECT *, unnest(weights) AS w, CAST(generate_subscripts(weights, 1) - 1 AS INT) AS pos FROM upd)"""


def _updates(t):
    d, k = F.col("o_orderdate"), F.col("o_custkey")
    return t.orders.select(
        (k % 3).alias("round_id"), (k % 8).alias("participant"), F.col("o_orderpriority").alias("layer"),
        F.array(F.col("o_totalprice") / 100000, F.month(d) / 12, F.dayofmonth(d) / 31).alias("weights"), (k % 50 + 1).alias("n"),
        (F.month(d) / 12).alias("loss"), (F.dayofmonth(d) / 31).alias("accuracy"),
        (F.col("o_orderstatus") == "P").alias("aggregated"), d.alias("created_at"),
    )


@query(
    "agg_federated_average",
    f"WITH {_UPD} SELECT layer, pos, round(sum(n * w) / sum(n), 6) AS weight FROM lw GROUP BY 1, 2",
)
def fedavg(t):
    return rounded(FD.weighted_average(_updates(t)))


@query(
    "agg_federated_average_arrays",
    f"""WITH {_UPD}, a AS (SELECT layer, pos, sum(n * w) / sum(n) AS weight FROM lw GROUP BY 1, 2)
    SELECT layer, string_agg(CAST(CAST(round(weight, 4) AS DECIMAL(12, 4)) AS VARCHAR), ',' ORDER BY pos) AS weights FROM a GROUP BY 1""",
)
def fedavg_arrays(t):
    a = FD.as_arrays(FD.weighted_average(_updates(t)))
    text = F.transform("weights", lambda x: F.round(x, 4).cast("decimal(12,4)").cast("string"))
    return a.select("layer", F.concat_ws(",", text).alias("weights"))


@query(
    "agg_masked_average",
    f"WITH {_UPD} SELECT layer, pos, round(sum(w) / sum(n), 8) AS weight FROM lw GROUP BY 1, 2",
)
def masked(t):
    return rounded(FD.masked_average(_updates(t)), 8)


@query(
    "agg_ring_mask_zero_sum",
    f"WITH {_UPD} SELECT DISTINCT layer, pos, true AS zero_sum FROM lw",
)
def ring(t):
    u = _updates(t).select("participant", "layer", F.posexplode("weights").alias("pos", "w"))
    one = u.groupBy("participant", "layer", "pos").agg(F.avg("w").alias("w"))
    return FD.mask_sums(FD.add_ring_masks(one, 8))


@query("agg_privacy_noise")
def noise(t):
    return rounded(FD.add_noise(FD.weighted_average(_updates(t)), 1.0, 1e-5))


@query(
    "agg_federated_round_metrics",
    f"""WITH {_UPD} SELECT round_id, count(*) AS participants, round(avg(loss), 6) AS mean_loss, round(stddev_pop(loss), 6) AS std_loss, round(avg(accuracy), 6) AS mean_accuracy,
    round(stddev_pop(accuracy), 6) AS std_accuracy, CAST(sum(n) AS BIGINT) AS total_samples, min(n) AS min_samples, max(n) AS max_samples FROM upd GROUP BY 1""",
)
def round_metrics(t):
    return rounded(FD.round_metrics(_updates(t)))


@query(
    "agg_federated_round",
    f"WITH {_UPD} SELECT layer, pos, round(sum(n * w) / sum(n), 6) AS weight FROM lw WHERE round_id = 1 AND NOT aggregated GROUP BY 1, 2",
)
def federated_round(t):
    return rounded(FD.aggregate_round(_updates(t), 1, 2))


@query(
    "agg_federated_status",
    f"""WITH {_UPD} SELECT count(*) AS participants, count(*) FILTER (c_acctbal > 0) AS active,
    (SELECT count(*) FILTER (created_at >= TIMESTAMP '2000-06-01') FROM upd) AS recent_updates FROM customer""",
)
def federated_status(t):
    p = t.customer.select((F.col("c_acctbal") > 0).alias("active"))
    return FD.status(p, _updates(t), "2000-06-01 00:00:00")


@query(
    "topk_last_rounds",
    "SELECT o_orderkey AS round_id, o_orderdate AS created_at FROM orders ORDER BY 2 DESC, 1 DESC LIMIT 10",
)
def last_rounds(t):
    return FD.last_rounds(t.orders.select(F.col("o_orderkey").alias("round_id"), F.col("o_orderdate").alias("created_at")))


_LIN = """x AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, 0.25 + 2 * (o_totalprice / 500000) - 2.5 * (month(o_orderdate) / 12.0::DOUBLE) AS z FROM orders),
    pr AS (SELECT id, y, CASE WHEN round(z, 9) >= 0 THEN 1 ELSE 0 END AS yhat, 1 / (1 + exp(-z)) AS score FROM x)"""


def _linear(t):
    f = t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
        F.array(F.col("o_totalprice") / 500000, F.month("o_orderdate") / 12).alias("x"),
    )
    w = t.spark.createDataFrame([(0, 0.25), (1, 2.0), (2, -2.5)], "pos int, weight double")
    return FD.score_linear(f, w)


@query(
    "eval_global_model",
    f"""WITH {_LIN} SELECT count(*) AS n, round(avg(CASE WHEN y = yhat THEN 1.0 ELSE 0 END), 6) AS accuracy FROM pr""",
)
def global_model(t):
    from genemill.operators.evaluate import classification_metrics

    p = _linear(t).withColumn("model", F.lit("global"))
    return rounded(classification_metrics(p).select("n", "accuracy"))


@query("eval_global_model_scores", f"WITH {_LIN} SELECT id, y, round(score, 6) AS score FROM pr")
def global_scores(t):
    return rounded(_linear(t).drop("yhat"))
