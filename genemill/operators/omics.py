"""Several omics layers in one long table (layer, gene_id, sample_id, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genemill.operators import normalize as N
from genemill.operators.distributed import median_by, reuse


def _filter_layer(df: DataFrame, keep) -> DataFrame:
    """Features that pass a rule on their aggregates and hold no null."""
    g = df.groupBy("gene_id").agg(
        F.var_samp("value").alias("var"), F.max("value").alias("top"), F.count_if(F.col("value").isNull()).alias("nulls")
    )
    return df.join(g.filter(keep & (F.col("nulls") == 0)), "gene_id", "left_semi")


def filter_methylation(df: DataFrame, min_variance: float = 0.3) -> DataFrame:
    """Variance above the limit, then complete probes only."""
    return _filter_layer(df, F.col("var") > min_variance)


def filter_copy_number(df: DataFrame, min_variance: float = 0.3) -> DataFrame:
    return _filter_layer(df, F.col("var") > min_variance)


def filter_proteins(df: DataFrame, min_intensity: float = 1e5) -> DataFrame:
    """Proteins above an intensity, as log2(x + 1)."""
    out = _filter_layer(df, F.col("top") > min_intensity)
    return out.withColumn("value", F.log2(F.col("value") + 1))


def align_layers(layers: DataFrame, reference: str = "expression") -> DataFrame:
    """Every layer restricted to the samples of the reference layer."""
    ref = layers.filter(F.col("layer") == reference).select("sample_id").distinct()
    return layers.join(ref, "sample_id", "left_semi")


def normalize_layer(layers: DataFrame, method: str = "quantile") -> DataFrame:
    """Per layer: z-score, robust scale or quantiles within a sample, or log2(x + 1)."""
    keys = ("layer", "sample_id")
    if method == "zscore":
        return N.z_score(layers, keys, 0)
    if method == "robust":
        return N.robust_z_iqr(layers, keys)
    if method == "log2":
        return layers.withColumn("value", F.log2(F.col("value") + 1))
    if method == "quantile":
        from genemill.operators.distributed import ordinal_ranks

        present = layers.filter(F.col("value").isNotNull())
        r = ordinal_ranks(present, list(keys), "value", "gene_id", "_rank")
        q = r.groupBy("layer", "_rank").agg(F.avg("value").alias("_q"))
        return r.drop("value").join(q, ["layer", "_rank"]).select(
            "layer", "gene_id", "sample_id", F.col("_q").alias("value")
        )
    raise ValueError(f"unknown layer normalization {method}")


def layer_names(layers: DataFrame) -> list[str]:
    """All layers by name; layers are kinds of measurement, so the list is short whatever the rows are."""
    return sorted(r[0] for r in layers.select("layer").distinct().collect() if r[0] is not None)


def layer_correlations(layers: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of each pair of layers over their shared (feature, sample) cells."""
    names = list(names) if names else layer_names(layers)
    wide = layers.groupBy("gene_id", "sample_id").pivot("layer", names).agg(F.first("value"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    both = lambda a, b: F.count_if(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull())
    row = wide.agg(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(f"`{a}`", f"`{b}`").alias("r"), both(a, b).alias("n")
                )
                for a, b in pairs
            ]
        ).alias("p")
    )
    return row.select(F.explode("p").alias("p")).select(
        F.col("p.a").alias("layer_1"), F.col("p.b").alias("layer_2"),
        F.col("p.r").alias("correlation"), F.col("p.n").alias("n_cells"),
    )


def prefix_features(layers: DataFrame) -> DataFrame:
    return layers.select(
        F.concat_ws("_", "layer", "gene_id").alias("gene_id"), "sample_id", "value"
    )


def concat_layers(layers: DataFrame) -> DataFrame:
    """All features of all layers under one another."""
    return prefix_features(layers)


def factor_integration(layers: DataFrame) -> DataFrame:
    """Standardise within (layer, sample), prefix the feature names, stack."""
    return prefix_features(N.z_score(layers, ("layer", "sample_id"), 0))


def pca_integration(layers: DataFrame, k: int = 50) -> DataFrame:
    """Components of each layer as features of the integrated table."""
    from genemill.operators.pca import pca

    names = layer_names(layers)
    out = None
    for name in names:
        s = pca(layers.filter(F.col("layer") == name), k).scores.select(
            F.concat(F.lit(f"{name}_PC"), F.col("component").cast("string")).alias("gene_id"),
            "sample_id",
            F.col("score").alias("value"),
        )
        out = s if out is None else out.unionByName(s)
    return out


def fill_missing(expr: DataFrame) -> DataFrame:
    """Null cells take the median of their sample, else 0."""
    expr = reuse(expr)
    med = median_by(expr, ["sample_id"], "value", "_med")
    j = expr.join(med, "sample_id", "left")
    return j.withColumn("value", F.coalesce("value", "_med", F.lit(0.0))).select(*expr.columns)


def top_variance(expr: DataFrame, k: int) -> DataFrame:
    """The k features of highest variance, with all their cells."""
    best = expr.groupBy("gene_id").agg(F.var_samp("value").alias("v")).orderBy(F.col("v").desc_nulls_last(), "gene_id")
    return expr.join(best.limit(k), "gene_id", "left_semi")


def integrate(layers: DataFrame, method: str = "concatenation", n_features: int = 1000) -> DataFrame:
    how = {"concatenation": concat_layers, "pca": pca_integration, "mofa": factor_integration}
    if method not in how:
        raise ValueError(f"unknown integration {method}; use one of {sorted(how)}")
    return top_variance(how[method](layers), n_features)


def integration_summary(layers: DataFrame) -> DataFrame:
    return layers.groupBy("layer").agg(
        F.count_distinct("gene_id").alias("n_features"),
        F.count_distinct("sample_id").alias("n_samples"),
        F.count(F.lit(1)).alias("n_cells"),
    )
